"""Embedding tables (D1): one vector per text.

The reference embeds with a language model; here the model is a user
function applied in Arrow batches (``mapInPandas``). The built-in default is a
hashed bag of words computed natively (tokens -> md5 bucket -> counts -> L2
norm), so pipelines run and can be checked without a model.
"""
from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rouge import rouge_tokens


def hashed_bow(df: DataFrame, text_col: str, dim: int = 64, out: str = "v") -> DataFrame:
    """Default embedder over the whole text: bucket = first 8 hex digits of
    md5(token) mod dim; counts per bucket, L2-normalized. Texts without tokens
    get the zero vector."""
    each = lambda value, fn: F.transform(F.array(value), fn)[0]  # noqa: E731  (the value is computed once a row)
    buckets = F.transform(rouge_tokens(text_col), lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % dim))
    counts = each(buckets, lambda b: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                                                 lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double")))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    unit = each(counts, lambda c: each(norm(c), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0))))
    return df.withColumn(out, unit)


def embed_column(df: DataFrame, text_col: str, fn: Callable[[list[str]], np.ndarray] | None = None,
                 dim: int = 64, id_col: str = "row_id", out: str = "v", batch_rows: int = 256) -> DataFrame:
    """``fn`` maps a list of texts to an (n, dim) array (a user model, run
    once per Arrow batch inside the executors); without it, ``hashed_bow``."""
    if fn is None:
        return hashed_bow(df, text_col, dim, out)
    schema = f"{id_col} bigint, {out} array<double>"

    def run(it):
        for pdf in it:
            for s in range(0, len(pdf), batch_rows):
                part = pdf.iloc[s:s + batch_rows]
                vecs = np.asarray(fn(part[text_col].fillna("").tolist()), dtype=np.float64)
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), out: list(vecs)})
    vecs = df.select(id_col, text_col).mapInPandas(run, schema)
    return df.join(vecs, id_col)
