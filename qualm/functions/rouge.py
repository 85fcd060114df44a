"""ROUGE-L F-measure per pair.

Tokenizing is native (lower case, non [a-z0-9] -> space, split). The LCS
length runs in an Arrow-batched pandas UDF, one token of the prediction at a time,
bit-parallel over the reference tokens; with stemming, tokens of over three
letters are stemmed in the same pass.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .stem import stem


def rouge_tokens(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def lcs_length(a, b) -> int:
    """Longest common subsequence length, bit-parallel (Crochemore et al. 2001):
    one big-integer add/or per token of ``a``, each word of the bit vector
    covering 64 tokens of ``b``."""
    m = len(b)
    if len(a) == 0 or m == 0:
        return 0
    masks = {}
    for j, t in enumerate(b):
        masks[t] = masks.get(t, 0) | (1 << j)
    full = (1 << m) - 1
    v = full
    for t in a:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return m - bin(v).count("1")


def _stems(tokens) -> list[str]:
    return [stem(t) if len(t) > 3 else t for t in tokens]


@F.pandas_udf(LongType())
def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x if x is not None else [], y if y is not None else [])
                      for x, y in zip(a, b)], dtype="int64")


@F.pandas_udf(LongType())
def stemmed_lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(_stems(x) if x is not None else [], _stems(y) if y is not None else [])
                      for x, y in zip(a, b)], dtype="int64")


def rouge_l(df: DataFrame, pred: str, ref: str, out: str = "rougeL", use_stemmer: bool = False) -> DataFrame:
    """ROUGE-L F = 2PR/(P+R) with P = lcs/|pred|, R = lcs/|ref|; 0 if a side is empty."""
    d = df.withColumn("_tp", rouge_tokens(pred)).withColumn("_tr", rouge_tokens(ref))
    d = d.withColumn("_lcs", (stemmed_lcs_udf if use_stemmer else lcs_udf)("_tp", "_tr"))
    np_, nr = F.size("_tp"), F.size("_tr")
    p = F.col("_lcs") / np_
    r = F.col("_lcs") / nr
    f = F.when((np_ == 0) | (nr == 0) | (F.col("_lcs") == 0), F.lit(0.0)).otherwise(2 * p * r / (p + r))
    return d.withColumn(out, f).drop("_tp", "_tr", "_lcs")
