"""Answer tables: evaluation-set assembly (B8), the carried columns (B10, B11),
and the train-text choice (B13)."""
from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_eval_set(sources: Mapping[str, tuple[DataFrame, Mapping[str, str]]],
                   split_col: str = "split") -> DataFrame:
    """Project + rename each source to the common names, tag it, stack by name.

    ``sources`` maps a split tag to (frame, {source column: common name}).
    """
    parts = []
    for tag, (df, renames) in sources.items():
        parts.append(df.select(*[F.col(s).alias(t) for s, t in renames.items()])
                       .withColumn(split_col, F.lit(tag)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def carry_columns(df: DataFrame, id_col: str, text_col: str, test: bool,
                  quality_cols: Sequence[str] = ("meteor_evals", "bertscore_f1", "perplexities",
                                                 "TS09_uq_values", "mcd_uq_value"),
                  paragraph_col: str | None = None) -> DataFrame:
    """Columns kept next to an embedding, keyed by id; quality columns only for test sets."""
    cols = [id_col, text_col] + (list(quality_cols) if test else [])
    if paragraph_col:
        cols.append(paragraph_col)
    return df.select(*cols)


def baseline_tables(df: DataFrame, split_col: str = "split",
                    cols: Sequence[str] = ("meteor_evals", "bertscore_f1", "perplexities",
                                           "TS09_uq_values", "mcd_uq_value")) -> dict[str, DataFrame]:
    """Per split, the quality and baseline-uncertainty columns (views by filter)."""
    base = df.select(split_col, *cols)
    return {s: base.filter(F.col(split_col) == s) for s in ("test", "d01", "d02")}


def train_text(df: DataFrame, mode: str = "model_answers", question_col: str = "train_questions",
               model_col: str = "train_model_answers", best_col: str = "train_best_answers") -> DataFrame:
    """The search embeds model answers; the notebook embeds best answers with the question."""
    if mode == "model_answers":
        return df.withColumn("train_text", F.coalesce(F.col(model_col), F.lit("")))
    return df.withColumn("train_text", F.concat(F.coalesce(F.col(question_col), F.lit("")), F.lit(" "),
                                                F.coalesce(F.col(best_col), F.lit(""))))
