"""Helpers that the operators of this subpackage share."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.materialize import materialize as cut  # noqa: F401  (written table in the shared folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def whole_row(df: DataFrame) -> Column:
    """The row as one struct, so that no name of an operator can clash with a column."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpack(df: DataFrame, columns: list[str], row: str = "q_row") -> DataFrame:
    """Columns of ``row``, in the given order."""
    return df.select(*[F.col(row).getField(c).alias(c) for c in columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
