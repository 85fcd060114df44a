"""Result grids (J1, J2) over the experiment-results table."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASELINE_METHODS = ("MCD", "TS")


def grid_label(method="method", reduction="reduction", dim="dimensionality"):
    return F.concat(F.col(method), F.lit(" - "), F.col(reduction), F.lit(" ("),
                    F.col(dim).cast("string"), F.lit(")"))


def correlation_grid(results: DataFrame, value_col: str, labels: Sequence[str] | None = None,
                     layer_col: str = "layer") -> DataFrame:
    """Drop baseline methods, label = 'method - reduction (dim)', pivot layer x label.

    A duplicate (layer, label) cell raises. ``labels`` is the known pivot domain
    (columns, in this order), which saves the pass that finds it; a label outside it raises.
    """
    r = results.filter(~F.col("method").isin(*BASELINE_METHODS)).withColumn("label", grid_label())
    cells = r.groupBy(layer_col, "label").agg(F.count("*").alias("_n"), F.first(value_col).alias("_v"))
    fault = F.when(F.col("_n") > 1, F.lit("duplicate (layer, label) cell: "))
    if labels is not None:
        fault = fault.when(~F.col("label").isin(*labels), F.lit("label outside the given ones: "))
    fault = F.concat(fault, F.coalesce("label", F.lit("null")))
    # the layer itself carries the check, so no column choice can skip it
    cells = cells.withColumn(layer_col, F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.col(layer_col)))
    return cells.groupBy(layer_col).pivot("label", None if labels is None else list(labels)).agg(F.first("_v"))


def baseline_means(results: DataFrame, value_cols: Sequence[str]) -> DataFrame:
    """Mean correlation of the MCD and TS rows."""
    return (results.filter(F.col("method").isin(*BASELINE_METHODS))
                   .groupBy("method").agg(*[F.avg(c).alias(f"mean_{c}") for c in value_cols]))
