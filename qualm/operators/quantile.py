"""Exact quantiles by histogram refinement (H2, D10, I19): many quantiles, groups and row subsets at once.

Every wanted position starts in the interval from the smallest to the largest value of its group. A round counts the rows of the
wanted intervals in BINS equal bins each (one aggregate with map-side combine) and moves every position into its bin, whose own
smallest and largest values are the next interval. A position is found when both are equal. Values are never sorted or kept;
a round shrinks an interval BINS times, and always below its distinct values, so the loop ends.
"""
from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize

BINS = 1024


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """0 .. BINS - 1, not falling in ``v``; spans over the largest double are halved."""
    wide = (hi - lo) >= F.lit(float("inf"))
    share = F.when(wide, (v / 2 - lo / 2) / (hi / 2 - lo / 2)).otherwise((v - lo) / (hi - lo))
    return F.least(F.floor(share * BINS).cast("int"), F.lit(BINS - 1))


def _narrow(wanted: pd.DataFrame, hist: pd.DataFrame) -> pd.DataFrame:
    """Positions of one interval moved into its bins; the lane's counts pick the bin."""
    hist = hist.sort_values("_bin")
    cum = np.cumsum(np.stack(hist["_n"].to_numpy()).astype(np.int64), axis=0)
    lane, k = wanted["_lane"].to_numpy(), wanted["_k"].to_numpy()
    at = np.array([np.searchsorted(cum[:, a], b, side="right") for a, b in zip(lane, k)], dtype=np.int64)
    below = np.where(at > 0, cum[np.maximum(at - 1, 0), lane], 0)
    return wanted.assign(_k=k - below, _lo=hist["_min"].to_numpy()[at], _hi=hist["_max"].to_numpy()[at])


def exact_quantiles(df: DataFrame, value_col: str, probs: DataFrame, group_cols: Sequence[str] = (), out_col: str = "value",
                    lanes: str | None = None, n_lanes: int = 1) -> DataFrame:
    """The linearly interpolated quantiles ``probs`` (a ``q`` in [0, 1], id columns, and group columns if they differ by group) of each group.

    ``lanes`` names a column of ``n_lanes`` booleans: lane i is the subset of rows where the i-th is true, and the result has a row per
    request and ``lane``. Null, NaN and infinite values take no part; an empty lane or group has no row. ``df`` is read once a round:
    pass a written table.
    """
    g, v = list(group_cols), F.col("_v")
    rows = df.select(*g, F.col(value_col).cast("double").alias("_v"), *([F.col(lanes).alias("_in")] if lanes else []))
    rows = rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    counts = F.array(*([F.sum(F.col("_in")[i].cast("long")) for i in range(n_lanes)] if lanes else [F.count(F.lit(1))])).alias("_n")
    spans = rows.groupBy(*g).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), counts)
    on = [c for c in g if c in probs.columns]
    asked = spans.join(probs, on) if on else spans.crossJoin(probs)
    ids = [c for c in probs.columns if c not in on]
    asked = asked.select(*g, *ids, "_lo", "_hi", F.posexplode("_n").alias("_lane", "_count")).where(F.col("_count") > 0)
    asked = asked.withColumn("_h", (F.col("_count") - 1) * F.col("q"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("_side"), F.floor("_h").alias("_k")), F.struct(F.lit(1).alias("_side"), F.ceil("_h").alias("_k"))))
    asked = asked.select("*", sides.alias("_s")).select(*g, *ids, "_lane", "_h", "_s._side", F.col("_s._k").cast("long").alias("_k"),
                                                        F.floor("_h").alias("_k0"), "_lo", "_hi")
    asked = materialize(asked)
    while not (left := asked.where("_lo < _hi")).isEmpty():
        spots = left.groupBy(*g).agg(F.collect_set(F.struct("_lo", "_hi")).alias("_all"))  # at most two intervals a request and lane
        near = rows.join(spots, g) if g else rows.crossJoin(spots)
        near = near.withColumn("_spot", F.get(F.filter("_all", lambda s: (v >= s["_lo"]) & (v <= s["_hi"])), F.lit(0))).where("_spot is not null")
        near = near.withColumn("_bin", _bin(v, F.col("_spot._lo"), F.col("_spot._hi"))).withColumn("_lo", F.col("_spot._lo"))
        hist = near.groupBy(*g, "_lo", "_bin").agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"), counts)
        moved = left.groupBy(*g, "_lo").cogroup(hist.groupBy(*g, "_lo")).applyInPandas(_narrow, asked.schema)
        asked = materialize(asked.where("_lo >= _hi").unionByName(moved))
    keys = [*g, *ids, "_lane"]
    one = lambda side: F.max(F.when(F.col("_side") == side, F.col("_lo")))
    found = asked.groupBy(*keys).agg(one(0).alias("_a"), one(1).alias("_b"), F.first("_h").alias("_h"), F.first("_k0").alias("_k0"))
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_h") - F.col("_k0"))
    return found.select(*g, *ids, *([F.col("_lane").alias("lane")] if lanes else []), value.alias(out_col))
