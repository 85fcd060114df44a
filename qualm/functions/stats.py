"""Aggregate and column expressions for the statistics rows.

Every function returns a Column, so it can sit inside ``groupBy().agg()`` with
other aggregates and run as one hash aggregate with map-side partials.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_finite(x) -> Column:
    """True for a real number; false for NULL, NaN and +-inf (Spark orders NaN above inf)."""
    return F.coalesce(F.abs(_c(x)) < F.lit(INF), F.lit(False))


def nan_to_num(x) -> Column:
    """NaN, +-inf and NULL become 0 (the guard applied before correlation)."""
    return F.when(is_finite(x), _c(x)).otherwise(F.lit(0.0))


def safe_pearson_raw(x, y) -> Column:
    """Pearson r over all non-null pairs; fewer than 3 pairs or a zero variance -> 0."""
    x, y = _c(x).cast("double"), _c(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x), F.when(both, y)
    den = F.sqrt(F.var_pop(xx) * F.var_pop(yy))
    r = F.covar_pop(xx, yy) / F.nullif(den, F.lit(0.0))
    return F.when(F.count(xx) < 3, F.lit(0.0)).otherwise(F.coalesce(r, F.lit(0.0)))


def safe_corr(x, y) -> Column:
    """G1: Pearson over finite pairs only; <3 pairs or non-finite r -> 0."""
    fin = is_finite(x) & is_finite(y)
    xx = F.when(fin, _c(x).cast("double"))
    yy = F.when(fin, _c(y).cast("double"))
    den = F.sqrt(F.var_pop(xx) * F.var_pop(yy))
    r = F.covar_pop(xx, yy) / F.nullif(den, F.lit(0.0))
    return F.when(F.count(xx) < 3, F.lit(0.0)).otherwise(
        F.when(is_finite(r), r).otherwise(F.lit(0.0)))


def r2_score(y, yhat) -> Column:
    """1 - SS_res / SS_tot; a constant target gives 1 when perfect, else 0."""
    y, p = _c(y).cast("double"), _c(yhat).cast("double")
    ss_res = F.sum((y - p) * (y - p))
    ss_tot = F.var_pop(y) * F.count(y)
    return (F.when(ss_tot == 0, F.when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
             .otherwise(F.lit(1.0) - ss_res / F.nullif(ss_tot, F.lit(0.0))))


def stats_1d(x, prefix: str = "") -> list[Column]:
    """N, mean, sample variance and sample std (NULL for n < 2; mean NULL when empty)."""
    x = _c(x).cast("double")
    return [F.count(x).cast("bigint").alias(f"{prefix}n"), F.avg(x).alias(f"{prefix}mean"),
            F.var_samp(x).alias(f"{prefix}var"), F.stddev_samp(x).alias(f"{prefix}std")]


def kl_divergence(p_counts: DataFrame, q_counts: DataFrame, key: str, count_col: str = "n",
                  eps: float = 1e-10) -> DataFrame:
    """KL(p || q) of two histograms given as (key, n) tables.

    Each side is normalized, clipped to [eps, 1] and renormalized before
    sum p ln(p/q); keys present on one side only count as 0 on the other.
    Histogram tables have one row per distinct key; totals come from a
    one-row aggregate joined back, never a whole-table window.
    """
    p = p_counts.select(F.col(key), F.col(count_col).cast("double").alias("p"))
    q = q_counts.select(F.col(key), F.col(count_col).cast("double").alias("q"))
    j = p.join(q, key, "full_outer").fillna(0.0, ["p", "q"])
    tot = j.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    j = j.crossJoin(F.broadcast(tot))  # one-row table of totals
    j = j.select(key, F.least(F.greatest(F.col("p") / F.col("tp"), F.lit(eps)), F.lit(1.0)).alias("p"),
                 F.least(F.greatest(F.col("q") / F.col("tq"), F.lit(eps)), F.lit(1.0)).alias("q"))
    tot2 = j.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    j = j.crossJoin(F.broadcast(tot2))
    pn, qn = F.col("p") / F.col("sp"), F.col("q") / F.col("sq")
    return j.agg(F.sum(pn * F.log(pn / qn)).alias("kl"))
