"""Queries over plain tables: B8, B9, B12, G1-G6, J1, J2."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as st
from ..operators.grids import baseline_means, correlation_grid
from ..operators.order import average_rank
from ..sources import tables as T
from ..sources.answers import build_eval_set
from .catalog import register

SQ = T.SQL


def _dirty(c="uq"):
    """A copy of ``uq`` with NaN, +inf, -inf and NULL planted by row id (for B12, G1)."""
    r = F.col("row_id") % 7
    return (F.when(r == 0, F.lit(float("nan"))).when(r == 1, F.lit(float("inf")))
             .when(r == 2, F.lit(float("-inf"))).when(r == 3, F.lit(None).cast("double"))
             .otherwise(F.col(c)))


DIRTY_SQL = """CASE row_id % 7 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE
  WHEN 2 THEN '-Infinity'::DOUBLE WHEN 3 THEN NULL ELSE uq END"""


@register("b8_eval_set", T.with_views("SELECT row_id, uq, bertscore_f1, rougeL, split FROM scores", "scores"),
          doubles=["uq", "bertscore_f1", "rougeL"])
def b8_eval_set(spark, sf):
    s = T.scores(spark, sf)
    src = {}
    for tag, cond in (("test", ~F.col("split").isin("d01", "d02")), ("d01", F.col("split") == "d01"),
                      ("d02", F.col("split") == "d02")):
        part = s.filter(cond).withColumnRenamed("uq", f"{tag}_uq")
        src[tag] = (part, {"row_id": "row_id", f"{tag}_uq": "uq", "bertscore_f1": "bertscore_f1",
                           "rougeL": "rougeL"})
    return build_eval_set(src)


@register("b9_filter_dimensionality", T.with_views(
    "SELECT * FROM results WHERE dimensionality = 128 AND layer IN (1, 2, 3)", "results"),
    doubles=["pearson_bertscore", "pearson_meteor"])
def b9_filter_dimensionality(spark, sf):
    r = T.results(spark, sf)
    return r.filter((F.col("dimensionality") == 128) & F.col("layer").isin(1, 2, 3))


@register("b12_nan_guard", T.with_views(f"""
SELECT row_id, CASE WHEN isfinite(x) THEN x ELSE 0e0 END AS x_guarded
FROM (SELECT row_id, {DIRTY_SQL} AS x FROM scores)""", "scores"), doubles=["x_guarded"])
def b12_nan_guard(spark, sf):
    s = T.scores(spark, sf).select("row_id", _dirty().alias("x"))
    return s.select("row_id", st.nan_to_num("x").alias("x_guarded"))


def _safe_corr_sql(x, y, where="isfinite({x}) AND isfinite({y})"):
    cond = where.format(x=x, y=y)
    xx, yy = f"CASE WHEN {cond} THEN {x} END", f"CASE WHEN {cond} THEN {y} END"
    r = f"covar_pop({xx}, {yy}) / nullif(sqrt(var_pop({xx}) * var_pop({yy})), 0)"
    return f"CASE WHEN count({xx}) < 3 THEN 0e0 ELSE coalesce(CASE WHEN isfinite({r}) THEN {r} END, 0e0) END"


@register("g1_safe_corr", T.with_views(f"""
SELECT split, {_safe_corr_sql('uq', 'bertscore_f1')} AS r_bert, {_safe_corr_sql('uq', 'rougeL')} AS r_rouge,
       {_safe_corr_sql('x', 'rougeL')} AS r_dirty, {_safe_corr_sql('uq', 'c')} AS r_const
FROM (SELECT *, {DIRTY_SQL} AS x, 1e0 AS c FROM scores) GROUP BY split""", "scores"),
    doubles=["r_bert", "r_rouge", "r_dirty", "r_const"])
def g1_safe_corr(spark, sf):
    s = T.scores(spark, sf).withColumn("x", _dirty()).withColumn("c", F.lit(1.0))
    return s.groupBy("split").agg(st.safe_corr("uq", "bertscore_f1").alias("r_bert"),
                                  st.safe_corr("uq", "rougeL").alias("r_rouge"),
                                  st.safe_corr("x", "rougeL").alias("r_dirty"),
                                  st.safe_corr("uq", "c").alias("r_const"))


@register("g2_sanity_checks", T.with_views(f"""
SELECT split, count(*) AS n, {_safe_corr_sql('uq', 'bertscore_f1')} AS r,
       {_safe_corr_sql('uq', 'bertscore_f1')} > 0 AS positive_warning
FROM scores GROUP BY split""", "scores"), doubles=["r"])
def g2_sanity_checks(spark, sf):
    s = T.scores(spark, sf)
    r = st.safe_corr("uq", "bertscore_f1")
    return s.groupBy("split").agg(F.count("*").alias("n"), r.alias("r"), (r > 0).alias("positive_warning"))


@register("g3_spearman", T.with_views(f"""
SELECT split, {_safe_corr_sql('ru', 'rb')} AS spearman_bert FROM (
  SELECT split,
    rank() OVER (PARTITION BY split ORDER BY uq) + (count(*) OVER (PARTITION BY split, uq) - 1) / 2e0 AS ru,
    rank() OVER (PARTITION BY split ORDER BY bertscore_f1)
      + (count(*) OVER (PARTITION BY split, bertscore_f1) - 1) / 2e0 AS rb
  FROM scores) GROUP BY split""", "scores"), doubles=["spearman_bert"])
def g3_spearman(spark, sf):
    s = T.scores(spark, sf)
    s = average_rank(s, "uq", ["split"], "ru")
    s = average_rank(s, "bertscore_f1", ["split"], "rb")
    return s.groupBy("split").agg(st.safe_corr("ru", "rb").alias("spearman_bert"))


@register("g4_kl_divergence", """
WITH h AS (SELECT event_type, count(*) FILTER (WHERE day(ts) <= 15) AS p,
                  count(*) FILTER (WHERE day(ts) > 15) AS q FROM events GROUP BY event_type),
n1 AS (SELECT event_type, p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM h),
n2 AS (SELECT event_type, least(greatest(p, 1e-10), 1e0) AS p, least(greatest(q, 1e-10), 1e0) AS q FROM n1),
n3 AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM n2)
SELECT sum(p * ln(p / q)) AS kl FROM n3""", doubles=["kl"])
def g4_kl_divergence(spark, sf):
    ev = T.read_table(spark, sf, "events")
    first = ev.filter(F.dayofmonth("ts") <= 15).groupBy("event_type").agg(F.count("*").alias("n"))
    second = ev.filter(F.dayofmonth("ts") > 15).groupBy("event_type").agg(F.count("*").alias("n"))
    return st.kl_divergence(first, second, "event_type")


@register("g5_r2_score", T.with_views("""
SELECT split, CASE WHEN var_pop(bertscore_f1) * count(*) = 0
                   THEN CASE WHEN sum((bertscore_f1 - rougeL) ^ 2) = 0 THEN 1e0 ELSE 0e0 END
              ELSE 1 - sum((bertscore_f1 - rougeL) ^ 2) / (var_pop(bertscore_f1) * count(*)) END AS r2
FROM scores GROUP BY split""", "scores"), doubles=["r2"])
def g5_r2_score(spark, sf):
    return T.scores(spark, sf).groupBy("split").agg(st.r2_score("bertscore_f1", "rougeL").alias("r2"))


@register("g6_stats_1d", T.with_views("""
SELECT split, count(uq) AS n, avg(uq) AS mean, var_samp(uq) AS var, stddev_samp(uq) AS std
FROM scores GROUP BY split""", "scores"), doubles=["mean", "var", "std"])
def g6_stats_1d(spark, sf):
    return T.scores(spark, sf).groupBy("split").agg(*st.stats_1d("uq"))


GRID_LABELS = [f"{m} - {r} ({d})" for m in ("KDE", "KNN") for r in ("PCA", "SVD") for d in (128, 256)]


def _grid_sql(value, view="results"):
    cells = ",\n  ".join(f"max(CASE WHEN label = '{lab}' THEN {value} END) AS \"{lab}\"" for lab in GRID_LABELS)
    return T.with_views(f"""
SELECT layer,
  {cells}
FROM (SELECT layer, method || ' - ' || reduction || ' (' || CAST(dimensionality AS VARCHAR) || ')' AS label, {value}
      FROM {view} WHERE method NOT IN ('MCD', 'TS')) GROUP BY layer""", view)


@register("j1_grid_pearson_bertscore", _grid_sql("pearson_bertscore"), doubles=GRID_LABELS)
def j1_grid_pearson_bertscore(spark, sf):
    return correlation_grid(T.results(spark, sf), "pearson_bertscore", GRID_LABELS)


@register("j1_grid_pearson_meteor", _grid_sql("pearson_meteor"), doubles=GRID_LABELS)
def j1_grid_pearson_meteor(spark, sf):
    return correlation_grid(T.results(spark, sf), "pearson_meteor", GRID_LABELS)


@register("j1_grid_spearman_bertscore", _grid_sql("spearman_bertscore", "rank_results"), doubles=GRID_LABELS)
def j1_grid_spearman_bertscore(spark, sf):
    return correlation_grid(T.rank_results(spark, sf), "spearman_bertscore", GRID_LABELS)


@register("j1_grid_spearman_meteor", _grid_sql("spearman_meteor", "rank_results"), doubles=GRID_LABELS)
def j1_grid_spearman_meteor(spark, sf):
    return correlation_grid(T.rank_results(spark, sf), "spearman_meteor", GRID_LABELS)


@register("j2_baseline_rank_means", T.with_views("""
SELECT method, avg(spearman_bertscore) AS mean_spearman_bertscore, avg(spearman_meteor) AS mean_spearman_meteor
FROM rank_results WHERE method IN ('MCD', 'TS') GROUP BY method""", "rank_results"),
    doubles=["mean_spearman_bertscore", "mean_spearman_meteor"])
def j2_baseline_rank_means(spark, sf):
    return baseline_means(T.rank_results(spark, sf), ["spearman_bertscore", "spearman_meteor"])


@register("j2_baseline_means", T.with_views("""
SELECT method, avg(pearson_bertscore) AS mean_pearson_bertscore, avg(pearson_meteor) AS mean_pearson_meteor
FROM results WHERE method IN ('MCD', 'TS') GROUP BY method""", "results"),
    doubles=["mean_pearson_bertscore", "mean_pearson_meteor"])
def j2_baseline_means(spark, sf):
    return baseline_means(T.results(spark, sf), ["pearson_bertscore", "pearson_meteor"])
