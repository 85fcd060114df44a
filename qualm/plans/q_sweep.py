"""Queries for the configuration / multi-objective rows (I1, I3-I16, I18) over the
``fronts`` and ``progress`` views."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pareto as P
from ..sources import tables as T
from .catalog import register

# Normalization windows chosen to fit the fixture objectives (parameters of I6).
WIN = {"bert_low": -0.1, "bert_high": 0.1, "rouge_low": -0.75, "rouge_high": 0.1}
FR = T.with_views("", "fronts")[:-1]
PG = T.with_views("", "progress")[:-1]


def _norm_sql():
    w = WIN
    return (f"greatest(0e0, least(1e0, (f1 - ({w['bert_low']})) / ({w['bert_high'] - w['bert_low']}e0))) AS fn1, "
            f"greatest(0e0, least(1e0, (f2 - ({w['rouge_low']})) / ({w['rouge_high'] - w['rouge_low']}e0))) AS fn2")


DECODE_SQL = """CAST(greatest(5, least(20, round_even(x0, 0))) AS BIGINT) AS min_cluster_size,
  CAST(greatest(1, least(20, round_even(x1, 0))) AS BIGINT) AS min_samples,
  greatest(0e0, least(0.5e0, x2)) AS cluster_selection_epsilon,
  CAST(greatest(5, least(35, round_even(x3, 0))) AS BIGINT) AS n_neighbors,
  CAST([128, 256][CAST(greatest(0, least(1, round_even(x4, 0))) AS INT) + 1] AS BIGINT) AS emb_dim,
  ['PCA'][CAST(greatest(0, least(0, round_even(x5, 0))) AS INT) + 1] AS reduction"""


@register("i1_decode_configs", FR + f"\nSELECT seed, gen, idx, f1, f2, {DECODE_SQL} FROM fronts",
          doubles=["f1", "f2", "cluster_selection_epsilon"])
def i1_decode_configs(spark, sf):
    return P.decode_x(T.fronts(spark, sf))


@register("i3_finite_filter", FR + "\nSELECT seed, gen, idx FROM fronts WHERE isfinite(f1) AND isfinite(f2)")
def i3_finite_filter(spark, sf):
    return P.finite_filter(T.fronts(spark, sf)).select("seed", "gen", "idx")


@register("i4_dim_counts", FR + """
SELECT seed, gen, CAST([128, 256][CAST(greatest(0, least(1, round_even(x4, 0))) AS INT) + 1] AS BIGINT) AS emb_dim,
       count(*) AS n_raw, count(*) FILTER (WHERE isfinite(f1) AND isfinite(f2)) AS n_valid
FROM fronts GROUP BY ALL""")
def i4_dim_counts(spark, sf):
    return P.dim_counts(T.fronts(spark, sf))


GEN_STATS_SQL = """gs AS (
  SELECT seed, gen, min(f1) AS best_obj_bert, min(f2) AS best_obj_rouge, min((f1 + f2) * 0.5e0) AS best_combined,
         avg(f1) AS mean_obj_bert, avg(f2) AS mean_obj_rouge, avg((f1 + f2) * 0.5e0) AS mean_combined,
         first(idx ORDER BY (f1 + f2) * 0.5e0, idx) AS best_idx
  FROM fronts WHERE isfinite(f1) AND isfinite(f2) GROUP BY seed, gen)"""


@register("i5_generation_stats", FR + ",\n" + GEN_STATS_SQL + "\nSELECT * FROM gs",
          doubles=["best_obj_bert", "best_obj_rouge", "best_combined", "mean_obj_bert", "mean_obj_rouge",
                   "mean_combined"])
def i5_generation_stats(spark, sf):
    return P.generation_stats(T.fronts(spark, sf))


@register("i6_normalize_window", FR + f""",
n AS (SELECT seed, gen, {_norm_sql()} FROM fronts)
SELECT seed, gen, avg(CAST(fn1 = 0 AS DOUBLE)) * 100 AS bert_low_pct, avg(CAST(fn1 = 1 AS DOUBLE)) * 100 AS bert_high_pct,
       avg(CAST(fn2 = 0 AS DOUBLE)) * 100 AS rouge_low_pct, avg(CAST(fn2 = 1 AS DOUBLE)) * 100 AS rouge_high_pct
FROM n GROUP BY seed, gen""", doubles=["bert_low_pct", "bert_high_pct", "rouge_low_pct", "rouge_high_pct"])
def i6_normalize_window(spark, sf):
    return P.clipped_share(P.normalize_window(T.fronts(spark, sf), **WIN))


@register("i7_nondominated", FR + """,
o AS (SELECT *, min(f2) OVER (PARTITION BY seed, gen ORDER BY f1, idx
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM fronts)
SELECT seed, gen, idx, f1, f2 FROM o WHERE pm IS NULL OR f2 <= pm""", doubles=["f1", "f2"])
def i7_nondominated(spark, sf):
    return P.nondominated(T.fronts(spark, sf)).select("seed", "gen", "idx", "f1", "f2")


@register("i8_hypervolume", FR + f""",
n AS (SELECT seed, gen, idx, {_norm_sql()} FROM fronts),
o AS (SELECT *, coalesce(min(fn2) OVER (PARTITION BY seed, gen ORDER BY fn1, fn2, idx
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.05e0) AS pm FROM n)
SELECT seed, gen, sum((1.05e0 - fn1) * greatest(0e0, pm - fn2)) AS hv FROM o GROUP BY seed, gen""",
          doubles=["hv"])
def i8_hypervolume(spark, sf):
    return P.hypervolume(P.normalize_window(T.fronts(spark, sf), **WIN))


@register("i9_smoothed_hv", PG + """
SELECT seed, gen, hv, avg(hv) OVER (PARTITION BY seed ORDER BY gen ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hv_smooth
FROM progress""", doubles=["hv", "hv_smooth"])
def i9_smoothed_hv(spark, sf):
    return P.smooth_hv(T.progress(spark, sf), 5)


ES = P.EARLY_STOP
EARLY_SQL = "WITH RECURSIVE " + PG[len("WITH "):] + f""",
s AS (SELECT seed, gen, hv, avg(hv) OVER (PARTITION BY seed ORDER BY gen ROWS BETWEEN {ES['smooth_k'] - 1} PRECEDING AND CURRENT ROW) AS hv_smooth,
             row_number() OVER (PARTITION BY seed ORDER BY gen) AS rn FROM progress),
r AS (
  SELECT seed, rn, gen, hv, hv_smooth, CASE WHEN gen >= {ES['min_gen']} THEN hv_smooth END AS best,
         0e0 AS rel, CAST(0 AS BIGINT) AS cnt FROM s WHERE rn = 1
  UNION ALL
  SELECT s.seed, s.rn, s.gen, s.hv, s.hv_smooth,
    CASE WHEN s.gen < {ES['min_gen']} THEN r.best WHEN r.best IS NULL THEN s.hv_smooth
         WHEN (s.hv_smooth - r.best) / greatest(abs(r.best), 1e-12) > {ES['rel_eps']} THEN s.hv_smooth ELSE r.best END,
    CASE WHEN s.gen >= {ES['min_gen']} AND r.best IS NOT NULL
         THEN (s.hv_smooth - r.best) / greatest(abs(r.best), 1e-12) ELSE 0e0 END,
    CASE WHEN s.gen < {ES['min_gen']} THEN r.cnt WHEN r.best IS NULL THEN 0
         WHEN (s.hv_smooth - r.best) / greatest(abs(r.best), 1e-12) > {ES['rel_eps']} THEN 0 ELSE r.cnt + 1 END
  FROM r JOIN s ON s.seed = r.seed AND s.rn = r.rn + 1),
st AS (SELECT *, min(CASE WHEN gen >= {ES['min_gen']} AND cnt >= {ES['patience']} THEN gen END)
                 OVER (PARTITION BY seed) AS stop FROM r),
es AS (SELECT seed, gen, hv, hv_smooth, best AS hv_best_smooth, rel AS hv_rel_improve, cnt AS earlystop_no_improve,
              coalesce(gen = stop, false) AS stopped
       FROM st WHERE stop IS NULL OR gen <= stop)"""


@register("i10_early_stop", EARLY_SQL + "\nSELECT * FROM es",
          doubles=["hv", "hv_smooth", "hv_best_smooth", "hv_rel_improve"])
def i10_early_stop(spark, sf):
    return P.early_stop(T.progress(spark, sf))


@register("i11_global_best", FR + ",\n" + GEN_STATS_SQL + """
SELECT seed, gen, best_combined,
       coalesce(best_combined < min(best_combined) OVER (PARTITION BY seed ORDER BY gen
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_new_best FROM gs""",
          doubles=["best_combined"])
def i11_global_best(spark, sf):
    return P.global_best(P.generation_stats(T.fronts(spark, sf)))


def _dedup_sql(part: str, order: str) -> str:
    keys = ", ".join(f"round({c}, 12)" for c in ["f1", "f2", "x0", "x1", "x2", "x3", "x4", "x5"])
    pb = f"PARTITION BY {part + ', ' if part else ''}{keys}"
    return f"""u AS (SELECT * FROM (SELECT *, row_number() OVER ({pb} ORDER BY {order}) AS _k
                    FROM fronts WHERE isfinite(f1) AND isfinite(f2)) WHERE _k = 1)"""


@register("i12_dedup_front_rows", FR + ",\n" + _dedup_sql("seed", "gen, idx") + "\nSELECT seed, gen, idx FROM u")
def i12_dedup_front_rows(spark, sf):
    return P.dedup_front_rows(T.fronts(spark, sf), by=["seed"]).select("seed", "gen", "idx")


@register("i13_cumulative_front", FR + ",\n" + _dedup_sql("seed", "gen, idx") + """,
o AS (SELECT *, min(f2) OVER (PARTITION BY seed ORDER BY f1, gen, idx
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM u)
SELECT seed, gen, idx, f1, f2 FROM o WHERE pm IS NULL OR f2 <= pm""", doubles=["f1", "f2"])
def i13_cumulative_front(spark, sf):
    return P.cumulative_front(T.fronts(spark, sf)).select("seed", "gen", "idx", "f1", "f2")


INTEGRATED_SQL = FR + ",\n" + _dedup_sql("", "seed, gen, idx") + """,
o AS (SELECT *, min(f2) OVER (ORDER BY f1, seed, gen, idx
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM u),
fr AS (SELECT * FROM o WHERE pm IS NULL OR f2 <= pm)"""


@register("i13_integrated_front", INTEGRATED_SQL + "\nSELECT seed, gen, idx, f1, f2 FROM fr", doubles=["f1", "f2"])
def i13_integrated_front(spark, sf):
    return P.cumulative_front(T.fronts(spark, sf), per_seed=False).select("seed", "gen", "idx", "f1", "f2")


@register("i13_front_counts", INTEGRATED_SQL + """
SELECT (SELECT count(DISTINCT seed) FROM fronts) AS n_seeds, (SELECT count(*) FROM fronts) AS n_points,
       (SELECT count(*) FROM u) AS n_unique, (SELECT count(*) FROM fr) AS n_front""")
def i13_front_counts(spark, sf):
    return P.front_counts(T.fronts(spark, sf))


@register("i14_solution_table", INTEGRATED_SQL + f"\nSELECT seed, gen, idx, f1, f2, {DECODE_SQL} FROM fr",
          doubles=["f1", "f2", "cluster_selection_epsilon"])
def i14_solution_table(spark, sf):
    front = P.cumulative_front(T.fronts(spark, sf), per_seed=False)
    return P.decode_x(front.select("seed", "gen", "idx", "f1", "f2", *P.X_COLS))


PSUM_SQL = EARLY_SQL + """,
ps AS (SELECT seed, max(gen) AS stop_gen, arg_max(hv, gen) AS final_hv, max(hv) AS best_hv,
         first(gen ORDER BY hv DESC, gen) AS gen_best_hv, arg_max(hv_smooth, gen) AS final_hv_smooth,
         max(hv_smooth) AS best_hv_smooth, first(gen ORDER BY hv_smooth DESC, gen) AS gen_best_hv_smooth,
         arg_max(earlystop_no_improve, gen) AS final_no_improve, arg_min(hv, gen) AS first_gen_hv,
         count(*) AS n_gens,
         arg_max(hv, gen) - arg_min(hv, gen) AS hv_gain_abs,
         (arg_max(hv, gen) - arg_min(hv, gen)) / nullif(abs(arg_min(hv, gen)), 0) AS hv_gain_rel
       FROM es WHERE NOT stopped GROUP BY seed)"""


@register("i15_progress_summary", PSUM_SQL + "\nSELECT * FROM ps",
          doubles=["final_hv", "best_hv", "final_hv_smooth", "best_hv_smooth", "first_gen_hv", "hv_gain_abs",
                   "hv_gain_rel"])
def i15_progress_summary(spark, sf):
    return P.progress_summary(P.early_stop(T.progress(spark, sf)))


@register("i16_seed_summary", PSUM_SQL + ",\nlong AS (" + "\n  UNION ALL ".join(
    f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM ps" for m in P.SUMMARY_METRICS) + """)
SELECT metric, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
       count(value) AS n FROM long WHERE isfinite(value) GROUP BY metric""",
          doubles=["mean", "std", "min", "max"])
def i16_seed_summary(spark, sf):
    return P.summarize_seeds(P.progress_summary(P.early_stop(T.progress(spark, sf))))


@register("i18_rvea_selection", FR + """,
z AS (SELECT seed, gen, min(f1) AS z1, min(f2) AS z2 FROM fronts GROUP BY seed, gen),
t AS (SELECT f.seed, f.gen, f.idx, f.f1 - z.z1 AS t1, f.f2 - z.z2 AS t2,
             sqrt((f.f1 - z.z1) ^ 2 + (f.f2 - z.z2) ^ 2) AS nrm FROM fronts f JOIN z USING (seed, gen)),
d AS (SELECT CAST(i AS BIGINT) AS dir_id, (i / 59e0) / sqrt((i / 59e0) ^ 2 + (1 - i / 59e0) ^ 2) AS u1,
             (1 - i / 59e0) / sqrt((i / 59e0) ^ 2 + (1 - i / 59e0) ^ 2) AS u2 FROM range(0, 60) r(i)),
g AS (SELECT a.dir_id, min(acos(least(1e0, a.u1 * b.u1 + a.u2 * b.u2))) AS gamma
      FROM d a JOIN d b ON a.dir_id <> b.dir_id GROUP BY a.dir_id),
c AS (SELECT t.*, d.dir_id, CASE WHEN nrm > 0 THEN least(1e0, (t1 * u1 + t2 * u2) / nrm) ELSE 1e0 END AS cs
      FROM t CROSS JOIN d),
b AS (SELECT seed, gen, idx, first(dir_id ORDER BY cs DESC, dir_id) AS dir_id, max(cs) AS cs, any_value(nrm) AS nrm
      FROM c GROUP BY seed, gen, idx),
a AS (SELECT b.*, (1 + 2 * pow(gen / 50e0, 2e0) * acos(cs) / g.gamma) * nrm AS apd FROM b JOIN g USING (dir_id))
SELECT seed, gen, dir_id, first(idx ORDER BY apd, idx) AS idx, min(apd) AS apd FROM a GROUP BY seed, gen, dir_id""",
          doubles=["apd"])
def i18_rvea_selection(spark, sf):
    return P.rvea_select(T.fronts(spark, sf))
