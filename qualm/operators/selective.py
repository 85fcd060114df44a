"""Selective-prediction evaluation.

Conventions (fixed):
* ``uq`` high = more uncertain; positive class for AUROC = incorrect answer.
* Rows are ranked "least uncertain first" by ``(uq, row_id)``; the row id
  breaks ties so every run keeps the same rows.
* A repeat ``r`` draws its calibration rows with seed ``seed_base + r``.

Repeats and schemes are lanes of one ordering (``lanes.py``): a row is sorted once per
solution and carries a flag per repeat and an error flag per repeat and scheme.
"""
from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import stats_1d
from ..plans.materialize import materialize
from .lanes import draw_repeats, lane_metrics, lane_thresholds
from .order import pick_first_n
from .quantile import exact_quantiles

# Threshold schemes (name, BERTScore percentile, ROUGE-L percentile)
# and rejection coverages, as the evaluation notebook defines them.
SCHEMES = [
    ("B30 R30", 30, 30),
    ("B30 R20", 30, 20),
    ("B25 R10", 25, 20),
    ("B30 R0", 30, 0),
    ("B0 R30", 0, 30),
]
COVERAGES = (0.8, 0.9, 0.95, 1.0)


def cov_name(c: float) -> str:
    return f"acc_at_{int(round(c * 100))}"


def schemes_table(spark: SparkSession, schemes=SCHEMES) -> DataFrame:
    return spark.createDataFrame([(i, n, float(b), float(r)) for i, (n, b, r) in enumerate(schemes)],
                                 "scheme_id bigint, scheme string, p_bert double, p_rouge double")


# -- H1 -----------------------------------------------------------------------
def calib_split(df: DataFrame, group_col: str = "split", calib_from: Sequence[str] = ("test",),
                calib_frac: float = 0.30, seed=42, out_col: str = "split2",
                by: Sequence[str] = (), id_col: str = "row_id") -> DataFrame:
    """Label round-half-even(frac * eligible) eligible rows 'calib', all others 'eval'.

    ``seed`` may be a column (one seed per ``by`` group, e.g. per repeat).
    """
    by = list(by)
    elig = F.col(group_col).isin(list(calib_from))
    n = (df.filter(elig).groupBy(*by).agg(F.count("*").alias("_ne")) if by
         else df.filter(elig).agg(F.count("*").alias("_ne")))
    n = n.withColumn("_nc", F.bround(F.lit(float(calib_frac)) * F.col("_ne"), 0).cast("bigint"))
    e = df.filter(elig)
    e = (e.join(F.broadcast(n.select(*by, "_nc")), by) if by else e.crossJoin(F.broadcast(n.select("_nc"))))
    e = pick_first_n(e, "_nc", seed, id_col=id_col, group_cols=by, out_col="_pk").drop("_nc")
    e = e.withColumn(out_col, F.when(F.col("_pk"), "calib").otherwise("eval")).drop("_pk")
    rest = df.filter(~elig | F.col(group_col).isNull()).withColumn(out_col, F.lit("eval"))
    return e.unionByName(rest)


# -- H2 -----------------------------------------------------------------------
def thresholds(calib: DataFrame, schemes: DataFrame, group_cols: Sequence[str] = (),
               bert_col: str = "bertscore_f1", rouge_col: str = "rougeL") -> DataFrame:
    """H2: (group..., scheme_id, scheme, p_bert, p_rouge, tau_bert, tau_rouge).

    Both quality columns are stacked so the same passes serve every scheme.
    """
    g = list(group_cols)
    vals = calib.select(*g, F.explode(F.array(
        F.struct(F.lit("b").alias("metric"), F.col(bert_col).cast("double").alias("v")),
        F.struct(F.lit("r").alias("metric"), F.col(rouge_col).cast("double").alias("v")))).alias("_s")
    ).select(*g, "_s.*")
    probs = (schemes.select("scheme_id", F.lit("b").alias("metric"), (F.col("p_bert") / 100).alias("q"))
             .unionByName(schemes.select("scheme_id", F.lit("r").alias("metric"),
                                         (F.col("p_rouge") / 100).alias("q"))))
    pv = exact_quantiles(materialize(vals), "v", probs, [*g, "metric"], "tau")
    wide = pv.groupBy(*g, "scheme_id").agg(
        F.max(F.when(F.col("metric") == "b", F.col("tau"))).alias("tau_bert"),
        F.max(F.when(F.col("metric") == "r", F.col("tau"))).alias("tau_rouge"))
    return wide.join(schemes, "scheme_id")


# -- H3 -----------------------------------------------------------------------
def joint_correct(bert: Column, rouge: Column, tau_bert: Column, tau_rouge: Column) -> Column:
    return (bert >= tau_bert) & (rouge >= tau_rouge)


def joint_labels(eval_df: DataFrame, thr: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """H3 in long form: one row per (eval row, scheme) with ``correct``."""
    g = list(group_cols)
    return (eval_df.join(F.broadcast(thr.select(*g, "scheme_id", "scheme", "tau_bert", "tau_rouge")), g or None,
                         "inner" if g else "cross")
            .withColumn("correct", joint_correct(F.col("bertscore_f1"), F.col("rougeL"),
                                                 F.col("tau_bert"), F.col("tau_rouge"))))


# -- H4-H9: all schemes and repeats at once -------------------------------------
def _evaluate(rows: DataFrame, schemes, coverages, n_repeats: int, by: Sequence[str], curve: bool, num_buckets: int | None):
    """Metrics of written ``rows`` (by..., row_id, uq, bertscore_f1, rougeL, calib), a row per (by..., lane, scheme)."""
    g = list(by)
    table = schemes_table(rows.sparkSession, schemes)
    thr = lane_thresholds(rows, table, n_repeats, g)
    S = len(schemes)
    known = F.map_from_entries(F.collect_list(F.struct((F.col("lane") * S + F.col("scheme_id")).cast("int"), F.struct("tau_bert", "tau_rouge"))))
    taus = thr.groupBy(*g).agg(known.alias("_t")).withColumn("_t", F.expr(f"transform(sequence(0, {n_repeats * S - 1}), i -> _t[i])"))
    ev = rows.join(taus, g) if g else rows.crossJoin(taus)  # a list of repeats x schemes thresholds a group
    ok = F.transform("_t", lambda t: F.coalesce(joint_correct(F.col("bertscore_f1"), F.col("rougeL"), t["tau_bert"], t["tau_rouge"]), F.lit(False)))
    made = lane_metrics(ev.withColumn("ok", ok), n_repeats, S, coverages, g, curve, num_buckets)
    per, points = made if curve else (made, None)
    err = F.col("n_err") / F.col("n")
    res = per.join(thr, [*g, "lane", "scheme_id"]).select(
        *g, "lane", "scheme", "p_bert", "p_rouge", "tau_bert", "tau_rouge", (F.lit(1.0) - err).alias("acc_joint"), err.alias("err_joint"), "auroc", "aurc",
        *[F.col("acc")[i].alias(cov_name(c)) for i, c in enumerate(coverages)], "n")
    if not curve:
        return res
    return res, points.join(table.select("scheme_id", "scheme"), "scheme_id").select(*g, "scheme", "m", (F.col("m") / F.col("n")).alias("coverage"), "risk")


def evaluate_schemes(scored: DataFrame, schemes=SCHEMES, coverages=COVERAGES, group_cols: Sequence[str] = (),
                     split2_col: str = "split2", curve: bool = False, num_buckets: int | None = None):
    """H8 for every scheme and group: thresholds on 'calib', metrics on the other rows.

    Returns the per-(group, scheme) metric table; with ``curve`` also the H5
    risk-coverage table (group, scheme, m, coverage, risk).
    """
    g = list(group_cols)
    drawn = F.array(F.coalesce(F.col(split2_col) == "calib", F.lit(False))).alias("calib")
    rows = materialize(scored.select(*g, "row_id", "uq", "bertscore_f1", "rougeL", drawn))
    made = _evaluate(rows, schemes, coverages, 1, g, curve, num_buckets)
    return (made[0].drop("lane"), made[1]) if curve else made.drop("lane")


# -- H9 / H10 / H12 -------------------------------------------------------------
def repeated_evaluation(scores: DataFrame, n_repeats: int = 15, seed_base: int = 42,
                        schemes=SCHEMES, coverages=COVERAGES, group_col: str = "split",
                        calib_from=("test",), calib_frac: float = 0.30,
                        by: Sequence[str] = (), num_buckets: int | None = None) -> DataFrame:
    """H9: uq scored once; calibration split redrawn per repeat; every scheme each time.

    ``by`` names solution columns when several solutions are evaluated together. Rows are not copied per repeat.
    """
    by = list(by)
    pool = F.col(group_col).isin(list(calib_from))
    drawn = draw_repeats(scores, n_repeats, seed_base, pool, calib_frac, by)
    rows = materialize(drawn.select(*by, "row_id", "uq", "bertscore_f1", "rougeL", "calib"))
    return _evaluate(rows, schemes, coverages, n_repeats, by, False, num_buckets).withColumnRenamed("lane", "repeat").withColumn("repeat", F.col("repeat").cast("bigint"))


LANE_ROWS = 1 << 20  # evaluation rows that one task orders


def repeated_lanes(rows: DataFrame, lanes: DataFrame, members: DataFrame, n_repeats: int = 15, seed_base: int = 42, schemes=SCHEMES, coverages=COVERAGES,
                   group_col: str = "split", calib_from=("test",), calib_frac: float = 0.30, lane_rows: int = LANE_ROWS) -> DataFrame:
    """H9 of many scores of the same ``rows`` (row_id, split, bertscore_f1, rougeL): ``lanes`` (set, row_id, uq) holds a list of scores a row, ``members``
    (set, pos, score) names them. Draws, thresholds and errors do not depend on the score and are made once; a task orders the rows by the
    scores of a set, one after another. More than ``lane_rows`` rows (a checked count) go through ``repeated_evaluation``."""
    if rows.count() > lane_rows:
        long = lanes.join(rows, "row_id").select("set", "row_id", group_col, "bertscore_f1", "rougeL", F.posexplode("uq").alias("pos", "uq"))
        long = materialize(long.join(F.broadcast(members), ["set", "pos"]).drop("set", "pos"))
        return repeated_evaluation(long, n_repeats, seed_base, schemes, coverages, group_col, calib_from, calib_frac, ["score"])
    R, S = n_repeats, len(schemes)
    table = schemes_table(rows.sparkSession, schemes)
    drawn = materialize(draw_repeats(rows, R, seed_base, F.col(group_col).isin(list(calib_from)), calib_frac))
    thr = materialize(lane_thresholds(drawn, table, R))
    tau = {(r["lane"], r["scheme_id"]): (r["tau_bert"], r["tau_rouge"]) for r in thr.collect()}  # repeats x schemes rows
    held = drawn.select("row_id", "bertscore_f1", "rougeL", "calib").toArrow().sort_by("row_id").combine_chunks()
    there = ~held.column("calib").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, R)
    bert, rouge = (held.column(c).to_numpy() for c in ("bertscore_f1", "rougeL"))  # null is NaN: not correct
    never = (float("nan"), float("nan"))
    taus = [[tuple(float("nan") if x is None else x for x in tau.get((r, s), never)) for s in range(S)] for r in range(R)]
    wrong = np.stack([np.stack([~((bert >= b) & (rouge >= g)) for b, g in per], axis=1) for per in taus], axis=1).astype(np.float64)
    shared = rows.sparkSession.sparkContext.broadcast((held.column("row_id").to_numpy(), there.T.copy(), np.ascontiguousarray(wrong.transpose(1, 0, 2))))

    def kernel(part: pa.Table) -> pa.Table:
        ids, on, err = shared.value
        part = part.sort_by("row_id").combine_chunks()
        mine = part.column("row_id").to_numpy()
        at = np.minimum(np.searchsorted(mine, ids), len(mine) - 1)
        known = np.flatnonzero(mine[at] == ids)
        uq = part.column("uq").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(mine), -1)[at[known]]
        # null and NaN are the same in an array: no score is null, and NaN is the most uncertain
        uq = np.where(np.isnan(uq), np.inf, uq)
        n = on[:, known].sum(axis=1)
        ends = [[math.ceil(c * k) for c in coverages] for k in n]
        # a row's place (set later), the sum of 1 / m over m .. n, and whether it is among the first m rows
        weights = [np.stack([np.empty(k), np.cumsum(1.0 / np.arange(k, 0, -1))[::-1], *[(np.arange(k) < m).astype(np.float64) for m in (k, *end)]]) for k, end in zip(n, ends)]
        out: dict = {c: [] for c in ("pos", "lane", "scheme_id", "n", "n_err", "aurc", "auroc", "acc")}
        for pos in range(uq.shape[1]):
            order = np.argsort(uq[:, pos], kind="stable")
            u = uq[order, pos]
            order = known[order]
            for r in range(R):
                k = int(n[r])
                if not k:
                    continue
                kept = on[r][order]
                v, e = u[kept], err[r][order[kept]]
                start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
                place = np.arange(1, k + 1, dtype=np.float64)
                if len(start) < k:  # rows of a tie share their mean place
                    size = np.diff(np.append(start, k))
                    place = np.repeat(start + (size + 1) / 2, size)
                weights[r][0] = place
                ranks, risks, errors, *firsts = weights[r] @ e
                aurc = (risks - (e[0] + errors / k) / 2) / k if k >= 2 else np.zeros(S)
                pairs = errors * (k - errors)
                auroc = (ranks - errors * (errors + 1) / 2) / np.where(pairs > 0, pairs, np.nan)
                acc = np.stack([1.0 - first / m if 0 < m <= k else np.full(S, np.nan) for m, first in zip(ends[r], firsts)], axis=1)
                out["pos"] += [pos] * S
                out["lane"] += [r] * S
                out["scheme_id"] += range(S)
                out["n"] += [k] * S
                for c, x in (("n_err", errors.astype(np.int64)), ("aurc", aurc), ("auroc", auroc), ("acc", acc)):
                    out[c] += x.tolist()
        types = {"pos": pa.int32(), "lane": pa.int32(), "scheme_id": pa.int64(), "n": pa.int64(), "n_err": pa.int64(), "aurc": pa.float64(), "auroc": pa.float64(), "acc": pa.list_(pa.float64())}
        made = {c: pa.array(x, t, from_pandas=True) for (c, x), t in zip(out.items(), types.values())}
        return pa.table({"set": pa.array([part.column("set")[0].as_py()] * len(out["n"]), pa.int64())} | made)

    found = lanes.groupBy("set").applyInArrow(kernel, "set bigint, pos int, lane int, scheme_id bigint, n bigint, n_err bigint, aurc double, auroc double, acc array<double>")
    err = F.col("n_err") / F.col("n")
    acc = [F.nanvl(F.col("acc")[i], F.lit(None).cast("double")).alias(cov_name(c)) for i, c in enumerate(coverages)]
    return found.join(F.broadcast(members), ["set", "pos"]).join(F.broadcast(thr), ["lane", "scheme_id"]).select(
        "score", F.col("lane").cast("bigint").alias("repeat"), "scheme", "p_bert", "p_rouge", "tau_bert", "tau_rouge", (F.lit(1.0) - err).alias("acc_joint"),
        err.alias("err_joint"), "auroc", "aurc", *acc, "n")


METRICS = ["tau_bert", "tau_rouge", "auroc", "aurc", "acc_joint"]


def summarize_repeats(per_rep: DataFrame, by: Sequence[str] = (), coverages=COVERAGES) -> DataFrame:
    """(by..., scheme, metric, n, mean, var, std) over repeats."""
    by = list(by)
    mets = METRICS + [cov_name(c) for c in coverages]
    long = per_rep.select(*by, "scheme", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in mets]))
        .alias("_m")).select(*by, "scheme", "_m.*")
    return long.groupBy(*by, "scheme", "metric").agg(*stats_1d("value"))


def summarize_shared(per_key: DataFrame, solutions: DataFrame, key: str, coverages=COVERAGES) -> DataFrame:
    """H10 of every solution, (solution, scheme, metric, n, mean, var, std), where ``solutions`` (solution, key) share the repeats of their
    key: summarized once for each different list of keys a solution has, and joined to the solutions."""
    keys = F.sort_array(F.collect_list(key))
    own = solutions.groupBy("solution").agg(keys.alias("_keys")).withColumn("_id", F.concat_ws(",", "_keys")).drop("_keys")
    lists = own.select("_id").distinct().select("_id", F.explode(F.split("_id", ",")).alias(key))
    lists = lists.withColumn(key, F.col(key).cast(per_key.schema[key].dataType))
    return own.join(summarize_repeats(lists.join(per_key, key), ["_id"], coverages), "_id").drop("_id")


def summarize_solutions(summary: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Statistics over per-solution means, per (group, scheme, metric)."""
    g = list(group_cols)
    return summary.groupBy(*g, "scheme", "metric").agg(*stats_1d("mean"))


# -- H13 -------------------------------------------------------------------------
def _pm(mean: Column, std: Column) -> Column:
    """Text cells of the few report rows, rounded from the binary value; the JVM's formatter rounds its shortest decimal form."""
    @F.pandas_udf("string")
    def cells(means: pd.Series, stds: pd.Series) -> pd.Series:
        return pd.Series(["" if pd.isna(m) else f"{m:.3f}" if pd.isna(s) else f"{m:.3f} ± {s:.3f}" for m, s in zip(means, stds)], dtype=object)
    return cells(mean, std)


def report_tables(across: DataFrame, model: str, coverages=COVERAGES):
    """Main, calibration and raw tables from the H12 long table.

    ``across`` = (scheme, metric, n, mean, var, std). Error std equals accuracy std.
    """
    def m(metric, stat):
        return F.max(F.when(F.col("metric") == metric, F.col(stat)))

    base = across.groupBy("scheme").agg(
        F.max("n").alias("n_solutions"),
        *[m(mt, st).alias(f"{mt}_{st}") for mt in METRICS + [cov_name(c) for c in coverages]
          for st in ("mean", "std", "var")])
    base = base.withColumn("Model", F.lit(model)).withColumnRenamed("scheme", "Scheme")
    main = base.select("Model", "Scheme",
                       _pm(F.col("auroc_mean"), F.col("auroc_std")).alias("AUROC"),
                       _pm(F.col("aurc_mean"), F.col("aurc_std")).alias("AURC"),
                       *[_pm(F.col(f"{cov_name(c)}_mean"), F.col(f"{cov_name(c)}_std"))
                         .alias(f"Acc@{int(round(c * 100))}") for c in coverages],
                       F.col("n_solutions").alias("n"))
    calib = base.select("Model", "Scheme",
                        _pm(F.col("tau_bert_mean"), F.col("tau_bert_std")).alias("tau_bert"),
                        _pm(F.col("tau_rouge_mean"), F.col("tau_rouge_std")).alias("tau_rouge"),
                        _pm(F.col("acc_joint_mean"), F.col("acc_joint_std")).alias("JointAcc"),
                        _pm(F.lit(1.0) - F.col("acc_joint_mean"), F.col("acc_joint_std")).alias("JointErr"),
                        F.col("n_solutions").alias("n"))
    raw = base.select("Model", "Scheme", "n_solutions",
                      *[c for c in base.columns if c not in ("Model", "Scheme", "n_solutions")])
    return main, calib, raw
