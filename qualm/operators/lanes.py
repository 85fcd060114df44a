"""Selective metrics of many calibration splits and threshold schemes in one ordering (H4-H9).

A row carries which repeats drew it for calibration (``calib``, a boolean a repeat) and which schemes call it correct in which
repeat (``ok``, repeats x schemes booleans). Rows are cut once into order buckets by (uq, row_id) and shuffled once; a bucket's
kernel keeps a running count and a running error sum a lane, from the totals of the buckets before it (a table of groups x buckets rows).
Ties of ``uq`` may span buckets: a bucket sums the ties inside it and hands on its first and last tie, which are summed over
buckets before they count.
"""
from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .order import PREFIX, crossing_prefixes, hash_key, order_buckets
from .quantile import exact_quantiles

LANE_BUCKET_ROWS = 1 << 16
METRIC, TIE, CURVE = range(3)


def draw_repeats(scores: DataFrame, n_repeats: int, seed_base: int, eligible: Column, frac: float, by: Sequence[str] = (), id_col: str = "row_id") -> DataFrame:
    """``scores`` with ``calib``: whether repeat r drew the row, from round-half-even(frac x eligible) rows with the least md5(seed:id).
    Every draw is known by its last row alone, so a row finds its repeats by itself. Rows are hashed twice: for the count by md5 prefix, and
    for the written rows, which know the repeats that surely drew them and keep the hash of those in whose crossing prefix they lie, 1 in 4,096."""
    by, each = list(by), range(n_repeats)
    eligible = F.coalesce(eligible, F.lit(False))
    pool = scores.where(eligible).select(*by, id_col)
    sizes = pool.groupBy(*by).agg(F.bround(F.lit(float(frac)) * F.count(F.lit(1)), 0).cast("bigint").alias("_n"))
    hashes = F.array(*[hash_key(seed_base + r, id_col) for r in each])
    prefixes = pool.select(*by, F.posexplode(hashes).alias("_r", "_h")).select(*by, "_r", F.substring("_h", 1, PREFIX).alias("_p"))
    crossing = materialize(crossing_prefixes(prefixes, sizes, by, [*by, "_r"]))
    listed = lambda c: F.expr(f"transform(sequence(0, {n_repeats - 1}), i -> _m[i].{c})")
    found = crossing.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_r", F.struct("_p", "_need")))).alias("_m")).select(*by, listed("_p").alias("_at"))
    rows = scores.join(F.broadcast(found), by, "left") if by else scores.crossJoin(F.broadcast(found))
    rows = rows.withColumn("_hs", F.when(eligible, hashes))
    # a hash is longer than a prefix; a null id is before all hashes. Lists are made by lambdas: written out, they pass the size a JVM compiles
    rows = rows.withColumn("_sure", F.expr("transform(_hs, (h, r) -> coalesce(h < _at[r], _at[r] is not null))"))
    rows = rows.withColumn("_near", F.expr("transform(_hs, (h, r) -> if(startswith(h, _at[r]), h, null))")).drop("_hs", "_at")
    rows = materialize(rows.withColumn("_near", F.when(F.exists("_near", lambda x: x.isNotNull()), F.col("_near"))))
    ranked = rows.where("_near is not null").select(*by, id_col, F.posexplode("_near").alias("_r", "_h")).where("_h is not null")
    place = Window.partitionBy(*by, "_r").orderBy("_h", id_col)
    cuts = ranked.withColumn("_rn", F.row_number().over(place)).join(F.broadcast(crossing.select(*by, "_r", "_need")), [*by, "_r"]).where("_rn = _need")
    last = cuts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_r", F.struct("_h", id_col).alias("_c")))).alias("_cuts"))
    rows = rows.join(F.broadcast(last), by, "left") if by else rows.crossJoin(F.broadcast(last))
    none = F.array(*[F.lit(False) for _ in each])
    drawn = F.expr(f"if(_near is null, _sure, transform(_sure, (x, r) -> x or (_near[r] is not null and struct(_near[r], `{id_col}`) <= _cuts[r])))")
    return rows.withColumn("calib", F.coalesce(drawn, none)).drop("_cuts", "_sure", "_near")


def lane_thresholds(rows: DataFrame, schemes: DataFrame, n_repeats: int, by: Sequence[str] = ()) -> DataFrame:
    """H2 of every repeat: (by..., lane, scheme_id, scheme, p_bert, p_rouge, tau_bert, tau_rouge)."""
    by = list(by)
    stacked = rows.select(*by, "calib", F.explode(F.array(F.struct(F.lit("b").alias("metric"), F.col("bertscore_f1").cast("double").alias("x")),
                                                          F.struct(F.lit("r").alias("metric"), F.col("rougeL").cast("double").alias("x")))).alias("s"))
    asked = [schemes.select("scheme_id", F.lit(m).alias("metric"), (F.col(p) / 100).alias("q")) for m, p in (("b", "p_bert"), ("r", "p_rouge"))]
    found = exact_quantiles(stacked.select(*by, "calib", "s.metric", "s.x"), "x", asked[0].unionByName(asked[1]), [*by, "metric"], "tau", "calib", n_repeats)
    tau = lambda m: F.max(F.when(F.col("metric") == m, F.col("tau")))
    return found.groupBy(*by, "lane", "scheme_id").agg(tau("b").alias("tau_bert"), tau("r").alias("tau_rouge")).join(schemes, "scheme_id")


def _flags(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(bool)


def _lane_errors(calib: np.ndarray, ok: np.ndarray, n_schemes: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a row counts in a repeat, and whether it is an error there, a column a lane."""
    there = ~calib
    return there, np.repeat(there, n_schemes, axis=1) & ~ok


def lane_metrics(rows: DataFrame, n_repeats: int, n_schemes: int, coverages: Sequence[float], by: Sequence[str] = (), curve: bool = False,
                 num_buckets: int | None = None) -> DataFrame:
    """Per (by..., lane, scheme_id): n, n_err, aurc, auroc and a list ``acc`` by coverage, of rows (by..., row_id, uq, calib, ok); with
    ``curve`` also the written table (by..., lane, scheme_id, m, n, risk)."""
    by, R, S = list(by), n_repeats, n_schemes
    uq = F.coalesce(F.when(F.isnan("uq"), F.lit(float("inf"))).otherwise(F.col("uq").cast("double")), F.lit(float("-inf")))  # null least, NaN most uncertain
    cut = materialize(order_buckets(rows.select(*by, "row_id", uq.alias("uq"), "calib", "ok"), ["uq", "row_id"], by, num_buckets, LANE_BUCKET_ROWS))
    types = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    keys = [*by, "_bucket"]
    key_schema = ", ".join(f"{c} {types[c]}" for c in keys)

    def totals(batches):
        for b in batches:
            if not b.num_rows:
                continue
            there, errors = _lane_errors(_flags(b.column("calib"), R), _flags(b.column("ok"), R * S), S)
            groups = b.select(keys).to_pandas().groupby(keys, dropna=False, sort=False)
            code = groups.ngroup().to_numpy()
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            sums = [np.add.reduceat(x[order].astype(np.int64), first, axis=0) for x in (there, errors)]
            heads = pa.Table.from_batches([b.select(keys)]).take(pa.array(order[first]))
            yield from heads.append_column("n", pa.array(sums[0].tolist(), pa.list_(pa.int64()))).append_column(
                "e", pa.array(sums[1].tolist(), pa.list_(pa.int64()))).to_batches()

    part = cut.select(*keys, "calib", "ok").mapInArrow(totals, f"{key_schema}, n array<long>, e array<long>")
    summed = part.groupBy(*keys).agg(*[F.expr(f"array({', '.join(f'sum({c}[{i}])' for i in range(width))}) as {c}") for c, width in (("n", R), ("e", R * S))])

    def running(table: pa.Table) -> pa.Table:
        """Totals of a group's earlier buckets and of the group."""
        table = table.sort_by("_bucket")
        for c, width in (("n", R), ("e", R * S)):
            x = table.column(c).combine_chunks().flatten().to_numpy().reshape(-1, width)
            table = table.append_column(f"{c}_before", pa.array((np.cumsum(x, axis=0) - x).tolist(), pa.list_(pa.int64())))
            table = table.append_column(f"{c}_all", pa.array([x.sum(axis=0).tolist()] * len(x), pa.list_(pa.int64())))
        return table.drop_columns(["n", "e"])

    before_schema = f"{key_schema}, n_before array<long>, n_all array<long>, e_before array<long>, e_all array<long>"
    before = materialize(summed.groupBy(*by).applyInArrow(running, before_schema))  # at most three times MAX_BUCKETS rows a group

    out_schema = pa.schema([("kind", pa.int32()), ("lane", pa.int32()), ("scheme_id", pa.int64()), ("uq", pa.float64()), ("risks", pa.float64()), ("first", pa.float64()),
                            ("last", pa.float64()), ("acc", pa.list_(pa.float64())), ("auc", pa.float64()), ("below", pa.int64()), ("neg", pa.int64()), ("pos", pa.int64()), ("m", pa.int64())])
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), "kind int, lane int, scheme_id long, uq double, risks double, first double, last double, acc array<double>, auc double, "
                        "below long, neg long, pos long, m long"])

    def kernel(table: pa.Table, heads: pa.Table) -> pa.Table:
        table, head = table.sort_by([("uq", "ascending"), ("row_id", "ascending")]), heads.select(["n_before", "n_all", "e_before"]).to_pylist()[0]
        there, errors = _lane_errors(_flags(table.column("calib"), R), _flags(table.column("ok"), R * S), S)
        uqs, out, curves = table.column("uq").to_numpy(), [], []
        for r in range(R):
            on, n, m0 = there[:, r], head["n_all"][r], head["n_before"][r]
            if not on.any():
                continue
            err = errors[on, r * S:(r + 1) * S].astype(np.int64)
            u, m = uqs[on], m0 + 1 + np.arange(on.sum())
            e0 = np.array(head["e_before"][r * S:(r + 1) * S], dtype=np.int64)
            cum = e0 + np.cumsum(err, axis=0)
            risk = cum / m[:, None]
            start = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            size = np.diff(np.append(start, len(u)))
            pos = np.add.reduceat(err, start, axis=0)
            neg = size[:, None] - pos
            below = (m[start] - 1)[:, None] - (cum[start] - err[start])
            inner = slice(1, -1)
            auc = (pos[inner] * (below[inner] + neg[inner] / 2)).sum(axis=0)
            at = [math.ceil(c * n) - m0 - 1 for c in coverages]
            for s in range(S):
                acc = [1.0 - risk[i, s] if 0 <= i < len(m) else None for i in at]
                out.append((METRIC, r, s, None, risk[:, s].sum(), risk[0, s] if m0 == 0 else None, risk[-1, s] if m[-1] == n else None, acc, auc[s], None, None, None, None))
                out += [(TIE, r, s, u[start[i]], None, None, None, None, None, below[i, s], neg[i, s], pos[i, s], None) for i in sorted({0, len(start) - 1})]
            if curve:
                empty = pa.nulls(len(m))
                for s in range(S):
                    values = {"kind": np.full(len(m), CURVE), "lane": np.full(len(m), r), "scheme_id": np.full(len(m), s), "risks": risk[:, s], "m": m, "pos": np.full(len(m), n)}
                    curves.append(pa.Table.from_arrays([pa.array(values[f.name], f.type) if f.name in values else empty.cast(f.type) for f in out_schema], schema=out_schema))
        columns = list(zip(*out)) or [[]] * len(out_schema)
        made = pa.concat_tables([pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema)], schema=out_schema), *curves])
        return pa.Table.from_arrays([*[pa.array(heads.column(c).to_pylist() * len(made), heads.schema.field(c).type) for c in by], *made.columns], names=[*by, *made.column_names])

    found = cut.groupBy(*keys).cogroup(before.groupBy(*keys)).applyInArrow(kernel, schema)
    found = materialize(found) if curve else found
    lane = [*by, "lane", "scheme_id"]
    sums = found.where(F.col("kind") != CURVE).groupBy(*lane, "kind", "uq").agg(
        *[F.sum(c).alias(c) for c in ("risks", "auc", "neg", "pos")], *[F.max(c).alias(c) for c in ("first", "last")], F.min("below").alias("below"),
        *[F.max(F.col("acc")[i]).alias(f"acc{i}") for i in range(len(coverages))])
    edges = F.when(F.col("kind") == TIE, F.col("pos") * (F.col("below") + F.col("neg") / 2))  # a tie in whole
    main = sums.groupBy(*lane).agg(
        F.sum("risks").alias("_risks"), F.max("first").alias("_first"), F.max("last").alias("_last"), F.sum("auc").alias("_inner"), F.sum(edges).alias("_edges"),
        F.array(*[F.max(f"acc{i}") for i in range(len(coverages))]).alias("acc"))
    whole = (before.select(*by, "n_all", "e_all").distinct().select(*by, "n_all", F.posexplode("e_all").alias("_l", "n_err"))
             .select(*by, (F.col("_l") / S).cast("int").alias("lane"), (F.col("_l") % S).cast("bigint").alias("scheme_id"), "n_err",
                     F.col("n_all")[(F.col("_l") / S).cast("int")].alias("n")))
    n, pos = F.col("n"), F.col("n_err").cast("double")
    per = main.join(whole, lane).select(
        *lane, "n", "n_err", "acc",
        F.when(n < 2, F.lit(0.0)).otherwise((F.col("_risks") - (F.col("_first") + F.col("_last")) / 2) / n).alias("aurc"),
        ((F.col("_inner") + F.col("_edges")) / F.nullif(pos * (n - pos), F.lit(0.0))).alias("auroc"))
    if not curve:
        return per
    return per, found.where(F.col("kind") == CURVE).select(*lane, "m", F.col("pos").alias("n"), F.col("risks").alias("risk"))
