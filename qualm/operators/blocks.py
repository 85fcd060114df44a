"""S2 (exact top-k) and S3 (pairwise log-density).

Points whose measured size is within ``BROADCAST_BYTES`` go to every executor
and the query side is read once, without a shuffle. Beyond that both sides are
cut into hash blocks of at most ``block_rows`` rows; each query block meets
each point block of the same ``by`` group once, through a ``cogroup`` on
(group, query block, point block). The same numpy kernels serve both ways, so
both give the same rows. Work is n x m, which an exact answer needs; memory per
task is two blocks, and a kernel holds at most ``DIFF_VALUES`` distances at
once. A large group (a hot cluster) simply gets more blocks, so no task ever
holds a whole group.
"""
from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 13  # a partial row of lanes holds folds x bandwidths sums, so fewer point blocks mean less to shuffle
KNN_BLOCK_ROWS = 1 << 14  # kernels walk a block in chunks, so it may be large: fewer copies of either side
DIFF_VALUES = 1 << 22  # differences held at once by a kernel
TERMS = 14  # of the series that stands for the exponentials of wide bandwidths
EXP_VALUES = 1 << 16  # distances whose exponentials are taken at once: they stay in the processor's cache
POINT_BLOCKS = 4  # a point block of the nearest neighbours in query blocks: every point block hands on k rows, or a row of lanes, a query
BROADCAST_BYTES = 32 << 20  # largest point side that is broadcast


def _sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("_cnt")) if by else df.agg(F.count("*").alias("_cnt"))


def _nblocks(cnt_col, block_rows):
    return F.greatest(F.lit(1), F.ceil(F.col(cnt_col) / F.lit(block_rows))).cast("int")


def _block_pairs(q: DataFrame, p: DataFrame, by: Sequence[str], block_rows: int, qid: str, pid: str, point_rows: int | None = None):
    """Attach (qb, pb) pair keys: queries are replicated over their group's point
    blocks and points over the group's query blocks. Block counts per group
    are computed lazily from group sizes (a table with one row per group)."""
    by = list(by)
    # block counts per group from one aggregate over both sides (no self-join
    # when queries and points come from the same frame)
    both = (q.select(*by, F.lit(1).alias("_side")).unionByName(p.select(*by, F.lit(2).alias("_side"))))
    nb = (both.groupBy(*by) if by else both.groupBy()).agg(
        F.count_if(F.col("_side") == 1).alias("_cq"), F.count_if(F.col("_side") == 2).alias("_cp"))
    nb = nb.filter((F.col("_cq") > 0) & (F.col("_cp") > 0)).select(
        *by, _nblocks("_cq", block_rows).alias("_nq"), _nblocks("_cp", point_rows or block_rows).alias("_np"))
    # nb has one row per group: broadcast it.
    qx = q.join(F.broadcast(nb), by) if by else q.crossJoin(F.broadcast(nb))
    px = p.join(F.broadcast(nb), by) if by else p.crossJoin(F.broadcast(nb))
    # block numbers are int on both sides: equal numbers of another type are dealt to other partitions and never meet
    own = lambda key, blocks: F.pmod(F.xxhash64(F.col(key)), F.col(blocks)).cast("int")
    qx = (qx.withColumn("_qb", own(qid, "_nq"))
            .withColumn("_pb", F.explode(F.sequence(F.lit(0), F.col("_np") - 1))))
    px = (px.withColumn("_pb", own(pid, "_np"))
            .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1))))
    return qx.drop("_nq", "_np"), px.drop("_nq", "_np")


def _small_points(p: DataFrame, vec: str, max_bytes: int) -> pd.DataFrame | None:
    """The points as a pandas frame if they measure at most ``max_bytes``, else None. At most one row more than fits
    is fetched."""
    first = p.select(vec).first()
    most = max_bytes // (8 * (len(first[0]) + len(p.columns))) if first else 0
    rows = p.limit(most + 1).toArrow() if first else p.limit(0).toArrow()
    return rows.to_pandas() if rows.num_rows <= most else None


def _per_group(points: pd.DataFrame, by: list[str]) -> dict:
    """Group key -> its points; the empty key for all of them if ungrouped."""
    return {k: g for k, g in points.groupby(by, sort=False)} if by else {(): points}


def _broadcast_map(q: DataFrame, points: pd.DataFrame, by: list[str], kern, schema: str) -> DataFrame:
    """``kern`` over each Arrow batch of queries and the broadcast points of their group."""
    shared = q.sparkSession.sparkContext.broadcast(_per_group(points, by))

    def run(batches):
        for batch in batches:
            parts = batch.groupby(by, sort=False) if by else [((), batch)]
            for key, part in parts:
                if (own := shared.value.get(key)) is not None and len(part) and len(own):
                    yield kern(part, own)
    return q.mapInPandas(run, schema)


def _select_topk(Q, P, qids, pids, k, exclude_self):
    """Exact k smallest distances per query row of Q against P (ties by point id), for chunks of queries."""
    step = max(1, DIFF_VALUES // max(1, P.shape[0]))
    parts = [(s, _select_topk_chunk(Q[s:s + step], P, qids[s:s + step], pids, k, exclude_self)) for s in range(0, len(Q), step)]
    return (np.concatenate([qi + s for s, (qi, _, _) in parts]), np.concatenate([pj for _, (_, pj, _) in parts]),
            np.concatenate([d for _, (_, _, d) in parts]))


def _kth_bound(d2, kk):
    """No less than the kk-th smallest value of each row and close to it: the kk-th smallest of the minima of many column sets."""
    sets = max(256, 8 * kk)
    deep = d2.shape[1] // sets
    if deep < 2:
        return np.partition(d2, kk - 1, axis=1)[:, kk - 1]
    bound = np.partition(np.fmin.reduce(d2[:, :deep * sets].reshape(len(d2), deep, sets), axis=1), kk - 1, axis=1)[:, kk - 1]
    if len(odd := np.flatnonzero(~np.isfinite(bound))):
        bound[odd] = np.partition(d2[odd], kk - 1, axis=1)[:, kk - 1]
    return bound


def _select_topk_chunk(Q, P, qids, pids, k, exclude_self):
    qn = (Q * Q).sum(1)
    pn = (P * P).sum(1)
    d2 = Q @ P.T  # squared distances without the query's own square, the same for all its points
    d2 *= -2.0
    d2 += pn
    if exclude_self:
        d2[qids[:, None] == pids[None, :]] = np.inf
    kk = min(k, P.shape[0])
    part = _kth_bound(d2, kk)
    # exact selection: keep everything within a bound of the matrix-product error,
    # then re-measure survivors by direct difference and sort by (dist, id).
    tol = 1e-9 * (qn + pn.max() + 1.0)
    qi, pj = np.nonzero(d2 <= (part + tol)[:, None])
    dist, step = np.empty(len(qi)), max(1, DIFF_VALUES // Q.shape[1])
    for s in range(0, len(qi), step):  # many equal rows leave many survivors
        diff = Q[qi[s:s + step]] - P[pj[s:s + step]]
        dist[s:s + step] = np.sqrt((diff * diff).sum(1))
    if exclude_self:
        keep = qids[qi] != pids[pj]
        qi, pj, dist = qi[keep], pj[keep], dist[keep]
    order = np.lexsort((pids[pj], dist, qi))
    qi, pj, dist = qi[order], pj[order], dist[order]
    starts = np.r_[0, np.flatnonzero(np.diff(qi)) + 1]
    rank = np.arange(len(qi)) - np.repeat(starts, np.diff(np.r_[starts, len(qi)]))
    sel = rank < kk
    return qi[sel], pj[sel], dist[sel]


def _topk_kernel(k: int, qid: str, pid: str, vec: str, by: list[str], exclude_self: bool,
                 point_group: str | None = None):
    def run(qdf: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        cols = [*by, "q_id", *(["pg"] if point_group else []), "p_id", "dist"]
        if len(qdf) == 0 or len(pdf) == 0:
            return pd.DataFrame({c: [] for c in cols})
        Q = np.stack(qdf[vec].to_numpy()).astype(np.float64)
        P = np.stack(pdf[vec].to_numpy()).astype(np.float64)
        qids, pids = qdf[qid].to_numpy(), pdf[pid].to_numpy()
        parts = []
        groups = [(None, np.arange(len(pdf)))] if not point_group else \
            [(g, np.flatnonzero(pdf[point_group].to_numpy() == g)) for g in np.unique(pdf[point_group].to_numpy())]
        for g, idx in groups:
            qi, pj, dist = _select_topk(Q, P[idx], qids, pids[idx], k, exclude_self)
            part = pd.DataFrame({"q_id": qids[qi], "p_id": pids[idx][pj], "dist": dist})
            if point_group:
                part.insert(1, "pg", g)
            parts.append(part)
        out = pd.concat(parts, ignore_index=True)
        for b in by:
            out.insert(0, b, qdf[b].iloc[0])
        return out[cols]
    return run


def _ranked(kern, keys: list[str]):
    """``kern`` with each row's rank: all points of the group were seen, and rows come ordered."""
    def run(qdf: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        out = kern(qdf, pdf)
        return out.assign(rank=out.groupby(keys, sort=False).cumcount() + 1)
    return run


def knn(queries: DataFrame, points: DataFrame, k: int, by: Sequence[str] = (), qid: str = "row_id",
        pid: str = "row_id", vec: str = "v", block_rows: int = KNN_BLOCK_ROWS,
        exclude_self: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Exact k nearest points per query row (Euclidean), within ``by`` groups.

    Returns (by..., q_id, p_id, rank, dist) with rank 1..min(k, group size),
    ties broken by point id. ``exclude_self`` drops pairs with equal ids
    (self-join use).
    """
    by = list(by)
    # re-alias group columns on each side: fresh attributes, so a self-join
    # (queries and points from one frame) is never ambiguous
    q = queries.select(*[F.col(b).alias(b) for b in by], F.col(qid).alias("_qid"), F.col(vec).alias("_v"))
    p = points.select(*[F.col(b).alias(b) for b in by], F.col(pid).alias("_pid"), F.col(vec).alias("_v"))
    schema = ", ".join([f"`{b}` {queries.schema[b].dataType.simpleString()}" for b in by] +
                       ["q_id bigint", "p_id bigint", "dist double"])
    kern = _topk_kernel(k, "_qid", "_pid", "_v", by, exclude_self)
    if (small := _small_points(p, "_v", broadcast_bytes)) is not None:
        return _broadcast_map(q, small, by, _ranked(kern, ["q_id"]), f"{schema}, rank bigint")
    qx, px = _block_pairs(q, p, by, block_rows, "_qid", "_pid", POINT_BLOCKS * block_rows)
    cand = (qx.groupBy(*by, "_qb", "_pb")
              .cogroup(px.groupBy(*by, "_qb", "_pb"))
              .applyInPandas(kern, schema))
    # merge: at most k candidates per point block for each query row
    w = Window.partitionBy(*by, "q_id").orderBy("dist", "p_id")
    return (cand.withColumn("rank", F.row_number().over(w).cast("bigint"))
                .filter(F.col("rank") <= k))


def knn_mean_distance(queries: DataFrame, points: DataFrame, k: int, by: Sequence[str] = (),
                      qid: str = "row_id", pid: str = "row_id", vec: str = "v", out_col: str = "uq",
                      block_rows: int = KNN_BLOCK_ROWS) -> DataFrame:
    """F1 core: mean distance to the k nearest points -> (by..., row_id, uq)."""
    nn = knn(queries, points, k, by, qid, pid, vec, block_rows)
    return nn.groupBy(*by, F.col("q_id").alias(qid)).agg(F.avg("dist").alias(out_col))


def knn_per_point_group(queries: DataFrame, points: DataFrame, k: int, group_col: str, qid: str = "row_id",
                        pid: str = "row_id", vec: str = "v", block_rows: int = KNN_BLOCK_ROWS,
                        broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Exact k nearest points of every point group (e.g. cluster) per query row,
    in one pass over the block pairs: queries are not copied per group.
    Returns (q_id, <group_col>, p_id, rank, dist)."""
    q = queries.select(F.col(qid).alias("_qid"), F.col(vec).alias("_v"))
    p = points.select(F.col(pid).alias("_pid"), F.col(vec).alias("_v"), F.col(group_col).alias("_pg"))
    gtype = points.schema[group_col].dataType.simpleString()
    kern = _topk_kernel(k, "_qid", "_pid", "_v", [], False, point_group="_pg")
    if (small := _small_points(p, "_v", broadcast_bytes)) is not None:
        found = _broadcast_map(q, small, [], _ranked(kern, ["q_id", "pg"]), f"q_id bigint, pg {gtype}, p_id bigint, dist double, rank bigint")
        return found.withColumnRenamed("pg", group_col)
    qx, px = _block_pairs(q, p, [], block_rows, "_qid", "_pid", POINT_BLOCKS * block_rows)
    cand = (qx.groupBy("_qb", "_pb").cogroup(px.groupBy("_qb", "_pb"))
              .applyInPandas(kern, f"q_id bigint, pg {gtype}, p_id bigint, dist double"))
    w = Window.partitionBy("q_id", "pg").orderBy("dist", "p_id")
    return (cand.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
                .withColumnRenamed("pg", group_col))


# ----------------------------------------------------------------------------- S3
def _exp_sums(t: np.ndarray, scale: np.ndarray, held: np.ndarray) -> np.ndarray:
    """rows x scales: the sums over columns of exp(scale * t), t at most 0. Scales that make little of the range of t share its power sums: around
    the middle of the range the series to TERMS terms leaves less than a rounding error."""
    out, half = np.empty((len(t), len(scale))), -t.min() / 2
    wide = scale * half <= 0.5
    if wide.sum() <= TERMS // 2 or half == 0:
        wide = np.zeros(len(scale), dtype=bool)
    for b in np.flatnonzero(~wide):
        out[:, b] = np.exp(np.multiply(t, scale[b], out=held), out=held).sum(1)
    if wide.any():
        u = t / half
        u += 1.0
        powers = np.empty((TERMS, len(t)))
        powers[0], powers[1] = t.shape[1], u.sum(1)
        np.multiply(u, u, out=held)
        for i in range(2, TERMS):
            powers[i] = held.sum(1)
            np.multiply(held, u, out=held)
        x = scale[wide] * half
        series = np.cumprod(np.vstack([np.ones(len(x)), x[None] / np.arange(1, TERMS)[:, None]]), axis=0)
        out[:, wide] = (powers.T @ series) * np.exp(-x)
    return out


def _lane_kernel(bandwidths: np.ndarray, n_folds: int, fold_col: str | None, by: list[str], keep: list[str], apart: str | None = None):
    """A row per query: per point fold the smallest squared distance and the count, per (fold, bandwidth) the sum of
    exp(-(d^2 - smallest) / (2 h^2)). A fold without points has an infinite distance and sums of 0, and so has the fold that a query's ``apart`` names."""
    scale = 1.0 / (2.0 * bandwidths * bandwidths)

    def run(qdf: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        cols = [*by, "q_id", *keep, "near", "sums", "cnt"]
        if len(qdf) == 0 or len(pdf) == 0:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in cols})  # an empty float column does not become a list
        Q = np.stack(qdf["_v"].to_numpy()).astype(np.float64)
        P = np.stack(pdf["_v"].to_numpy()).astype(np.float64)
        folds = pdf["_fold"].to_numpy() if fold_col else np.zeros(len(pdf), dtype=np.int64)
        members = [np.flatnonzero(folds == f) for f in range(n_folds)]
        near, sums = np.full((len(Q), n_folds), np.inf), np.zeros((len(Q), n_folds, len(scale)))
        left = np.column_stack([-2.0 * Q, np.ones(len(Q)), (Q * Q).sum(1)])
        own = qdf[apart].to_numpy() if apart else np.full(len(Q), -1)
        for f, at in enumerate(members):
            if not len(at):
                continue
            right = np.ascontiguousarray(np.column_stack([P[at], (P[at] * P[at]).sum(1), np.ones(len(at))]).T)
            rows, step, few = np.flatnonzero(own != f), max(1, DIFF_VALUES // 4 // len(at)), max(1, EXP_VALUES // len(at))
            for lo in range(0, len(rows), step):
                r = rows[lo:lo + step]
                t = np.maximum(left[r] @ right, 0.0)
                low = near[r, f] = t.min(1)
                np.subtract(low[:, None], t, out=t)
                held = np.empty_like(t[:few])
                for i in range(0, len(r), few):
                    sums[r[i:i + few], f] = _exp_sums(t[i:i + few], scale, held[:len(r) - i])
        out = {b: [qdf[b].iloc[0]] * len(Q) for b in by}
        out |= {"q_id": qdf["_qid"].to_numpy(), **{c: qdf[c].to_numpy() for c in keep}}
        out |= {"near": list(near), "sums": list(sums.reshape(len(Q), -1)), "cnt": [[len(m) for m in members]] * len(Q)}
        return pd.DataFrame(out)[cols]
    return run


def _merge_lanes(keys: list[str], scale: np.ndarray):
    """Runs of equal keys in a sorted stream become one row each; the last row of a batch waits for the next batch, so
    a batch and one row are all that is held, however many point blocks a query met."""
    def merge(b: pd.DataFrame) -> pd.DataFrame:
        new = np.zeros(len(b), dtype=bool)
        new[0] = True
        for k in keys:
            new[1:] |= b[k].to_numpy()[1:] != b[k].to_numpy()[:-1]
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        near, cnt = np.stack(b["near"].to_numpy()), np.stack(b["cnt"].to_numpy())
        sums = np.stack(b["sums"].to_numpy()).reshape(len(b), near.shape[1], len(scale))
        least = np.minimum.reduceat(near, starts)
        gap = np.where(np.isfinite(near), near - np.where(np.isfinite(least), least, 0.0)[group], 0.0)
        total = np.add.reduceat(sums * np.exp(-gap[:, :, None] * scale), starts)
        return b.iloc[starts].assign(near=list(least), sums=list(total.reshape(len(starts), -1)), cnt=list(np.add.reduceat(cnt, starts)))

    def run(batches):
        last = None
        for b in batches:
            b = b if last is None else pd.concat([last, b], ignore_index=True)
            if len(b):
                b = merge(b)
                last = b.iloc[-1:]
                yield b.iloc[:-1]
        if last is not None:
            yield last
    return run


def log_density_lanes(queries: DataFrame, points: DataFrame, bandwidths: Sequence[float], by: Sequence[str] = (),
                      fold_col: str | None = None, n_folds: int = 1, qid: str = "row_id", pid: str = "row_id", vec: str = "v",
                      keep: Sequence[str] = (), apart: str | None = None, block_rows: int = BLOCK_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """S3: a row per (by..., query) with fixed-width lanes: ``near`` (smallest squared distance per point fold), ``sums``
    (fold x bandwidth, sums of exp(-(d^2 - near) / (2 h^2))) and ``cnt`` (points per fold). Folds are 0 .. n_folds - 1.
    ``keep`` names query columns that are passed on, ``apart`` one of them, the fold that a query is not measured against. A query without points of its group has no row.

    A small point side is broadcast, and a query row is final at once. Beyond it a query row comes once per point block;
    those partial rows meet by key and are merged in a sorted stream."""
    by, keep, bw = list(by), list(keep), np.asarray(bandwidths, dtype=np.float64)
    q = queries.select(*[F.col(b).alias(b) for b in by], F.col(qid).alias("_qid"), F.col(vec).alias("_v"), *[F.col(c).alias(c) for c in keep])
    p = points.select(*[F.col(b).alias(b) for b in by], F.col(pid).alias("_pid"), F.col(vec).alias("_v"),
                      *([F.col(fold_col).alias("_fold")] if fold_col else []))
    typed = lambda cs: [f"`{c}` {queries.schema[c].dataType.simpleString()}" for c in cs]
    schema = ", ".join([*typed(by), "q_id bigint", *typed(keep), "near array<double>, sums array<double>, cnt array<bigint>"])
    kern = _lane_kernel(bw, n_folds, fold_col, by, keep, apart)
    if (small := _small_points(p, "_v", broadcast_bytes)) is not None:
        return _broadcast_map(q, small, by, kern, schema)
    qx, px = _block_pairs(q, p, by, block_rows, "_qid", "_pid", POINT_BLOCKS * block_rows)
    parts = qx.groupBy(*by, "_qb", "_pb").cogroup(px.groupBy(*by, "_qb", "_pb")).applyInPandas(kern, schema)
    key = [*by, "q_id"]
    return parts.repartition(*key).sortWithinPartitions(*key).mapInPandas(_merge_lanes(key, 1.0 / (2.0 * bw * bw)), schema)


def log_density_parts(queries: DataFrame, points: DataFrame, bandwidths: Sequence[float],
                      by: Sequence[str] = (), fold_col: str | None = None, n_folds: int = 5, qid: str = "row_id",
                      pid: str = "row_id", vec: str = "v", block_rows: int = BLOCK_ROWS,
                      broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The lanes in long form: (by..., q_id, fold, bw_idx, lse, cnt) with the log-sum-exp of -|q-p|^2 / (2 h^2)."""
    by, nb = list(by), len(bandwidths)
    lanes = log_density_lanes(queries, points, bandwidths, by, fold_col, n_folds if fold_col else 1, qid, pid, vec, (), None, block_rows, broadcast_bytes)
    folds = lanes.select(*by, "q_id", "sums", "cnt", F.posexplode("near").alias("fold", "_near")).where(F.col("_near") < float("inf"))
    cells = folds.select(*by, "q_id", F.col("fold").cast("bigint").alias("fold"), "_near", F.get("cnt", F.col("fold")).alias("cnt"),
                         F.posexplode(F.slice("sums", F.col("fold") * nb + 1, F.lit(nb))).alias("bw_idx", "_s"))
    h = F.get(F.array(*[F.lit(float(x)) for x in bandwidths]), F.col("bw_idx"))
    return cells.select(*by, "q_id", "fold", F.col("bw_idx").cast("bigint").alias("bw_idx"), "cnt", (F.log("_s") - F.col("_near") / (2 * h * h)).alias("lse"))
