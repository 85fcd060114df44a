"""Candidate edges that hold the spanning tree of the mutual-reachability graph (S6), without a tree per pair of blocks.

(a) neighbour lists by the blocked kNN, a few longer than ``min_samples``;
(b) Boruvka over the lists: a component takes its least edge only if no row outside its rows' lists can have a smaller one, which
    the lists' last distances tell, so every edge taken is one of the tree. The step holds the lists as flat arrays, so it is one task
    a group up to ``LIST_VALUES`` list entries (a checked count); beyond them rows stay components of their own;
(c) the rows are cut into blocks by component, and every pair of blocks with different components is walked in tiles: one matrix
    product a tile, the least value for every two components, and of these what a spanning tree of the tile's components needs. Values
    within the product's error are measured again by direct differences. By the cycle property (b) and (c) hold the whole tree.

The trees of smaller min_samples are within the tree of the largest one and the lists of that length: a pair outside each other's lists
has the same weight for all of them, and the path that kept it out of the largest one's tree only gets lighter, in the order
(weight, low id, high id) as well.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from ..session import shuffle_partitions
from .blocks import DIFF_VALUES, knn

PAIR_BLOCK_ROWS = 1 << 14
TILE_ROWS = 1 << 10
LIST_VALUES = 1 << 25
SPARE = 12  # neighbours beyond min_samples: longer lists settle more edges


def neighbour_lists(points: DataFrame, k: int, by: list[str], queries: DataFrame | None = None) -> DataFrame:
    """(by..., row_id, ids, dists): the k nearest points in order, for every different row (the row itself left out) or for ``queries``."""
    own = queries is None
    q = (points if own else queries).dropDuplicates([*by, "row_id"]).repartition(max(shuffle_partitions(points.sparkSession), points.sparkSession.sparkContext.defaultParallelism))
    nn = knn(q, points, k, by=by, exclude_self=own)
    found = nn.groupBy(*by, F.col("q_id").alias("row_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "p_id", "dist"))).alias("_n"))
    return found.select(*by, "row_id", F.col("_n.p_id").alias("ids"), F.col("_n.dist").alias("dists"))


def flat_lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a table (row_id, ids, dists): its rows in order of row_id, the lists' lengths in that order, and the lists one after another."""
    table = table.combine_chunks()
    rows = table.column("row_id").to_numpy()
    order = np.argsort(rows, kind="stable")
    table = table.take(pa.array(order)).combine_chunks()
    ids, dists = (table.column(c).combine_chunks() for c in ("ids", "dists"))
    return rows[order], ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), ids.flatten().to_numpy(), dists.flatten().to_numpy()


def boruvka(n: int, lo: np.ndarray, hi: np.ndarray, w: np.ndarray, beyond: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(component of each of n nodes, indices of the edges taken) of the spanning forest under the order (w, lo, hi). ``beyond`` = (distance, node)
    a node: its edges that are not listed weigh at least that distance, and those of that weight lead to higher nodes only. A component
    whose least listed edge may not be its least edge then takes none."""
    order = np.lexsort((hi, lo, w))
    a, b, at = lo[order], hi[order], np.arange(len(order))
    comp, taken = np.arange(n), []
    while True:
        ca, cb = comp[a], comp[b]
        open_ = ca != cb
        a, b, at, ca, cb = a[open_], b[open_], at[open_], ca[open_], cb[open_]
        if not len(a):
            break
        none = len(a)
        best, other = np.full(n, none), np.full(n, none)
        back = np.arange(none)[::-1]
        best[ca[::-1]], other[cb[::-1]] = back, back  # edges are in order: the last write is the least edge
        best = np.minimum(best, other)
        if beyond is not None:
            e = np.minimum(best[comp], none - 1)
            wt, far, last, me = w[order[at[e]]], beyond[0], beyond[1], np.arange(n)
            first = (a[e] < np.minimum(me, last + 1)) | ((a[e] == me) & (b[e] <= last))
            unsure = (wt > far) | ((wt == far) & ~first)
            best[comp[unsure]] = none
        own = np.flatnonzero(best < none)
        if not len(own):
            break
        e = best[own]
        up = np.arange(n)
        up[own] = ca[e] + cb[e] - own
        mutual = own[(up[up[own]] == own) & (own < up[own])]
        up[mutual] = mutual
        while (up[up] != up).any():
            up = up[up]
        comp = up[comp]
        taken.append(np.unique(at[e]))
    return comp, order[np.concatenate(taken)] if taken else np.empty(0, dtype=np.int64)


def _settled(ms: int, k: int, block_rows: int, by: list[str]):
    """(b) for one group: rows (kind 0: row, component, block; kind 1: edge lo, hi, w)."""
    def run(table: pa.Table) -> pa.Table:
        ids, size, near, dist = flat_lists(table)
        n, end = len(ids), np.cumsum(size)
        core = dist[end - size + np.minimum(ms, size) - 1]
        a, b = np.repeat(np.arange(n), size), np.searchsorted(ids, near)
        w = np.maximum(dist, np.maximum(core[a], core[b]))
        whole = size < k  # such a list names all other rows
        beyond = np.where(whole, np.inf, dist[end - 1]), b[end - 1]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        comp, taken = boruvka(n, lo, hi, w, beyond)
        rows = np.bincount(comp, minlength=n)
        order = np.lexsort((comp, -rows[comp]))
        block = np.empty(n, dtype=np.int64)
        block[order] = np.arange(n) // block_rows
        m = len(taken)
        out = {"kind": np.r_[np.zeros(n, dtype=np.int32), np.ones(m, dtype=np.int32)], "a": np.r_[ids, ids[lo[taken]]], "b": np.r_[ids[comp], ids[hi[taken]]],
               "block": np.r_[block, np.zeros(m, dtype=np.int64)], "w": np.r_[core, w[taken]]}
        keys = {c: pa.array([table.column(c)[0].as_py()] * (n + m), table.schema.field(c).type) for c in by}
        return pa.table(keys | {c: pa.array(x) for c, x in out.items()})
    return run


def _bottlenecks(M: np.ndarray) -> np.ndarray:
    """The largest value on the path between every two nodes in the spanning tree of a full matrix: in the order in which Prim reaches the
    nodes it is the largest of the steps from one to the other."""
    n = len(M)
    best, left, order, step = M[0].copy(), np.ones(n, dtype=bool), np.zeros(n, dtype=np.int64), np.zeros(n)
    left[0] = False
    for i in range(1, n):
        rest = np.flatnonzero(left)
        t = rest[np.argmin(best[rest])]
        order[i], step[i] = t, best[t]
        left[t] = False
        np.minimum(best, M[t], out=best)
    out = np.zeros((n, n))
    for i in range(n - 1):
        out[order[i], order[i + 1:]] = out[order[i + 1:], order[i]] = np.maximum.accumulate(step[i + 1:])
    return out


def _exact(X, Y, cx, cy, rows, cols):
    dist, step = np.empty(len(rows)), max(1, DIFF_VALUES // X.shape[1])
    for s in range(0, len(rows), step):
        diff = X[rows[s:s + step]] - Y[cols[s:s + step]]
        dist[s:s + step] = np.sqrt((diff * diff).sum(1))
    return np.maximum(dist, np.maximum(cx[rows], cy[cols]))


def _tile(A: dict, B: dict, same: bool) -> list[tuple]:
    """Least edges (lo, hi, w) between components of two tiles of rows in order of component."""
    left = np.column_stack([-2.0 * A["X"], np.ones(len(A["X"])), A["sq"]])
    D = left @ np.column_stack([B["X"], B["sq"], np.ones(len(B["X"]))]).T
    np.maximum(D, B["core"] ** 2, out=D)
    sa, sb = (np.flatnonzero(np.diff(T["comp"], prepend=T["comp"][0] - 1)) for T in (A, B))
    R = D.min(axis=1)[:, None] if len(sb) == 1 else np.minimum.reduceat(D, sb, axis=1)
    R = np.maximum(R, (A["core"] ** 2)[:, None])
    C = np.minimum.reduceat(R, sa, axis=0)
    ca, cb = A["comp"][sa], B["comp"][sb]
    C[ca[:, None] == cb[None, :]] = np.inf
    if same:
        C[np.tril_indices(len(C))] = np.inf
    error = 1e-15 * (A["X"].shape[1] + 16) * (A["sq"].max() + B["sq"].max() + max(A["core"].max(), B["core"].max()) ** 2)
    need = np.isfinite(C)
    if C.size > 4 * (len(ca) + len(cb)):
        names, at = np.unique(np.r_[ca, cb], return_inverse=True)
        at = np.ix_(at[:len(ca)], at[len(ca):])
        M = np.full((len(names), len(names)), np.inf)
        M[at] = C
        need &= C <= _bottlenecks(np.minimum(M, M.T))[at] + 2 * error
    ea, eb, out = np.append(sa, len(D)), np.append(sb, D.shape[1]), []
    for i, j in zip(*np.nonzero(need)):
        most = C[i, j] + 2 * error
        rows = sa[i] + np.flatnonzero(R[sa[i]:ea[i + 1], j] <= most)
        r, c = np.nonzero(D[rows, sb[j]:eb[j + 1]] <= most)
        r, c = rows[r], sb[j] + c
        w = _exact(A["X"], B["X"], A["core"], B["core"], r, c)
        r, c, w = (x[w == w.min()] for x in (r, c, w))
        lo, hi = np.minimum(A["ids"][r], B["ids"][c]), np.maximum(A["ids"][r], B["ids"][c])
        e = np.lexsort((hi, lo))[0]
        out.append((lo[e], hi[e], w[e]))
    return out


def _between(by: list[str], tile_rows: int):
    """(c) for one pair of blocks."""
    def tiles(pdf: pd.DataFrame) -> list[dict]:
        pdf = pdf.sort_values("comp", kind="stable")
        X = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        whole = {"X": X, "sq": (X * X).sum(1), "core": pdf["core"].to_numpy(), "comp": pdf["comp"].to_numpy(), "ids": pdf["row_id"].to_numpy()}
        return [{k: x[s:s + tile_rows] for k, x in whole.items()} for s in range(0, len(X), tile_rows)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found, sides = [], [tiles(x) for _, x in pdf.groupby("block")]
        for i, A in enumerate(sides[0]):
            for j, B in enumerate(sides[-1]):
                if len(sides) == 1 and j < i or A["comp"][0] == A["comp"][-1] == B["comp"][0] == B["comp"][-1]:
                    continue
                found += _tile(A, B, len(sides) == 1 and i == j)
        out = pd.DataFrame(found, columns=["lo", "hi", "w"]).astype({"lo": "int64", "hi": "int64", "w": "float64"})
        for c in by:
            out.insert(0, c, pdf[c].iloc[0])
        return out[[*by, "lo", "hi", "w"]]
    return run


def tree_edges(points: DataFrame, lists: DataFrame, ms: int, k: int, by: list[str], block_rows: int = PAIR_BLOCK_ROWS, tile_rows: int = TILE_ROWS,
               list_values: int = LIST_VALUES) -> DataFrame:
    """(by..., lo, hi, w): written edges that hold the spanning tree of every group's mutual-reachability graph at ``ms``, from ``lists`` of the ``k`` nearest
    rows. Rows of one id are one node."""
    typed = "".join(f"`{c}` {points.schema[c].dataType.simpleString()}, " for c in by)
    keys = by or [F.lit(0).alias("_all")]
    most = lists.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most * k <= list_values:
        made = materialize(lists.groupBy(*keys).applyInArrow(_settled(ms, k, block_rows, by), f"{typed}kind int, a bigint, b bigint, block bigint, w double"))
        nodes = made.where("kind = 0").select(*by, F.col("a").alias("row_id"), F.col("b").alias("comp"), "block", F.col("w").alias("core"))
    else:
        made = None
        blocks = -(-most // block_rows)
        nodes = materialize(lists.select(*by, "row_id", F.col("row_id").alias("comp"), F.pmod(F.xxhash64("row_id"), F.lit(blocks)).alias("block"),
                                         F.get("dists", F.least(F.lit(ms), F.size("dists")) - 1).alias("core")))
    blocks = materialize(nodes.groupBy(*by, "block").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")))  # a row a block
    right = blocks.select(*[F.col(c).alias(f"r_{c}") for c in blocks.columns])
    mixed = ~((F.col("c0") == F.col("c1")) & (F.col("r_c0") == F.col("r_c1")) & (F.col("c0") == F.col("r_c0")))
    pairs = blocks.join(right, [F.col(c) == F.col(f"r_{c}") for c in by] + [F.col("block") <= F.col("r_block"), mixed])
    touch = pairs.select(*by, F.struct("block", "r_block").alias("pair"), F.explode(F.array_distinct(F.array("block", "r_block"))).alias("block"))
    x = nodes.join(F.broadcast(touch), [*by, "block"]).join(points.select(*by, "row_id", "v"), [*by, "row_id"])
    found = x.groupBy(*by, "pair").applyInPandas(_between(by, tile_rows), f"{typed}lo bigint, hi bigint, w double")
    if made is not None:
        found = found.unionByName(made.where("kind = 1").select(*by, F.col("a").alias("lo"), F.col("b").alias("hi"), "w"))
    return materialize(found.groupBy(*by, "lo", "hi").agg(F.min("w").alias("w")))
