"""Configuration sweep with the HDBSCAN score (I2, H11 with F4), stages shared.

Configurations are rows (cfg, space, min_cluster_size, min_samples, epsilon,
n_neighbors); ``space`` names a vector space (e.g. a reduced dimension) of the
points table. Work is shared across the table:

* one self-kNN per space at the largest min_samples gives every core distance;
* one set of candidate edges per space (``spanning.py``): with the neighbour lists it holds the tree of every min_samples;
* one dendrogram per (space, min_samples), one condensation per min_cluster_size on it, one labelling per different selection;
* one list of nearest points per evaluation row and space: a cluster's nearest rows are those of the list with its label, and where
  the list has too few of them the cluster's rows are searched; the list itself serves every fallback;
* one lane of scores per (labelling, n_neighbors), a row of lanes per (labelling, evaluation row).

A labelling task holds one space's rows, checked against ``edges_per_task``; for a larger space every configuration goes through the
distributed single-configuration path instead (configurations are one row each, bounded by the search budget).
"""
from __future__ import annotations

import zlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from . import hdbscan as H
from .blocks import _select_topk
from .spanning import SPARE, boruvka, flat_lists, neighbour_lists, tree_edges
from .sweep import objectives

MS_SHARES = 10  # tasks that share out the values of min_samples of a space
LISTED = 128  # nearest points of an evaluation row
EVAL_ROWS = 1 << 13  # evaluation rows of a scoring task
SETS = 32  # labellings of a scoring task


class SweepTooLarge(ValueError):
    """A space is larger than the shared bounded path allows."""


# ----------------------------------------------------------------------------- labellings
def _dendrogram(n: int, lo: np.ndarray, hi: np.ndarray):
    """(left, right, up, size) of the single-linkage tree: edges come in order, node n + i is the i-th merge."""
    top, left, right = list(range(2 * n - 1)), [0] * (n - 1), [0] * (n - 1)
    for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist())):
        while top[a] != a:
            top[a] = a = top[top[a]]
        while top[b] != b:
            top[b] = b = top[top[b]]
        left[i], right[i] = a, b
        top[a] = top[b] = n + i
    left, right = np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)
    up, size = np.arange(2 * n - 1), [1] * (2 * n - 1)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        size[n + i] = size[a] + size[b]
    up[left] = up[right] = n + np.arange(n - 1)
    return left, right, up, np.array(size, dtype=np.int64)


def _condensed(n: int, tree: tuple, w: np.ndarray, mcs: int):
    """The condensed tree: (chain a row falls out of, (parent, birth, stability) by chain, chains but the root with children first, root),
    where a chain is named by the node that began it; None without any cluster but the root."""
    left, right, up, size = tree
    node, big = n + np.arange(n - 1), size >= mcs
    big[:n] = False
    if not big[-1]:
        return None
    lam = np.where(w == 0, np.inf, 1.0 / np.where(w == 0, 1.0, w))
    one, both = big[left] ^ big[right], big[left] & big[right]
    chain = np.arange(2 * n - 1)
    chain[node[one]] = np.where(big[left], left, right)[one]
    while (chain[chain] != chain).any():
        chain = chain[chain]
    kid, parent = chain[np.r_[left[both], right[both]]], np.r_[node[both], node[both]]
    if not len(kid):
        return None
    out = up.copy()
    while not big[out].all():  # the first large node above
        out = np.where(big[out], out, out[out])
    fell, at = chain[out[:n]], lam[out[:n] - n]
    birth, above = np.zeros(2 * n - 1), np.full(2 * n - 1, -1)
    birth[kid], above[kid] = np.r_[lam[both], lam[both]], parent
    with np.errstate(invalid="ignore"):
        stab = np.bincount(fell, at - birth[fell], minlength=2 * n - 1)
        stab += np.bincount(parent, (birth[kid] - birth[parent]) * size[np.r_[left[both], right[both]]], minlength=2 * n - 1)
    stab[np.isnan(stab)] = 0.0
    return fell, above, birth, stab, np.sort(kid), int(chain[-1])


def _selections(condensed: tuple, epsilons: list[float]) -> list[tuple[np.ndarray, list[float]]]:
    """Excess-of-mass choice (root never chosen), then the epsilon merge: (a row's chosen chain or -1, the epsilons that give it)."""
    fell, above, birth, stab, order, root = condensed
    order, up = order.tolist(), above.tolist()
    below: dict = {}
    best, own, blocked, eom = {}, {}, {root: False}, []
    for c in order:
        sub, mine = below.get(c, 0), float(stab[c])
        own[c], best[c] = mine >= sub, max(mine, sub)
        below[up[c]] = below.get(up[c], 0) + best[c]
    for c in reversed(order):
        over = blocked[up[c]]
        if own[c] and not over:
            eom.append(c)
        blocked[c] = over or own[c]
    eps = {c: 1.0 / birth[c] if birth[c] > 0 else np.inf for c in order}

    def anchor(c, epsilon):
        while not (up[c] == root or eps[c] > epsilon):
            c = up[c]
        return c
    groups: dict = {}
    for e in epsilons:
        groups.setdefault(frozenset(anchor(c, e) if e > 0 and eps[c] < e else c for c in eom), []).append(e)
    out = []
    for chosen, same in groups.items():
        target = np.full(len(above), -1)
        for c in reversed(order):
            t = target[up[c]]
            target[c] = t if t >= 0 else (c if c in chosen else -1)
        out.append((target[fell], same))
    return out


def _numbered(target: np.ndarray) -> np.ndarray:
    """Labels 0.. by smallest member, -1 for noise."""
    names, first, at = np.unique(target, return_index=True, return_inverse=True)
    kept = names >= 0
    label = np.full(len(names), -1, dtype=np.int32)
    label[np.flatnonzero(kept)[np.argsort(first[kept])]] = np.arange(kept.sum())
    return label[at]


def _means(X: np.ndarray, weight: np.ndarray, label: np.ndarray):
    """(labels in order, sizes, centroids) with rows counted by weight."""
    order = np.argsort(label, kind="stable")
    start = np.flatnonzero(np.diff(label[order], prepend=-2))
    if not len(start):
        return label[:0], weight[:0], X[:0]
    size = np.add.reduceat(weight[order], start)
    return label[order[start]], size, np.add.reduceat((X * weight[:, None])[order], start, axis=0) / size[:, None]


def _merged(X: np.ndarray, weight: np.ndarray, label: np.ndarray, mcs: int) -> tuple[np.ndarray, bool]:
    """Small groups (noise included) into the nearest large one, and whether there is a large one."""
    sizes = np.bincount(label + 1, weight)
    small, large = (sizes > 0) & (sizes < mcs), sizes >= mcs
    if not (small.any() and large.any()):
        return label, bool(large.any())
    names, size, cents = _means(X, weight, label)
    s, big = np.flatnonzero(size < mcs), np.flatnonzero(size >= mcs)
    qi, to, _ = _select_topk(cents[s], cents[big], names[s], names[big], 1, False)
    moved = np.arange(len(sizes)) - 1
    moved[names[s][qi] + 1] = to
    return moved[label + 1].astype(np.int32), True


def _packed(label: np.ndarray) -> bytes:
    """A labelling is one value of a row, few bits a label: a reader's batch of such rows stays small."""
    return zlib.compress(label.astype(np.int32).tobytes(), 1)


def _unpacked(value: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(value), dtype=np.int32)


def _label_space(asked: dict, kmax: int, shares: int):
    """Labellings of one space for a share of the values of min_samples: rows (space, cfgs, large, labels, merged, sig)."""
    def run(rows: pa.Table, edges: pa.Table) -> pa.Table:
        rows = rows.sort_by("row_id").combine_chunks()
        out: dict = {c: [] for c in ("cfgs", "large", "labels", "merged", "sig")}
        if rows.num_rows:
            space, share = rows.column("space")[0].as_py(), rows.column("share")[0].as_py()
            ids, size, near, dist = flat_lists(rows.select(["row_id", "ids", "dists"]))
            n, first = len(ids), np.cumsum(size) - size
            X = rows.column("v").combine_chunks().flatten().to_numpy().reshape(n, -1)
            weight = rows.column("copies").to_numpy().astype(np.float64) ** 2
            a, b = np.repeat(np.arange(n), size), np.searchsorted(ids, near)
            ta, tb = (np.searchsorted(ids, edges.column(c).to_numpy()) for c in ("lo", "hi"))
            lo, hi = np.r_[np.minimum(a, b), np.minimum(ta, tb)], np.r_[np.maximum(a, b), np.maximum(ta, tb)]
            d = np.r_[dist, np.sqrt(((X[ta] - X[tb]) ** 2).sum(1))]
            for ms in (m for m in sorted(asked.get(space, {})) if m % shares == share):
                core = np.full(n, np.inf)
                core[size > 0] = dist[(first + np.minimum(ms, size) - 1)[size > 0]]
                w = np.maximum(d, np.maximum(core[lo], core[hi]))
                _, taken = boruvka(n, lo, hi, w)
                taken = taken[np.lexsort((hi[taken], lo[taken], w[taken]))]
                tree = _dendrogram(n, lo[taken], hi[taken]) if len(taken) == n - 1 and n > 1 else None
                for mcs, wanted in asked[space][ms].items():
                    made = _condensed(n, tree, w[taken], mcs) if tree else None
                    choices = _selections(made, sorted(wanted)) if made else [(np.full(n, -1), sorted(wanted))]
                    for target, epsilons in choices:
                        label = _numbered(target)
                        merged, large = _merged(X, weight, label, mcs)
                        out["cfgs"].append(sorted(c for e in epsilons for c in wanted[e]))
                        out["large"].append(large)
                        out["labels"].append(_packed(label))
                        out["merged"].append(_packed(merged))
                        out["sig"].append(blake2b(merged.astype(np.int32).tobytes(), digest_size=16).hexdigest())
        m = len(out["large"])
        types = {"cfgs": pa.list_(pa.int64()), "large": pa.bool_(), "labels": pa.binary(), "merged": pa.binary(), "sig": pa.string()}
        spaces = pa.array([rows.column("space")[0].as_py()] * m if m else [], rows.schema.field("space").type)
        return pa.table({"space": spaces} | {c: pa.array(x, types[c]) for c, x in out.items()})
    return run


def _spaces(points: DataFrame) -> DataFrame:
    """(space, row_id, v, copies): rows that come more than once count for their neighbours as often."""
    return materialize(points.groupBy("space", "row_id").agg(F.first(F.col("v").cast("array<double>")).alias("v"), F.count(F.lit(1)).alias("copies")))


def _label_rows(points: DataFrame, rows: DataFrame, configs: DataFrame, block_rows: int, edges_per_task: int) -> DataFrame:
    """Written (space, cfgs, large, labels, merged, sig), a row for each different choice of clusters; labels in order of row_id."""
    pts = materialize(points.select("space", "row_id", F.col("v").cast("array<double>").alias("v")))
    sizes = pts.groupBy("space").agg(F.count("*").alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) > edges_per_task:
        raise SweepTooLarge("sweep too large for the shared bounded path")
    cfg = configs.join(sizes, "space").select(
        "cfg", "space", F.col("min_cluster_size").cast("bigint").alias("mcs"),
        F.greatest(F.lit(1), F.least(F.col("min_samples"), F.col("_n") - 1)).cast("int").alias("ms"),
        F.col("epsilon").cast("double").alias("epsilon")).collect()  # the configuration table: one small row per candidate
    asked: dict = {}
    for r in cfg:
        asked.setdefault(r["space"], {}).setdefault(r["ms"], {}).setdefault(r["mcs"], {}).setdefault(r["epsilon"], []).append(r["cfg"])
    kmax = max(r["ms"] for r in cfg)
    k = kmax + SPARE
    lists = materialize(neighbour_lists(pts, k, ["space"]))
    edges = tree_edges(pts, lists, kmax, k, ["space"], 4 * block_rows, max(2, block_rows // 2))
    shares = F.explode(F.array(*[F.lit(i) for i in range(MS_SHARES)])).alias("share")
    cut = [F.coalesce(F.slice(c, 1, kmax), F.array().cast(t)).alias(c) for c, t in (("ids", "array<bigint>"), ("dists", "array<double>"))]
    left = rows.join(lists, ["space", "row_id"], "left").select("space", shares, "row_id", "v", "copies", *cut)
    right = edges.select(F.col("space").alias("space"), shares, "lo", "hi")
    stype = points.schema["space"].dataType.simpleString()
    return materialize(left.groupBy("space", "share").cogroup(right.groupBy("space", "share")).applyInArrow(
        _label_space(asked, kmax, MS_SHARES), f"space {stype}, cfgs array<bigint>, large boolean, labels binary, merged binary, sig string"))


def hdbscan_labels_many(points: DataFrame, configs: DataFrame, block_rows: int = H.MST_BLOCK_ROWS,
                        edges_per_task: int = H.EDGES_PER_TASK) -> DataFrame:
    """(cfg, space, row_id, label) for every configuration. ``points`` = (space,
    row_id, v); ``configs`` = (cfg, space, min_cluster_size, min_samples, epsilon)."""
    lab, same = _labellings(points, configs, block_rows, edges_per_task)
    return same.join(lab.withColumnRenamed("cfg", "lead"), "lead").select("cfg", "space", "row_id", "label")


def _labellings(points: DataFrame, configs: DataFrame, block_rows: int = H.MST_BLOCK_ROWS, edges_per_task: int = H.EDGES_PER_TASK):
    """(cfg, space, row_id, label) of one configuration for each choice of clusters, and (cfg, lead): the configuration among
    them that every configuration shares its choice with."""
    rows = _spaces(points)
    made = _label_rows(points, rows, configs, block_rows, edges_per_task)
    own = rows.groupBy("space").agg(F.sort_array(F.collect_list("row_id")).alias("ids"))

    def unpack(batches):
        for b in batches:
            for r in b.to_pylist():
                label = _unpacked(r["labels"])
                yield pa.RecordBatch.from_pydict({"cfg": pa.array(np.full(len(label), r["cfg"])), "space": pa.array([r["space"]] * len(label), b.schema.field("space").type),
                                                  "row_id": pa.array(r["ids"]), "label": pa.array(label.astype(np.int64))})
    lab = made.join(own, "space").select(F.col("cfgs")[0].alias("cfg"), "space", "ids", "labels")
    return (lab.mapInArrow(unpack, f"cfg bigint, space {points.schema['space'].dataType.simpleString()}, row_id bigint, label bigint"),
            made.select(F.explode("cfgs").alias("cfg"), F.col("cfgs")[0].alias("lead")))


# ----------------------------------------------------------------------------- scores
def _repeated(near: np.ndarray, dist: np.ndarray, copies: np.ndarray):
    """Lists in which a row that comes c times in the table, and so c times in a list, comes c * c times; filled up with row -1."""
    times = copies[near]
    if (times == 1).all():
        return near, dist
    total = times.sum(axis=1)
    row = np.repeat(np.arange(len(near)), total)
    at = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
    wide = np.full((len(near), total.max()), -1), np.full((len(near), total.max()), np.inf)
    for held, x in zip(wide, (near, dist)):
        held[row, at] = np.repeat(x.ravel(), times.ravel())
    return wide


def _scored(evals: pa.Table, sets: pa.Table) -> pa.Table:
    """(set, row_id, uq): per evaluation row and labelling its mean distance to the k nearest rows of the cluster with the nearest centroid, for
    every k of the set; of a cluster with fewer rows, or without any cluster, to the k nearest of all."""
    evals, sets = evals.combine_chunks(), sets.combine_chunks()
    out = pa.schema([("set", pa.int64()), ("row_id", pa.int64()), ("uq", pa.list_(pa.float64()))])
    if not evals.num_rows or not sets.num_rows:
        return out.empty_table()
    flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy()
    held = sets.filter(sets.column("ids").is_valid()).combine_chunks()
    ids, copies = flat(held, "ids"), flat(held, "copies")
    X, weight = flat(held, "x").reshape(len(ids), -1), copies.astype(np.float64) ** 2
    m = evals.num_rows
    E, dist = flat(evals, "v").reshape(m, -1), flat(evals, "dists").reshape(m, -1)
    near, every = np.searchsorted(ids, flat(evals, "ids")).reshape(m, -1), np.cumsum(dist, axis=1)
    near, dist = _repeated(near, dist, copies)
    parts = []
    for i in range(sets.num_rows):
        label = _unpacked(sets.column("labels")[i].as_py())
        ks = np.array(sets.column("ks")[i].as_py())
        most = int(ks.max())
        name, size, cents = _means(X, weight, label)
        name, size, cents = (x[name >= 0] for x in (name, size, cents))
        uq = every[:, np.minimum(ks, every.shape[1]) - 1] / np.minimum(ks, every.shape[1])
        if len(name):
            qi, own, _ = _select_topk(E, cents, np.arange(m), name, 1, False)
            own, size = own[np.argsort(qi)], size[np.searchsorted(name, own[np.argsort(qi)])]
            inside = (label[near] == own[:, None]) & (near >= 0)
            place = np.cumsum(inside, axis=1, dtype=np.int32)
            D = np.zeros((m, most))
            r, c = np.nonzero(inside & (place <= most))
            D[r, place[r, c] - 1] = dist[r, c]
            few = (place[:, -1] < np.minimum(most, size)) & (size >= ks.min())
            for one in np.unique(own[few]):
                rows, members = np.flatnonzero(few & (own == one)), np.flatnonzero(label == one)
                members = np.repeat(members, copies[members] ** 2)
                qi, _, found = _select_topk(E[rows], X[members], np.arange(len(rows)), ids[members], most, False)
                D[rows, :min(most, len(members))] = found.reshape(len(rows), -1)
            mean = np.cumsum(D, axis=1)[:, ks - 1] / ks
            uq = np.where(size[:, None] >= ks, mean, uq)
        offsets = pa.array(np.arange(0, uq.size + 1, len(ks)), pa.int32())
        parts.append(pa.table([pa.array(np.full(m, sets.column("set")[i].as_py())), evals.column("row_id"),
                               pa.ListArray.from_arrays(offsets, pa.array(uq.ravel()))], schema=out))
    return pa.concat_tables(parts)


def hdbscan_lanes(points: DataFrame, evals: DataFrame, configs: DataFrame, penalise: bool = False, block_rows: int = H.MST_BLOCK_ROWS,
                  edges_per_task: int = H.EDGES_PER_TASK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """F4 for a table of configurations: written (set, row_id, uq) with a list of scores a row, (set, pos, score): the configuration whose
    scores are at a place of the list, and (cfg, score): the configuration among them that has a configuration's scores. ``evals`` = (space, row_id, v);
    ``configs`` also carries n_neighbors. Components are rounded to single precision (D11), as in F4.
    Configurations of the same labelling share the merge, centroids and neighbours; with the same number of neighbours they have the
    same scores. With ``penalise`` a configuration without any group of its minimum size has no score, so that I2 gives it the penalty."""
    single = F.transform("v", lambda x: x.cast("float").cast("double")).alias("v")
    points, evals = points.select("space", "row_id", single), evals.select("space", "row_id", single)
    rows = _spaces(points)
    try:
        made = _label_rows(points, rows, configs, block_rows, edges_per_task)
    except SweepTooLarge:
        found = materialize(_one_by_one(points, evals, configs, penalise, edges_per_task=edges_per_task))
        plan = configs.select("cfg", F.col("cfg").alias("score"))
        return found.select(F.col("cfg").alias("set"), "row_id", F.array("uq").alias("uq")), plan.select(F.col("cfg").alias("set"), F.lit(0).alias("pos"), "score"), plan
    # merged labellings that are equal share centroids and neighbours
    sets = materialize(made.groupBy("space", "sig").agg(F.min(F.col("cfgs")[0]).alias("set"), F.first("merged").alias("labels")))
    named = made.select("space", "sig", "large", F.explode("cfgs").alias("cfg")).join(sets.select("space", "sig", "set"), ["space", "sig"])
    plan = materialize(named.join(configs.select("cfg", F.col("n_neighbors").cast("bigint").alias("k")), "cfg").select("cfg", "space", "set", "k", "large"))
    scores = plan.groupBy("set", "k").agg(F.min("cfg").alias("score"))
    place = Window.partitionBy("set").orderBy("k")
    members = materialize(scores.select("set", (F.row_number().over(place) - 1).alias("pos"), "k", "score"))
    asked = plan.groupBy("space", "set").agg(F.sort_array(F.collect_set("k")).alias("ks"))
    asked = asked.withColumn("_i", F.row_number().over(Window.partitionBy("space").orderBy("set")) - 1)
    asked = asked.select("space", "set", "ks", F.floor(F.col("_i") / SETS).alias("part"), (F.col("_i") % SETS == 0).alias("_first"))
    kmax = int(plan.agg(F.max("k")).first()[0])
    listed = materialize(neighbour_lists(points, max(LISTED, kmax), ["space"], evals).join(evals.dropDuplicates(["space", "row_id"]), ["space", "row_id"]))
    chunks = -(-listed.count() // EVAL_ROWS)  # of all spaces: a chunk of one has fewer rows
    whole = rows.groupBy("space").agg(F.sort_array(F.collect_list(F.struct("row_id", "copies", "v"))).alias("_p")).select(
        "space", F.col("_p.row_id").alias("ids"), F.col("_p.copies").alias("copies"), F.flatten(F.col("_p.v")).alias("x"))
    held = sets.select("set", "labels").join(asked, "set").join(whole.withColumn("_first", F.lit(True)), ["space", "_first"], "left")
    right = held.select(F.col("space").alias("space"), F.col("part").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(max(0, chunks - 1)))).alias("chunk"), "set", "ks", "labels", "ids", "copies", "x")
    parts = asked.select(F.col("space").alias("space"), F.col("part").alias("part")).distinct()
    left = listed.join(F.broadcast(parts), "space").select(
        "space", "part", F.pmod(F.xxhash64("row_id"), F.lit(max(1, chunks))).cast("int").alias("chunk"), "row_id", "v", "ids", "dists")
    keys = ["space", "part", "chunk"]
    lanes = materialize(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scored, "set bigint, row_id bigint, uq array<double>"))
    if penalise:  # no group of the required size at all: the search fails there, and so the configuration gets no score
        plan = plan.where("large")
    return lanes, members.select("set", "pos", "score"), materialize(plan.join(members, ["set", "k"]).select("cfg", "score"))


def lane_rows(lanes: DataFrame, members: DataFrame, *also: str) -> DataFrame:
    """(cfg, row_id, uq, also...): a row per score."""
    long = lanes.select("set", "row_id", *also, F.posexplode("uq").alias("pos", "uq"))
    return long.join(F.broadcast(members), ["set", "pos"]).select(F.col("score").alias("cfg"), "row_id", "uq", *also)


def hdbscan_knn_many(points: DataFrame, evals: DataFrame, configs: DataFrame, penalise: bool = False, **kw) -> DataFrame:
    """F4 for every configuration: (cfg, row_id, uq), see ``hdbscan_lanes``."""
    found, plan = hdbscan_knn_shared(points, evals, configs, penalise, **kw)
    return plan.join(found.withColumnRenamed("cfg", "score"), "score").select("cfg", "row_id", "uq")


def hdbscan_knn_shared(points: DataFrame, evals: DataFrame, configs: DataFrame, penalise: bool = False, **kw) -> tuple[DataFrame, DataFrame]:
    """The lanes in long form: (cfg, row_id, uq) of one configuration for each different score, and (cfg, score)."""
    lanes, members, plan = hdbscan_lanes(points, evals, configs, penalise, **kw)
    return lane_rows(lanes, members), plan


def _one_by_one(points: DataFrame, evals: DataFrame, configs: DataFrame, penalise: bool = False, **kw) -> DataFrame:
    """Distributed single-configuration path for every configuration row."""
    from .score import hdbscan_knn_uncertainty
    from .hdbscan import hdbscan_labels
    out = None
    for r in configs.collect():  # the configuration table: one small row per candidate
        tr = points.filter(F.col("space") == r["space"]).select("row_id", "v")
        ev = evals.filter(F.col("space") == r["space"]).select("row_id", "v")
        lab = hdbscan_labels(tr, r["min_cluster_size"], r["min_samples"], r["epsilon"],
                             edges_per_task=kw.get("edges_per_task", H.EDGES_PER_TASK))
        one = hdbscan_knn_uncertainty(tr, ev, r["min_cluster_size"], r["min_samples"], r["epsilon"],
                                      r["n_neighbors"], labels=lab).withColumn("cfg", F.lit(r["cfg"]))
        if penalise:
            large = lab.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= r["min_cluster_size"]).limit(1)
            one = one.crossJoin(large.select("n")).drop("n")
        one = one.select("cfg", "row_id", "uq")
        out = one if out is None else out.unionByName(one)
    return out


def hdbscan_objectives(scored: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """I2 objectives per configuration from (cfg, uq, bertscore_f1, rougeL)."""
    return objectives(scored, ["cfg"], configs=configs)
