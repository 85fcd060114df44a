"""Exact HDBSCAN as Spark stages.

(a) core distances by the blocked kNN (S2);
(b) candidate edges that hold the spanning tree of the mutual-reachability
    graph (``spanning.py``: certain edges of the neighbour lists, then tiles of
    row pairs of different components); rows of one block: dense Prim;
(c) distributed Boruvka over those edges: lightest outgoing edge per component
    (``min`` over a struct), hook, pointer-jump, checkpoint per round;
(d) condensation by weight range: the tree edges are cut into ranges of at
    most ``edges_per_task``; each range is one union-find pass that sees only
    component summaries (size, chain, and the members of components still
    below ``min_cluster_size``), carrying the state forward between ranges;
(e) stability and excess-of-mass choice level by level on the cluster tree
    (at most 2n / min_cluster_size chains), then ``cluster_selection_epsilon``;
(f) labels = nearest chosen ancestor of the chain a point fell out of, or -1;
    renumbered by smallest member id.

Edges are totally ordered by (weight, low id, high id) everywhere, and weights
come from direct differences, so every task agrees on the same tree.
"""
from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .blocks import DIFF_VALUES, knn
from .order import global_rank
from .spanning import SPARE, neighbour_lists, tree_edges

MST_BLOCK_ROWS = 2048
EDGES_PER_TASK = 1 << 20
MAX_ROUNDS = 64


# ----------------------------------------------------------------------------- (a)
def core_distance_table(train: DataFrame, min_samples: int, vec: str = "v") -> DataFrame:
    """(row_id, core): distance to the min_samples-th nearest other row
    (min_samples capped at n - 1, at least 1, as the library does)."""
    nn = knn(train, train, max(1, int(min_samples)), exclude_self=True, vec=vec)
    return nn.groupBy(F.col("q_id").alias("row_id")).agg(F.max_by("dist", "rank").alias("core"))


# ----------------------------------------------------------------------------- (b)
def _distances(X: np.ndarray) -> np.ndarray:
    """All distances by direct differences; |a - b| and |b - a| are the same number, so half of them are computed."""
    m = len(X)
    D = np.empty((m, m))
    step = max(1, DIFF_VALUES // X.size)
    for s in range(0, m, step):
        diff = X[s:s + step, None, :] - X[None, s:, :]
        D[s:s + step, s:] = np.sqrt((diff * diff).sum(-1))
        D[s:, s:s + step] = D[s:s + step, s:].T
    return D


def _prim(ids: np.ndarray, D: np.ndarray, core: np.ndarray) -> pd.DataFrame:
    """The spanning tree of the mutual-reachability graph under the order (w, lo, hi). Arrays hold the rows outside the tree."""
    m = len(ids)
    t = int(np.argmin(ids))
    rest = np.delete(np.arange(m), t)
    own, near, src = core[rest], np.full(m - 1, np.inf), np.full(m - 1, t)
    ends = lambda j, s: (np.minimum(ids[rest[j]], ids[s]), np.maximum(ids[rest[j]], ids[s]))
    out_lo, out_hi, out_w = np.empty(m - 1, dtype=np.int64), np.empty(m - 1, dtype=np.int64), np.empty(m - 1)
    for r in range(m - 1, 0, -1):
        w = np.maximum(D[t].take(rest[:r]), np.maximum(own[:r], core[t]))
        better = w < near[:r]
        tie = np.flatnonzero(w == near[:r])
        if len(tie):
            (lo, hi), (old_lo, old_hi) = ends(tie, t), ends(tie, src[tie])
            better[tie] = (lo < old_lo) | ((lo == old_lo) & (hi < old_hi))
        np.copyto(near[:r], w, where=better)
        np.copyto(src[:r], t, where=better)
        cand = np.flatnonzero(near[:r] == near[:r].min())
        lo, hi = ends(cand, src[cand])
        i = np.lexsort((hi, lo))[0] if len(cand) > 1 else 0
        j = cand[i]
        out_lo[m - 1 - r], out_hi[m - 1 - r], out_w[m - 1 - r] = lo[i], hi[i], near[j]
        t = int(rest[j])
        for x in (rest, own, near, src):  # the last row takes the place of the one that left
            x[j] = x[r - 1]
    return pd.DataFrame({"lo": out_lo, "hi": out_hi, "w": out_w})


def _local_mst(pdf: pd.DataFrame) -> pd.DataFrame:
    if len(pdf) < 2:
        return pd.DataFrame({c: [] for c in ["lo", "hi", "w"]})
    X = np.stack(pdf["v"].to_numpy()).astype(np.float64)
    return _prim(pdf["row_id"].to_numpy(), _distances(X), pdf["core"].to_numpy().astype(np.float64))


def spanning_tree(points: DataFrame, min_samples: int, block_rows: int = MST_BLOCK_ROWS, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(lo, hi, w): the tree over written ``points`` (row_id, v). More than ``block_rows`` rows go through candidate edges."""
    if points.count() <= block_rows:
        nodes = points.join(core_distance_table(points, min_samples), "row_id")
        local = nodes.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(_local_mst, "lo bigint, hi bigint, w double")
        return materialize(local.groupBy("lo", "hi").agg(F.min("w").alias("w")))
    k = min_samples + SPARE
    lists = materialize(neighbour_lists(points, k, []))
    cand = tree_edges(points, lists, min_samples, k, [], 8 * block_rows, max(2, block_rows // 2))
    return minimum_spanning_tree(lists.select("row_id"), cand, edges_per_task)


# ----------------------------------------------------------------------------- (c)
def _pointer_jump(parent: DataFrame) -> DataFrame:
    """(c, p) rooted forest -> (c, root). Each round halves every path."""
    cur = parent
    for _ in range(MAX_ROUNDS):
        nxt = (cur.alias("a").join(cur.alias("b"), F.col("a.p") == F.col("b.c"))
                  .select(F.col("a.c").alias("c"), F.col("b.p").alias("p")))
        nxt = materialize(nxt)
        if nxt.join(cur, ["c", "p"], "left_anti").limit(1).count() == 0:
            return nxt
        cur = nxt
    raise RuntimeError("pointer jumping did not converge")


def _kruskal(pdf: pd.DataFrame) -> pd.DataFrame:
    """Minimum spanning forest of a bounded edge set over component ids."""
    parent = {}

    def find(a):
        root = a
        while root in parent:
            root = parent[root]
        while a in parent and parent[a] != root:
            parent[a], a = root, parent[a]
        return root
    pdf = pdf.sort_values(["w", "lo", "hi"])
    keep = []
    for i, (ca, cb) in enumerate(zip(pdf["ca"].to_numpy(), pdf["cb"].to_numpy())):
        ra, rb = find(ca), find(cb)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            keep.append(i)
    return pdf.iloc[keep][["lo", "hi", "w"]]


def minimum_spanning_tree(nodes: DataFrame, edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """Distributed Boruvka: (lo, hi, w) of the minimum spanning forest. Once the
    edges still crossing components fit ``edges_per_task`` (a checked count),
    one Kruskal task finishes the tree."""
    comp = materialize(nodes.select(F.col("row_id").alias("node"), F.col("row_id").alias("c")))
    edges = materialize(edges)
    tree = None
    for _ in range(MAX_ROUNDS):
        e = materialize(edges.join(comp.withColumnRenamed("node", "lo").withColumnRenamed("c", "ca"), "lo")
                        .join(comp.withColumnRenamed("node", "hi").withColumnRenamed("c", "cb"), "hi")
                        .filter(F.col("ca") != F.col("cb")))
        if e.count() <= edges_per_task:
            last = (e.withColumn("_g", F.lit(0)).groupBy("_g")
                     .applyInPandas(lambda pdf: _kruskal(pdf), "lo bigint, hi bigint, w double"))
            tree = last if tree is None else tree.unionByName(last)
            return materialize(tree)
        key = F.struct("w", "lo", "hi")
        cand = (e.select(F.col("ca").alias("c"), F.struct(key.alias("k"), F.col("cb").alias("o")).alias("s"))
                 .unionByName(e.select(F.col("cb").alias("c"),
                                       F.struct(key.alias("k"), F.col("ca").alias("o")).alias("s"))))
        best = materialize(cand.groupBy("c").agg(F.min("s").alias("s")))
        if best.limit(1).count() == 0:
            break
        chosen = best.select("s.k.lo", "s.k.hi", "s.k.w").distinct()
        tree = chosen if tree is None else tree.unionByName(chosen)
        tree = materialize(tree.distinct())
        par = best.select("c", F.col("s.o").alias("p"))
        back = par.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        par = par.join(back, "p", "left").select(
            "c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c"))
                  .otherwise(F.col("p")).alias("p"))
        roots = _pointer_jump(materialize(par))
        comp = materialize(comp.join(roots, "c", "left")
                           .select("node", F.coalesce(F.col("p"), F.col("c")).alias("c")))
    else:
        raise RuntimeError("the spanning tree did not end")
    if tree is None:
        return edges.limit(0)
    return tree


# ----------------------------------------------------------------------------- (d)
def _condense_range(mcs: int, rng_id: int):
    """Union-find over one weight range, seeing component summaries only."""
    def run(edf: pd.DataFrame, cdf: pd.DataFrame) -> pd.DataFrame:
        size = dict(zip(cdf["comp"], cdf["size"]))
        chain = {c: (None if pd.isna(h) else int(h)) for c, h in zip(cdf["comp"], cdf["chain"])}
        members = {c: (list(m) if m is not None else []) for c, m in zip(cdf["comp"], cdf["members"])}
        parent = {}

        def find(c):
            root = c
            while root in parent:
                root = parent[root]
            while c in parent and parent[c] != root:
                parent[c], c = root, parent[c]
            return root

        rows = []  # kind, a, b, lam, n
        counter = 0
        edf = edf.sort_values(["w", "lo", "hi"])
        for ca, cb, w in zip(edf["ca"], edf["cb"], edf["w"]):
            A, Bc = find(ca), find(cb)
            if A == Bc:
                continue
            lam = np.inf if w == 0 else 1.0 / w
            sa, sb = size[A], size[Bc]
            new = min(A, Bc)
            big_a, big_b = sa >= mcs, sb >= mcs
            if big_a and big_b:
                counter += 1
                y = (rng_id << 32) | counter
                rows.append(("cluster", y, chain[A], lam, sa))
                rows.append(("cluster", y, chain[Bc], lam, sb))
                ch, mem = y, []
            elif big_a or big_b:
                keep, drop = (A, Bc) if big_a else (Bc, A)
                for p in members[drop]:
                    rows.append(("point", chain[keep], p, lam, 1))
                ch, mem = chain[keep], []
            elif sa + sb >= mcs:
                counter += 1
                x = (rng_id << 32) | counter
                for p in members[A] + members[Bc]:
                    rows.append(("point", x, p, lam, 1))
                ch, mem = x, []
            else:
                ch, mem = None, members[A] + members[Bc]
            other = Bc if new == A else A
            parent[other] = new
            size[new], chain[new], members[new] = sa + sb, ch, mem
        out = [("remap", c, find(c), None, None) for c in list(size.keys()) if find(c) != c]
        for c in set(find(c) for c in size.keys()):
            out.append(("comp", c, chain[c], None, size[c]))
        res = pd.DataFrame(rows + out, columns=["kind", "a", "b", "lam", "n"])
        # members of components that are still small travel as a list
        res["members"] = [members.get(a) if k == "comp" and size.get(a, 0) < mcs else None
                          for k, a in zip(res["kind"], res["a"])]
        return res
    return run


def condense(nodes: DataFrame, tree: DataFrame, mcs: int, edges_per_task: int = EDGES_PER_TASK):
    """(clusters, points): cluster rows (parent, child, lam, size) and fall-out
    rows (chain, row_id, lam), plus the root chain id (None if no cluster)."""
    spark = nodes.sparkSession
    n_edges = tree.count()
    R = max(1, -(-n_edges // edges_per_task))
    if R > 1:
        fr = [i / R for i in range(1, R)]
        b = tree.agg(F.percentile_approx("w", fr, 10000).alias("b")).first()["b"]
        tree = tree.withColumn("_r", F.size(F.filter(F.array(*[F.lit(float(x)) for x in b]),
                                                     lambda e: e < F.col("w"))))
    else:
        tree = tree.withColumn("_r", F.lit(0))
    tree = materialize(tree)
    comp = materialize(nodes.select(F.col("row_id").alias("node"), F.col("row_id").alias("comp")))
    info = materialize(nodes.select(F.col("row_id").alias("comp"), F.lit(1).cast("bigint").alias("size"),
                                    F.lit(None).cast("bigint").alias("chain"),
                                    F.array(F.col("row_id")).alias("members")))
    outs = []
    schema = "kind string, a bigint, b bigint, lam double, n bigint, members array<bigint>"
    for r in range(R):
        er = (tree.filter(F.col("_r") == r)
                  .join(comp.withColumnRenamed("node", "lo").withColumnRenamed("comp", "ca"), "lo")
                  .join(comp.withColumnRenamed("node", "hi").withColumnRenamed("comp", "cb"), "hi")
                  .select(F.lit(r).alias("_g"), "ca", "cb", "w", "lo", "hi"))
        touched = er.select(F.col("ca").alias("comp")).unionByName(er.select(F.col("cb").alias("comp"))).distinct()
        ci = info.join(touched, "comp", "left_semi").withColumn("_g", F.lit(r))
        res = materialize(er.groupBy("_g").cogroup(ci.groupBy("_g")).applyInPandas(_condense_range(mcs, r + 1),
                                                                                   schema))
        outs.append(res.filter(F.col("kind").isin("cluster", "point")))
        newinfo = res.filter(F.col("kind") == "comp").select(F.col("a").alias("comp"), F.col("n").alias("size"),
                                                            F.col("b").alias("chain"), "members")
        if r == R - 1:          # last range: only the root summary is still needed
            info = info.join(touched, "comp", "left_anti").unionByName(newinfo)
            break
        remap = res.filter(F.col("kind") == "remap").select(F.col("a").alias("comp"), F.col("b").alias("_to"))
        comp = materialize(comp.join(remap, "comp", "left")
                           .select("node", F.coalesce(F.col("_to"), F.col("comp")).alias("comp")))
        info = materialize(info.join(touched, "comp", "left_anti").unionByName(newinfo))
    allrows = outs[0]
    for o in outs[1:]:
        allrows = allrows.unionByName(o)
    allrows = materialize(allrows) if R > 1 else allrows  # a single range result is already a cut
    clusters = allrows.filter(F.col("kind") == "cluster").select(
        F.col("a").alias("parent"), F.col("b").alias("child"), "lam", F.col("n").alias("size"))
    points = allrows.filter(F.col("kind") == "point").select(F.col("a").alias("chain"), F.col("b").alias("row_id"),
                                                             "lam")
    root = info.filter(F.col("size") >= mcs).agg(F.max("chain")).first()[0]
    return clusters, points, root


# ----------------------------------------------------------------------------- (e), (f)
def _levels(clusters: DataFrame, root) -> DataFrame:
    """(chain, parent, depth) for every non-root chain, by level-wise joins."""
    par = clusters.select(F.col("child").alias("chain"), "parent")
    lvl = par.filter(F.col("parent") == F.lit(root)).withColumn("depth", F.lit(1))
    lvl = materialize(lvl)
    frontier = lvl
    for d in count(2):
        nxt = par.join(frontier.select(F.col("chain").alias("parent")), "parent").withColumn("depth", F.lit(d))
        nxt = materialize(nxt)
        if nxt.limit(1).count() == 0:
            break
        lvl = materialize(lvl.unionByName(nxt))
        frontier = nxt
    return lvl


def _select_one_task(root: int, epsilon: float):
    """Excess of mass, epsilon merge and targets over a bounded cluster tree."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        par = dict(zip(pdf["chain"], pdf["parent"]))
        birth = dict(zip(pdf["chain"], pdf["birth"]))
        stab = dict(zip(pdf["chain"], pdf["stab"]))
        kids = {}
        for c, p in par.items():
            kids.setdefault(p, []).append(c)
        order, st = [], [root]
        while st:                      # top-down order from the root
            x = st.pop()
            order.append(x)
            st += kids.get(x, [])
        best, own = {}, {}
        for c in reversed(order):      # children before parents
            sub = sum(best[k] for k in kids.get(c, []))
            own[c] = stab.get(c, 0.0) >= sub
            best[c] = max(stab.get(c, 0.0), sub)
        eps = {c: (1.0 / birth[c] if birth[c] > 0 else np.inf) for c in par}
        blocked, anchor, eom = {root: False}, {}, set()
        for c in order[1:]:
            p = par[c]
            if own[c] and not blocked[p]:
                eom.add(c)
            blocked[c] = blocked[p] or own[c]
            anchor[c] = c if (p == root or eps[c] > epsilon) else anchor[p]
        if epsilon > 0:
            chosen = {anchor[c] if eps[c] < epsilon else c for c in eom}
        else:
            chosen = set(eom)
        target = {}
        for c in order[1:]:
            p = par[c]
            pt = target.get(p)
            target[c] = pt if pt is not None else (c if c in chosen else None)
        sel = [c in chosen and (target.get(par[c]) is None) for c in order[1:]]
        return pd.DataFrame({"chain": order[1:], "selected": sel,
                             "target": pd.array([target[c] for c in order[1:]], dtype="Int64")})
    return run


def select_clusters(clusters: DataFrame, points: DataFrame, root, epsilon: float = 0.0,
                    rows_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """Excess-of-mass choice (root never chosen) and epsilon merge:
    (chain, selected, target) for non-root chains. A cluster tree within
    ``rows_per_task`` chains (checked) is settled in one task; a larger one
    level by level with joins."""
    if root is None or clusters.limit(1).count() == 0:
        return clusters.sparkSession.createDataFrame([], "chain bigint, selected boolean, target bigint")
    birth = clusters.select(F.col("child").alias("chain"), F.col("lam").alias("birth"))
    rows = (clusters.select(F.col("parent").alias("chain"), "lam", "size")
            .unionByName(points.select("chain", "lam", F.lit(1).cast("bigint").alias("size"))))
    births_all = birth.unionByName(clusters.sparkSession.createDataFrame([(int(root), 0.0)], "chain bigint, birth double"))
    stab = (rows.join(births_all, "chain")
                .groupBy("chain").agg(F.sum((F.col("lam") - F.col("birth")) * F.col("size")).alias("stab")))
    if clusters.count() <= rows_per_task:
        tbl = (clusters.select(F.col("child").alias("chain"), "parent", F.col("lam").alias("birth"))
               .join(stab, "chain", "left").fillna(0.0, ["stab"]))
        return materialize(tbl.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(
            _select_one_task(int(root), float(epsilon)), "chain bigint, selected boolean, target bigint"))
    lv = _levels(clusters, root).join(stab, "chain", "left").join(birth, "chain").fillna(0.0, ["stab"])
    lv = materialize(lv)
    maxd = lv.agg(F.max("depth")).first()[0]
    # bottom-up: best(c) = max(stab, sum best(children)); own = stab >= sum best(children)
    best = None
    for d in range(maxd, 0, -1):
        cur = lv.filter(F.col("depth") == d)
        if best is not None:
            ch = best.groupBy(F.col("parent").alias("chain")).agg(F.sum("best").alias("_cs"))
            cur = cur.join(ch, "chain", "left")
        else:
            cur = cur.withColumn("_cs", F.lit(None).cast("double"))
        cs = F.coalesce(F.col("_cs"), F.lit(0.0))
        cur = cur.select("chain", "parent", "depth", "birth", (F.col("stab") >= cs).alias("own"),
                         F.greatest(F.col("stab"), cs).alias("best"))
        cur = materialize(cur)
        best = cur if best is None else materialize(best.unionByName(cur))
    # top-down: chosen = own and no own ancestor; eps anchor = nearest ancestor-or-self born above epsilon
    tbl = best.withColumn("eps", F.when(F.col("birth") > 0, 1.0 / F.col("birth")).otherwise(F.lit(float("inf"))))
    done = None
    for d in range(1, maxd + 1):
        cur = tbl.filter(F.col("depth") == d)
        if done is None:
            cur = cur.withColumn("_blk", F.lit(False)).withColumn("anchor", F.col("chain"))
        else:
            up = done.select(F.col("chain").alias("parent"), F.col("blocked").alias("_blk"),
                             F.col("anchor").alias("_pa"))
            cur = cur.join(up, "parent").withColumn(
                "anchor", F.when(F.col("eps") > epsilon, F.col("chain")).otherwise(F.col("_pa")))
        cur = cur.select("chain", "parent", "depth", "eps", "anchor",
                         (F.col("own") & ~F.col("_blk")).alias("eom"),
                         (F.col("_blk") | F.col("own")).alias("blocked"))
        cur = materialize(cur)
        done = cur if done is None else materialize(done.unionByName(cur))
    if epsilon and epsilon > 0:
        moved = done.filter(F.col("eom")).select(
            F.when(F.col("eps") < epsilon, F.col("anchor")).otherwise(F.col("chain")).alias("chain")).distinct()
    else:
        moved = done.filter(F.col("eom")).select("chain")
    sel = materialize(moved.withColumn("selected", F.lit(True)))
    # drop a chosen chain that has a chosen proper ancestor
    anc = _ancestor_flags(done, sel, maxd)
    return anc


def _ancestor_flags(done: DataFrame, sel: DataFrame, maxd: int) -> DataFrame:
    """(chain, selected, target): final choice and the nearest chosen
    ancestor-or-self of every chain (NULL if none)."""
    t = done.join(sel, "chain", "left").fillna(False, ["selected"])
    out = None
    for d in range(1, maxd + 1):
        cur = t.filter(F.col("depth") == d)
        if out is None:
            cur = cur.withColumn("_pt", F.lit(None).cast("bigint"))
        else:
            cur = cur.join(out.select(F.col("chain").alias("parent"), F.col("target").alias("_pt")), "parent", "left")
        fin = F.col("selected") & F.col("_pt").isNull()
        cur = cur.select("chain", "parent", "depth", fin.alias("selected"),
                         F.when(F.col("_pt").isNotNull(), F.col("_pt"))
                          .when(fin, F.col("chain")).otherwise(F.lit(None).cast("bigint")).alias("target"))
        cur = materialize(cur)
        out = cur if out is None else materialize(out.unionByName(cur))
    return out


def hdbscan_labels(train: DataFrame, min_cluster_size: int, min_samples: int, epsilon: float = 0.0,
                   vec: str = "v", block_rows: int = MST_BLOCK_ROWS, edges_per_task: int = EDGES_PER_TASK
                   ) -> DataFrame:
    """(row_id, label) with -1 for noise; labels renumbered 0.. by
    smallest member row id."""
    spark = train.sparkSession
    pts = materialize(train.select("row_id", F.col(vec).cast("array<double>").alias("v")))
    n = pts.count()
    tree = spanning_tree(pts, max(1, min(int(min_samples), n - 1)), block_rows, edges_per_task)
    clusters, points, root = condense(pts.select("row_id"), tree, int(min_cluster_size), edges_per_task)
    sel = select_clusters(clusters, points, root, float(epsilon), edges_per_task)
    lab = (points.join(sel.select("chain", "target"), "chain", "left")
                 .select("row_id", F.col("target").alias("_t")))
    lab = pts.select("row_id").join(lab, "row_id", "left")
    first = lab.filter(F.col("_t").isNotNull()).groupBy("_t").agg(F.min("row_id").alias("_m"))
    first = global_rank(first, ["_m"], [], rank_col="_lr").withColumn("label", F.col("_lr") - 1)
    return (lab.join(first.select("_t", "label"), "_t", "left")
               .select("row_id", F.coalesce(F.col("label"), F.lit(-1).cast("bigint")).alias("label")))
