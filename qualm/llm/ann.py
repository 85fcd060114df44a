"""Operator 2: nearest neighbours by a forest of random-projection trees.

Trees split a bounded sample of the distinct vectors at the median of a random direction between two of its points;
the forest is broadcast and every vector is then filed under its leaf of each tree. A query walks all trees with one
shared priority queue, nearest cell first, until the leaves it has opened hold enough vectors. Leaves and the queries
that open them meet in tasks, where every candidate is reranked by the exact distance; each leaf returns at most
``k + 1`` per query. A leaf of many vectors is cut into parts of about PART_ROWS, and queries into shares of about
QUERY_ROWS, so what a task holds does not grow with the table. Vectors keep their type: doubles are not rounded. Equal vectors are one point with its ``k + 1`` smallest ids, so no group of copies makes a large
leaf and none is lost from a result.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another length than most,
take no part; neither do null ids. Repeated rows count once; an id with several vectors is several candidates, named
once at its smallest distance. Ties go to the smaller id. Fewer than k candidates give fewer rows; an empty table none.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut

TREES, LEAF, SAMPLE, SHARE, LEAST, GROUP_ROWS, PART_ROWS, QUERY_ROWS = 12, 64, 20_000, 0.8, 2000, 40_000, 20_000, 5_000


@dataclass
class Forest:
    """Nodes of all trees in one table: a direction and offset, and two children; a child below 0 is leaf -child - 1."""
    directions: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: list[int]
    sizes: np.ndarray

    @classmethod
    def fit(cls, points: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 5) -> Forest:
        rng, directions, offsets, children, roots, leaves = np.random.default_rng(seed), [], [], [], [], 0
        for _ in range(trees):
            stack, root = [(np.arange(len(points)), -1, 0)], None
            while stack:
                own, parent, side = stack.pop()
                ref = None
                if len(own) > leaf:
                    a, b = split(points[own], rng)
                    direction = (a - b) / max(np.linalg.norm(a - b), 1e-30)
                    along = points[own] @ direction
                    middle = np.median(along)
                    right = along > middle
                    if 0 < right.sum() < len(own):
                        ref = len(offsets)
                        directions.append(direction)
                        offsets.append(middle)
                        children.append([0, 0])
                        stack += [(own[~right], ref, 0), (own[right], ref, 1)]
                if ref is None:
                    ref, leaves = -leaves - 1, leaves + 1
                if parent < 0:
                    root = ref
                else:
                    children[parent][side] = ref
            roots.append(root)
        width = points.shape[1]
        return cls(np.array(directions).reshape(-1, width), np.array(offsets), np.array(children, dtype=np.int64).reshape(-1, 2), roots,
                   np.zeros(leaves, dtype=np.int64))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.empty((len(x), len(self.roots)), dtype=np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root, dtype=np.int64)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                right = (x[inner] * self.directions[node]).sum(axis=1) > self.offsets[node]
                at[inner] = self.children[node, right.astype(int)]
            out[:, t] = -at - 1
        return out

    def probe(self, query: np.ndarray, want: int) -> list[int]:
        """Leaves of all trees by one queue: smallest distance to the cell first, until they hold ``want`` vectors."""
        margin = (self.directions @ query - self.offsets).tolist() if len(self.offsets) else []
        queue, opened, held = [(0.0, r) for r in self.roots], [], 0
        heapq.heapify(queue)
        while queue and held < want:
            far, at = heapq.heappop(queue)
            while at >= 0:
                m = margin[at]
                low, high = self.children[at]
                near, other = (high, low) if m > 0 else (low, high)
                heapq.heappush(queue, (far + m * m, int(other)))
                at = int(near)
            opened.append(-at - 1)
            held += int(self.sizes[-at - 1])
        return opened


def split(x: np.ndarray, rng: np.random.Generator, rounds: int = 4, most: int = 400) -> np.ndarray:
    """Two centres between which to project: two random points moved by a few rounds of two-means on some of the rows."""
    x = x[rng.permutation(len(x))[:most]]
    centres = x[rng.choice(len(x), 2, replace=False)]
    for _ in range(rounds):
        second = ((x - centres[1]) ** 2).sum(axis=1) < ((x - centres[0]) ** 2).sum(axis=1)
        if not 0 < second.sum() < len(x):
            break
        centres = np.array([x[~second].mean(axis=0), x[second].mean(axis=0)])
    return centres


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def distances(query: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - query) ** 2).sum(axis=1))


def valid(vectors: DataFrame) -> DataFrame:
    """(id, vec) of the rows that take part."""
    v = F.col("vec")
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = (vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("vec"))
            .where("id is not null and vec is not null"))
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.coalesce(good, F.lit(False)))
    common = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("vec") == (common["d"] if common else 0))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE,
            share: float = SHARE, least: int = LEAST, part_rows: int = PART_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``. A query opens
    leaves of ``least`` vectors or ``share`` of all, whichever is more, counted over all trees."""
    spark = vectors.sparkSession
    rows = valid(vectors)
    # one point per distinct vector; ids beyond the k + 1 smallest of a vector cannot be among any query's k nearest
    rank = F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))
    points = cut(rows.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids")))
    n = points.count()
    chosen = points.orderBy(F.xxhash64("vec"), "vec").limit(sample).select("vec").toPandas()  # at most ``sample`` vectors
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    forest = Forest.fit(matrix(chosen["vec"]), trees, leaf)
    shared = spark.sparkContext.broadcast(forest)
    kind = rows.schema["vec"].dataType.simpleString()
    sizes = points.select("vec").mapInPandas(
        lambda bs: (pd.DataFrame({"leaf": x}) for b in bs if len(b) for x in [shared.value.leaves(matrix(b["vec"])).ravel()]), "leaf long")
    for leaf_id, size in sizes.groupBy("leaf").agg(F.count(F.lit(1))).collect():  # a row per leaf of the bounded forest
        forest.sizes[leaf_id] = size
    asked = rows.where(F.col("id") % every == 0).select("id", "vec")
    reps = cut(asked.groupBy("vec").agg(F.min("id").alias("rep")))
    asks = reps.count()
    shares = max(1, math.ceil(asks / query_rows))
    counted, want = spark.sparkContext.broadcast(forest), max(least, math.ceil(share * n))
    opened = asks * min(len(forest.sizes), math.ceil(want * len(forest.sizes) / max(1, int(forest.sizes.sum()))))
    groups = max(1, math.ceil(n * trees * shares / GROUP_ROWS), math.ceil(opened / GROUP_ROWS))

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = np.maximum(1, -(-counted.value.sizes // part_rows))
        for b in batches:
            if len(b):
                at = counted.value.leaves(matrix(b["vec"]))
                i = np.repeat(np.arange(len(b)), at.shape[1])
                leaf_ids = at.ravel()
                part = b["h"].to_numpy()[i] % parts[leaf_ids]
                for s in range(shares):
                    yield pd.DataFrame({"leaf": leaf_ids, "part": part, "share": s, "ids": b["ids"].to_numpy()[i], "vec": b["vec"].to_numpy()[i]})

    hashed = points.select("ids", "vec", F.pmod(F.xxhash64("vec"), F.lit(1 << 40)).alias("h"))
    index = hashed.mapInPandas(file, f"leaf long, part long, share long, ids array<long>, vec {kind}")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = np.maximum(1, -(-counted.value.sizes // part_rows))
        for b in batches:
            for rep, vec, h in zip(b["rep"], b["vec"], b["h"]):
                leaves = np.array(counted.value.probe(np.asarray(vec, dtype=np.float64), want), dtype=np.int64)
                times = parts[leaves]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                yield pd.DataFrame({"leaf": np.repeat(leaves, times), "part": part, "share": h % shares, "rep": rep, "vec": [vec] * len(part)})

    probes = (reps.withColumn("h", F.pmod(F.xxhash64("rep"), F.lit(1 << 40)))
              .repartition(max(2, min(n // 500, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
              .mapInPandas(ask, f"leaf long, part long, share long, rep long, vec {kind}"))

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            cell = ["leaf", "part", "share"]
            by_leaf = dict(tuple(left.groupby(cell)))
            for leaf_id, asks in right.groupby(cell):
                if (own := by_leaf.get(leaf_id)) is None:
                    continue
                x, ids = matrix(own["vec"]), own["ids"].to_numpy()
                for rep, vec in zip(asks["rep"], asks["vec"]):
                    d = distances(np.asarray(vec, dtype=np.float64), x)
                    cutoff = np.partition(d, k)[k] if len(d) > k + 1 else np.inf
                    near = sorted((d[i], v) for i in np.flatnonzero(d <= cutoff).tolist() for v in ids[i].tolist())[:k + 1]
                    out += [(rep, v, s) for s, v in near]
        return pd.DataFrame(out, columns=["rep", "vec_id", "score"]).astype({"rep": "int64", "vec_id": "int64", "score": "float64"})

    group = F.pmod(F.xxhash64("leaf", "part", "share"), F.lit(groups)).alias("g")
    found = (index.groupBy(group).cogroup(probes.groupBy(group)).applyInPandas(rerank, "rep long, vec_id long, score double")
             .groupBy("rep", "vec_id").agg(F.min("score").alias("score")))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
    own = asked.select(F.col("id").alias("query_id"), "vec").distinct().join(reps, "vec").select("query_id", "rep")
    final = own.join(best, "rep").where("query_id <> vec_id")
    final = final.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return final.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
