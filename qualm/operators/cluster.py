"""Clustering (E1-E4): k-means, small-cluster merging, HDBSCAN core distances.

Cluster-level tables (sizes, centroids) have one row per cluster; centroid to
centroid and row to centroid searches use the blocked exact kNN (S2), so no
table is ever paired with all of another.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .blocks import DIFF_VALUES, knn
from .order import hash_key


def _nearest(X: np.ndarray, C: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest centre of each row by direct differences; ties -> first centre."""
    lab, low, step = np.empty(len(X), dtype=np.int64), np.empty(len(X)), max(1, DIFF_VALUES // max(1, C.size))
    for s in range(0, len(X), step):
        d2 = ((X[s:s + step, None, :] - C[None, :, :]) ** 2).sum(axis=2)
        lab[s:s + step] = d2.argmin(axis=1)
        low[s:s + step] = d2.min(axis=1)
    return lab, low


def _totals(points: DataFrame, centres: np.ndarray, vec: str):
    """(sums, counts, inertia) of all runs' clusters in one aggregate. A task holds a sum per (run, cluster), and a row per
    task, run and cluster is shuffled; runs x clusters rows reach the driver."""
    runs, k, d = centres.shape

    def partial(batches):
        sums, counts, inertia = np.zeros((runs, k, d)), np.zeros((runs, k), dtype=np.int64), np.zeros((runs, k))
        for b in batches:
            if len(b):
                X = np.stack(b[vec].to_numpy()).astype(np.float64)
                for r in range(runs):
                    lab, low = _nearest(X, centres[r])
                    member = (lab[:, None] == np.arange(k)).astype(np.float64)
                    sums[r] += member.T @ X
                    counts[r] += np.bincount(lab, minlength=k)
                    inertia[r] += np.bincount(lab, low, minlength=k)
        yield pd.DataFrame([(r, c, int(counts[r, c]), inertia[r, c], sums[r, c]) for r in range(runs) for c in range(k) if counts[r, c]],
                           columns=["run", "cluster", "n", "inertia", "total"])

    rows = (points.select(vec).mapInPandas(partial, "run int, cluster int, n bigint, inertia double, total array<double>")
            .groupBy("run", "cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"),
                                           Summarizer.sum(array_to_vector("total")).alias("total")).collect())
    sums, counts, inertia = np.zeros((runs, k, d)), np.zeros((runs, k), dtype=np.int64), np.zeros(runs)
    for r in rows:
        sums[r["run"], r["cluster"]], counts[r["run"], r["cluster"]] = r["total"].toArray(), r["n"]
        inertia[r["run"]] += r["inertia"]
    return sums, counts, inertia


def random_starts(points: DataFrame, k: int, runs: int = 1, seed: int = 0, vec: str = "v", id_col: str = "row_id") -> np.ndarray:
    """runs x k x d: in each run the k rows that come first by md5(seed + run:id), ties by id."""
    first = lambda r: points.orderBy(hash_key(seed + r, id_col), id_col).limit(k).select(vec).collect()
    return np.array([[x[0] for x in first(r)] for r in range(runs)], dtype=np.float64)


def plus_plus_starts(points: DataFrame, k: int, runs: int = 1, seed: int = 0, vec: str = "v", id_col: str = "row_id") -> np.ndarray:
    """runs x k x d by k-means++: a row is drawn with a chance in proportion to its squared distance from the centres so
    far. The draw is a race: the row with the smallest -ln(u) / weight wins, u hashed from (seed, run, round, id), so a
    round is one job for all runs that sends a row per task and run. Rows on a centre come last, by id."""
    chosen: list[list[np.ndarray]] = [[] for _ in range(runs)]
    for turn in range(k):
        so_far = np.array(chosen) if turn else None

        def race(batches):
            best: list = [None] * runs
            for b in batches:
                if len(b):
                    X, ids = np.stack(b["v"].to_numpy()).astype(np.float64), b["id"].to_numpy()
                    u = ((np.stack(b["h"].to_numpy()).astype(np.int64).view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53
                    for r in range(runs):
                        w = _nearest(X, so_far[r])[1] if so_far is not None else np.ones(len(X))
                        key = np.where(w > 0, -np.log(u[:, r]) / np.where(w > 0, w, 1.0), np.inf)
                        i = np.lexsort((ids, key))[0]
                        if best[r] is None or (key[i], ids[i]) < best[r][:2]:
                            best[r] = (key[i], ids[i], X[i])
            yield pd.DataFrame([(r, *x) for r, x in enumerate(best) if x is not None], columns=["run", "key", "id", "v"])

        hashes = F.array(*[F.xxhash64(F.lit(seed), F.lit(r), F.lit(turn), F.col(id_col)) for r in range(runs)])
        won = (points.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).alias("v"), hashes.alias("h"))
               .mapInPandas(race, "run int, key double, id bigint, v array<double>")
               .groupBy("run").agg(F.min_by("v", F.struct("key", "id")).alias("v")).collect())
        for row in won:
            chosen[row["run"]].append(np.array(row["v"]))
    return np.array(chosen)


def lloyd(points: DataFrame, starts: np.ndarray, max_iter: int = 300, tol: float = 1e-4, vec: str = "v"):
    """Lloyd iterations of all runs together: (centres of the run with the least inertia, its inertia, its number).

    ``starts`` is runs x k x d. A run ends when its centres move by at most ``tol`` times the mean variance (squared, in
    total), or after ``max_iter`` rounds, which is the method's parameter. A centre without rows stays where it is. Ties in
    inertia -> first run. Centres (runs x k x d, independent of the rows) live on the driver; a lost executor costs a
    re-read of its part of ``points``."""
    centres = np.array(starts, dtype=np.float64)
    if tol > 0:
        spread = points.select(array_to_vector(F.col(vec)).alias("v")).agg(Summarizer.metrics("variance").summary(F.col("v")).alias("s")).first()["s"]
        tol = tol * float(np.mean(spread["variance"].toArray()))
    active = np.arange(len(centres))
    for _ in range(max_iter):
        sums, counts, _ = _totals(points, centres[active], vec)
        moved = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], centres[active])
        shift = ((moved - centres[active]) ** 2).sum(axis=(1, 2))
        centres[active] = moved
        active = active[shift > tol]
        if not len(active):
            break
    inertia = _totals(points, centres, vec)[2]
    best = int(np.argmin(inertia))
    return centres[best], float(inertia[best]), best


def assign(df: DataFrame, centres: np.ndarray, vec: str = "v", out: str = "cluster") -> DataFrame:
    """``df`` with the index of the nearest centre."""
    @F.pandas_udf("bigint")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(_nearest(np.stack(v.to_numpy()).astype(np.float64), centres)[0] if len(v) else [], dtype="int64")
    return df.withColumn(out, nearest(F.col(vec)))


def kmeans_fit_predict(train: DataFrame, evals: DataFrame | None, k: int, seed: int = 0, vec: str = "v",
                       max_iter: int = 300, out: str = "cluster", init: str | np.ndarray = "k-means||", n_init: int = 1,
                       tol: float = 1e-4, id_col: str = "row_id"):
    """K-means on train; every row gets the nearest centre. Returns (train labelled, evals labelled or None, centres
    table). ``init`` is "k-means||" (Spark ML, one run), "k-means++" or "random" (``n_init`` runs together, the least
    inertia wins), or an array of start centres (k x d, or runs x k x d). k is cut to the number of rows."""
    spark = train.sparkSession
    table = lambda cs: spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(cs)],
                                             f"{out} bigint, centroid array<double>")
    if isinstance(init, str) and init == "k-means||":
        km = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_f", predictionCol=out)
        model = km.fit(train.withColumn("_f", array_to_vector(F.col(vec))))
        lab = lambda d: model.transform(d.withColumn("_f", array_to_vector(F.col(vec)))).drop("_f") \
            .withColumn(out, F.col(out).cast("bigint"))
        return lab(train), (lab(evals) if evals is not None else None), table(model.clusterCenters())
    points = materialize(train.select(F.col(id_col), F.col(vec)))
    if isinstance(init, str):
        draw = {"random": random_starts, "k-means++": plus_plus_starts}.get(init)
        if draw is None:
            raise ValueError(f"unknown init {init}")
        k = min(k, points.count())
        starts = draw(points, k, n_init, seed, vec, id_col)
    else:
        starts = np.asarray(init, dtype=np.float64)
        starts = starts[None] if starts.ndim == 2 else starts
    centres = lloyd(points, starts, max_iter, tol, vec)[0]
    return assign(train, centres, vec, out), (assign(evals, centres, vec, out) if evals is not None else None), table(centres)


def centroids(df: DataFrame, label: str, vec: str = "v") -> DataFrame:
    """(label, size, centroid) per cluster, vector means in the JVM."""
    return (df.groupBy(label).agg(F.count("*").alias("size"),
                                  Summarizer.mean(array_to_vector(F.col(vec))).alias("_m"))
              .select(label, "size", vector_to_array("_m").alias("centroid")))


def merge_small_clusters(df: DataFrame, label: str, min_size: int, vec: str = "v",
                         include_noise: bool = False, out: str | None = None) -> DataFrame:
    """Move every cluster smaller than ``min_size`` to the nearest large
    cluster, centroid to centroid, using the original centroids (no cascade).
    E2 never touches noise (-1); E3 (``include_noise``) treats noise as a
    cluster: small noise is absorbed and large noise is a legal target.
    With no large cluster the labels stay as they are."""
    out = out or label
    c = centroids(df, label, vec)
    elig = c if include_noise else c.filter(F.col(label) != -1)
    small = elig.filter(F.col("size") < min_size).select(F.col(label).alias("row_id"), F.col("centroid").alias("v"))
    large = elig.filter(F.col("size") >= min_size).select(F.col(label).alias("row_id"), F.col("centroid").alias("v"))
    nn = knn(small, large, 1)  # ties -> smallest label
    mapping = nn.select(F.col("q_id").alias(label), F.col("p_id").alias("_to"))
    return (df.join(mapping, label, "left")
              .withColumn(out, F.coalesce(F.col("_to"), F.col(label))).drop("_to"))


def core_distances(train: DataFrame, min_samples: int, vec: str = "v", id_col: str = "row_id") -> DataFrame:
    """Distance to the min_samples-th nearest other row (the row itself not counted)."""
    nn = knn(train, train, min_samples, qid=id_col, pid=id_col, vec=vec, exclude_self=True)
    return (nn.groupBy(F.col("q_id").alias(id_col))
              .agg(F.max_by("dist", "rank").alias("core_dist")))
