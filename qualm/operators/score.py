"""Uncertainty scoring (F1-F8): joins from evaluation rows to train rows.

All return (row_id, uq) keyed by the evaluation row id (plus any carried
columns the caller selects afterwards).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import knn, knn_mean_distance


def knn_uncertainty(train: DataFrame, evals: DataFrame, k: int = 5, vec: str = "v",
                    id_col: str = "row_id") -> DataFrame:
    """mean Euclidean distance to the k nearest train rows."""
    return knn_mean_distance(evals, train, k, qid=id_col, pid=id_col, vec=vec, out_col="uq")


# ---------------------------------------------------------------------------------- F3
def kmeans_uq(train: DataFrame, evals: DataFrame, k_clusters: int, knn_k: int | None, seed: int = 0,
              vec: str = "v", id_col: str = "row_id", **fit) -> DataFrame:
    """0.4 x distance to the nearest centroid + 0.6 x mean distance to the
    k nearest train rows of that cluster (k cut to the cluster size); the
    centroid distance alone when the cluster or k is at most 1, or with ``knn_k`` None
    (kNN off); non-finite -> 0. ``fit`` goes to E1: ``init``, ``n_init``, ``max_iter``, ``tol``."""
    from .cluster import kmeans_fit_predict
    from ..functions.stats import nan_to_num
    tr, _, cents = kmeans_fit_predict(train, None, k_clusters, seed, vec, id_col=id_col, **fit)
    c = cents.select(F.col("cluster").alias("row_id"), F.col("centroid").alias("v"))
    q = evals.select(F.col(id_col).alias("row_id"), F.col(vec).alias("v"))
    near = knn(q, c, 1).select(F.col("q_id").alias("row_id"), F.col("p_id").alias("cluster"),
                               F.col("dist").alias("cdist"))
    if knn_k is None or knn_k <= 1:
        return near.select(F.col("row_id").alias(id_col), nan_to_num(F.col("cdist")).alias("uq"))
    qc = q.join(near, "row_id")
    pts = tr.select(F.col(id_col).alias("row_id"), F.col(vec).alias("v"), "cluster")
    sizes = pts.groupBy("cluster").agg(F.count("*").alias("csize"))
    nn = knn(qc, pts, knn_k, by=["cluster"]).groupBy("cluster", F.col("q_id").alias("row_id")).agg(
        F.avg("dist").alias("kdist"))
    r = qc.join(sizes, "cluster", "left").join(nn, ["cluster", "row_id"], "left")
    uq = F.when(F.coalesce(F.col("csize"), F.lit(0)) <= 1, F.col("cdist")).otherwise(0.4 * F.col("cdist") + 0.6 * F.col("kdist"))
    return r.select(F.col("row_id").alias(id_col), nan_to_num(uq).alias("uq"))


# ---------------------------------------------------------------------------- F6 / F7 / F8
import math  # noqa: E402

import numpy as np  # noqa: E402
from pyspark.ml.functions import array_to_vector, vector_to_array  # noqa: E402
from pyspark.ml.stat import Summarizer  # noqa: E402

from .blocks import log_density_lanes  # noqa: E402
from .order import global_rank  # noqa: E402

BANDWIDTHS = [float(x) for x in np.logspace(-1, 1.5, 30)]  # 30 values, 10^-1 .. 10^1.5
N_FOLDS = 5


def _dim(df: DataFrame, vec: str) -> int:
    return len(df.select(vec).first()[0])


def contiguous_folds(df: DataFrame, n_folds: int = N_FOLDS, by=(), id_col: str = "row_id") -> DataFrame:
    """Unshuffled k-fold labels in row order: the first n % k folds get one extra row."""
    by = list(by)
    r = global_rank(df, [id_col], by, rank_col="_r")
    n = df.groupBy(*by).agg(F.count("*").alias("_n")) if by else df.agg(F.count("*").alias("_n"))
    r = r.join(F.broadcast(n), by) if by else r.crossJoin(F.broadcast(n))
    base, extra = F.floor(F.col("_n") / n_folds), F.col("_n") % n_folds
    i = F.col("_r") - 1
    big = extra * (base + 1)
    fold = F.when(i < big, F.floor(i / (base + 1))).otherwise(extra + F.floor((i - big) / F.greatest(base, F.lit(1))))
    return r.withColumn("fold", fold.cast("bigint")).drop("_r", "_n")


def _held_out(by: list[str], bandwidths, d: int):
    """Log densities of a row under the points of the other folds, one per bandwidth, from its lanes."""
    bw = np.asarray(bandwidths, dtype=np.float64)
    scale = 1.0 / (2.0 * bw * bw)

    def run(batches):
        for b in batches:
            if len(b):
                i, own = np.arange(len(b)), b["fold"].to_numpy()
                near, cnt = np.stack(b["near"].to_numpy()).copy(), np.stack(b["cnt"].to_numpy())
                near[i, own] = np.inf
                sums = np.stack(b["sums"].to_numpy()).reshape(len(b), near.shape[1], len(bw))
                low, n = near.min(axis=1), cnt.sum(axis=1) - cnt[i, own]
                some = n > 0  # a group of one row has no other fold
                if not some.any():
                    continue
                near, sums, low = near[some], sums[some], low[some]
                total = (sums * np.exp(-(near - low[:, None])[:, :, None] * scale)).sum(axis=1)
                logp = np.log(total) - low[:, None] * scale - np.log(n[some])[:, None] - (d / 2.0) * np.log(2 * np.pi * bw * bw)
                yield b.loc[some, [*by, "fold"]].assign(logp=list(logp))
    return run


def choose_bandwidth(train: DataFrame, bandwidths=BANDWIDTHS, by=(), vec: str = "v", id_col: str = "row_id",
                     n_folds: int = N_FOLDS, **blocks) -> DataFrame:
    """cross-validated Gaussian-KDE bandwidth per group: fold mean of the
    held-out total log-likelihood; the first of equal scores wins.
    Returns (by..., bw_idx, bandwidth, cv_score). A group of one row has no score and no row.

    A train row is one row of lanes (folds x bandwidths) from the pair pass to its fold's sum; ``blocks`` goes to that pass."""
    by = list(by)
    d = _dim(train, vec)
    tf = contiguous_folds(train, n_folds, by, id_col)
    lanes = log_density_lanes(tf, tf, bandwidths, by, "fold", n_folds, id_col, id_col, vec, keep=["fold"], apart="fold", **blocks)
    typed = "".join(f"`{b}` {train.schema[b].dataType.simpleString()}, " for b in by)
    logp = lanes.mapInPandas(_held_out(by, bandwidths, d), f"{typed}fold bigint, logp array<double>")
    per_fold = logp.groupBy(*by, "fold").agg(Summarizer.sum(array_to_vector("logp")).alias("s"))
    # a literal key where there are no groups: a vector aggregate over no rows at all would fail
    cv = per_fold.groupBy(*(by or [F.lit(0).alias("_all")])).agg(vector_to_array(Summarizer.mean(F.col("s"))).alias("m"))
    best = cv.select(*by, F.array_max("m").alias("cv_score"), (F.array_position("m", F.array_max("m")) - 1).cast("bigint").alias("bw_idx"))
    return best.select(*by, "bw_idx", F.get(F.array(*[F.lit(float(b)) for b in bandwidths]), F.col("bw_idx").cast("int")).alias("bandwidth"),
                       "cv_score")


def _minus_log_density(d: int, h: float) -> Column:
    """-log density from lanes of one fold and one bandwidth."""
    logp = F.log(F.get("sums", F.lit(0))) - F.get("near", F.lit(0)) / (2 * h * h) - F.log(F.get("cnt", F.lit(0)))
    return (d / 2.0) * math.log(2 * math.pi * h * h) - logp


def kde_neg_log_density(train: DataFrame, evals: DataFrame, bandwidth: float, by=(), vec: str = "v",
                        id_col: str = "row_id") -> DataFrame:
    """-log p(x) under a Gaussian KDE of the train rows (per ``by`` group)."""
    by = list(by)
    lanes = log_density_lanes(evals, train, [bandwidth], by, qid=id_col, pid=id_col, vec=vec)
    return lanes.select(*by, F.col("q_id").alias(id_col), _minus_log_density(_dim(train, vec), bandwidth).alias("uq"))


def kde_by_group(train: DataFrame, evals: DataFrame, bw: DataFrame, by: str, d: int) -> DataFrame:
    """(row_id, by, uq): -log density of (row_id, v, by) rows under their group's KDE with its bandwidth h from ``bw``.
    h is applied by scaling vectors by 1/h and using bandwidth 1: log p_h(x) = log p_1(x/h) - d ln h."""
    scale = lambda df: df.join(bw, by).withColumn("v", F.transform("v", lambda x: x / F.col("bandwidth")))
    lanes = log_density_lanes(scale(evals), scale(train), [1.0], [by, "bandwidth"])
    return lanes.select(F.col("q_id").alias("row_id"), by, (_minus_log_density(d, 1.0) + d * F.log("bandwidth")).alias("uq"))


def split_frames(uq: DataFrame, evals: DataFrame, metrics=("meteor", "bertscore_f1", "perplexity"), id_col: str = "row_id") -> DataFrame:
    """The frames of F2, F7 and F8 in one table: (row_id, split, uq, metrics...) for every scored evaluation row."""
    return evals.select(id_col, "split", *metrics).join(uq.select(id_col, "uq"), id_col).select(id_col, "split", "uq", *metrics)


def kde_uncertainty(train: DataFrame, evals: DataFrame, bandwidths=BANDWIDTHS, vec: str = "v",
                    id_col: str = "row_id") -> DataFrame:
    """global KDE with the cross-validated bandwidth; score = -log density."""
    bw = choose_bandwidth(train, bandwidths, vec=vec, id_col=id_col).first()["bandwidth"]
    return kde_neg_log_density(train, evals, bw, vec=vec, id_col=id_col)


# ---------------------------------------------------------------------------------- F2
def kmeans_knn_uncertainty(train: DataFrame, evals: DataFrame, k_clusters: int, k: int, seed: int = 0,
                           vec: str = "v", id_col: str = "row_id", **fit) -> DataFrame:
    """k-means, merge clusters below k rows, nearest merged centroid, mean
    distance to the k nearest train rows of that cluster. A row whose cluster
    has fewer than k rows takes the largest score of the earlier rows (row-id
    order), 0 for the first."""
    from .cluster import centroids, kmeans_fit_predict, merge_small_clusters
    from ..plans.materialize import materialize
    tr, _, _ = kmeans_fit_predict(train, None, k_clusters, seed, vec, id_col=id_col, **fit)
    tr = materialize(merge_small_clusters(tr, "cluster", k, vec))
    cents = centroids(tr, "cluster", vec)
    c = cents.select(F.col("cluster").alias("row_id"), F.col("centroid").alias("v"), F.col("size"))
    q = evals.select(F.col(id_col).alias("row_id"), F.col(vec).alias("v"))
    near = knn(q, c.drop("size"), 1).select(F.col("q_id").alias("row_id"), F.col("p_id").alias("cluster"))
    qc = q.join(near, "row_id").join(c.select(F.col("row_id").alias("cluster"), "size"), "cluster")
    pts = tr.select(F.col(id_col).alias("row_id"), F.col(vec).alias("v"), "cluster")
    ok = qc.filter(F.col("size") >= k)
    nn = knn(ok, pts, k, by=["cluster"]).groupBy(F.col("q_id").alias("row_id")).agg(F.avg("dist").alias("_uq"))
    allq = qc.select("row_id").join(nn, "row_id", "left")
    ranked = global_rank(allq, ["row_id"], [], rank_col="_r", max_cols=["_uq"])
    uq = F.coalesce(F.col("_uq"), F.col("prevmax__uq"), F.lit(0.0))
    return ranked.select(F.col("row_id").alias(id_col), uq.alias("uq"))


# ---------------------------------------------------------------------------------- F8
def kmeans_kde_fit(train: DataFrame, k_clusters: int, min_cluster_size: int, seed: int = 0, bandwidths=BANDWIDTHS,
                   vec: str = "v", id_col: str = "row_id", **fit):
    """F8's model: (train rows (row_id, v, cluster) after the merge of small clusters, k-means centres, and per cluster its
    size and cross-validated bandwidth). A cluster of one row (no large one to join) has no bandwidth."""
    from .cluster import kmeans_fit_predict, merge_small_clusters
    from ..plans.materialize import materialize
    tr, _, cents = kmeans_fit_predict(train, None, k_clusters, seed, vec, id_col=id_col, **fit)
    tr = merge_small_clusters(tr, "cluster", min_cluster_size, vec)
    tr = materialize(tr.select(F.col(id_col).alias("row_id"), F.col(vec).alias("v"), "cluster"))
    sizes = tr.groupBy("cluster").agg(F.count("*").alias("size"))
    bw = choose_bandwidth(tr, bandwidths, by=["cluster"]).select("cluster", "bandwidth")
    return tr, cents, materialize(sizes.join(bw, "cluster", "left"))


def kmeans_kde_clusters(train: DataFrame, k_clusters: int, min_cluster_size: int, seed: int = 0, bandwidths=BANDWIDTHS,
                        vec: str = "v", id_col: str = "row_id", **fit) -> DataFrame:
    """F8, per cluster: (cluster, size, bandwidth, uq), uq the mean of -log density over the cluster's own train rows
    under its KDE; null for a cluster of one row."""
    tr, _, model = kmeans_kde_fit(train, k_clusters, min_cluster_size, seed, bandwidths, vec, id_col, **fit)
    bw = model.select("cluster", "bandwidth").where("bandwidth is not null")
    mean = kde_by_group(tr, tr, bw, "cluster", _dim(train, vec)).groupBy("cluster").agg(F.avg("uq").alias("uq"))
    return model.join(mean, "cluster", "left").select("cluster", "size", "bandwidth", "uq")


def kmeans_kde_uncertainty(train: DataFrame, evals: DataFrame, k_clusters: int, min_cluster_size: int,
                           seed: int = 0, bandwidths=BANDWIDTHS, vec: str = "v", id_col: str = "row_id", **fit) -> DataFrame:
    """F8: k-means, merge small clusters, one cross-validated KDE per cluster
    (keyed by label); each eval row is scored by the nearest k-means centre
    whose merged cluster has at least ``min_cluster_size`` rows; +inf if none."""
    tr, cents, model = kmeans_kde_fit(train, k_clusters, min_cluster_size, seed, bandwidths, vec, id_col, **fit)
    large = model.filter((F.col("size") >= min_cluster_size) & F.col("bandwidth").isNotNull())
    elig = cents.join(large, "cluster", "left_semi").select(F.col("cluster").alias("row_id"), F.col("centroid").alias("v"))
    q = evals.select(F.col(id_col).alias("row_id"), F.col(vec).alias("v"))
    near = knn(q, elig, 1).select(F.col("q_id").alias("row_id"), F.col("p_id").alias("cluster"))
    scored = kde_by_group(tr, q.join(near, "row_id"), large.select("cluster", "bandwidth"), "cluster", _dim(train, vec)).select("row_id", "uq")
    return (q.select("row_id").join(scored, "row_id", "left")
             .select(F.col("row_id").alias(id_col), F.coalesce(F.col("uq"), F.lit(float("inf"))).alias("uq")))


# ---------------------------------------------------------------------------- F4 / F5
def _single(df: DataFrame, vec: str, id_col: str) -> DataFrame:
    """(row_id, v) with components rounded to single precision (D11); sums stay double."""
    return df.select(F.col(id_col).alias("row_id"), F.transform(vec, lambda x: x.cast("float").cast("double")).alias("v"))


def _global_knn_mean(train_pts: DataFrame, q: DataFrame, n_neighbors: int) -> DataFrame:
    return knn(q, train_pts, n_neighbors).groupBy(F.col("q_id").alias("row_id")).agg(F.avg("dist").alias("uq"))


def hdbscan_knn_uncertainty(train: DataFrame, evals: DataFrame, min_cluster_size: int, min_samples: int,
                            epsilon: float, n_neighbors: int, vec: str = "v", id_col: str = "row_id",
                            labels: DataFrame | None = None) -> DataFrame:
    """F4 (flagship): HDBSCAN on train, small clusters (noise included) merged
    into the nearest large one, each eval row assigned to the nearest non-noise
    centroid and scored by its mean distance to the n nearest rows of that
    cluster; a cluster smaller than n -> global kNN; no cluster -> global kNN
    for every row; an empty train set -> 0."""
    from ..plans.materialize import materialize
    from .cluster import centroids, merge_small_clusters
    from .hdbscan import hdbscan_labels
    pts, q = _single(train, vec, id_col), _single(evals, vec, id_col)
    if pts.limit(1).count() == 0:
        return q.select(F.col("row_id").alias(id_col), F.lit(0.0).alias("uq"))
    lab = labels if labels is not None else hdbscan_labels(pts, min_cluster_size, min_samples, epsilon)
    lab = materialize(merge_small_clusters(pts.join(lab, "row_id"), "label", min_cluster_size,
                                           include_noise=True))
    cl = lab.filter(F.col("label") != -1)
    if cl.limit(1).count() == 0:
        g = _global_knn_mean(pts, q, n_neighbors)
        return g.select(F.col("row_id").alias(id_col), "uq")
    cents = centroids(cl, "label", "v")
    c = cents.select(F.col("label").alias("row_id"), F.col("centroid").alias("v"))
    near = knn(q, c, 1).select(F.col("q_id").alias("row_id"), F.col("p_id").alias("label"))
    qc = q.join(near, "row_id").join(cents.select("label", "size"), "label")
    inside = qc.filter(F.col("size") >= n_neighbors)
    fall = qc.filter(F.col("size") < n_neighbors).select("row_id", "v")
    s1 = (knn(inside, cl.select("row_id", "v", "label"), n_neighbors, by=["label"])
          .groupBy(F.col("q_id").alias("row_id")).agg(F.avg("dist").alias("uq")))
    s2 = _global_knn_mean(pts, fall, n_neighbors)
    return s1.unionByName(s2).select(F.col("row_id").alias(id_col), "uq")


def hdbscan_min_cluster_uncertainty(train: DataFrame, evals: DataFrame, min_cluster_size: int, min_samples: int,
                                    epsilon: float, n_neighbors: int, vec: str = "v", id_col: str = "row_id",
                                    labels: DataFrame | None = None) -> DataFrame:
    """like F4, but the score is the smallest mean kNN distance over every
    non-noise cluster with at least n rows; global kNN when none qualifies."""
    from ..plans.materialize import materialize
    from .cluster import merge_small_clusters
    from .hdbscan import hdbscan_labels
    pts, q = _single(train, vec, id_col), _single(evals, vec, id_col)
    lab = labels if labels is not None else hdbscan_labels(pts, min_cluster_size, min_samples, epsilon)
    lab = materialize(merge_small_clusters(pts.join(lab, "row_id"), "label", min_cluster_size,
                                           include_noise=True))
    sizes = lab.filter(F.col("label") != -1).groupBy("label").agg(F.count("*").alias("size"))
    ok = sizes.filter(F.col("size") >= n_neighbors).select("label")
    if ok.limit(1).count() == 0:
        g = _global_knn_mean(pts, q, n_neighbors)
        return g.select(F.col("row_id").alias(id_col), "uq")
    # one pass: top-n per (eval row, qualifying cluster), no copies of the eval rows
    from .blocks import knn_per_point_group
    per = (knn_per_point_group(q, lab.join(ok, "label"), n_neighbors, "label")
           .groupBy("label", F.col("q_id").alias("row_id")).agg(F.avg("dist").alias("m")))
    return per.groupBy("row_id").agg(F.min("m").alias("uq")).select(F.col("row_id").alias(id_col), "uq")
