"""Embedding pooling (D2-D4) and reductions.

Fits are distributed aggregates (Summarizer, the range finder of ``lowrank.py``, covariance
aggregates); only d-vectors and, for D10, one d x d matrix reach the driver. Transforms
are column expressions or Arrow-batched numpy matmuls against a d x k matrix.
"""
from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.quantile import exact_quantiles
from ..plans.materialize import materialize
from .lowrank import STRIPE, centred, count_mean, right_singular, sum_stripes


# -- D2-D4 ------------------------------------------------------------------------
def mean_pooling(tokens: DataFrame, id_col: str = "row_id", vec: str = "vec", mask: str = "mask") -> DataFrame:
    """Masked mean of token vectors per row; divisor floored at 1e-9.

    Vector sums run in the JVM (Summarizer, weighted by the mask), with map-side
    partial aggregation; no per-dimension explode."""
    t = tokens.select(id_col, array_to_vector(F.col(vec)).alias("_v"), F.col(mask).cast("double").alias("_w"))
    agg = t.groupBy(id_col).agg(Summarizer.sum(F.col("_v"), F.col("_w")).alias("_s"), F.sum("_w").alias("_m"))
    return agg.select(id_col, F.transform(vector_to_array("_s"), lambda x: x / F.greatest(F.col("_m"), F.lit(1e-9)))
                      .alias("pooled"))


def cls_pooling(tokens: DataFrame, id_col: str = "row_id", vec: str = "vec", pos: str = "pos") -> DataFrame:
    """First token's vector."""
    return tokens.groupBy(id_col).agg(F.min_by(F.col(vec), F.col(pos)).alias("pooled"))


def last_token_pooling(tokens: DataFrame, id_col: str = "row_id", vec: str = "vec", pos: str = "pos",
                       mask: str = "mask") -> DataFrame:
    """Vector at index (mask sum - 1), floored at 0 (right padding)."""
    tgt = tokens.groupBy(id_col).agg(F.greatest(F.sum(mask) - 1, F.lit(0)).cast("bigint").alias("_t"))
    return (tokens.join(tgt, id_col).filter(F.col(pos) == F.col("_t"))
                  .select(id_col, F.col(vec).alias("pooled")))


def explode_vector(df: DataFrame, vec: str, keys: Sequence[str], out: str = "value") -> DataFrame:
    """Long form (keys..., d, value) of an array column, for comparisons."""
    return df.select(*keys, F.posexplode(vec).alias("d", out)).withColumn("d", F.col("d").cast("bigint"))


# -- D5 ---------------------------------------------------------------------------
def fit_scaler(df: DataFrame, vec: str = "v") -> tuple[np.ndarray, np.ndarray]:
    """Mean and population std per dimension (std 0 -> 1). One aggregate."""
    s = df.select(array_to_vector(F.col(vec)).alias("_v")).agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s")).first()["s"]
    n = float(s["count"])
    mean = s["mean"].toArray()
    var = s["variance"].toArray() * ((n - 1) / n if n > 1 else 0.0)
    std = np.sqrt(var)
    std[std == 0] = 1.0
    return mean, std


def apply_scaler(df: DataFrame, mean, std, vec: str = "v", out: str | None = None) -> DataFrame:
    """Mean and std travel as one broadcast row, so the plan does not grow with the dimension."""
    out = out or vec
    model = df.sparkSession.createDataFrame([([float(x) for x in mean], [float(x) for x in std])], "_mean array<double>, _std array<double>")
    centred = F.zip_with(F.col(vec), F.col("_mean"), lambda x, a: x - a)
    return df.crossJoin(F.broadcast(model)).withColumn(out, F.zip_with(centred, F.col("_std"), lambda x, b: x / b)).drop("_mean", "_std")


def standard_scale(train: DataFrame, evals: DataFrame, vec: str = "v", fit_on: str = "both"):
    """Fit on train and eval together (default) or on train only; transform both."""
    src = train.select(vec).unionByName(evals.select(vec)) if fit_on == "both" else train.select(vec)
    mean, std = fit_scaler(src, vec)
    return apply_scaler(train, mean, std, vec), apply_scaler(evals, mean, std, vec), (mean, std)


# -- D6-D8 -------------------------------------------------------------------------
def _project_udf(W: np.ndarray, mean: np.ndarray | None):
    Wc = np.ascontiguousarray(W, dtype=np.float64)
    mu = None if mean is None else np.asarray(mean, dtype=np.float64)

    @F.pandas_udf("array<double>")
    def proj(v: pd.Series) -> pd.Series:
        out, some = pd.Series([None] * len(v), dtype=object), v.notna().to_numpy()
        if some.any() and len(Wc):
            X = np.stack(v[some].to_numpy()).astype(np.float64)
            if mu is not None:
                X = X - mu
            out[some] = pd.Series(list(X @ Wc), index=out.index[some])
        return out
    return proj


def _fix_signs(W: np.ndarray) -> np.ndarray:
    """Deterministic sign: the largest-magnitude loading of each component is positive."""
    if not len(W):
        return W
    idx = np.abs(W).argmax(axis=0)
    sgn = np.sign(W[idx, np.arange(W.shape[1])])
    sgn[sgn == 0] = 1
    return W * sgn


def fit_pca(train: DataFrame, k: int, vec: str = "v"):
    """Principal axes of the train rows (centred; no whitening), their mean and variances."""
    n, mean, W, sigma, _ = right_singular(train, k, True, vec)
    return _fix_signs(W), mean, sigma ** 2 / max(n - 1, 1)


def fit_svd(train: DataFrame, k: int, vec: str = "v"):
    """Top-k right singular vectors and values of the uncentred train matrix."""
    _, _, W, sigma, _ = right_singular(train, k, False, vec)
    return _fix_signs(W), sigma


def reduce_dimensionality(train: DataFrame, evals: DataFrame, k: int, method: str = "PCA",
                          vec: str = "v", out: str = "r"):
    """D6-D8 dispatch; an unknown name means PCA. A null vector has a null projection, and without any train
    vector all have."""
    m = method.upper()
    if m in ("SVD", "TUCKER"):
        W, _ = fit_svd(train, k, vec)
        f = _project_udf(W, None)
    else:
        W, mean, _ = fit_pca(train, k, vec)
        f = _project_udf(W, mean)
    return train.withColumn(out, f(F.col(vec))), evals.withColumn(out, f(F.col(vec)))


# -- D10 ---------------------------------------------------------------------------
def covariance(df: DataFrame, vec: str = "v") -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, sample covariance) of an array column in two aggregates: the mean, then centred outer products.

    A task holds one d x d sum and sends it in stripes of ``STRIPE`` matrix rows, which are summed by stripe number, so no
    task but the driver meets the whole matrix of another; d x d values (a property of the vectors, not of the number of
    rows) reach the driver. Rows with a null vector take no part."""
    rows = df.select(F.col(vec).alias("v")).where(F.col("v").isNotNull())
    n, mean = count_mean(rows)
    if n < 2:
        return n, np.zeros(0), np.zeros((0, 0))
    d = len(mean)

    def outer(batches):
        total = np.zeros((d, d))
        for b in batches:
            if len(b):
                X = centred(b, mean)
                total += X.T @ X
        yield pd.DataFrame({"stripe": range(0, d, STRIPE), "part": [total[i:i + STRIPE].ravel() for i in range(0, d, STRIPE)]})

    parts = rows.mapInPandas(outer, "stripe int, part array<double>")
    return n, mean, sum_stripes(parts, d, d) / (n - 1)


def whitening(cov: np.ndarray) -> np.ndarray:
    """W with W W^T the inverse of ``cov`` (its pseudo-inverse if singular), so |(x - mean) W| is the Mahalanobis distance."""
    try:
        low = np.linalg.cholesky(cov)
        if np.diag(low).min() > 1e-8 * np.diag(low).max():
            return np.linalg.inv(low).T
    except np.linalg.LinAlgError:
        pass
    vals, vecs = np.linalg.eigh(cov)
    keep = vals > max(vals.max(), 0.0) * 1e-15 * len(vals)
    return vecs[:, keep] / np.sqrt(vals[keep])


def mahalanobis_filter(df: DataFrame, cols: Sequence[str] | str, percentile: float = 95.0,
                       out: str = "mahalanobis") -> DataFrame:
    """Keep rows whose Mahalanobis distance is strictly below the given
    percentile of all distances. ``cols`` is an array column or a list of numeric columns. Distances are one matrix
    product per Arrow batch, and the percentile is exact, so the plan does not grow with the dimension. With fewer than
    two vectors all rows stay, with a null distance; rows with a null vector or component have none and go."""
    if isinstance(cols, str):
        v = F.transform(F.col(cols), lambda x: x.cast("double"))
    else:
        v = F.array(*[F.col(c).cast("double") for c in cols])
    v = F.when(~F.exists(v, lambda x: x.isNull()), v)
    n, mean, cov = covariance(df.select(v.alias("v")))
    if n < 2:
        return df.withColumn(out, F.lit(None).cast("double"))
    W = whitening(cov)

    @F.pandas_udf("double")
    def distance(x: pd.Series) -> pd.Series:
        res, some = np.full(len(x), np.nan), x.notna().to_numpy()
        if some.any():
            res[some] = np.sqrt((((np.stack(x[some].to_numpy()) - mean) @ W) ** 2).sum(axis=1))
        return pd.Series(res)

    withd = materialize(df.withColumn(out, distance(v)).where(~F.isnan(out)))
    thr = exact_quantiles(withd, out, df.sparkSession.createDataFrame([(percentile / 100.0,)], "q double"), [], "_thr")
    return withd.crossJoin(F.broadcast(thr.select("_thr"))).filter(F.col(out) < F.col("_thr")).drop("_thr")


# -- D9 ----------------------------------------------------------------------------
def relax(state: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least ``d`` per (keys..., node) along edges (u, w, dist), from the values in ``state``. Only values that fell in the
    last round travel; a round that lowers none ends it. Values fall and paths are finite, so it ends without a cap."""
    key = [*keys, "node"]
    state = front = materialize(state.select(*key, "d"))
    while True:
        step = (front.join(edges, F.col("node") == F.col("u")).select(*keys, F.col("w").alias("node"), (F.col("d") + F.col("dist")).alias("d"))
                .groupBy(*key).agg(F.min("d").alias("d")))
        front = materialize(step.join(state.withColumnRenamed("d", "_old"), key, "left")
                            .where(F.col("_old").isNull() | (F.col("d") < F.col("_old"))).drop("_old"))
        if front.isEmpty():
            return state
        state = materialize(state.unionByName(front).groupBy(*key).agg(F.min("d").alias("d")))


def component_links(pts: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (u, w, dist), both ways, between the nearest two rows of every two components of the neighbour graph; ties
    to the smallest ids. Each row looks up its nearest row in every other component, in one pass."""
    from .blocks import knn_per_point_group
    same = edges.select("u", "w", F.lit(0).cast("bigint").alias("dist"))
    comp = relax(pts.select(F.col("row_id").alias("node"), F.col("row_id").alias("d")), same, [])
    comp = comp.select(F.col("node").alias("row_id"), F.col("d").alias("comp"))
    near = knn_per_point_group(pts, pts.join(comp, "row_id"), 1, "comp")
    own = comp.select(F.col("row_id").alias("q_id"), F.col("comp").alias("own"))
    best = (near.join(own, "q_id").where("own < comp").groupBy("own", "comp")
            .agg(F.min(F.struct("dist", F.col("q_id").alias("u"), F.col("p_id").alias("w"))).alias("e")).select("e.*"))
    return best.select("u", "w", "dist").unionByName(best.select(F.col("w").alias("u"), F.col("u").alias("w"), "dist"))


def landmark_isomap(train: DataFrame, evals: DataFrame, k: int, n_neighbors: int = 5, n_landmarks: int = 64,
                    seed: int = 0, vec: str = "v", out: str = "r"):
    """Isomap by landmarks (de Silva and Tenenbaum, 2003).

    The neighbour graph comes from the blocked kNN (symmetrised); geodesic
    distances from the landmarks to every row are relaxed along graph edges,
    one join per round of the distances that fell, until nothing shortens. If some row is not reached, the
    graph's components are joined by their nearest pairs and the relaxation goes on. Classical MDS runs on the
    landmark x landmark matrix (small, on the driver); every row is placed by
    distance-based triangulation against the landmarks. Evaluation rows reach
    the landmarks through their train neighbours.
    """
    from .blocks import knn
    from .order import pick_first_n
    pts = materialize(train.select("row_id", F.col(vec).alias("v")))
    nn = knn(pts, pts, n_neighbors, exclude_self=True)
    e = nn.select(F.col("q_id").alias("u"), F.col("p_id").alias("w"), "dist")
    edges = materialize(e.unionByName(e.select(F.col("w").alias("u"), F.col("u").alias("w"), "dist"))
                        .groupBy("u", "w").agg(F.min("dist").alias("dist")))
    lm = (pick_first_n(pts.withColumn("_n", F.lit(int(n_landmarks))), "_n", seed, out_col="_pk")
          .filter("_pk").select("row_id"))
    lm_ids = sorted(r["row_id"] for r in lm.collect())  # at most n_landmarks ids
    L = len(lm_ids)
    spark = train.sparkSession
    lmi = spark.createDataFrame([(int(x), i) for i, x in enumerate(lm_ids)], "l bigint, li int")
    dist = relax(lmi.select("l", F.col("l").alias("node"), F.lit(0.0).alias("d")), edges, ["l"])
    if dist.count() < L * pts.count():
        dist = relax(dist, materialize(edges.unionByName(component_links(pts, edges))), ["l"])
    # classical MDS on the landmark block
    sub = dist.join(lmi.withColumnRenamed("l", "node").withColumnRenamed("li", "nj"), "node") \
              .join(lmi, "l").select("li", "nj", "d").collect()
    D2 = np.zeros((L, L))
    for r in sub:
        D2[r["li"], r["nj"]] = r["d"] ** 2
    D2 = (D2 + D2.T) / 2
    J = np.eye(L) - 1.0 / L
    B = -0.5 * J @ D2 @ J
    vals, vecs = np.linalg.eigh(B)
    order = np.argsort(vals)[::-1][:k]
    lam, V = np.maximum(vals[order], 1e-12), _fix_signs(vecs[:, order])
    Lsharp = V / np.sqrt(lam)          # L x k
    mu = D2.mean(axis=1)                # mean squared distance column

    @F.pandas_udf("array<double>")
    def place(dv: pd.Series) -> pd.Series:
        if len(dv) == 0:
            return pd.Series([], dtype=object)
        X = np.stack(dv.to_numpy()).astype(np.float64) ** 2
        return pd.Series(list(-0.5 * (X - mu) @ Lsharp))

    def to_vec(long_df):
        g = long_df.join(F.broadcast(lmi), "l").groupBy("row_id").agg(
            F.array_sort(F.collect_list(F.struct("li", "d"))).alias("_s"))
        return g.select("row_id", place(F.transform("_s", lambda x: x["d"])).alias(out))

    tr = to_vec(dist.select("l", F.col("node").alias("row_id"), "d"))
    q = evals.select("row_id", F.col(vec).alias("v"))
    qn = knn(q, pts, n_neighbors).select(F.col("q_id").alias("row_id"), F.col("p_id").alias("node"),
                                         F.col("dist").alias("_e"))
    ev_long = (qn.join(dist, "node").groupBy("l", "row_id").agg(F.min(F.col("_e") + F.col("d")).alias("d")))
    ev = to_vec(ev_long)
    return train.join(tr, "row_id"), evals.join(ev, "row_id")
