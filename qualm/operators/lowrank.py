"""Top right singular vectors of a table of vectors (D6-D8), without a d x d matrix or its eigen-solve.

A randomised range finder with block Krylov rounds (Halko, Martinsson and Tropp, 2011; Musco and Musco, 2015). A round
sends a block of k + OVERSAMPLE directions to all tasks, which sum X^T (X block) over their Arrow batches, and the driver adds the
directions to an orthonormal basis. Rounds end when the k best directions of the basis are singular vectors to
``tol``, or when the basis fills the space, so few rounds do for a falling spectrum and d / (k + OVERSAMPLE) always do. Last, a
tall-skinny QR of X times the best directions turns them into singular vectors: each task keeps one small R, and the Rs
are merged in a tree.

The driver holds the basis, d values a direction; a task holds d x (k + OVERSAMPLE). Neither grows with the number of rows.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize

OVERSAMPLE = 10
STRIPE = 64               # matrix rows that travel as one row
LEVELS = (4096, 64)       # groups on each level of the tree; the last level's Rs meet on the driver


def count_mean(rows: DataFrame) -> tuple[int, np.ndarray]:
    """(n, mean) of the array column ``v`` in one aggregate; (0, no values) without rows."""
    found = (rows.select(array_to_vector("v").alias("v")).groupBy(F.lit(0).alias("_all"))
             .agg(Summarizer.metrics("mean", "count").summary(F.col("v")).alias("s")).first())
    return (int(found["s"]["count"]), found["s"]["mean"].toArray()) if found else (0, np.zeros(0))


def sum_stripes(parts: DataFrame, n_rows: int, width: int) -> np.ndarray:
    """The sum of matrices that came as (stripe, part) rows."""
    total = np.zeros((n_rows, width))
    for r in parts.groupBy("stripe").agg(Summarizer.sum(array_to_vector("part")).alias("s")).collect():
        total[r["stripe"]:r["stripe"] + STRIPE] = r["s"].toArray().reshape(-1, width)
    return total


def centred(batch: pd.DataFrame, mean: np.ndarray) -> np.ndarray:
    return np.stack(batch["v"].to_numpy()).astype(np.float64) - mean


def gram_times(rows: DataFrame, mean: np.ndarray, block: np.ndarray) -> np.ndarray:
    """X^T (X block) of the rows of X less ``mean``, in one pass."""
    d, width = block.shape
    sent = rows.sparkSession.sparkContext.broadcast((mean, block))

    def products(batches):
        mu, w = sent.value
        total, some = np.zeros((d, width)), False
        for b in batches:
            if len(b):
                x, some = centred(b, mu), True
                total += x.T @ (x @ w)
        if some:
            yield pd.DataFrame({"stripe": range(0, d, STRIPE), "part": [total[i:i + STRIPE].ravel() for i in range(0, d, STRIPE)]})

    return sum_stripes(rows.mapInPandas(products, "stripe int, part array<double>"), d, width)


def tall_r(rows: DataFrame, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of (X - mean) basis: one R per task, merged group by group in a tree."""
    width = basis.shape[1]
    sent = rows.sparkSession.sparkContext.broadcast((mean, basis))

    def local(batches):
        mu, w = sent.value
        r = np.zeros((0, width))
        for b in batches:
            if len(b):
                r = np.linalg.qr(np.vstack([r, centred(b, mu) @ w]), mode="r")
        if len(r):
            yield pd.DataFrame({"r": [r.ravel()]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.vstack([np.reshape(x, (-1, width)) for x in group["r"]]), mode="r")
        return pd.DataFrame({"part": [int(group["part"].iloc[0])], "r": [r.ravel()]})

    found = rows.mapInPandas(local, "r array<double>").select(F.spark_partition_id().alias("part"), "r")
    for groups in LEVELS:
        found = (found.withColumn("part", F.col("part") % groups).groupBy("part")
                 .applyInPandas(merge, "part int, r array<double>"))
    last = sorted(found.collect(), key=lambda x: x["part"])  # at most LEVELS[-1] matrices of width^2
    return np.linalg.qr(np.vstack([np.reshape(x["r"], (-1, width)) for x in last]), mode="r")


def independent(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal directions that ``block`` adds to ``basis``."""
    norm = np.linalg.norm(block, axis=0)
    block = block[:, norm > 0] / norm[norm > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-8]
    return np.linalg.qr(u - basis @ (basis.T @ u))[0]


def right_singular(vectors: DataFrame, k: int, centre: bool, vec: str = "v", seed: int = 0, tol: float = 1e-12):
    """(n, mean, W, sigma, rounds): the first k right singular vectors, as columns of W, and singular values of the vectors,
    less their mean if ``centre``. Null vectors take no part; k is at most the dimension; without vectors W has no rows."""
    rows = materialize(vectors.select(F.col(vec).alias("v")).where(F.col("v").isNotNull()))
    n, mean = count_mean(rows)
    d, k = len(mean), min(k, len(mean))
    if n == 0:
        return 0, mean, np.zeros((0, 0)), np.zeros(0), 0
    shift = mean if centre else np.zeros(d)
    width = min(k + OVERSAMPLE, d)
    block = np.random.default_rng(seed).normal(size=(d, width))
    basis, image, rounds = np.zeros((d, 0)), np.zeros((d, 0)), 0
    while True:
        block = independent(block, basis)
        if block.shape[1]:  # otherwise the basis is closed under X^T X
            block = block[:, :d - basis.shape[1]]
            made = gram_times(rows, shift, block)
            basis, image, rounds = np.hstack([basis, block]), np.hstack([image, made]), rounds + 1
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        best = np.argsort(values)[::-1][:width]
        values, turn = values[best], turn[:, best]
        off = np.linalg.norm(image @ turn[:, :k] - (basis @ turn[:, :k]) * values[:k], axis=0)
        if not block.shape[1] or basis.shape[1] == d or off.max() <= tol * max(values[0], 0.0):
            break
        block = made
    near = basis @ turn
    _, sigma, vt = np.linalg.svd(tall_r(rows, shift, near))
    w = near @ vt.T
    return n, mean, w[:, :k], np.append(sigma, np.zeros(width))[:k], rounds
