"""PCA projections and cross-validated KDE against numpy builds."""
import math

import numpy as np
import pandas as pd

from qualm.operators.reduce import reduce_dimensionality
from qualm.operators.score import BANDWIDTHS, choose_bandwidth, kde_uncertainty


def test_pca_projection_matches_numpy(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6))
    E = rng.normal(size=(10, 6))
    tr = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(80), "v": list(X)}))
    ev = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(100, 110), "v": list(E)}))
    a, b = reduce_dimensionality(tr, ev, 3, "PCA")
    Y = np.stack(a.toPandas().sort_values("row_id")["r"].to_numpy())
    mu = X.mean(0)
    _, _, Vt = np.linalg.svd(X - mu, full_matrices=False)
    ref = (X - mu) @ Vt[:3].T
    assert np.allclose(np.abs(Y), np.abs(ref), atol=1e-6)   # columns equal up to sign
    Ye = np.stack(b.toPandas().sort_values("row_id")["r"].to_numpy())
    assert np.allclose(np.abs(Ye), np.abs((E - mu) @ Vt[:3].T), atol=1e-6)


def _cv_bruteforce(X, bws, folds=5):
    n, d = X.shape
    sizes = [n // folds + (1 if i < n % folds else 0) for i in range(folds)]
    idx = np.split(np.arange(n), np.cumsum(sizes)[:-1])
    D2 = ((X[:, None] - X[None]) ** 2).sum(-1)
    scores = []
    for h in bws:
        s = []
        for f in idx:
            rest = np.setdiff1d(np.arange(n), f)
            a = -D2[np.ix_(f, rest)] / (2 * h * h)
            m = a.max(1)
            lp = m + np.log(np.exp(a - m[:, None]).sum(1)) - math.log(len(rest)) - d / 2 * math.log(2 * math.pi * h * h)
            s.append(lp.sum())
        scores.append(np.mean(s))
    return int(np.argmax(scores))


def test_kde_bandwidth_and_scores(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(60, 3)) * 2.0
    E = rng.normal(size=(7, 3))
    tr = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(60), "v": list(X)}))
    ev = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(100, 107), "v": list(E)}))
    got = choose_bandwidth(tr).first()
    best = _cv_bruteforce(X, BANDWIDTHS)
    assert got["bw_idx"] == best
    h = BANDWIDTHS[best]
    uq = kde_uncertainty(tr, ev).toPandas().sort_values("row_id")["uq"].to_numpy()
    D2 = ((E[:, None] - X[None]) ** 2).sum(-1)
    a = -D2 / (2 * h * h)
    m = a.max(1)
    ref = -(m + np.log(np.exp(a - m[:, None]).sum(1)) - math.log(60) - 1.5 * math.log(2 * math.pi * h * h))
    assert np.allclose(uq, ref)


def test_svd_projection_matches_numpy(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(50, 5)) + 3.0
    tr = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(50), "v": list(X)}))
    a, _ = reduce_dimensionality(tr, tr.limit(0), 2, "SVD")
    Y = np.stack(a.toPandas().sort_values("row_id")["r"].to_numpy())
    _, _, Vt = np.linalg.svd(X, full_matrices=False)     # uncentred
    assert np.allclose(np.abs(Y), np.abs(X @ Vt[:2].T), atol=1e-6)


def test_hashed_bag_of_words(spark):
    import hashlib
    import re
    from qualm.operators.embed import embed_column
    texts = ["The cat sat on the mat", "", "Ünïcode words and 42 numbers, numbers!"]
    df = spark.createDataFrame(pd.DataFrame({"row_id": [1, 2, 3], "t": texts}))
    got = {r["row_id"]: np.array(r["v"]) for r in embed_column(df, "t", dim=16).collect()}
    for rid, t in zip([1, 2, 3], texts):
        v = np.zeros(16)
        for tok in re.sub(r"[^a-z0-9]+", " ", t.lower()).split():
            v[int(hashlib.md5(tok.encode()).hexdigest()[:8], 16) % 16] += 1
        n = np.linalg.norm(v)
        assert np.allclose(got[rid], v / n if n else v)
