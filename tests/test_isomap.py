"""Landmark Isomap with every row a landmark equals classical Isomap."""
import numpy as np
import pandas as pd

from qualm.operators.reduce import landmark_isomap


def _isomap_bruteforce(X, k, n_neighbors):
    n = len(X)
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    G = np.full((n, n), np.inf)
    np.fill_diagonal(G, 0)
    for i in range(n):
        nb = [j for j in np.argsort(D[i]) if j != i][:n_neighbors]
        G[i, nb] = D[i, nb]
        G[nb, i] = D[i, nb]
    for m in range(n):  # Floyd-Warshall
        G = np.minimum(G, G[:, m:m + 1] + G[m:m + 1, :])
    J = np.eye(n) - 1.0 / n
    B = -0.5 * J @ (G ** 2) @ J
    vals, vecs = np.linalg.eigh(B)
    o = np.argsort(vals)[::-1][:k]
    return vecs[:, o] * np.sqrt(vals[o])


def test_all_landmarks_match_classical(spark):
    t = np.linspace(0, 3 * np.pi, 60)
    X = np.c_[np.cos(t), np.sin(t), 0.3 * t] + np.random.default_rng(0).normal(scale=0.01, size=(60, 3))
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(60), "v": list(X)}))
    tr, _ = landmark_isomap(df, df.limit(0), 2, n_neighbors=5, n_landmarks=60)
    Y = np.stack(tr.toPandas().sort_values("row_id")["r"].to_numpy())
    E = _isomap_bruteforce(X, 2, 5)
    dY = np.sqrt(((Y[:, None] - Y[None]) ** 2).sum(-1))
    dE = np.sqrt(((E[:, None] - E[None]) ** 2).sum(-1))
    assert np.allclose(dY, dE, atol=1e-6)
