"""Range finder, tall-skinny QR and the reductions built on them, against numpy."""
import numpy as np
import pandas as pd
import pytest

from qualm.operators import lowrank as L
from qualm.operators.reduce import fit_pca, fit_svd, reduce_dimensionality


def frame(spark, X, parts=5):
    return spark.createDataFrame(pd.DataFrame({"row_id": np.arange(len(X)), "v": list(X)})).repartition(parts)


def test_few_rounds_for_a_falling_spectrum(spark):
    rng = np.random.default_rng(3)
    X = (rng.normal(size=(600, 300)) * 0.9 ** np.arange(300)) @ np.linalg.qr(rng.normal(size=(300, 300)))[0] + 0.3
    mu = X.mean(0)
    for centre in (True, False):
        n, mean, W, sigma, rounds = L.right_singular(frame(spark, X), 6, centre)
        _, s, vt = np.linalg.svd(X - mu if centre else X, full_matrices=False)
        assert n == 600 and np.allclose(mean, mu) and rounds <= 8  # 19 rounds would fill the space
        assert np.allclose(sigma, s[:6], rtol=1e-10)
        assert np.allclose(np.abs((W * vt[:6].T).sum(axis=0)), 1, atol=1e-9)


def test_flat_spectrum_fills_the_space(spark):
    X = np.random.default_rng(4).normal(size=(90, 30))
    _, _, W, sigma, rounds = L.right_singular(frame(spark, X), 4, False)
    _, s, vt = np.linalg.svd(X)
    assert rounds <= 3 and np.allclose(sigma, s[:4]) and np.allclose(np.abs((W * vt[:4].T).sum(axis=0)), 1, atol=1e-9)


@pytest.mark.parametrize("levels", [(4096, 64), (3, 2), (1,)])
def test_tree_of_qr(spark, monkeypatch, levels):
    monkeypatch.setattr(L, "LEVELS", levels)
    X = np.random.default_rng(5).normal(size=(200, 7))
    for rows in (X, X[:3]):  # also fewer rows than columns
        df = frame(spark, rows, 11).select("v")
        r = L.tall_r(df, np.zeros(7), np.eye(7))
        assert np.allclose(r.T @ r, rows.T @ rows)


def test_low_rank_wide_k_nulls_and_no_rows(spark):
    rng = np.random.default_rng(6)
    X = rng.normal(size=(40, 2)) @ rng.normal(size=(2, 5))
    W, sigma = fit_svd(frame(spark, X), 9)
    assert W.shape == (5, 5) and np.allclose(W.T @ W, np.eye(5)) and np.allclose(sigma[2:], 0, atol=1e-8)
    assert np.allclose((X @ W) @ W.T, X)
    same, mean, var = fit_pca(frame(spark, np.ones((4, 3))), 2)
    assert np.allclose(mean, 1) and np.allclose(var, 0) and same.shape == (3, 2)
    some = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [2.0, 1.0]), (4, [0.0, 0.5])], "row_id long, v array<double>")
    a, b = reduce_dimensionality(some, some, 1, "PCA")
    rows = {r["row_id"]: r["r"] for r in a.collect()}
    assert rows[2] is None and all(len(rows[i]) == 1 for i in (1, 3, 4)) and {r["row_id"]: r["r"] for r in b.collect()} == rows
    _, none = reduce_dimensionality(some.limit(0), some, 1, "SVD")
    assert [r["r"] for r in none.collect()] == [None] * 4
