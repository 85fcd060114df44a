"""k-means based scores (E1, F2, F3, F8) against numpy on well-separated blobs,
where k-means must recover the blobs, so the expected values are unambiguous."""
import math

import numpy as np
import pandas as pd

from qualm.operators.cluster import kmeans_fit_predict
from qualm.operators.score import (BANDWIDTHS, kmeans_kde_uncertainty, kmeans_knn_uncertainty, kmeans_uq)
from tests.test_reduce_kde import _cv_bruteforce


def _data(spark, sizes=(40, 35, 30), seed=0):
    rng = np.random.default_rng(seed)
    centers = np.array([[0, 0, 0], [20, 0, 0], [0, 20, 0]], float)
    X = np.vstack([rng.normal(c, 1.0, size=(n, 3)) for c, n in zip(centers, sizes)])
    truth = np.repeat(np.arange(len(sizes)), sizes)
    E = rng.normal(size=(9, 3)) * 8
    tr = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(len(X)), "v": list(X)}))
    ev = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(1000, 1009), "v": list(E)}))
    return X, truth, E, tr, ev


def _knn_mean(P, x, k):
    return np.sort(np.sqrt(((P - x) ** 2).sum(1)))[:min(k, len(P))].mean()


def test_kmeans_recovers_blobs(spark):
    X, truth, _, tr, _ = _data(spark)
    lab = kmeans_fit_predict(tr, None, 3)[0].toPandas().sort_values("row_id")["cluster"].to_numpy()
    for t in range(3):  # one label per blob and one blob per label
        assert len(set(lab[truth == t])) == 1
    assert len(set(lab)) == 3


def test_f3_matches_numpy(spark):
    X, truth, E, tr, ev = _data(spark)
    got = kmeans_uq(tr, ev, 3, 5).toPandas().sort_values("row_id")["uq"].to_numpy()
    cents = np.stack([X[truth == t].mean(0) for t in range(3)])
    exp = []
    for x in E:
        d = np.sqrt(((cents - x) ** 2).sum(1))
        c = int(np.argmin(d))
        exp.append(0.4 * d[c] + 0.6 * _knn_mean(X[truth == c], x, 5))
    assert np.allclose(got, exp)


def test_f2_matches_numpy(spark):
    X, truth, E, tr, ev = _data(spark)
    got = kmeans_knn_uncertainty(tr, ev, 3, 5).toPandas().sort_values("row_id")["uq"].to_numpy()
    cents = np.stack([X[truth == t].mean(0) for t in range(3)])
    exp = [_knn_mean(X[truth == int(np.argmin(((cents - x) ** 2).sum(1)))], x, 5) for x in E]
    assert np.allclose(got, exp)


def test_f8_matches_numpy(spark):
    X, truth, E, tr, ev = _data(spark)
    got = kmeans_kde_uncertainty(tr, ev, 3, 10).toPandas().sort_values("row_id")["uq"].to_numpy()
    cents = np.stack([X[truth == t].mean(0) for t in range(3)])
    exp = []
    for x in E:
        c = int(np.argmin(((cents - x) ** 2).sum(1)))
        P = X[truth == c]
        h = BANDWIDTHS[_cv_bruteforce(P, BANDWIDTHS)]
        a = -((P - x) ** 2).sum(1) / (2 * h * h)
        m = a.max()
        exp.append(-(m + math.log(np.exp(a - m).sum()) - math.log(len(P)) - 1.5 * math.log(2 * math.pi * h * h)))
    assert np.allclose(got, exp)


def test_sweep_objectives_match_numpy(spark):
    """I2 objectives: per configuration k, correlations of the kNN score with both qualities."""
    from qualm.operators.sweep import knn_scores_for_configs, objectives
    X, _, E, tr, ev = _data(spark)
    rng = np.random.default_rng(5)
    qual = pd.DataFrame({"row_id": np.arange(1000, 1009), "bertscore_f1": rng.random(9), "rougeL": rng.random(9)})
    cfg = spark.createDataFrame(pd.DataFrame({"k": [1, 3, 7]}))
    s = knn_scores_for_configs(tr, ev, cfg, k_col="k").join(spark.createDataFrame(qual), "row_id")
    asked = cfg.union(spark.createDataFrame([(99,)], "k long"))
    got = objectives(s, ["k"], configs=asked).toPandas().set_index("k")
    assert (got.loc[99, "f1"], got.loc[99, "f2"]) == (1000, 1000)  # no scored row
    for k in (1, 3, 7):
        uq = np.array([_knn_mean(X, x, k) for x in E])
        assert np.isclose(got.loc[k, "f1"], np.corrcoef(uq, qual["bertscore_f1"])[0, 1])
        assert np.isclose(got.loc[k, "f2"], np.corrcoef(uq, qual["rougeL"])[0, 1])


def test_grid_raises_on_duplicate_and_unknown_cells(spark):
    import pytest
    from qualm.operators.grids import correlation_grid
    rows = [(1, "KNN", "PCA", 128, 0.5), (1, "KDE", "ISOMAP", 64, 0.25), (2, "MCD", "PCA", 128, 0.1)]
    df = spark.createDataFrame(rows, "layer long, method string, reduction string, dimensionality long, r double")
    grid = correlation_grid(df, "r").first().asDict()
    assert grid == {"layer": 1, "KDE - ISOMAP (64)": 0.25, "KNN - PCA (128)": 0.5}
    with pytest.raises(Exception, match="label outside"):
        correlation_grid(df, "r", ["KNN - PCA (128)"]).collect()
    with pytest.raises(Exception, match="duplicate"):
        correlation_grid(df.union(df), "r").collect()


def test_logs_reject_incomplete_records(spark, tmp_path):
    import pytest
    from qualm.sources import io as IO
    with pytest.raises(ValueError, match="misses"):
        IO.write_best_solution(spark.range(1), str(tmp_path / "b"))
    full = spark.range(1).selectExpr("1L AS seed", *[f"1.0D AS {c}" for c in IO.PROGRESS_COLS])
    for wrong in (full.drop("hv"), full.withColumn("more", full.seed)):
        with pytest.raises(ValueError, match="progress rows"):
            IO.write_progress(wrong, str(tmp_path / "p"))
