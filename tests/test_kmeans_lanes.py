"""Lloyd runs, density lanes, vector outliers and disconnected neighbour graphs against numpy builds."""
import numpy as np
import pandas as pd
import pytest

from qualm.operators.cluster import kmeans_fit_predict, lloyd, plus_plus_starts, random_starts
from qualm.operators.reduce import STRIPE, covariance, landmark_isomap, mahalanobis_filter
from qualm.operators.score import choose_bandwidth, kmeans_kde_clusters, kmeans_uq, split_frames
from tests.test_reduce_kde import _cv_bruteforce


def _frame(spark, X, first=0):
    return spark.createDataFrame(pd.DataFrame({"row_id": np.arange(first, first + len(X)), "v": list(X)}))


def _lloyd(X, C, rounds):
    C = C.copy()
    for _ in range(rounds):
        lab = ((X[:, None] - C[None]) ** 2).sum(2).argmin(1)
        C = np.array([X[lab == i].mean(0) if (lab == i).any() else C[i] for i in range(len(C))])
    return C, ((X[:, None] - C[None]) ** 2).sum(2).min(1).sum()


def test_lloyd_runs_together_and_the_least_inertia_wins(spark):
    X = np.random.default_rng(0).normal(size=(200, 4))
    starts = np.stack([X[:5], X[50:55], X[100:105]])
    starts[1, 4] = 1e6  # a centre that no row ever takes stays where it is
    want = [_lloyd(X, s, 6) for s in starts]
    centres, inertia, run = lloyd(_frame(spark, X).repartition(7), starts, max_iter=6, tol=0.0)
    assert run == int(np.argmin([w[1] for w in want]))
    assert np.allclose(centres, want[run][0]) and np.isclose(inertia, want[run][1])
    one = lloyd(_frame(spark, X), starts[1:2], max_iter=6, tol=0.0)[0]
    assert np.allclose(one, want[1][0]) and (one[4] == 1e6).all()


def test_starts_are_rows_and_repeat(spark):
    rng = np.random.default_rng(1)
    X = np.vstack([rng.normal(c, 0.1, size=(30, 2)) for c in ([0, 0], [50, 0], [0, 50], [50, 50])])
    df = _frame(spark, X)
    for draw in (random_starts, plus_plus_starts):
        a, b = draw(df, 4, 3, 7), draw(df.repartition(5), 4, 3, 7)
        assert a.shape == (3, 4, 2) and (a == b).all()
        assert all((X == c).all(1).any() for c in a.reshape(-1, 2))
    for run in plus_plus_starts(df, 4, 5, 2):  # far groups: one start in each
        assert len({tuple(np.round(c / 50)) for c in run}) == 4
    same = _frame(spark, np.ones((6, 2)))
    assert plus_plus_starts(same, 3, 2).shape == (2, 3, 2)


def test_kmeans_options(spark):
    X = np.random.default_rng(2).normal(size=(60, 3))
    df, ev = _frame(spark, X), _frame(spark, X[:9] + 0.01, 100)
    for init in ("random", "k-means++", X[:4]):
        tr, _, cents = kmeans_fit_predict(df, ev, 4, init=init, n_init=2, max_iter=3)
        C = np.stack(cents.toPandas().sort_values("cluster")["centroid"].to_numpy())
        got = tr.toPandas().sort_values("row_id")["cluster"].to_numpy()
        assert (got == ((X[:, None] - C[None]) ** 2).sum(2).argmin(1)).all()
    with pytest.raises(ValueError, match="unknown init"):
        kmeans_fit_predict(df, ev, 4, init="other")
    assert kmeans_fit_predict(df.limit(2), None, 4, init="random")[2].count() == 2
    off = kmeans_uq(df, ev, 4, None, init=X[:4], max_iter=3, tol=0.0).toPandas().sort_values("row_id")["uq"].to_numpy()
    C = _lloyd(X, X[:4], 3)[0]
    assert np.allclose(off, np.sqrt((((X[:9] + 0.01)[:, None] - C[None]) ** 2).sum(2)).min(1))


def test_lanes_merge_over_point_blocks(spark):
    X = np.random.default_rng(3).normal(size=(90, 3))
    df = _frame(spark, X)
    bands = [0.05, 0.3, 1.0, 4.0]
    whole, cut = choose_bandwidth(df, bands).first(), choose_bandwidth(df, bands, block_rows=7, broadcast_bytes=0).first()
    assert whole["bw_idx"] == cut["bw_idx"] == _cv_bruteforce(X, bands)
    assert np.isclose(whole["cv_score"], cut["cv_score"], rtol=1e-12)
    alone = df.where("row_id = 3")
    assert choose_bandwidth(alone, bands).count() == 0


def test_cluster_density_is_the_mean_of_its_rows(spark):
    rng = np.random.default_rng(4)
    X = np.vstack([rng.normal(0, 1, size=(40, 2)), rng.normal(30, 1, size=(30, 2)), [[500.0, 500.0]]])
    got = kmeans_kde_clusters(_frame(spark, X), 3, 1, bandwidths=[0.5, 1.0], init=X[[0, 40, 70]]).toPandas().sort_values("size")
    assert got["size"].tolist() == [1, 30, 40] and np.isnan(got["uq"].iloc[0])
    for (_, row), P in zip(list(got.iterrows())[1:], (X[40:70], X[:40])):
        h = [0.5, 1.0][_cv_bruteforce(P, [0.5, 1.0])]
        a = -((P[:, None] - P[None]) ** 2).sum(2) / (2 * h * h)
        want = -(np.log(np.exp(a).sum(1)) - np.log(len(P)) - np.log(2 * np.pi * h * h)).mean()
        assert row["bandwidth"] == h and np.isclose(row["uq"], want)


def test_split_frames_keep_scored_rows(spark):
    uq = spark.createDataFrame([(1, 0.5), (2, 0.25)], "row_id long, uq double")
    ev = spark.createDataFrame([(1, "test", 0.1), (2, "d01", 0.2), (3, "d01", 0.3)], "row_id long, split string, meteor double")
    got = split_frames(uq, ev, ["meteor"]).orderBy("row_id").collect()
    assert [tuple(r) for r in got] == [(1, "test", 0.5, 0.1), (2, "d01", 0.25, 0.2)]


def test_mahalanobis_on_vectors(spark):
    rng = np.random.default_rng(5)
    d = STRIPE + 6  # two stripes
    X = rng.normal(size=(300, d)) @ rng.normal(size=(d, d)) + 100
    n, mean, cov = covariance(_frame(spark, X))
    assert n == 300 and np.allclose(mean, X.mean(0)) and np.allclose(cov, np.cov(X, rowvar=False))
    diff = X - X.mean(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", diff, np.linalg.inv(np.cov(X, rowvar=False)), diff))
    got = mahalanobis_filter(_frame(spark, X), "v", 90.0).toPandas().sort_values("row_id")
    keep = np.flatnonzero(want < np.percentile(want, 90))
    assert got["row_id"].tolist() == keep.tolist() and np.allclose(got["mahalanobis"], want[keep], rtol=1e-6)


def test_mahalanobis_edges(spark):
    X = np.random.default_rng(6).normal(size=(50, 2))
    flat = np.c_[X, X[:, 0] + X[:, 1]]  # singular: the pseudo-inverse gives the distance in the plane
    diff = X - X.mean(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", diff, np.linalg.inv(np.cov(X, rowvar=False)), diff))
    got = mahalanobis_filter(_frame(spark, flat), "v", 100.0).toPandas().sort_values("row_id")
    assert np.allclose(got["mahalanobis"], want[got["row_id"]], rtol=1e-5) and len(got) == 49
    one = _frame(spark, X[:1])
    assert mahalanobis_filter(one, "v").collect()[0]["mahalanobis"] is None
    assert mahalanobis_filter(one.limit(0), "v").count() == 0
    holes = _frame(spark, X).unionByName(spark.createDataFrame([(99, None), (98, [None, 1.0])], "row_id long, v array<double>"))
    kept = {r["row_id"] for r in mahalanobis_filter(holes, "v", 100.0).collect()}
    assert len(kept) == 49 and not kept & {98, 99}
    small = len(mahalanobis_filter(_frame(spark, X), "v")._jdf.queryExecution().optimizedPlan().toString())
    wide = len(mahalanobis_filter(_frame(spark, np.tile(X, 20) + np.random.default_rng(7).normal(size=(50, 40))), "v")
               ._jdf.queryExecution().optimizedPlan().toString())
    assert wide < 1.2 * small


def test_isomap_joins_separate_groups(spark):
    rng = np.random.default_rng(8)
    X = np.vstack([rng.normal(c, 1.0, size=(n, 3)) for c, n in (([0, 0, 0], 25), ([60, 0, 0], 20), ([0, 90, 0], 15))])
    tr, ev = landmark_isomap(_frame(spark, X), _frame(spark, X[:4] + 0.001, 500), 2, n_neighbors=4, n_landmarks=60)
    Y = np.stack(tr.toPandas().sort_values("row_id")["r"].to_numpy())
    n, D = len(X), np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    G = np.full((n, n), np.inf)
    for i in range(n):
        for j in [j for j in np.argsort(D[i]) if j != i][:4]:
            G[i, j] = G[j, i] = D[i, j]
    comp = np.arange(n)
    for _ in range(n):
        comp = np.array([min([comp[i], *comp[np.isfinite(G[i])]]) for i in range(n)])
    assert len(set(comp)) >= 3
    for a in sorted(set(comp)):
        for b in sorted(set(comp)):
            if a < b:
                ia, ib = np.flatnonzero(comp == a), np.flatnonzero(comp == b)
                i, j = np.unravel_index(D[np.ix_(ia, ib)].argmin(), (len(ia), len(ib)))
                G[ia[i], ib[j]] = G[ib[j], ia[i]] = D[ia[i], ib[j]]
    np.fill_diagonal(G, 0)
    for m in range(n):
        G = np.minimum(G, G[:, m:m + 1] + G[m:m + 1, :])
    J = np.eye(n) - 1.0 / n
    vals, vecs = np.linalg.eigh(-0.5 * J @ (G ** 2) @ J)
    o = np.argsort(vals)[::-1][:2]
    E = vecs[:, o] * np.sqrt(vals[o])
    dist = lambda Z: np.sqrt(((Z[:, None] - Z[None]) ** 2).sum(-1))
    assert np.allclose(dist(Y), dist(E), atol=1e-5)
    near = np.stack(ev.toPandas().sort_values("row_id")["r"].to_numpy())
    assert np.abs(near - Y[:4]).max() < 5
