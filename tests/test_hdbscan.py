"""Distributed HDBSCAN against the single-machine algorithm on small inputs."""
import numpy as np
import pandas as pd
import pytest

from qualm.operators.hdbscan import hdbscan_labels
from tests.hdbscan_bruteforce import hdbscan_bruteforce


def _blobs(seed, n_per=40, k=4, noise=25, d=3):
    rng = np.random.default_rng(seed)
    pts = [rng.normal(loc=rng.uniform(-10, 10, d), scale=rng.uniform(0.3, 1.2), size=(n_per, d)) for _ in range(k)]
    pts.append(rng.uniform(-14, 14, size=(noise, d)))
    return np.vstack(pts)


@pytest.mark.parametrize("seed,mcs,ms,eps,block_rows,ept", [
    (0, 8, 5, 0.0, 1024, 1 << 20), (1, 5, 3, 0.0, 50, 40), (2, 10, 10, 0.0, 64, 1 << 20),
    (3, 6, 4, 1.5, 1024, 1 << 20), (4, 6, 4, 1.5, 60, 30)])
def test_labels_match_bruteforce(spark, seed, mcs, ms, eps, block_rows, ept):
    """Small edges-per-task values force Boruvka rounds, several condensation
    ranges and the level-wise selection; large ones the bounded single tasks."""
    X = _blobs(seed)
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(len(X)), "v": list(X)}))
    got = hdbscan_labels(df, mcs, ms, eps, block_rows=block_rows, edges_per_task=ept).toPandas().sort_values("row_id")
    exp = hdbscan_bruteforce(X, mcs, ms, eps)
    assert (got["label"].to_numpy() == exp).all()


def _f4_bruteforce(T_, E_, mcs, ms, eps, k):
    lab = hdbscan_bruteforce(T_, mcs, ms, eps)
    u, c = np.unique(lab, return_counts=True)
    small, large = u[c < mcs], u[c >= mcs]
    if len(small) and len(large):
        cent = {l: T_[lab == l].mean(0) for l in large}
        new = lab.copy()
        for s in small:
            m = T_[lab == s].mean(0)
            new[lab == s] = min(cent, key=lambda l: (np.linalg.norm(m - cent[l]), l))
        lab = new
    labs = sorted(l for l in np.unique(lab) if l != -1)

    def knn_mean(P, x, kk):
        d = np.sort(np.sqrt(((P - x) ** 2).sum(1)))
        return d[:min(kk, len(P))].mean()
    if not labs:
        return np.array([knn_mean(T_, x, k) for x in E_])
    cents = np.stack([T_[lab == l].mean(0) for l in labs])
    out = []
    for x in E_:
        l = labs[int(np.argmin(np.sqrt(((cents - x) ** 2).sum(1))))]
        P = T_[lab == l]
        out.append(knn_mean(P, x, k) if len(P) >= k else knn_mean(T_, x, k))
    return np.array(out)


def test_f4_matches_bruteforce(spark):
    from qualm.operators.score import hdbscan_knn_uncertainty
    X = _blobs(5, n_per=30, k=3, noise=15)
    E_ = _blobs(6, n_per=5, k=3, noise=5)
    tr = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(len(X)), "v": list(X)}))
    ev = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(1000, 1000 + len(E_)), "v": list(E_)}))
    got = hdbscan_knn_uncertainty(tr, ev, 8, 4, 0.0, 5).toPandas().sort_values("row_id")
    exp = _f4_bruteforce(X, E_, 8, 4, 0.0, 5)
    assert np.allclose(got["uq"].to_numpy(), exp)


def test_f5_matches_bruteforce(spark):
    from qualm.operators.score import hdbscan_min_cluster_uncertainty
    X = _blobs(7, n_per=30, k=3, noise=15)
    E_ = _blobs(8, n_per=4, k=3, noise=4)
    lab = hdbscan_bruteforce(X, 8, 4, 0.0)
    u, c = np.unique(lab, return_counts=True)
    small, large = u[c < 8], u[c >= 8]
    if len(small) and len(large):
        cent = {l: X[lab == l].mean(0) for l in large}
        new = lab.copy()
        for s in small:
            m = X[lab == s].mean(0)
            new[lab == s] = min(cent, key=lambda l: (np.linalg.norm(m - cent[l]), l))
        lab = new
    ok = [l for l in np.unique(lab) if l != -1 and (lab == l).sum() >= 5]
    exp = np.array([min(np.sort(np.sqrt(((X[lab == l] - x) ** 2).sum(1)))[:5].mean() for l in ok) for x in E_])
    tr = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(len(X)), "v": list(X)}))
    ev = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(1000, 1000 + len(E_)), "v": list(E_)}))
    got = hdbscan_min_cluster_uncertainty(tr, ev, 8, 4, 0.0, 5).toPandas().sort_values("row_id")
    assert np.allclose(got["uq"].to_numpy(), exp)


def test_shared_sweep_matches_one_by_one(spark):
    """The shared sweep gives each configuration the same labels and F4 score as
    running that configuration alone."""
    from qualm.operators.score import hdbscan_knn_uncertainty
    from qualm.operators.sweep_hdbscan import hdbscan_knn_many, hdbscan_labels_many
    X = _blobs(9, n_per=30, k=3, noise=15)
    E_ = _blobs(10, n_per=4, k=3, noise=4)
    cfgs = [(0, 8, 4, 0.0, 5), (1, 5, 2, 0.0, 3), (2, 10, 6, 1.0, 7), (3, 8, 6, 0.0, 40)]
    pts = spark.createDataFrame(pd.DataFrame({"space": 1, "row_id": np.arange(len(X)), "v": list(X)}))
    ev = spark.createDataFrame(pd.DataFrame({"space": 1, "row_id": np.arange(1000, 1000 + len(E_)), "v": list(E_)}))
    cdf = spark.createDataFrame(pd.DataFrame(cfgs, columns=["cfg", "min_cluster_size", "min_samples", "epsilon",
                                                            "n_neighbors"]).assign(space=1))
    many = hdbscan_labels_many(pts, cdf).toPandas()
    uq_many = hdbscan_knn_many(pts, ev, cdf).toPandas()
    for cfg, mcs, ms, eps, k in cfgs:
        exp = hdbscan_bruteforce(X, mcs, ms, eps)
        got = many[many.cfg == cfg].sort_values("row_id")["label"].to_numpy()
        assert (got == exp).all(), cfg
        one = hdbscan_knn_uncertainty(pts.drop("space"), ev.drop("space"), mcs, ms, eps, k).toPandas()
        a = uq_many[uq_many.cfg == cfg].sort_values("row_id")["uq"].to_numpy()
        assert np.allclose(a, one.sort_values("row_id")["uq"].to_numpy()), cfg


def test_sweep_falls_back_one_by_one(spark):
    """Beyond the bounded size the sweep runs each configuration on the distributed path."""
    from qualm.operators.sweep_hdbscan import hdbscan_knn_many
    X = _blobs(11, n_per=20, k=2, noise=8)
    E_ = _blobs(12, n_per=3, k=2, noise=2)
    pts = spark.createDataFrame(pd.DataFrame({"space": 1, "row_id": np.arange(len(X)), "v": list(X)}))
    ev = spark.createDataFrame(pd.DataFrame({"space": 1, "row_id": np.arange(1000, 1000 + len(E_)), "v": list(E_)}))
    cdf = spark.createDataFrame(pd.DataFrame([(0, 6, 3, 0.0, 4), (1, 8, 5, 0.0, 6)],
                                             columns=["cfg", "min_cluster_size", "min_samples", "epsilon",
                                                      "n_neighbors"]).assign(space=1))
    shared = hdbscan_knn_many(pts, ev, cdf).toPandas().sort_values(["cfg", "row_id"])
    forced = hdbscan_knn_many(pts, ev, cdf, edges_per_task=10).toPandas().sort_values(["cfg", "row_id"])
    assert np.allclose(shared["uq"].to_numpy(), forced["uq"].to_numpy())


def test_prim_matches_sorted_edges_with_ties():
    """Whole-number points have many equal distances: the tree is the one of the order (w, lo, hi)."""
    from qualm.operators.hdbscan import _distances, _kruskal, _prim
    rng = np.random.default_rng(13)
    X, ids = rng.integers(0, 4, size=(60, 2)).astype(float), rng.permutation(60) + 5
    D = _distances(X)
    assert (D == np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))).all()
    core = np.sort(D, axis=1)[:, 3]
    i, j = np.triu_indices(60, 1)
    w = np.maximum(D[i, j], np.maximum(core[i], core[j]))
    lo, hi = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
    want = _kruskal(pd.DataFrame({"ca": lo, "cb": hi, "lo": lo, "hi": hi, "w": w}))
    edges = lambda t: sorted(zip(t["w"], t["lo"], t["hi"]))
    assert edges(_prim(ids, D, core)) == edges(want)


def test_equal_selections_are_labelled_and_scored_once(spark):
    """Configurations that differ in epsilon only, without effect, or that have the same k, share labels and scores."""
    from qualm.operators.sweep_hdbscan import hdbscan_knn_shared, _labellings
    X, E_ = _blobs(9, n_per=30, k=3, noise=15), _blobs(10, n_per=4, k=3, noise=4)
    pts = spark.createDataFrame(pd.DataFrame({"space": 1, "row_id": np.arange(len(X)), "v": list(X)}))
    ev = spark.createDataFrame(pd.DataFrame({"space": 1, "row_id": np.arange(1000, 1000 + len(E_)), "v": list(E_)}))
    cfgs = [(4, 8, 4, 0.0, 5), (5, 8, 4, 1e-9, 5), (6, 8, 4, 0.0, 7)]
    cdf = spark.createDataFrame(pd.DataFrame(cfgs, columns=["cfg", "min_cluster_size", "min_samples", "epsilon", "n_neighbors"]).assign(space=1))
    lab, same = _labellings(pts, cdf)
    assert lab.count() == len(X) and {tuple(r) for r in same.collect()} == {(4, 4), (5, 4), (6, 4)}
    found, plan = hdbscan_knn_shared(pts, ev, cdf)
    assert found.count() == 2 * len(E_) and {tuple(r) for r in plan.collect()} == {(4, 4), (5, 4), (6, 6)}
