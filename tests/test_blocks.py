"""Block pairs over many shuffle partitions: every query block meets every point block, and a block may be empty."""
import numpy as np
import pandas as pd
import pytest

from qualm.operators.blocks import knn, knn_per_point_group, log_density_lanes
from qualm.operators.score import choose_bandwidth, kde_by_group, kde_neg_log_density


@pytest.fixture
def dealt(spark):
    """Partitions stay as they are dealt; on one coalesced partition any two blocks meet."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _frame(spark, X, first=0, **cols):
    return spark.createDataFrame(pd.DataFrame({"row_id": np.arange(first, first + len(X)), "v": list(X), **cols}))


def test_block_pairs_meet_over_partitions(dealt):
    rng = np.random.default_rng(3)
    P, Q = rng.normal(size=(90, 4)), rng.normal(size=(40, 4))
    D = np.sqrt(((Q[:, None] - P[None]) ** 2).sum(-1))
    got = knn(_frame(dealt, Q, 1000), _frame(dealt, P), 5, block_rows=8, broadcast_bytes=0).toPandas().sort_values(["q_id", "rank"])
    assert np.allclose(got["dist"].to_numpy().reshape(40, 5), np.sort(D, axis=1)[:, :5])
    part = np.arange(90) % 3
    near = knn_per_point_group(_frame(dealt, Q, 1000), _frame(dealt, P, g=part), 1, "g", block_rows=8, broadcast_bytes=0).toPandas()
    assert np.allclose(near.sort_values(["q_id", "g"])["dist"].to_numpy().reshape(40, 3), np.stack([D[:, part == g].min(1) for g in range(3)], axis=1))


def test_lanes_with_empty_blocks(dealt):
    """Groups of a few rows in blocks of one row: most pairs of blocks have one side only."""
    rng = np.random.default_rng(4)
    P, Q = rng.normal(size=(60, 3)), rng.normal(size=(25, 3))
    g, h = np.arange(60) % 6, np.arange(25) % 7  # no points of group 6
    points, queries = _frame(dealt, P, g=g, fold=np.arange(60) // 6 % 2), _frame(dealt, Q, 1000, g=h)
    lanes = log_density_lanes(queries, points, [0.5, 2.0], ["g"], "fold", 2, block_rows=1, broadcast_bytes=0).toPandas().set_index("q_id")
    assert sorted(lanes.index) == [1000 + i for i in range(25) if h[i] != 6]
    for i in lanes.index - 1000:
        for f in range(2):
            d2 = ((P[(g == h[i]) & (np.arange(60) // 6 % 2 == f)] - Q[i]) ** 2).sum(1)
            row = lanes.loc[1000 + i]
            assert np.isclose(row["near"][f], d2.min()) and row["cnt"][f] == len(d2)
            for b, bw in enumerate([0.5, 2.0]):
                assert np.isclose(row["sums"][2 * f + b], np.exp(-(d2 - d2.min()) / (2 * bw * bw)).sum())


def test_densities_by_blocks_equal_the_broadcast_ones(dealt, monkeypatch):
    """F6-F8 where no point side is broadcast."""
    rng = np.random.default_rng(5)
    X, E = rng.normal(size=(70, 3)), rng.normal(size=(20, 3))
    tr, ev = _frame(dealt, X, cluster=np.arange(70) % 4), _frame(dealt, E, 1000, cluster=np.arange(20) % 4)
    bw = dealt.createDataFrame([(c, 0.5 + c) for c in range(4)], "cluster bigint, bandwidth double")

    def results():
        frames = [choose_bandwidth(tr, by=["cluster"]).orderBy("cluster"), kde_neg_log_density(tr, ev, 1.0).orderBy("row_id"),
                  kde_by_group(tr, ev, bw, "cluster", 3).orderBy("row_id")]
        return [f.toPandas().to_numpy(dtype=float) for f in frames]
    whole = results()
    monkeypatch.setattr(log_density_lanes, "__defaults__", (*log_density_lanes.__defaults__[:-2], 9, 0))  # block_rows, broadcast_bytes
    cut = results()
    for a, b in zip(whole, cut):
        assert a.shape == b.shape and np.allclose(a, b)


def test_sums_of_wide_and_narrow_bandwidths():
    """The series that wide bandwidths share gives the sums of their exponentials; equal distances have no range."""
    from qualm.operators.blocks import _exp_sums
    t = -np.random.default_rng(8).random((7, 300)) * 12
    t -= t.max(axis=1, keepdims=True)
    scale = 1.0 / (2.0 * np.logspace(-1, 1.5, 30) ** 2)
    for x in (t, np.zeros((3, 5))):
        want = np.stack([np.exp(x * c).sum(axis=1) for c in scale], axis=1)
        assert np.allclose(_exp_sums(x, scale, np.empty_like(x)), want, rtol=1e-13, atol=0)


def test_a_query_leaves_its_own_fold_out(dealt):
    """Held-out densities need no distance to the query's own fold; the other folds' lanes are the same."""
    rng = np.random.default_rng(9)
    tr = _frame(dealt, rng.normal(size=(50, 3)), fold=np.arange(50) % 5)
    for size in (0, 32 << 20):
        kw = {"keep": ["fold"], "block_rows": 9, "broadcast_bytes": size}
        whole, apart = (log_density_lanes(tr, tr, [0.5, 2.0], (), "fold", 5, **kw, **a).toPandas().sort_values("q_id") for a in ({}, {"apart": "fold"}))
        own = np.arange(50) % 5
        for c, width in (("near", 1), ("sums", 2)):
            a, b = (np.stack(x[c]).reshape(50, 5, width) for x in (whole, apart))
            assert (b[np.arange(50), own] == (np.inf if c == "near" else 0.0)).all()
            a[np.arange(50), own] = b[np.arange(50), own]
            assert np.allclose(a, b, rtol=1e-12)
