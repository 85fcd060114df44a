"""The shared sweep beyond one block a space, lists too short for a cluster, and repeats over lanes of scores."""
import numpy as np
import pandas as pd

from qualm.operators import sweep_hdbscan as W
from qualm.operators.selective import repeated_evaluation, repeated_lanes
from tests.hdbscan_bruteforce import hdbscan_bruteforce
from tests.test_hdbscan import _blobs, _f4_bruteforce

CFGS = [(0, 8, 4, 0.0, 5), (1, 5, 2, 0.0, 3), (2, 10, 6, 1.0, 7), (3, 8, 6, 0.0, 40), (4, 8, 4, 0.0, 9)]


def _sweep(spark, X, E_):
    frame = lambda V, first: spark.createDataFrame(pd.DataFrame({"space": 1, "row_id": np.arange(first, first + len(V)), "v": list(V)}))
    cfg = pd.DataFrame(CFGS, columns=["cfg", "min_cluster_size", "min_samples", "epsilon", "n_neighbors"]).assign(space=1)
    return frame(X, 0), frame(E_, 1000), spark.createDataFrame(cfg)


def test_a_space_of_many_blocks_is_shared(spark):
    """As many rows as a labelling task may hold, in blocks of 10: every configuration has the labels of the published algorithm."""
    X = _blobs(9, n_per=30, k=3, noise=15)
    pts, _, cdf = _sweep(spark, X, X[:1])
    many = W.hdbscan_labels_many(pts, cdf, block_rows=10, edges_per_task=len(X)).toPandas()
    for cfg, mcs, ms, eps, _ in CFGS:
        assert many[many.cfg == cfg].sort_values("row_id")["label"].tolist() == hdbscan_bruteforce(X, mcs, ms, eps).tolist(), cfg


def test_clusters_are_searched_where_lists_are_short(spark, monkeypatch):
    monkeypatch.setattr(W, "LISTED", 1)
    monkeypatch.setattr(W, "EVAL_ROWS", 7)
    monkeypatch.setattr(W, "SETS", 2)
    single = lambda V: V.astype(np.float32).astype(np.float64)
    X, E_ = single(_blobs(9, n_per=30, k=3, noise=15)), single(_blobs(10, n_per=4, k=3, noise=4))
    lanes, members, plan = W.hdbscan_lanes(*_sweep(spark, X, E_))
    got = plan.join(W.lane_rows(lanes, members).withColumnRenamed("cfg", "score"), "score").toPandas()
    for cfg, mcs, ms, eps, k in CFGS:
        own = got[got.cfg == cfg].sort_values("row_id")["uq"].to_numpy()
        assert np.allclose(own, _f4_bruteforce(X, E_, mcs, ms, eps, k)), cfg


def test_repeats_over_lanes(spark):
    """The same metrics as one evaluation per score, with ties and NaN, drawn and judged once for all scores."""
    rng = np.random.default_rng(31)
    m = 150
    rows = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(m) * 3, "split": rng.choice(["test", "d01"], m), "bertscore_f1": rng.random(m).round(2), "rougeL": rng.random(m).round(2)}))
    U = {1: rng.random((m, 2)), 2: rng.integers(0, 9, size=(m, 3)).astype(float)}
    U[2][5, 1] = U[2][9, 1] = np.nan
    lanes = spark.createDataFrame([(s, int(i) * 3, [float(x) for x in u[i]]) for s, u in U.items() for i in range(m)], "set long, row_id long, uq array<double>")
    members = spark.createDataFrame([(1, 0, 10), (1, 1, 11), (2, 0, 20), (2, 1, 21), (2, 2, 22)], "set long, pos int, score long")
    got = repeated_lanes(rows, lanes, members, 4)
    long = W.lane_rows(lanes, members).withColumnRenamed("cfg", "score").join(rows, "row_id")
    want = repeated_evaluation(long, 4, by=["score"])
    keys = ["score", "repeat", "scheme"]
    a, b = (x.toPandas().sort_values(keys, ignore_index=True)[want.columns] for x in (got, want))
    assert len(a) == 5 * 4 * 5
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9)
    cut = repeated_lanes(rows, lanes, members, 4, lane_rows=10).toPandas().sort_values(keys, ignore_index=True)[want.columns]
    pd.testing.assert_frame_equal(cut, b, check_exact=False, rtol=1e-9)
