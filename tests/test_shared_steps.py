"""Nearest neighbours and summaries that solutions share, against brute force."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from qualm.operators.blocks import POINT_BLOCKS, _block_pairs, _kth_bound, _select_topk, knn
from qualm.operators.selective import COVERAGES, METRICS, cov_name, summarize_repeats, summarize_shared


def test_neighbours_by_column_minima():
    """The bound holds and lets few more than k through, also with ties, non-finite values and rows without k finite ones."""
    rng = np.random.default_rng(5)
    d = rng.normal(size=(40, 2100))
    d[3, :2090], d[4], d[5, ::2], d[6] = np.inf, np.nan, np.nan, 1.0
    bound, kth = _kth_bound(d, 35), np.partition(d, 34, axis=1)[:, 34]
    finite = np.isfinite(kth)
    assert (bound[finite] >= kth[finite]).all() and np.median((d <= bound[:, None]).sum(1)) < 70
    P, Q = rng.normal(size=(3000, 6)).round(1), rng.normal(size=(50, 6)).round(1)
    qi, pj, dist = _select_topk(Q, P, np.arange(50) + 9000, np.arange(3000), 35, False)
    full = np.sqrt(((Q[:, None] - P[None]) ** 2).sum(-1))
    for q in range(50):
        assert pj[qi == q].tolist() == np.lexsort((np.arange(3000), full[q]))[:35].tolist()


def test_a_query_meets_few_point_blocks(spark):
    """Every point block hands on k rows a query, so point blocks are larger than query blocks."""
    X = np.random.default_rng(6).normal(size=(400, 3))
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(400), "v": list(X)}))
    found = knn(df, df, 3, block_rows=50, broadcast_bytes=0, exclude_self=True)
    q, p = df.select(F.col("row_id").alias("_qid"), "v"), df.select(F.col("row_id").alias("_pid"), "v")
    qx, _ = _block_pairs(q, p, [], 50, "_qid", "_pid", POINT_BLOCKS * 50)
    assert qx.count() == 400 * 2
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1)) + np.diag(np.full(400, np.inf))
    got = found.toPandas().sort_values(["q_id", "rank"])["dist"].to_numpy().reshape(400, 3)
    assert np.allclose(got, np.sort(D, axis=1)[:, :3])


def test_solutions_share_the_summary_of_their_key(spark):
    """The same rows as a summary of every solution's repeats, also for a solution named twice or with two keys."""
    rng = np.random.default_rng(7)
    names = METRICS + [cov_name(c) for c in COVERAGES]
    per = spark.createDataFrame(pd.DataFrame([{"k": k, "repeat": r, "scheme": s, **{m: rng.normal() for m in names}} for k in (5, 6, 7) for r in range(4) for s in "xy"]))
    solutions = spark.createDataFrame([("1-1-1", 5), ("1-1-2", 5), ("1-1-3", 6), ("1-1-3", 6), ("1-1-4", 7), ("1-1-4", 5)], "solution string, k long")
    keys = ["solution", "scheme", "metric"]
    want = summarize_repeats(solutions.join(per, "k"), ["solution"]).toPandas().sort_values(keys, ignore_index=True)
    got = summarize_shared(per, solutions, "k").toPandas()[want.columns].sort_values(keys, ignore_index=True)
    pd.testing.assert_frame_equal(got, want)
