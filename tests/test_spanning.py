"""Candidate edges of the spanning tree against all pairs, with ties, copies and tiles of one or many components."""
import numpy as np
import pandas as pd
import pytest

from qualm.operators.hdbscan import _distances, _kruskal, spanning_tree
from qualm.operators.spanning import _bottlenecks, neighbour_lists, tree_edges


def _frame(spark, X, ids=None):
    return spark.createDataFrame(pd.DataFrame({"row_id": np.arange(len(X)) if ids is None else ids, "v": list(X)}))


def _tree(X, ids, ms):
    D = _distances(X)
    core = np.sort(D, axis=1)[:, ms]
    i, j = np.triu_indices(len(X), 1)
    lo, hi = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
    return _edges(_kruskal(pd.DataFrame({"ca": lo, "cb": hi, "lo": lo, "hi": hi, "w": np.maximum(D[i, j], np.maximum(core[i], core[j]))})))


def _edges(t):
    return sorted(zip(t["w"], t["lo"], t["hi"]))


def _points(kind, rng):
    far = np.concatenate([rng.normal(size=(60, 3)) + c * 40.0 for c in range(4)])
    return {"far": far, "whole": rng.integers(0, 4, size=(250, 2)).astype(float), "copies": np.repeat(rng.normal(size=(40, 3)), 6, axis=0), "noise": rng.normal(size=(240, 6))}[kind]


@pytest.mark.parametrize("kind", ["far", "whole", "copies", "noise"])
@pytest.mark.parametrize("list_values", [1 << 25, 0])
def test_edges_hold_the_tree(spark, kind, list_values):
    """``list_values`` 0: no edge is settled by the lists, every row is a component."""
    rng = np.random.default_rng(21)
    X = _points(kind, rng)
    ids = rng.permutation(len(X)) + 7
    pts = _frame(spark, X, ids)
    lists = neighbour_lists(pts, 9, [])
    cand = tree_edges(pts, lists, 4, 9, [], block_rows=64, tile_rows=20, list_values=list_values).toPandas()
    assert _edges(_kruskal(cand.assign(ca=cand["lo"], cb=cand["hi"]))) == _tree(X, ids, 4)
    if list_values and kind == "far":  # pairs within a settled component are not walked
        assert len(cand) < 2 * len(X)


@pytest.mark.parametrize("kind", ["far", "whole"])
def test_tree_of_more_rows_than_a_block(spark, kind):
    X = _points(kind, np.random.default_rng(22))
    ids = np.arange(len(X))
    for rows in (40, 4096):
        assert _edges(spanning_tree(_frame(spark, X), 3, block_rows=rows).toPandas()) == _tree(X, ids, 3)


def test_bottlenecks():
    rng = np.random.default_rng(23)
    M = rng.random((12, 12))
    M = np.minimum(M, M.T)
    want = M.copy()
    for k in range(12):
        want = np.minimum(want, np.maximum(want[:, [k]], want[[k]]))
    off = ~np.eye(12, dtype=bool)
    assert (_bottlenecks(M)[off] == want[off]).all()
