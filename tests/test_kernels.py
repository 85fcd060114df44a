"""Kernels and scale paths against brute force on small inputs."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from qualm.functions.rouge import lcs_length
from qualm.operators.blocks import knn
from qualm.operators.order import global_rank, pick_first_n
from qualm.operators.pareto import hypervolume, nondominated


def _lcs_brute(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[-1][-1]


def test_lcs_matches_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = list(rng.integers(0, 5, rng.integers(0, 30)).astype(str))
        b = list(rng.integers(0, 5, rng.integers(0, 30)).astype(str))
        assert lcs_length(a, b) == _lcs_brute(a, b)


def test_global_rank_many_buckets_with_heavy_ties(spark):
    rng = np.random.default_rng(1)
    n = 5000
    pdf = pd.DataFrame({"g": rng.integers(0, 3, n), "row_id": np.arange(n),
                        "uq": np.where(rng.random(n) < 0.4, 1.0, rng.integers(0, 50, n).astype(float)),
                        "e": rng.integers(0, 2, n)})
    df = spark.createDataFrame(pdf)
    out = global_rank(df, ["uq", "row_id"], ["g"], sum_cols=["e"], rank_col="m", num_buckets=7).toPandas()
    exp = pdf.sort_values(["g", "uq", "row_id"]).copy()
    exp["m"] = exp.groupby("g").cumcount() + 1
    exp["cum_e"] = exp.groupby("g")["e"].cumsum()
    got = out.set_index("row_id").loc[exp["row_id"]]
    assert (got["m"].to_numpy() == exp["m"].to_numpy()).all()
    assert (got["cum_e"].to_numpy() == exp["cum_e"].to_numpy()).all()


def test_pick_first_n_is_exact(spark):
    df = spark.range(3000).withColumnRenamed("id", "row_id").withColumn("n", F.lit(1234))
    got = pick_first_n(df, "n", 7).filter("picked").count()
    assert got == 1234


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_knn_matches_brute_force(spark, broadcast_bytes):
    rng = np.random.default_rng(2)
    P = rng.normal(size=(300, 6))
    Q = rng.normal(size=(70, 6))
    pdf = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(300), "v": list(P)}))
    qdf = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(1000, 1070), "v": list(Q)}))
    got = knn(qdf, pdf, 4, block_rows=32, broadcast_bytes=broadcast_bytes).toPandas().sort_values(["q_id", "rank"])
    d = np.sqrt(((Q[:, None, :] - P[None, :, :]) ** 2).sum(-1))
    exp = np.sort(d, axis=1)[:, :4].ravel()
    assert np.allclose(got["dist"].to_numpy(), exp)
    assert (got.groupby("q_id").size() == 4).all()


def test_front_and_hypervolume_properties(spark):
    rng = np.random.default_rng(3)
    pts = pd.DataFrame({"seed": 1, "gen": 1, "idx": np.arange(400), "f1": rng.random(400), "f2": rng.random(400)})
    df = spark.createDataFrame(pts)
    front = nondominated(df, ["seed", "gen"], strict=True, local_buckets=5).toPandas()
    F_ = front[["f1", "f2"]].to_numpy()
    for a in F_:  # mutually non-dominated
        assert not ((F_ <= a).all(1) & (F_ < a).any(1)).any()
    hv_all = hypervolume(df.withColumnRenamed("f1", "fn1").withColumnRenamed("f2", "fn2")).first()["hv"]
    hv_half = hypervolume(df.filter("idx < 200").withColumnRenamed("f1", "fn1")
                          .withColumnRenamed("f2", "fn2")).first()["hv"]
    assert hv_all >= hv_half > 0


def _by_hand(rows, schemes, coverages):
    """H2-H7 of rows (row_id, uq, bert, rouge, calib) in numpy."""
    calib, out = [r for r in rows if r[4]], {}
    ev = sorted((r for r in rows if not r[4]), key=lambda r: (r[1], r[0]))
    for name, pb, pr in schemes:
        tb, tr = (np.percentile([r[i] for r in calib], p) for i, p in ((2, pb), (3, pr)))
        err = np.array([not (r[2] >= tb and r[3] >= tr) for r in ev], dtype=float)
        uq = np.array([r[1] for r in ev])
        risk = np.cumsum(err) / np.arange(1, len(err) + 1)
        pos, neg = uq[err == 1], uq[err == 0]
        pairs = (pos[:, None] > neg[None, :]).sum() + (pos[:, None] == neg[None, :]).sum() / 2
        out[name] = [tb, tr, pairs / (len(pos) * len(neg)), ((risk[1:] + risk[:-1]) / 2).sum() / len(err), *[1 - risk[int(np.ceil(c * len(err))) - 1] for c in coverages]]
    return out


@pytest.mark.parametrize("num_buckets", [None, 1, 7])
def test_repeats_in_one_ordering_match_numpy(spark, num_buckets):
    """Heavy ties of uq over many buckets, two solutions, repeats drawn by md5."""
    import hashlib
    from qualm.operators import selective as S
    rng = np.random.default_rng(3)
    rows = [(int(i), sol, "test" if i % 3 else "d01", float(rng.integers(0, 9) if i % 2 else 4), float(rng.random()), float(rng.integers(0, 20) / 20))
            for sol in ("a", "b") for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, sol string, split string, uq double, bertscore_f1 double, rougeL double")
    got = S.repeated_evaluation(df, 3, 5, calib_frac=0.3, by=["sol"], num_buckets=num_buckets).collect()
    assert len(got) == 2 * 3 * 5
    for r in got:
        mine = [x for x in rows if x[1] == r.sol]
        pool = sorted((hashlib.md5(f"{5 + r.repeat}:{x[0]}".encode()).hexdigest(), x[0]) for x in mine if x[2] == "test")
        drawn = {i for _, i in pool[:round(0.3 * len(pool))]}
        want = _by_hand([(x[0], *x[3:], x[0] in drawn) for x in mine], S.SCHEMES, S.COVERAGES)[r.scheme]
        assert np.allclose([r.tau_bert, r.tau_rouge, r.auroc, r.aurc, *[r[S.cov_name(c)] for c in S.COVERAGES]], want, rtol=1e-12)
        assert r.n == len(mine) - len(drawn)


def test_curve_is_the_running_risk(spark):
    from qualm.operators import selective as S
    from qualm.sources import tables as T
    sp = S.calib_split(T.scores(spark, "/root/testdata/sf0.001"))
    res, curve = S.evaluate_schemes(sp, curve=True, num_buckets=5)
    pdf, n = curve.toPandas(), res.toPandas().set_index("scheme")["n"]
    for scheme, g in pdf.groupby("scheme"):
        assert sorted(g["m"]) == list(range(1, n[scheme] + 1)) and np.allclose(g["coverage"], g["m"] / n[scheme])


def test_exact_quantiles_of_lanes(spark):
    from qualm.operators.quantile import exact_quantiles
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=3000), rng.lognormal(0, 3, 1000), [0.5] * 2000, [np.nan, np.inf], [-1e308, 1e308]])
    g, lanes = rng.integers(0, 3, len(v)), rng.integers(0, 2, (len(v), 3)).astype(bool)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v, "l": lanes.tolist()}))
    probs = spark.createDataFrame([(i, q) for i, q in enumerate([0.0, 0.1, 0.5, 0.77, 0.95, 1.0])], "id int, q double")
    rows = exact_quantiles(df, "v", probs, ["g"], lanes="l", n_lanes=3).collect()
    assert len(rows) == 3 * 3 * 6
    for r in rows:
        assert np.isclose(r.value, np.quantile(v[(g == r.g) & lanes[:, r.lane] & np.isfinite(v)], r.q), rtol=1e-12)
    assert exact_quantiles(df.limit(0), "v", probs).count() == 0
    assert exact_quantiles(df.where("v = 0.5"), "v", probs).select("value").distinct().collect() == [(0.5,)]


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_knn_per_point_group_matches_brute_force(spark, broadcast_bytes):
    from qualm.operators.blocks import knn_per_point_group
    rng = np.random.default_rng(4)
    P = rng.normal(size=(200, 5))
    lab = rng.integers(0, 4, 200)
    Q = rng.normal(size=(30, 5))
    pdf = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(200), "v": list(P), "label": lab}))
    qdf = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(500, 530), "v": list(Q)}))
    got = knn_per_point_group(qdf, pdf, 3, "label", block_rows=32, broadcast_bytes=broadcast_bytes).toPandas()
    for (qi, l), g in got.groupby(["q_id", "label"]):
        d = np.sort(np.sqrt(((P[lab == l] - Q[qi - 500]) ** 2).sum(1)))[:3]
        assert np.allclose(np.sort(g["dist"].to_numpy()), d)
    assert len(got) == 30 * 4 * 3


@pytest.mark.parametrize("n", [0, 1, 777, 1667, 9000])
def test_pick_is_the_smallest_hashes(spark, n):
    """The rows of the smallest md5(seed:id), also when none or all are asked for; rows off the crossing prefix are not sorted."""
    import hashlib
    df = spark.range(5000).withColumnRenamed("id", "row_id").withColumn("g", F.col("row_id") % 3).withColumn("n", F.lit(n))
    got = pick_first_n(df, "n", 11, group_cols=["g"]).filter("picked").collect()
    want = set()
    for g in range(3):
        want |= set(sorted(range(g, 5000, 3), key=lambda i: (hashlib.md5(f"11:{i}".encode()).hexdigest(), i))[:n])
    assert {r.row_id for r in got} == want and len(got) == len(want)


def test_small_train_sides_do_not_shuffle_the_evaluation_rows(spark):
    qdf = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(50)], "row_id long, v array<double>")
    found = knn(qdf, qdf, 2, exclude_self=True)
    assert "Exchange" not in found._jdf.queryExecution().toString()
    assert found.filter("rank = 1").count() == 50


def test_grouped_knn_and_density_agree_either_way(spark):
    from qualm.operators.blocks import log_density_parts
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, i % 3, i % 2, rng.normal(size=3).tolist()) for i in range(90)] + [(90, None, 0, [0.0] * 3)],
                               "row_id long, g int, fold int, v array<double>")
    for run in (lambda b: knn(df, df, 3, by=["g"], exclude_self=True, block_rows=16, broadcast_bytes=b),
                lambda b: log_density_parts(df, df, [0.5, 2.0], by=["g"], fold_col="fold", block_rows=16, broadcast_bytes=b)):
        one, other = (run(b).toPandas() for b in (0, 1 << 20))
        keys = [c for c in one.columns if c not in ("dist", "lse")]
        one, other = (x[sorted(x.columns)].sort_values(keys).reset_index(drop=True) for x in (one, other))
        pd.testing.assert_frame_equal(one, other, check_dtype=False, rtol=1e-9)
        assert len(one)


def test_equal_rows_stay_within_memory(spark):
    from qualm.operators.blocks import _select_topk
    same = np.ones((600, 8))
    qi, pj, dist = _select_topk(same, same, np.arange(600), np.arange(600), 2, True)
    assert len(qi) == 1200 and (dist == 0).all() and set(pj.tolist()) <= {0, 1, 2}
