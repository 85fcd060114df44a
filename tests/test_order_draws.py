"""Order buckets and draws whose work must not grow faster than their rows."""
import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from qualm.operators.lanes import draw_repeats
from qualm.operators.order import order_buckets


@pytest.mark.parametrize("hot", [0, 3000])
def test_ties_do_not_multiply_the_buckets(spark, hot):
    """100 rows a value: no value fills a bucket, so none is cut; a value of 3,000 rows is."""
    ids = np.random.default_rng(2).permutation(6000 + hot)
    u = np.concatenate([np.arange(6000) % 60, np.full(hot, 30)]).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"row_id": ids, "uq": u, "g": 1})).repartition(4)
    got = order_buckets(df, ["uq", "row_id"], ["g"], 50).toPandas()
    assert len(got) == 6000 + hot
    sizes = got.groupby("_bucket").size()
    assert len(sizes) <= 3 * 50 and sizes.max() <= 2 * len(got) / 50 + 100
    ordered = got.sort_values(["uq", "row_id"])["_bucket"].to_numpy()
    assert (np.diff(ordered) >= 0).all()


def test_buckets_of_one_key(spark):
    x = np.r_[np.random.default_rng(3).normal(size=500), np.inf, -np.inf]
    got = order_buckets(spark.createDataFrame([(float(v),) for v in x], "x double"), ["x"], num_buckets=40).toPandas().sort_values("x")
    assert (np.diff(got["_bucket"].to_numpy()) >= 0).all() and got["_bucket"].nunique() >= 30


def test_draws_are_the_smallest_hashes_of_every_repeat(spark):
    """Repeated ids are drawn together with the last; a null id is before all hashes; a group without eligible rows draws none."""
    ids = [(i, "a" if i % 3 else "b") for i in range(3000)] + [(7, "a"), (7, "a"), (None, "a")]
    rows = [(i, g, "test" if j % 5 else "d01") for j, (i, g) in enumerate(ids)] + [(i, "c", "d01") for i in range(20)]
    df = spark.createDataFrame(rows, "row_id long, g string, split string")
    got = draw_repeats(df, 4, 42, F.col("split") == "test", 0.3, ["g"]).collect()
    assert len(got) == len(rows)
    for g in "abc":
        for r in range(4):
            key = lambda i: ("", 0) if i is None else (hashlib.md5(f"{42 + r}:{i}".encode()).hexdigest(), i)
            pool = sorted(key(i) for i, h, s in rows if h == g and s == "test")
            last = pool[round(0.3 * len(pool)) - 1] if pool else None
            want = sorted(str(i) for i, h, s in rows if h == g and s == "test" and key(i) <= last)
            assert sorted(str(x.row_id) for x in got if x.g == g and x.calib[r]) == want
    alone = draw_repeats(df.where("g = 'c'"), 4, 42, F.col("split") == "test", 0.3).collect()
    assert len(alone) == 20 and all(x.calib == [False] * 4 for x in alone)
