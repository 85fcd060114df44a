"""S1 (global order without one big partition) and S5 (exact-n pick).

``global_rank`` gives every row its 1-based position inside its group under a
total order, plus running sums, without a window over a whole group: rows are
cut into buckets at sampled key boundaries, numbered inside
``(group, bucket)`` windows, and shifted by the prefix-summed sizes of the
earlier buckets (a table of groups x buckets rows). The order key must be
unique inside a group (add a row id) so the result is deterministic.

``pick_first_n`` selects, per group, the n rows with the smallest
``md5(seed:row_id)``; md5 is uniform, so a count by its first hex digits shows
where the n-th row lies, and only rows of that prefix are ranked. DuckDB's
``md5`` gives the same text, so the pick can be checked exactly.
"""
from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize

BUCKET_ROWS = 1 << 18     # rows aimed at in an order bucket; each is one window task
MAX_BUCKETS = 1024        # buckets per group: their edges are kept per group
PCT_ACCURACY = 10000
PREFIX = 3                # hex digits of md5 that a pick counts by: 4,096 prefixes


def bucket_count(df: DataFrame, group_cols: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS) -> int:
    """Order buckets for the largest group: about ``bucket_rows`` rows in each, two at least."""
    g = _cols(group_cols)
    largest = (df.groupBy(*g).count() if g else df.groupBy().count()).agg(F.max("count")).first()[0] or 0
    return max(2, min(MAX_BUCKETS, -(-largest // bucket_rows)))


def _cols(xs) -> list[str]:
    return [xs] if isinstance(xs, str) else list(xs or [])


def _below(edges: str, heads: str, step: int, value: Column) -> Column:
    """How many of the sorted ``edges`` are less than ``value``: by every ``step``-th of them (``heads``), then inside one stretch."""
    less = lambda e: e < value
    stretch = F.size(F.filter(F.col(heads), less)) - 1
    return F.when(stretch >= 0, stretch * step + F.size(F.filter(F.slice(F.col(edges), stretch * step + 1, F.lit(step)), less))).otherwise(stretch + 1)


def order_buckets(df: DataFrame, order_cols: Sequence[str], group_cols: Sequence[str] = (), num_buckets: int | None = None,
                  bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``_bucket``: numbers that rise with ``order_cols`` inside a group. A value of the first key that alone has more rows than
    a bucket is cut by the second, into as many parts as it fills buckets: with the others, at most three times the wanted number."""
    g, order_cols = _cols(group_cols), _cols(order_cols)
    prim = order_cols[0]
    tie = order_cols[1] if len(order_cols) > 1 else None
    B = bucket_count(df, g, bucket_rows) if num_buckets is None else max(1, int(num_buckets))
    fr = [i / B for i in range(1, B)] or [0.5]
    step = math.isqrt(B - 1) + 1
    pa = lambda c: F.array_distinct(F.percentile_approx(F.col(c), fr, PCT_ACCURACY))
    b1 = (df.groupBy(*g) if g else df.groupBy()).agg(pa(prim).alias("_b"), F.ceil(F.count(F.lit(1)) / B).alias("_rows"))
    b1 = b1.withColumn("_heads", F.expr(f"transform(sequence(0, size(_b) - 1, {step}), i -> _b[i])"))
    x = df.join(F.broadcast(b1), g) if g else df.crossJoin(F.broadcast(b1))
    x = x.withColumn("_lo", _below("_b", "_heads", step, F.col(prim)))
    x = x.withColumn("_eq", F.coalesce(F.get("_b", F.col("_lo")) == F.col(prim), F.lit(False))).drop("_b", "_heads")
    if tie is not None:
        hot = x.filter("_eq").groupBy(*g, prim).agg(F.count(F.lit(1)).alias("_c"), F.max("_rows").alias("_each"), pa(tie).alias("_tb"))
        hot = hot.where(F.col("_c") > F.col("_each")).withColumn("_parts", F.ceil(F.col("_c") / F.col("_each")).cast("int"))
        cuts = F.expr("if(size(_tb) < _parts, _tb, transform(sequence(1, _parts - 1), i -> _tb[cast(i * size(_tb) div _parts as int)]))")
        x = x.join(F.broadcast(hot.select(*g, prim, cuts.alias("_tb"))), [*g, prim], "left")
        sub = F.when(F.col("_tb").isNotNull(), 1 + F.size(F.filter(F.col("_tb"), lambda e: e < F.col(tie)))).otherwise(0)
        x = x.withColumn("_bucket", F.col("_lo") * (B + 2) + sub).drop("_tb")
    else:
        x = x.withColumn("_bucket", F.col("_lo") * (B + 2) + F.col("_eq").cast("int"))
    return x.drop("_lo", "_eq", "_rows")


def global_rank(df: DataFrame, order_cols: Sequence[str], group_cols: Sequence[str] = (),
                sum_cols: Sequence[str] = (), rank_col: str = "pos",
                num_buckets: int | None = None, max_cols: Sequence[str] = ()) -> DataFrame:
    """Add ``rank_col`` (1-based, per group, ascending ``order_cols``) and, for
    each ``c`` in ``sum_cols``, ``cum_<c>`` = running sum up to and including the row;
    for each ``c`` in ``max_cols``, ``prevmax_<c>`` = maximum over the earlier rows (NULL if none).

    ``order_cols`` is (primary,) with unique values per group, or
    (primary, tiebreak) with a unique tiebreak. Bucket edges come from
    ``percentile_approx`` of the primary key per group; the rows of a primary that fills more than a bucket (hot, tied values) are cut again by
    ``percentile_approx`` of the tiebreak, so one tied value never lands in a
    single task. Buckets are numbered in key order, windows run per
    (group, bucket), and bucket totals are prefix-summed on a
    groups x buckets table and joined back on the windows' own partitioning.
    The number of buckets comes from the largest group's rows (one count) unless given.
    """
    g, order_cols, sum_cols = _cols(group_cols), _cols(order_cols), _cols(sum_cols)
    max_cols = _cols(max_cols)
    x = order_buckets(df, order_cols, g, num_buckets)
    wb = Window.partitionBy(*g, "_bucket").orderBy(*order_cols)
    local = x.withColumn("_rn", F.row_number().over(wb))
    wr = wb.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in sum_cols:
        local = local.withColumn(f"_cs_{c}", F.sum(c).over(wr))
    wp = wb.rowsBetween(Window.unboundedPreceding, -1)
    for c in max_cols:
        local = local.withColumn(f"_cm_{c}", F.max(c).over(wp))
    tot = local.groupBy(*g, "_bucket").agg(
        F.count("*").alias("_bn"), *[F.sum(c).alias(f"_bs_{c}") for c in sum_cols],
        *[F.max(c).alias(f"_bm_{c}") for c in max_cols])
    wt = (Window.partitionBy(*g) if g else Window.partitionBy()).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offs = tot.select(*g, "_bucket",
                      F.coalesce(F.sum("_bn").over(wt), F.lit(0)).alias("_off"),
                      *[F.coalesce(F.sum(f"_bs_{c}").over(wt), F.lit(0)).alias(f"_bo_{c}") for c in sum_cols],
                      *[F.max(f"_bm_{c}").over(wt).alias(f"_bx_{c}") for c in max_cols])
    out = local.join(offs, [*g, "_bucket"])
    for c in max_cols:
        out = out.withColumn(f"prevmax_{c}", F.greatest(F.col(f"_bx_{c}"), F.col(f"_cm_{c}")))
    out = out.withColumn(rank_col, (F.col("_off") + F.col("_rn")).cast("bigint"))
    for c in sum_cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_bo_{c}") + F.col(f"_cs_{c}"))
    return out.drop("_bucket", "_rn", "_off", *[f"_cs_{c}" for c in sum_cols],
                    *[f"_bo_{c}" for c in sum_cols], *[f"_cm_{c}" for c in max_cols],
                    *[f"_bx_{c}" for c in max_cols])


def hash_key(seed, id_col: str) -> Column:
    """md5 of 'seed:row_id' (hex text); same bytes in Spark and DuckDB."""
    s = seed if isinstance(seed, Column) else F.lit(str(int(seed)))
    return F.md5(F.concat(s.cast("string"), F.lit(":"), F.col(id_col).cast("string")))


def crossing_prefixes(hashed: DataFrame, sizes: DataFrame, by: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """(parts..., _p, _need): the md5 prefix in which the count of a part's rows crosses its group's ``_n``, and how many rows are
    missing before it. A part has at most 16 ** PREFIX prefixes; a part that never reaches ``_n``, or wants none, has no row."""
    parts = list(parts)
    counts = hashed.groupBy(*parts, "_p").agg(F.count(F.lit(1)).alias("_c"))
    upto = (Window.partitionBy(*parts) if parts else Window.partitionBy()).orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_sum", F.sum("_c").over(upto))
    counts = counts.join(sizes, list(by)) if by else counts.crossJoin(sizes)
    need = F.col("_n") - (F.col("_sum") - F.col("_c"))
    return counts.where((F.col("_sum") >= F.col("_n")) & (need > 0)).select(*parts, "_p", need.alias("_need"))


def pick_cuts(df: DataFrame, sizes: DataFrame, seed: Column, id_col: str, by: Sequence[str] = (), also: Sequence[str] = ()) -> DataFrame:
    """(by..., also..., _h, id): the ``_n``-th row of each part in the order of (md5(seed:id), id). ``sizes`` has ``_n`` by ``by``; ``also``
    are columns that divide a group further, such as repeats. Only rows of the crossing prefix, 1 in 4,096, are ranked."""
    parts = [*by, *also]
    hashed = df.withColumn("_h", hash_key(seed, id_col)).withColumn("_p", F.substring("_h", 1, PREFIX))
    crossing = materialize(crossing_prefixes(hashed, sizes, by, parts))
    near = hashed.join(crossing, [*parts, "_p"])
    place = (Window.partitionBy(*parts) if parts else Window.partitionBy()).orderBy("_h", id_col)
    return near.withColumn("_rn", F.row_number().over(place)).where(F.col("_rn") == F.col("_need")).select(*parts, "_h", id_col)


def pick_first_n(df: DataFrame, n_col: Column | str, seed, id_col: str = "row_id", group_cols: Sequence[str] = (), out_col: str = "picked") -> DataFrame:
    """Flag the ``n`` rows with the smallest (md5(seed:id), id) per group.

    ``n_col`` is the same for all rows of a group; ``seed`` a literal or a column (so several repeats can be picked in one pass). Rows
    before the prefix where the count crosses n are in, rows behind it out; only the rows of that prefix, 1 in 4,096, are ranked.
    """
    g = _cols(group_cols)
    n_col = F.col(n_col) if isinstance(n_col, str) else n_col
    h = df.withColumn("_n", n_col.cast("bigint")).withColumn("_h", hash_key(seed, id_col)).withColumn("_p", F.substring("_h", 1, PREFIX))
    crossing = materialize(crossing_prefixes(h, h.groupBy(*g).agg(F.max("_n").alias("_n")), g, g).withColumnRenamed("_p", "_at"))
    h = h.join(crossing, g, "left") if g else h.join(crossing, F.lit(True), "left")
    none = F.col("_at").isNull()  # all rows or none
    sure = h.where(none | (F.col("_p") != F.col("_at"))).withColumn(out_col, F.when(none, F.col("_n") > 0).otherwise(F.col("_p") < F.col("_at")))
    place = (Window.partitionBy(*g) if g else Window.partitionBy()).orderBy("_h", id_col)
    edge = h.where(F.col("_p") == F.col("_at")).withColumn(out_col, F.row_number().over(place) <= F.col("_need"))
    return sure.unionByName(edge).select(*df.columns, out_col)


def average_rank(df: DataFrame, value_col: str, group_cols: Sequence[str] = (),
                 out_col: str | None = None) -> DataFrame:
    """Tie-averaged 1-based rank of ``value_col`` per group (for Spearman, G3).

    Distinct values are ranked with ``global_rank`` on their counts, then joined
    back by (group, value): no window ever holds a whole group.
    """
    g = _cols(group_cols)
    out_col = out_col or f"rank_{value_col}"
    d = df.groupBy(*g, value_col).agg(F.count("*").alias("_c"))
    d = global_rank(d, [value_col], g, sum_cols=["_c"], rank_col="_r")
    d = d.select(*g, value_col, (F.col("cum__c") - (F.col("_c") - 1) / 2.0).alias(out_col))
    return df.join(d, [*g, value_col], "left")
