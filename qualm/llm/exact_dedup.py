"""Operator 12: exact dedup with a heavy-hitter split, in DataFrame functions only.

Texts are equal when identical without the whitespace ``[\\x20\\x09-\\x0D]``; their SHA-256 stands for them. A summary of COUNTERS
counters (``approx_top_k``: Misra-Gries with batched decrements) finds the frequent digests: partial summaries are made in
the tasks that read the rows, merged in GROUPS groups, then in one. Every digest of over 8 / COUNTERS of all rows is among the at
most FREQUENT found. Their sizes and winners are then verified by exact aggregation over full digests and broadcast (at
most FREQUENT rows), so copies of frequent texts are settled where they are read. The other digests, of bounded size each, are
shuffled. A digest that the summary names without cause, or leaves out, only changes the way it takes, not its result.

Of equal texts the row with the most code points stays, then the smallest doc_id (null last), then the first as read.

Defined results: null text is empty; all empty texts are one group; repeated rows are copies, so exactly one of them stays; a null
doc_id is a row like others, and keep_id is null where such a row stays; an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, text_of, unpack, whole_row

COUNTERS, FREQUENT, GROUPS = 16_384, 2_048, 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")


def digests(docs: DataFrame) -> list[Column]:
    """digest (32 bytes) and n (code points of the original) of a row's whole text."""
    text = text_of("text")
    return [F.unhex(F.sha2(normalised(text), 256)).alias("digest"), F.length(text).cast("long").alias("n")]


def counted(digest: Column) -> Column:
    """60 bits of a digest, which the summary counts."""
    return F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("long")


def frequent(rows: DataFrame, counters: int = COUNTERS, most: int = FREQUENT) -> DataFrame:
    """(item): at most ``most`` items that may be frequent."""
    summaries = (rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("g"))
                 .agg(F.expr(f"approx_top_k_accumulate(item, {counters})").alias("summary")))
    # one group by a column, not a plain total: a total also makes summaries of empty partitions, which do not merge
    merged = summaries.groupBy((F.col("g") < 0).alias("all")).agg(F.expr(f"approx_top_k_combine(summary, {counters})").alias("summary"))
    found = merged.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {most})")).alias("x"))
    return found.where(F.col("x.count") > 1).select("x.item")


def place() -> Column:
    """The smallest of a group is the row that stays."""
    return F.struct((-F.col("n")).alias("m"), F.col("doc").isNull().alias("nil"), F.col("doc"), F.col("row"))


def winners(rows: DataFrame, counters: int = COUNTERS, most: int = FREQUENT) -> DataFrame:
    """(h_digest, h_size, h_first) of the frequent digests, verified: exact sizes and winners over whole digests."""
    items = F.broadcast(cut(frequent(rows, counters, most)))  # at most `most` rows
    found = rows.join(items, "item").groupBy("digest").agg(F.count(F.lit(1)).alias("h_size"), F.min(place()).alias("h_first"))
    return found.where(F.col("h_size") > 1).withColumnRenamed("digest", "h_digest")


def settled(rows: DataFrame, counters: int = COUNTERS, most: int = FREQUENT) -> DataFrame:
    """``rows`` (digest, n, doc, row, item and others) with ``size`` and ``first`` of their group."""
    heavy = F.broadcast(cut(winners(rows, counters, most)))
    split = rows.join(heavy, F.col("digest") == F.col("h_digest"), "left")
    others = rows.columns
    there = split.where(F.col("h_digest").isNotNull()).select(*others, F.col("h_size").alias("size"), F.col("h_first").alias("first"))
    group = Window.partitionBy("digest")
    rest = (split.where(F.col("h_digest").isNull()).select(*others).withColumn("size", F.count(F.lit(1)).over(group))
            .withColumn("first", F.min(place()).over(group)))
    return there.unionByName(rest)


def written(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc, digest, n, item, row) of every document and ``more``, written once, so that ``row`` names a row for good."""
    rows = docs.select(F.col("doc_id").alias("doc"), *digests(docs), *more)
    return cut(rows.withColumn("item", counted(F.col("digest"))).withColumn("row", F.monotonically_increasing_id()))


def exact_copies(docs: DataFrame, counters: int = COUNTERS, most: int = FREQUENT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and n_chars of every document."""
    done = settled(written(docs), counters, most)
    return done.select(F.col("doc").alias("doc_id"), F.col("first.doc").alias("keep_id"), F.col("size").cast("long").alias("group_size"),
                       (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
                       F.col("n").alias("n_chars"))


def drop_copies(docs: DataFrame, counters: int = COUNTERS, most: int = FREQUENT) -> DataFrame:
    """The documents that stay, all columns kept. Copies of frequent texts go where they are read; other rows are shuffled by digest."""
    done = settled(written(docs, whole_row(docs).alias("q_row")), counters, most)
    return unpack(done.where(F.col("row") == F.col("first.row")), docs.columns)


COPIES_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
d AS (SELECT doc_id, length(x) AS n, sha256(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g')) AS h FROM t)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER g = 1 AS kept, h AS text_sha256, n AS n_chars
FROM d WINDOW g AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST)
"""
