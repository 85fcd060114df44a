"""Connected components by alternating large and small stars, one written table per round."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def _star(pairs: DataFrame, directed: DataFrame) -> DataFrame:
    """Links each neighbour of ``u`` to the least node around ``u``; pairs as (u, v), u > v."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) -> (node, label): the smallest node reachable. Nodes without a link to another are absent.

    Null ends and links of a node to itself are left out; repeated links count once. Hubs are pre-aggregated in
    ``min`` and joined by a sort-merge join that adaptive execution may split.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_star(both, both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u > v").distinct())
        near = _star(large, large)
        small = (near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
                 .union(near.select("u", F.col("m").alias("v"))).distinct())
        edges = cut(small)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == mark or not now["n"]:
            break
        mark = now
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
            .union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()))
