"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import discard, stored


def _around(edges: DataFrame) -> DataFrame:
    """u, and least: the smallest of u and its neighbours v."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node that it is connected with, for every node of edges (a, b); self-links, repeated
    and null ends are dropped. Rounds go on until the edges stay the same; each is a table in the shared folder.

    Large star links every larger neighbour of a node to the least of them all, small star every smaller one and the node
    itself. Both keep what is connected, and end at stars around the roots.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_around(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        small = large.join(_around(large), "u")
        last = now
        now = stored(small.select(F.col("v").alias("u"), F.col("least").alias("v")).union(small.select("u", F.col("least"))).where("u <> v").distinct(), "edges")
        discard(last)
