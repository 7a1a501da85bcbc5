"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoflow.session import cut, remove


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges (u, v)`` with ``m``, the least of u and its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("_v")).select("u", F.least("u", "_v").alias("m"))
    return edges.join(least, "u")


def stars(edges: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` of long ids to ``(node, root)`` for every node but the roots; root is the least id reachable.

    Each round is a few grouped minima and is written to the shared folder in two steps, so nothing is
    gathered and lost executors cost a step at most. In one plan the first step would stand twice, with its exchanges, each
    of which is a thread of the driver and on small inputs often a broadcast. Self-loops and repeats are harmless.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(state)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_with_least(both).where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        pairs = _with_least(large)
        small = pairs.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = pairs.select("u", F.col("m").alias("v"))
        after = cut(small.unionByName(own).where("u > v").distinct())
        remove(now, large)
        now = after
