"""Connected components of a graph of number pairs, by alternating star steps.

A large star hangs every larger neighbour of a node on the node's smallest neighbour; a small star
does the same for the smaller ones.  Alternating both halves path lengths in each round, so a
round count that is logarithmic in the longest chain ends in stars around the smallest node of
each component.  Every round reads and writes a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersieve.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum, to see when nothing moves any more."""
    code = F.xxhash64("a", "b").cast("decimal(20,0)")
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(code).alias("s")).first()
    return row["n"], row["s"]


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that has an edge (``a, b``); the root is the component's smallest node."""
    at = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    before = _mark(at)
    while before[0]:
        at = stored(_small_star(stored(_large_star(at), "stars")), "stars")
        now = _mark(at)
        if now == before:
            break
        before = now
    nodes = at.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
