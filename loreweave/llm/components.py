"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("b"), F.col("_m").alias("a")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them. Edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("_m"))
    moved = edges.join(least, "b").filter("a <> _m").select(F.col("a").alias("b"), F.col("_m").alias("a"))
    return moved.unionByName(least.select("b", F.col("_m").alias("a"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: for every node of edges (a, b, with a < b) the least node of its component.

    The steps need as many rounds as about the logarithm of the longest chain.
    Each round's edges are written to the shared folder and those of the round
    before dropped; only a count and a checksum of the edges reach the driver.
    No edges: no rows.
    """
    scratch = Scratch(edges.sparkSession, "components")
    edges, before = scratch.write(edges.select("a", "b").distinct()), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
        after = scratch.write(_small_star(_large_star(edges)))
        scratch.drop(edges)
        edges, before = after, now
