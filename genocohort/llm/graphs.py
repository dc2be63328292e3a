"""Connected components of a graph of any size, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import removed, stored


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).collect()[0]
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b), root the smallest node reachable.

    Each round hangs every node's larger neighbours, then its smaller ones, on its smallest neighbour; rounds are written to
    the shared folder, each removed when the next is there, and end when nothing changes. Groups are only aggregated and joined, never gathered, so a node with very
    many neighbours is split like any skewed key. Loops, repeated edges and an empty table are fine.
    """
    places: list[str] = []
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", places)
    before = _fingerprint(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, places = places, []
        edges = stored(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "edges", places)
        now = _fingerprint(edges)
        removed(edges.sparkSession, old)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
