"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before its shuffle) and a join back, and is written
to the shared folder; nothing of the graph comes to the driver but two checksums a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raingrid.session import written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least).distinct()


def _falling(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge in ``edges`` (a, b): root is the least node
    reachable. Nodes without an edge, and self loops, have no row."""
    current = written(_falling(edges), "edges")
    mark = None
    while True:
        state = tuple(current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == mark or not state[0]:
            break
        mark = state
        current = written(_small(_large(current)), "edges")
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(current.select("b", "b").distinct())
