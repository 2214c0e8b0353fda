"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node at the node's least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours at the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that is not the least of its component.

    ``edges`` holds two comparable columns; self loops and repeats are ignored,
    null ends are dropped. Each round is two joins over the remaining edges and
    is written to the checkpoint folder, so rounds do not pile up lineage; the
    rounds end when the edge set stays the same (every component is a star).
    Only two numbers per round reach the driver.
    """
    larger, smaller = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    current = edges.where(F.col(a) != F.col(b)).select(larger, smaller).distinct()
    seen = None
    while True:
        current = settle(_small_star(_large_star(current)))
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
