"""Connected components by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the least of node and neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    least = materialise(least, "components-least")  # a hub's edges can then be split among tasks
    return (
        both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the least of them (all have b < a)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (key, root) for each node with an edge, the root included.

    Each round is written to the shared folder, so a lost executor costs one round. Only a
    count and a checksum of a round reach the driver.
    """
    edges = materialise(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "components",
    )
    before = None
    while True:
        now = edges.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("sum")
        ).first()
        if now == before or not now["n"]:
            break
        before = now
        edges = materialise(_small_star(_large_star(edges)), "components")
    roots = edges.select(F.col("b").alias("key"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("key"), F.col("b").alias("root")).union(roots)
