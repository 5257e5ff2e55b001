"""Finite return distributions as a long table (key..., x, p)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_weights(df: DataFrame, keys: list[str], x: Column, weight: Column) -> DataFrame:
    """Equal values merged, zero weights dropped, weights divided by their sum by key."""
    merged = df.groupBy(*keys, x.alias("x")).agg(F.sum(weight).alias("w")).where("w <> 0")
    sums = merged.groupBy(*keys).agg(F.sum("w").alias("t"))
    joined = merged.join(sums, keys) if keys else merged.join(F.broadcast(sums))
    return joined.select(*keys, "x", (F.col("w") / F.col("t")).alias("p"))


def mixture(parts: DataFrame, weights: DataFrame, part_key: str, keys: list[str]) -> DataFrame:
    """Weighted union: ``weights`` has part_key, the new keys and w; parts share values."""
    return (
        parts.join(weights, part_key)
        .groupBy(*keys, "x")
        .agg(F.sum(F.col("w") * F.col("p")).alias("p"))
        .where("p <> 0")
    )


def shift(dist: DataFrame, by: Column) -> DataFrame:
    return dist.withColumn("x", F.col("x") + by)


def moments(dist: DataFrame, keys: list[str]) -> DataFrame:
    mean = F.sum(F.col("x") * F.col("p"))
    return dist.groupBy(*keys).agg(
        mean.alias("mean"),
        (F.sum(F.col("x") * F.col("x") * F.col("p")) - mean * mean).alias("variance"),
        F.min("x").alias("minimum"),
        F.sum("p").alias("total"),
        F.count(F.lit(1)).alias("outcomes"),
    )


def broken(dist: DataFrame, keys: list[str], tolerance: float = 1e-10) -> DataFrame:
    """Keys whose probabilities aren't all positive or don't add up to one."""
    return (
        dist.groupBy(*keys)
        .agg(F.sum("p").alias("total"), F.min("p").alias("least"))
        .where((F.abs(F.col("total") - 1) > tolerance) | (F.col("least") <= 0))
    )


def nested(dist: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key, with the outcomes as array<struct<x, p>> in order of x."""
    return dist.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("p").alias("p")))).alias("outcomes")
    )


def flat(nested_dist: DataFrame, keys: list[str]) -> DataFrame:
    return nested_dist.select(*keys, F.inline("outcomes"))


def support_union(dists: list[DataFrame]) -> DataFrame:
    out = dists[0].select("x")
    for d in dists[1:]:
        out = out.union(d.select("x"))
    return out.distinct()


def upper_pairs(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Pairs left <= right of a small table with weight 2 off the diagonal: each unordered
    pair stands for both orders. The table must be small: pairs grow with its square."""
    left = df.select(key, *columns).toDF(*[f"l_{c}" for c in (key, *columns)])
    right = df.select(key, *columns).toDF(*[f"r_{c}" for c in (key, *columns)])
    a, b = F.col(f"l_{key}"), F.col(f"r_{key}")
    return left.join(right, a <= b).withColumn("weight", F.when(a == b, 1).otherwise(2))
