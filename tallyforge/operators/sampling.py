"""Splits, subsets, weights and draws that replay exactly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import text_key, uniform
from .ordered import running


def apportion(total: int, weights: Sequence[float]) -> list[int]:
    """Largest remainders; of equal ones the lower index; no part stays empty."""
    if total < len(weights) or any(w <= 0 for w in weights) or abs(sum(weights) - 1) > 1e-9:
        raise ValueError("weights must be positive and add up to one, with a unit for each")
    raw = [total * w for w in weights]
    counts = [int(r + 1e-9) for r in raw]
    order = sorted(range(len(raw)), key=lambda i: (-round(raw[i] - counts[i], 9), i))
    for i in order[: total - sum(counts)]:
        counts[i] += 1
    for i, c in enumerate(counts):
        if c == 0:
            giver = max(range(len(counts)), key=lambda j: (counts[j], -j))
            counts[giver] -= 1
            counts[i] += 1
    return counts


def prefix(df: DataFrame, group: str, below: int) -> DataFrame:
    """Groups numbered below a bound: subsets nest. An empty one is an error."""
    found = df.where(F.col(group) < below)
    if found.isEmpty():
        raise ValueError(f"no {group} is below {below}")
    return found


def shard(df: DataFrame, key: str, index: int, count: int) -> DataFrame:
    if not 0 <= index < count:
        raise ValueError("a shard's index must lie below the number of shards")
    return df.where(F.pmod(F.col(key), F.lit(count)) == index)


def balanced_weights(df: DataFrame, target: str, cap: float) -> DataFrame:
    """Adds min(sqrt(largest class / own class), cap) as ``weight``."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("c"))
    top = counts.agg(F.max("c").alias("top"))
    weights = counts.join(F.broadcast(top)).select(  # one row
        target, F.least(F.sqrt(F.col("top") / F.col("c")), F.lit(cap)).alias("weight")
    )
    return df.join(weights, target)


def epoch_order(df: DataFrame, seed: int, epoch: int, *keys: str) -> DataFrame:
    """A permutation of the rows for each epoch, by a hash of seed plus epoch and key."""
    return df.withColumn("u", uniform(text_key(F.lit(seed + epoch), *keys))).orderBy("u", *keys)


def weighted_draws(df: DataFrame, key: str, weight: str, draws: int, seed: int) -> DataFrame:
    """``draws`` rows with replacement, each with a chance in proportion to its weight.

    Running sums of the weights cut [0, total) into one interval a row; each draw is a
    point in it. Points and intervals meet in cells of equal width, so the join is on the
    cell; an interval that covers several cells is in each of them.
    """
    spark = df.sparkSession
    upto = running(df.select(key, weight), F.col(key), [], {"upto": F.col(weight).cast("double")})
    spans = upto.select(key, (F.col("upto") - F.col(weight)).alias("low"), F.col("upto").alias("high"))
    size = df.agg(F.sum(F.col(weight).cast("double")).alias("total"), F.count(F.lit(1)).alias("n")).first()
    total, cells = float(size["total"] or 0.0), max(1, int(size["n"]))
    width = total / cells if total else 1.0
    points = spark.range(draws).select(
        F.col("id").alias("draw"), (uniform(text_key(F.lit(seed), F.col("id"))) * total).alias("point")
    )
    points = points.withColumn("cell", F.floor(F.col("point") / width))
    spans = spans.where("high > low").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width)))
    )
    return points.join(spans, "cell").where("low <= point AND point < high").select("draw", key)


def explored(legal: Column, best: Column, probability: float, key: Column) -> Column:
    """The best action, or with the given chance one of the others (uniformly, by hash);
    a state without an alternative uses no randomness."""
    others = F.array_remove(legal, best)
    pick = F.element_at(others, (F.floor(uniform(F.concat(key, F.lit("|pick"))) * F.size(others)) + 1).cast("int"))
    return F.when((F.size(others) > 0) & (uniform(key) < probability), pick).otherwise(best)


def permuted(values: Column, key: Column) -> Column:
    """The array in an order given by hashes of key and place: the same multiset."""
    tagged = F.transform(
        values, lambda v, i: F.struct(F.sha2(F.concat_ws("|", key, i.cast("string")), 256).alias("h"), v.alias("v"))
    )
    return F.transform(F.array_sort(tagged), lambda t: t["v"])


def permuted_slice(values: Column, start: Column, length: Column, key: Column) -> Column:
    """Only ``length`` places from ``start`` (from 1) change places."""
    return F.concat(
        F.slice(values, F.lit(1), start - 1),
        permuted(F.slice(values, start, length), key),
        F.slice(values, start + length, F.size(values)),
    )


def padded(values: Column, length: int, fill: int = 0) -> Column:
    """An array of exactly ``length``: filled on the right; a longer one is an error."""
    return F.when(F.size(values) > length, F.raise_error(F.lit("a sequence is longer than its batch"))).otherwise(
        F.concat(values, F.array_repeat(F.lit(fill), F.lit(length) - F.size(values)))
    )


def batches(df: DataFrame, size: int, *order: str) -> DataFrame:
    """Adds batch and place within it, in the given order."""
    from .ordered import numbered

    rows = numbered(df, F.col(order[0]), list(order[1:]))
    return rows.select(
        "*", F.floor(F.col("row_index") / size).cast("long").alias("batch"), (F.col("row_index") % size).alias("place")
    ).drop("row_index")


def frequency_scores(df: DataFrame, vocabulary: DataFrame, token: str) -> DataFrame:
    """ln(count) of each token of the vocabulary; 0 for one never seen."""
    counts = df.groupBy(token).agg(F.count(F.lit(1)).alias("c"))
    return vocabulary.join(counts, token, "left").select(token, F.coalesce(F.ln("c"), F.lit(0.0)).alias("score"))
