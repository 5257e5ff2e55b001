"""Balances that compound over an order, and experiment slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running


def balances(df: DataFrame, order: Column, ties: list[str], growth: Column, start: float, keys: list[str] | None = None) -> DataFrame:
    """Adds balance_before and balance_after, with balance_after = start * product of the
    growth factors so far: sums of logarithms, so it distributes."""
    out = running(df.withColumn("__g", F.ln(growth)), order, ties, {"log_after": F.col("__g")}, keys)
    step = F.ln(growth)
    return out.select(
        "*",
        (F.lit(start) * F.exp(F.col("log_after") - step)).alias("balance_before"),
        (F.lit(start) * F.exp("log_after")).alias("balance_after"),
    ).drop("log_after")


def lagged(df: DataFrame, partition: str, order: list[str], value: str, start: float) -> DataFrame:
    """Adds ``value`` of the row before in its partition as ``before``; ``start`` at first."""
    w = Window.partitionBy(partition).orderBy(*order)
    return df.withColumn("before", F.lag(value, 1, start).over(w))


def slice_gaps(slices: DataFrame, start: str, count: str, *partition: str) -> DataFrame:
    """Slices that don't begin where the one before ends. Slices are few: one a shard."""
    w = Window.partitionBy(*(partition or [F.lit(1)])).orderBy(start)
    expected = F.lag(F.col(start) + F.col(count)).over(w)
    return slices.withColumn("expected", expected).where(F.col("expected").isNotNull() & (F.col("expected") != F.col(start)))


def stitched(slices: DataFrame, order: str, rounds: str, log_growth: str, start: float) -> DataFrame:
    """Offset of rounds and balance at the start of each slice, from those before it."""
    out = running(slices, F.col(order), [], {"round_offset": F.col(rounds), "log_before": F.col(log_growth)}, inclusive=False)
    return out.withColumn("balance_start", F.lit(start) * F.exp("log_before")).drop("log_before")


def running_counts(df: DataFrame, order: Column, ties: list[str], card: Column, keys: list[str]) -> DataFrame:
    """Running count, cards seen and cards left by value, after each card of a shoe."""
    from ..functions.cards import SIX_DECKS, count_weight

    sums = {"running_count": count_weight(card), "seen": F.lit(1)}
    sums |= {f"seen_{v}": (card == v).cast("int") for v in range(1, 11)}
    out = running(df, order, ties, {k: v.cast("long") for k, v in sums.items()}, keys)
    left = F.array(*[F.lit(SIX_DECKS[v - 1]).cast("long") - F.col(f"seen_{v}") for v in range(1, 11)])
    return out.withColumn("remaining", left).drop(*[f"seen_{v}" for v in range(1, 11)])
