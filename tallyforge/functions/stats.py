"""Estimates, summaries and percentile rules as aggregate columns and small plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running

Z95 = 1.96


def estimate(value: Column | str, prefix: str = "") -> list[Column]:
    """Aggregates of a mean with its sample standard error (0 for one value) and interval."""
    v = F.col(value) if isinstance(value, str) else value
    mean = F.avg(v)
    error = F.coalesce(F.stddev_samp(v) / F.sqrt(F.count(v)), F.lit(0.0))
    return [
        mean.alias(f"{prefix}mean"),
        error.alias(f"{prefix}standard_error"),
        F.count(v).alias(f"{prefix}sample_count"),
        (mean - Z95 * error).alias(f"{prefix}ci_low"),
        (mean + Z95 * error).alias(f"{prefix}ci_high"),
    ]


def two_level(df: DataFrame, group: str, value: Column, *keys: str) -> DataFrame:
    """Mean by group, then mean and interval over the groups: the groups are the sample."""
    means = df.groupBy(*keys, group).agg(F.avg(value).alias("m"), F.count(F.lit(1)).alias("rows"))
    return means.groupBy(*keys).agg(*estimate("m"), F.sum("rows").alias("row_count"))


def verdict(low: Column, high: Column, better: str = "better", worse: str = "worse", neither: str = "inconclusive") -> Column:
    return F.when(low > 0, better).when(high < 0, worse).otherwise(neither)


def scaled(mean: Column, error: Column, by: float) -> list[Column]:
    m, e = mean * by, error * abs(by)
    return [m.alias("mean"), e.alias("standard_error"), (m - Z95 * e).alias("ci_low"), (m + Z95 * e).alias("ci_high")]


def pooled(parts: DataFrame, *keys: str) -> DataFrame:
    """Partial estimates (mean, standard_error, sample_count) into one for each key, with
    within and between variance: sums only, so partial results combine anywhere."""
    n, m, e = F.col("sample_count").cast("double"), F.col("mean"), F.col("standard_error")
    sums = parts.groupBy(*keys).agg(
        F.sum(n).alias("n"),
        F.sum(n * m).alias("nm"),
        F.sum((n - 1) * n * e * e).alias("within"),
        F.sum(n * m * m).alias("nmm"),
    )
    mean = F.col("nm") / F.col("n")
    spread = F.greatest(F.col("within") + F.col("nmm") - F.col("nm") * mean, F.lit(0.0))
    error = F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1) / F.col("n"))).otherwise(F.lit(0.0))
    return sums.select(
        *keys,
        mean.alias("mean"),
        error.alias("standard_error"),
        F.col("n").cast("long").alias("sample_count"),
        (mean - Z95 * error).alias("ci_low"),
        (mean + Z95 * error).alias("ci_high"),
    )


def rank_at(rule: str, p: float, n: Column) -> Column:
    """Index from 0 of the percentile ``p`` among n sorted values. ``truncated``: int(p n),
    at most n-1; ``ceiling``: ceil(p n) - 1; ``upper_median``: n // 2."""
    if rule == "truncated":
        return F.least(F.floor(n * p), n - 1).cast("long")
    if rule == "ceiling":
        return F.greatest(F.ceil(n * p) - 1, F.lit(0)).cast("long")
    if rule == "upper_median":
        return F.floor(n / 2).cast("long")
    raise ValueError(f"unknown rule {rule!r}")


def numeric_summary(df: DataFrame, value: str, *keys: str, rule: str = "truncated") -> DataFrame:
    """n, min, mean, upper median, 95th percentile and max by key.

    Equal values are counted first; running counts over ranges of the values find the ranks.
    No list of a group is built, and no task sees all values of a key.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    counted = counted.select(*[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)], F.col(value).alias("v"), "c")
    names = [f"key{i}" for i in range(len(keys))]
    totals = counted.groupBy(*names).agg(F.sum("c").alias("n")).select(*[F.col(k).alias(f"t_{k}") for k in names], "n")
    ranked = running(counted, F.col("v"), [], {"upto": F.col("c")}, names)
    on = F.lit(True)
    for k in names:
        on = on & F.col(k).eqNullSafe(F.col(f"t_{k}"))
    # without keys the total is one row
    ranked = ranked.join(totals if names else F.broadcast(totals), on)

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("v")))

    n = F.col("n")
    out = ranked.groupBy(*names).agg(
        F.sum("c").alias("count"),
        F.min("v").alias("minimum"),
        (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"),
        at(rank_at("upper_median", 0.5, n)).alias("median"),
        at(rank_at(rule, 0.95, n)).alias("p95"),
        F.max("v").alias("maximum"),
    )
    rest = ("count", "minimum", "mean", "median", "p95", "maximum")
    return out.select(*[F.col(f"key{i}").alias(k) for i, k in enumerate(keys)], *rest)


def histogram_estimate(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean of a histogram with the population standard error sqrt(sum p (x-m)^2 / n)."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    x, c = F.col(value).cast("double"), F.col("c")
    sums = counts.groupBy(*keys).agg(
        F.sum(c).alias("n"), F.sum(c * x).alias("s"), F.sum(c * x * x).alias("q"), F.count(F.lit(1)).alias("outcomes")
    )
    mean = F.col("s") / F.col("n")
    error = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)) / F.col("n"))
    return sums.select(*keys, F.col("n").alias("rollouts"), "outcomes", mean.alias("mean"), error.alias("standard_error"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)
