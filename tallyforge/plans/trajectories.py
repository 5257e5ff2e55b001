"""Balances, slices and ordered operators over the data tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered, trajectory
from ..sources.tables import load
from .statistics import r, rounded

START = 100.0


def _growth() -> Column:
    return 1 + 0.01 * (F.col("value") - 100) / 1000


_GROWTH = "ln(1 + 0.01 * (value - 100) / 1000)"


def running_balance(spark: SparkSession, d: str) -> DataFrame:
    """A balance that compounds over all events in order of time."""
    e = load(spark, d, "events", "event_id", "ts", "value")
    out = trajectory.balances(e, F.col("event_id"), [], _growth(), START)
    return rounded(out.select("event_id", "balance_before", "balance_after"))


RUNNING_BALANCE = f"""
WITH s AS (SELECT event_id, {_GROWTH} AS g, sum({_GROWTH}) OVER (ORDER BY event_id) AS l FROM events)
SELECT event_id, round(100 * exp(l - g), 6) AS balance_before, round(100 * exp(l), 6) AS balance_after FROM s
"""


def lag_balance(spark: SparkSession, d: str) -> DataFrame:
    """The value before each event of a user; the start value for the first."""
    e = load(spark, d, "events", "user_id", "event_id", "value")
    out = trajectory.lagged(e, "user_id", ["event_id"], "value", START)
    return rounded(out.select("event_id", "user_id", "before", (F.col("value") - F.col("before")).alias("change")))


LAG_BALANCE = """
SELECT event_id, user_id, round(lag(value, 1, 100.0) OVER w, 6) AS before, round(value - lag(value, 1, 100.0) OVER w, 6) AS change
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
"""


def round_index(spark: SparkSession, d: str) -> DataFrame:
    """Global and per-user row numbers from 0."""
    e = load(spark, d, "events", "event_id", "user_id")
    every = ordered.numbered(e, F.col("event_id"), [], "global_index")
    return ordered.running(every, F.col("event_id"), [], {"user_index": F.lit(1).cast("long")}, ["user_id"], inclusive=False)


ROUND_INDEX = """
SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS global_index, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS user_index FROM events
"""


def slice_contiguity(spark: SparkSession, d: str) -> DataFrame:
    """Slices of orders by thousand; those that don't begin where the last one ends."""
    o = load(spark, d, "orders", "o_orderkey")
    slices = o.groupBy(F.floor(F.col("o_orderkey") / 1000).alias("slice")).agg(
        F.min("o_orderkey").alias("start"), F.count(F.lit(1)).alias("count")
    )
    damaged = slices.withColumn("count", F.when(F.col("slice") % 4 == 1, F.col("count") - 1).otherwise(F.col("count")))
    return trajectory.slice_gaps(damaged, "start", "count").select("slice", "start", "expected")


SLICE_CONTIGUITY = """
WITH s AS (SELECT floor(o_orderkey / 1000)::BIGINT AS slice, min(o_orderkey) AS start, count(*)::BIGINT AS c FROM orders GROUP BY 1),
g AS (SELECT slice, start, lag(start + CASE WHEN slice % 4 = 1 THEN c - 1 ELSE c END) OVER (ORDER BY start) AS expected FROM s)
SELECT slice, start, expected FROM g WHERE expected <> start
"""


def downsample(spark: SparkSession, d: str) -> DataFrame:
    """Every k-th event with k = n // 500, and the last."""
    e = load(spark, d, "events", "event_id", "value")
    return rounded(ordered.every_kth(e, F.col("event_id"), [], 500).select("row_index", "event_id", "value"))


DOWNSAMPLE = """
WITH s AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS row_index, count(*) OVER () AS n FROM events)
SELECT row_index, event_id, round(value, 6) AS value FROM s WHERE row_index % greatest(1, n // 500) = 0 OR row_index = n - 1
"""


def stitch(spark: SparkSession, d: str) -> DataFrame:
    """Slices of users stitched: offset of rounds and balance where each begins."""
    e = load(spark, d, "events", "user_id", "value")
    slices = e.groupBy(F.floor(F.col("user_id") / 10).alias("slice")).agg(
        F.count(F.lit(1)).alias("rounds"), F.sum(F.ln(_growth())).alias("log_growth")
    )
    out = trajectory.stitched(slices, "slice", "rounds", "log_growth", START)
    return rounded(out.select("slice", "rounds", "round_offset", "balance_start"))


STITCH = f"""
WITH s AS (SELECT floor(user_id / 10)::BIGINT AS slice, count(*)::BIGINT AS rounds, sum({_GROWTH}) AS g FROM events GROUP BY 1)
SELECT slice, rounds, (coalesce(sum(rounds) OVER w, 0))::BIGINT AS round_offset, round(100 * exp(coalesce(sum(g) OVER w, 0)), 6) AS balance_start
FROM s WINDOW w AS (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""


def true_count_path(spark: SparkSession, d: str) -> DataFrame:
    """Running and true count and what is left of the shoe, after each card dealt to a user
    (an event's id gives the card)."""
    from ..functions.cards import true_count

    e = load(spark, d, "events", "event_id", "user_id").withColumn("card", (F.col("event_id") % 13 + 1).cast("int"))
    e = e.withColumn("card", F.least("card", F.lit(10)))
    out = trajectory.running_counts(e, F.col("event_id"), [], F.col("card"), ["user_id"])
    left = F.when(F.col("seen") < 312, true_count(F.col("running_count"), F.col("seen")))  # none without a card left
    return out.select(
        "event_id", "running_count", "seen", left.alias("true_count"), F.array_join(F.transform("remaining", lambda x: x.cast("string")), ",").alias("remaining")
    )


_SEEN = ", ".join(f"{24 if v < 10 else 96} - count(*) FILTER (WHERE card = {v}) OVER w" for v in range(1, 11))
TRUE_COUNT_PATH = f"""
WITH e AS (SELECT event_id, user_id, least(event_id % 13 + 1, 10) AS card FROM events),
s AS (SELECT event_id, (sum(CASE WHEN card BETWEEN 2 AND 6 THEN 1 WHEN card IN (1, 10) THEN -1 ELSE 0 END) OVER w)::BIGINT AS rc, count(*) OVER w AS seen,
  array_to_string([{_SEEN}], ',') AS remaining FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, rc AS running_count, seen, CASE WHEN seen < 312 THEN floor(rc / ((312 - seen) / 52))::BIGINT END AS true_count, remaining FROM s
"""

QUERIES = {
    "q_running_balance": (running_balance, RUNNING_BALANCE),
    "q_lag_balance": (lag_balance, LAG_BALANCE),
    "q_round_index": (round_index, ROUND_INDEX),
    "q_slice_contiguity": (slice_contiguity, SLICE_CONTIGUITY),
    "q_downsample": (downsample, DOWNSAMPLE),
    "q_stitch": (stitch, STITCH),
    "q_true_count_path": (true_count_path, TRUE_COUNT_PATH),
}
