"""Estimates, summaries, paired experiments and pooling over the data tables.

A group (user, order, supplier) stands for the sampling unit, an event's centred value for
a profit. Doubles are rounded to a fixed number of places, as sums differ in their last
bits with the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cards, hashing, stats
from ..operators import evaluation
from ..sources.tables import load

PLACES = 6


def r(c: Column | str, places: int = PLACES) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """All double columns rounded; the others as they are."""
    return df.select(*[r(n).alias(n) if t == "double" and n not in keep else F.col(n) for n, t in df.dtypes])


def two_level_ci(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events", "event_type", "user_id", "value")
    return rounded(stats.two_level(events, "user_id", F.col("value"), "event_type"))


TWO_LEVEL_CI = """
WITH m AS (SELECT event_type, user_id, avg(value) AS m, count(*) AS c FROM events GROUP BY ALL),
e AS (SELECT event_type, avg(m) AS mean, coalesce(stddev_samp(m) / sqrt(count(*)), 0) AS se, count(*)::BIGINT AS n, sum(c)::BIGINT AS c FROM m GROUP BY ALL)
SELECT event_type, round(mean, 6) AS mean, round(se, 6) AS standard_error, n AS sample_count,
  round(mean - 1.96 * se, 6) AS ci_low, round(mean + 1.96 * se, 6) AS ci_high, c AS row_count FROM e
"""


def _summary(spark: SparkSession, d: str, rule: str) -> DataFrame:
    orders = load(spark, d, "orders", "o_orderpriority", "o_totalprice")
    out = stats.numeric_summary(orders, "o_totalprice", "o_orderpriority", rule=rule)
    return out.select(*[r(c, 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def numeric_summary_a(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d, "truncated")


def numeric_summary_b(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d, "ceiling")


def _summary_sql(rank: str) -> str:
    return f"""
WITH l AS (SELECT o_orderpriority, count(*)::BIGINT AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_totalprice) AS av,
  list_sort(list(o_totalprice)) AS s FROM orders GROUP BY 1)
SELECT o_orderpriority, n AS count, round(lo, 4) AS minimum, round(av, 4) AS mean, round(s[n // 2 + 1], 4) AS median,
  round(s[{rank}], 4) AS p95, round(hi, 4) AS maximum FROM l
"""


NUMERIC_SUMMARY_A = _summary_sql("least(floor(n * 0.95::DOUBLE)::BIGINT, n - 1) + 1")
NUMERIC_SUMMARY_B = _summary_sql("greatest(ceil(n * 0.95::DOUBLE)::BIGINT - 1, 0) + 1")


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem", "l_returnflag", "l_suppkey", "l_quantity")
    return lines.groupBy("l_returnflag", "l_suppkey").agg(*stats.estimate("l_quantity"))


def pooled_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Partial estimates by supplier pooled by flag: the same as the estimate of all rows."""
    return rounded(stats.pooled(_suppliers(spark, d), "l_returnflag"))


POOLED_ESTIMATE = """
WITH e AS (SELECT l_returnflag, avg(l_quantity) AS mean, coalesce(stddev_samp(l_quantity) / sqrt(count(*)), 0) AS se, count(*)::BIGINT AS n FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(mean, 6) AS mean, round(se, 6) AS standard_error, n AS sample_count,
  round(mean - 1.96 * se, 6) AS ci_low, round(mean + 1.96 * se, 6) AS ci_high FROM e
"""


def scaled_estimate(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem", "l_returnflag", "l_quantity")
    e = lines.groupBy("l_returnflag").agg(*stats.estimate("l_quantity"))
    return rounded(e.select("l_returnflag", *stats.scaled(F.col("mean"), F.col("standard_error"), -100.0)))


SCALED_ESTIMATE = """
WITH e AS (SELECT l_returnflag, -100 * avg(l_quantity) AS mean, 100 * coalesce(stddev_samp(l_quantity) / sqrt(count(*)), 0) AS se FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(mean, 6) AS mean, round(se, 6) AS standard_error, round(mean - 1.96 * se, 6) AS ci_low, round(mean + 1.96 * se, 6) AS ci_high FROM e
"""


def pooled_bins(spark: SparkSession, d: str) -> DataFrame:
    """Pooling by three keys: category, policy and bin."""
    lines = load(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_suppkey", "l_discount")
    bins = F.when(F.col("l_discount") < 0.03, "low").when(F.col("l_discount") < 0.07, "middle").otherwise("high")
    parts = lines.groupBy("l_returnflag", "l_linestatus", bins.alias("bin"), "l_suppkey").agg(*stats.estimate("l_quantity"))
    return rounded(stats.pooled(parts, "l_returnflag", "l_linestatus", "bin"))


POOLED_BINS = """
WITH e AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_discount < 0.03 THEN 'low' WHEN l_discount < 0.07 THEN 'middle' ELSE 'high' END AS bin,
  avg(l_quantity) AS mean, coalesce(stddev_samp(l_quantity) / sqrt(count(*)), 0) AS se, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, bin, round(mean, 6) AS mean, round(se, 6) AS standard_error, n AS sample_count,
  round(mean - 1.96 * se, 6) AS ci_low, round(mean + 1.96 * se, 6) AS ci_high FROM e
"""


def histogram_se(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events", "event_type", "value")
    half = events.withColumn("half_units", F.round(F.col("value") / 50).cast("int"))
    return rounded(stats.histogram_estimate(half, "half_units", "event_type"))


HISTOGRAM_SE = """
WITH h AS (SELECT event_type, round(value / 50)::INTEGER AS x FROM events),
s AS (SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT x)::BIGINT AS k, sum(x)::DOUBLE AS s, sum(x * x)::DOUBLE AS q FROM h GROUP BY 1)
SELECT event_type, n AS rollouts, k AS outcomes, round(s / n, 6) AS mean, round(sqrt(greatest(q / n - (s / n) * (s / n), 0) / n), 6) AS standard_error FROM s
"""


def _policy_growth(spark: SparkSession, d: str) -> DataFrame:
    """Log growth by user under two bet policies: a fixed fraction, and by event type."""
    events = load(spark, d, "events", "user_id", "event_type", "value")
    profit = (F.col("value") - 100) / 1000
    flexible = F.when(F.col("event_type") == "purchase", 0.05).otherwise(0.001)
    return events.groupBy("user_id").agg(
        F.sum(F.ln(1 + 0.01 * profit)).alias("fixed"), F.sum(F.ln(1 + flexible * profit)).alias("flexible")
    )


def log_growth_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_policy_growth(spark, d))


LOG_GROWTH_BY_GROUP = """
SELECT user_id, round(sum(ln(1 + 0.01 * ((value - 100) / 1000))), 6) AS fixed,
  round(sum(ln(1 + CASE WHEN event_type = 'purchase' THEN 0.05 ELSE 0.001 END * ((value - 100) / 1000))), 6) AS flexible
FROM events GROUP BY 1
"""


def paired_advantage(spark: SparkSession, d: str) -> DataFrame:
    g = _policy_growth(spark, d)
    left, right = g.select("user_id", F.col("flexible").alias("v")), g.select("user_id", F.col("fixed").alias("v"))
    out = evaluation.paired(left, right, "user_id", "v")
    return out.select(*[r(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


PAIRED_ADVANTAGE = """
WITH g AS (SELECT user_id, sum(ln(1 + CASE WHEN event_type = 'purchase' THEN 0.05 ELSE 0.001 END * ((value - 100) / 1000))) - sum(ln(1 + 0.01 * ((value - 100) / 1000))) AS x FROM events GROUP BY 1),
e AS (SELECT avg(x) AS m, coalesce(stddev_samp(x) / sqrt(count(*)), 0) AS s, count(*)::BIGINT AS n FROM g)
SELECT round(m, 9) AS mean, round(s, 9) AS standard_error, n AS sample_count, round(m - 1.96 * s, 9) AS ci_low, round(m + 1.96 * s, 9) AS ci_high,
  CASE WHEN m - 1.96 * s > 0 THEN 'left' WHEN m + 1.96 * s < 0 THEN 'right' ELSE 'inconclusive' END AS verdict FROM e
"""


def _binned(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events", "event_id", "user_id", "event_type", "value")
    share = 0.35 + (F.col("event_id") % 70) / 1000
    return e.select(
        "event_type",
        "user_id",
        "value",
        cards.penetration_bin((F.col("event_id") % 100) / 100).alias("penetration"),
        cards.true_count_bin((F.col("event_id") % 13) - 6).alias("true_count"),
        cards.high_share_bin(share).alias("high_share"),
    )


def bins_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Three binnings by policy: clustered by user, so the sample is the users of a bin."""
    rows = _binned(spark, d).select(
        F.col("event_type").alias("policy"),
        "user_id",
        "value",
        F.explode(F.map_from_arrays(F.array(F.lit("penetration"), F.lit("true_count"), F.lit("high_share")), F.array("penetration", "true_count", "high_share"))).alias("category", "bin"),
    )
    return rounded(stats.two_level(rows, "user_id", F.col("value"), "category", "policy", "bin"))


BINS_BREAKDOWN = """
WITH b AS (SELECT event_type AS policy, user_id, value, (event_id % 100) / 100.0::DOUBLE AS p, (event_id % 13) - 6 AS c, 0.35::DOUBLE + (event_id % 70) / 1000.0::DOUBLE AS h FROM events),
u AS (
  SELECT 'penetration' AS category, policy, user_id, value, CASE WHEN p < 0.2 THEN '0%-20%' WHEN p < 0.4 THEN '20%-40%' WHEN p < 0.6 THEN '40%-60%' ELSE '60%-80%' END AS bin FROM b
  UNION ALL SELECT 'true_count', policy, user_id, value, CASE WHEN c <= -3 THEN '<=-3' WHEN c <= -1 THEN '-2 to -1' WHEN c <= 1 THEN '0 to 1' WHEN c <= 3 THEN '2 to 3' ELSE '>=4' END FROM b
  UNION ALL SELECT 'high_share', policy, user_id, value, CASE WHEN h < 0.37::DOUBLE THEN '<37%' WHEN h < 0.385::DOUBLE THEN '37%-38.5%' WHEN h < 0.40::DOUBLE THEN '38.5%-40%' ELSE '>=40%' END FROM b),
m AS (SELECT category, policy, bin, user_id, avg(value) AS m, count(*) AS c FROM u GROUP BY ALL),
e AS (SELECT category, policy, bin, avg(m) AS mean, coalesce(stddev_samp(m) / sqrt(count(*)), 0) AS se, count(*)::BIGINT AS n, sum(c)::BIGINT AS c FROM m GROUP BY ALL)
SELECT category, policy, bin, round(mean, 6) AS mean, round(se, 6) AS standard_error, n AS sample_count,
  round(mean - 1.96 * se, 6) AS ci_low, round(mean + 1.96 * se, 6) AS ci_high, c AS row_count FROM e
"""


def context_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Sums and maxima over slices, and how many slices tell nothing (nulls)."""
    rows = load(spark, d, "lineitem", "l_suppkey", "l_quantity", "l_returnflag")
    slices = rows.groupBy("l_suppkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("long"))).alias("dropped"),
        F.max(F.when(F.col("l_suppkey") % 3 > 0, F.col("l_quantity").cast("long"))).alias("longest"),
    )
    return slices.agg(
        F.sum("dropped").alias("dropped"),
        F.max("longest").alias("longest"),
        F.count_if(F.col("longest").isNull()).alias("slices_without"),
        F.count(F.lit(1)).alias("slices"),
    )


CONTEXT_STATISTICS = """
WITH s AS (SELECT l_suppkey, sum(l_quantity::BIGINT) FILTER (WHERE l_returnflag = 'R') AS dropped, max(l_quantity::BIGINT) FILTER (WHERE l_suppkey % 3 > 0) AS longest FROM lineitem GROUP BY 1)
SELECT sum(dropped)::BIGINT AS dropped, max(longest) AS longest, (count(*) FILTER (WHERE longest IS NULL))::BIGINT AS slices_without, count(*)::BIGINT AS slices FROM s
"""


def weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    """Mean of batch means, weighted by batch size."""
    rows = load(spark, d, "lineitem", "l_returnflag", "l_orderkey", "l_discount")
    batches = rows.groupBy("l_returnflag", (F.col("l_orderkey") % 64).alias("batch")).agg(
        F.avg("l_discount").alias("loss"), F.count(F.lit(1)).alias("size")
    )
    return rounded(batches.groupBy("l_returnflag").agg(stats.weighted_mean(F.col("loss"), F.col("size")).alias("loss"), F.sum("size").alias("rows")))


WEIGHTED_LOSS = """
SELECT l_returnflag, round(avg(l_discount), 6) AS loss, count(*)::BIGINT AS rows FROM lineitem GROUP BY 1
"""


def throughput(spark: SparkSession, d: str) -> DataFrame:
    """Rows by worker and the spread over workers, as a generation benchmark reports it."""
    e = load(spark, d, "events", "event_id", "value")
    w = e.groupBy(hashing.bucket(F.col("event_id").cast("string"), 8).alias("worker")).agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("seconds"))
    return rounded(w.select("worker", "rows", (F.col("rows") / F.col("seconds")).alias("rows_per_second")))


THROUGHPUT = """
SELECT ('0x' || substr(sha256(event_id::VARCHAR), 1, 8))::BIGINT % 8 AS worker, count(*)::BIGINT AS rows, round(count(*) / sum(value), 6) AS rows_per_second FROM events GROUP BY 1
"""

QUERIES = {
    "q_two_level_ci": (two_level_ci, TWO_LEVEL_CI),
    "q_numeric_summary_a": (numeric_summary_a, NUMERIC_SUMMARY_A),
    "q_numeric_summary_b": (numeric_summary_b, NUMERIC_SUMMARY_B),
    "q_pooled_estimate": (pooled_estimate, POOLED_ESTIMATE),
    "q_scaled_estimate": (scaled_estimate, SCALED_ESTIMATE),
    "q_pooled_bins": (pooled_bins, POOLED_BINS),
    "q_histogram_se": (histogram_se, HISTOGRAM_SE),
    "q_log_growth_by_group": (log_growth_by_group, LOG_GROWTH_BY_GROUP),
    "q_paired_advantage": (paired_advantage, PAIRED_ADVANTAGE),
    "q_bins_breakdown": (bins_breakdown, BINS_BREAKDOWN),
    "q_context_statistics": (context_statistics, CONTEXT_STATISTICS),
    "q_weighted_loss": (weighted_loss, WEIGHTED_LOSS),
    "q_throughput": (throughput, THROUGHPUT),
}
