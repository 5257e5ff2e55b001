"""Scoring, sampling and subset queries over the data tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import evaluation, sampling
from ..operators.ordered import numbered
from ..sources.tables import load
from .statistics import r, rounded


def pk_join_regret(spark: SparkSession, d: str) -> DataFrame:
    """Lines (predictions) against parts (references), one for each key: the regret of the
    price class that a line's quantity picks, mean, 95th percentile and maximum."""
    parts = load(spark, d, "part", "p_partkey", "p_brand", "p_retailprice", "p_size")
    reference = parts.select(
        F.col("p_partkey").alias("l_partkey"),
        "p_brand",
        F.array(F.col("p_retailprice") / 100, F.col("p_size").cast("double"), F.lit(20.0)).alias("values"),
    )
    lines = load(spark, d, "lineitem", "l_partkey", "l_quantity")
    scored = evaluation.referenced(lines, reference, "l_partkey")
    chosen = (F.col("l_quantity").cast("int") % 3).cast("int")
    return rounded(evaluation.regret_summary(scored.select("p_brand", evaluation.regret(F.col("values"), chosen).alias("regret")), "regret", "p_brand"))


PK_JOIN_REGRET = """
WITH s AS (SELECT p_brand, greatest(p_retailprice / 100, p_size::DOUBLE, 20) - CASE l_quantity::INTEGER % 3 WHEN 0 THEN p_retailprice / 100 WHEN 1 THEN p_size::DOUBLE ELSE 20 END AS x
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT p_brand, count(*)::BIGINT AS rows, round(avg(x), 6) AS mean, round(quantile_disc(x, 0.95), 6) AS p95, round(max(x), 6) AS maximum FROM s GROUP BY 1
"""


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    """Three policies' choices on each line: model, control and target."""
    lines = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    q = F.col("l_quantity").cast("int")
    return lines.select(
        F.col("l_returnflag").alias("kind"),
        F.col("l_linestatus").alias("target"),
        F.when(q % 7 < 5, F.col("l_linestatus")).otherwise("F").alias("model"),
        F.when(q % 5 < 3, F.col("l_linestatus")).otherwise("O").alias("control"),
        F.col("l_discount").alias("loss"),
    )


_DECISIONS_SQL = """WITH x AS (SELECT l_returnflag AS kind, l_linestatus AS target, CASE WHEN l_quantity::INTEGER % 7 < 5 THEN l_linestatus ELSE 'F' END AS model,
  CASE WHEN l_quantity::INTEGER % 5 < 3 THEN l_linestatus ELSE 'O' END AS control, l_discount AS loss FROM lineitem)"""


def accuracy_groupings(spark: SparkSession, d: str) -> DataFrame:
    rows = _decisions(spark, d)
    out = evaluation.accuracies(rows, "kind", "target", F.col("model") == F.col("target"), F.col("loss"))
    return out.select("level", "kind", "target", "rows", F.col("hits").cast("long").alias("hits"), r("accuracy").alias("accuracy"), r("loss", 9).alias("loss"))


ACCURACY_GROUPINGS = f"""
{_DECISIONS_SQL}
SELECT grouping(kind, target)::BIGINT AS level, kind, target, count(*)::BIGINT AS rows, sum((model = target)::INTEGER)::BIGINT AS hits,
  round(avg((model = target)::INTEGER), 6) AS accuracy, round(avg(loss), 9) AS loss FROM x GROUP BY GROUPING SETS ((), (kind), (target))
"""


def agreement_deviation(spark: SparkSession, d: str) -> DataFrame:
    rows = _decisions(spark, d)
    return rounded(rows.groupBy("kind").agg(*evaluation.agreement(F.col("model"), F.col("control"), F.col("target"))))


AGREEMENT_DEVIATION = f"""
{_DECISIONS_SQL}
SELECT kind, (count(*) FILTER (WHERE model = control))::BIGINT AS agreements, (count(*) FILTER (WHERE model <> control))::BIGINT AS deviations,
  round(count(*) FILTER (WHERE model = control) / count(*), 6) AS agreement,
  round(count(*) FILTER (WHERE model = control AND model = target) / nullif(count(*) FILTER (WHERE model = control), 0), 6) AS accuracy_agreeing,
  round(count(*) FILTER (WHERE model <> control AND model = target) / nullif(count(*) FILTER (WHERE model <> control), 0), 6) AS model_accuracy_deviating,
  round(count(*) FILTER (WHERE model <> control AND control = target) / nullif(count(*) FILTER (WHERE model <> control), 0), 6) AS control_accuracy_deviating
FROM x GROUP BY 1
"""


def frequency_baseline(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events", "event_type")
    extra = spark.createDataFrame([("never",)], "event_type string")
    vocabulary = e.select("event_type").distinct().unionByName(extra)
    return rounded(sampling.frequency_scores(e, vocabulary, "event_type"))


FREQUENCY_BASELINE = """
WITH c AS (SELECT event_type, count(*) AS c FROM events GROUP BY 1)
SELECT event_type, round(ln(c), 6) AS score FROM c UNION ALL SELECT 'never', 0
"""


def sampling_weights(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "lineitem", "l_returnflag")
    out = sampling.balanced_weights(e, "l_returnflag", 1.3)
    return rounded(out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.max("weight").alias("weight")))


SAMPLING_WEIGHTS = """
WITH c AS (SELECT l_returnflag, count(*)::BIGINT AS c FROM lineitem GROUP BY 1)
SELECT l_returnflag, c AS rows, round(least(sqrt((SELECT max(c) FROM c) / c), 1.3), 6) AS weight FROM c
"""


def weighted_draw(spark: SparkSession, d: str) -> DataFrame:
    """1,000 draws with replacement, orders by number of lines."""
    lines = load(spark, d, "lineitem", "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("w"))
    return sampling.weighted_draws(lines, "l_orderkey", "w", 1000, 7)


WEIGHTED_DRAW = """
WITH w AS (SELECT l_orderkey, count(*) AS w FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey, sum(w) OVER (ORDER BY l_orderkey) - w AS low, sum(w) OVER (ORDER BY l_orderkey) AS high FROM w),
p AS (SELECT range AS draw, ('0x' || substr(sha256('7|' || range), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (SELECT count(*) FROM lineitem) AS point FROM range(1000))
SELECT draw, l_orderkey FROM p JOIN s ON low <= point AND point < high
"""


def epoch_order(spark: SparkSession, d: str) -> DataFrame:
    """The place of each row in epoch 3: a seeded permutation, numbered without one task that
    sees all rows."""
    e = load(spark, d, "events", "event_id", "event_type")
    rows = numbered(sampling.epoch_order(e, 11, 3, "event_id"), F.col("u"), ["event_id"], "place")
    return rows.select("event_id", "event_type", r("u", 9).alias("u"), "place")


EPOCH_ORDER = """
SELECT event_id, event_type, round(('0x' || substr(sha256('14|' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE, 9) AS u,
  row_number() OVER (ORDER BY ('0x' || substr(sha256('14|' || event_id), 1, 8))::BIGINT, event_id) - 1 AS place FROM events
"""


def prefix_subset(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders", "o_custkey", "o_totalprice")
    parts = []
    for k in (50, 100, 150):
        s = sampling.prefix(o, "o_custkey", k)
        parts.append(s.agg(F.lit(k).alias("prefix"), F.count(F.lit(1)).alias("rows"), F.countDistinct("o_custkey").alias("groups"), r(F.sum("o_totalprice"), 2).alias("total")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


PREFIX_SUBSET = " UNION ALL ".join(
    f"SELECT {k} AS prefix, count(*)::BIGINT AS rows, count(DISTINCT o_custkey)::BIGINT AS groups, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey < {k}"
    for k in (50, 100, 150)
)


def shard_modulo(spark: SparkSession, d: str) -> DataFrame:
    """All shards, and that they add up to the whole."""
    o = load(spark, d, "orders", "o_orderkey")
    parts = [sampling.shard(o, "o_orderkey", i, 4).select(F.lit(i).alias("shard"), "o_orderkey") for i in range(4)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


SHARD_MODULO = """
SELECT (o_orderkey % 4)::INTEGER AS shard, count(*)::BIGINT AS rows, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1
"""


def exploration(spark: SparkSession, d: str) -> DataFrame:
    """Behaviour that leaves the best action one time in five, where there is another."""
    e = load(spark, d, "events", "event_id", "event_type")
    legal = F.when(F.col("event_id") % 4 == 0, F.array(F.col("event_type"))).otherwise(
        F.array_distinct(F.array(F.col("event_type"), F.lit("hit"), F.lit("stand")))
    )
    out = e.withColumn("behavior", sampling.explored(legal, F.col("event_type"), 0.2, hashing.text_key(F.lit("explore"), "event_id")))
    return out.groupBy("event_type", "behavior").agg(F.count(F.lit(1)).alias("rows"))


_U = "('0x' || substr(sha256({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
EXPLORATION = f"""
SELECT event_type, CASE WHEN event_id % 4 <> 0 AND {_U.format("'explore|' || event_id")} < 0.2
  THEN ['hit', 'stand'][(floor({_U.format("'explore|' || event_id || '|pick'")} * 2) + 1)::INTEGER] ELSE event_type END AS behavior, count(*)::BIGINT AS rows
FROM events GROUP BY 1, 2
"""


def masked_choice(spark: SparkSession, d: str) -> DataFrame:
    """The best legal id of five scores, its cross-entropy, and the first place of the best."""
    l = load(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_discount", "l_tax", "l_linenumber")
    scores = F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50, F.lit(0.5), F.lit(0.5))
    legal = F.when(F.col("l_linenumber") % 2 == 0, F.array(*[F.lit(i) for i in (0, 1, 3)])).otherwise(F.array(*[F.lit(i) for i in (4, 3, 2)]))
    rows = l.select(
        evaluation.masked_argmax(scores, legal).alias("choice"),
        evaluation.argmax(scores).alias("place"),
        evaluation.cross_entropy(scores, legal, F.element_at(legal, 1)).alias("loss"),
    )
    return rows.groupBy("choice", "place").agg(F.count(F.lit(1)).alias("rows"), r(F.avg("loss")).alias("loss"))


MASKED_CHOICE = """
WITH s AS (SELECT [l_discount * 10, l_tax * 10, l_quantity / 50, 0.5, 0.5] AS v, CASE WHEN l_linenumber % 2 = 0 THEN [0, 1, 3] ELSE [4, 3, 2] END AS g FROM lineitem),
t AS (SELECT v, g, [v[g[1] + 1], v[g[2] + 1], v[g[3] + 1]] AS o FROM s)
SELECT g[list_position(o, list_max(o))] AS choice, list_position(v, list_max(v)) - 1 AS place, count(*)::BIGINT AS rows,
  round(avg(ln(exp(o[1]) + exp(o[2]) + exp(o[3])) - o[1]), 6) AS loss FROM t GROUP BY 1, 2
"""


def permutation_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Original against permuted sequences by key: the same multiset, and how many moved."""
    c = load(spark, d, "conversations", "conv_id", "turn", "role")
    seq = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("s")).select("conv_id", F.col("s.role").alias("a"))
    out = seq.withColumn("b", sampling.permuted(F.col("a"), F.col("conv_id").cast("string")))
    return out.select(
        "conv_id",
        (F.array_sort("a") == F.array_sort("b")).alias("same_items"),
        F.array_join("b", ",").alias("permuted"),
        (F.col("a") != F.col("b")).alias("moved"),
    )


PERMUTATION_CONSISTENCY = """
WITH s AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS i FROM conversations),
p AS (SELECT conv_id, string_agg(role, ',' ORDER BY i) AS a, string_agg(role, ',' ORDER BY sha256(conv_id || '|' || i)) AS b FROM s GROUP BY 1)
SELECT conv_id, true AS same_items, b AS permuted, a <> b AS moved FROM p
"""


def pair_identity(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a copy that differ from the original in some column, nulls being equal."""
    a = load(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    status = F.when(F.col("o_orderkey") % 97 == 0, None).otherwise(F.col("o_orderstatus"))
    b = a.where("o_orderkey % 89 <> 0").withColumn("o_orderstatus", status)
    return evaluation.mismatches(a, b, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


PAIR_IDENTITY = "SELECT o_orderkey FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0"

QUERIES = {
    "q_pk_join_regret": (pk_join_regret, PK_JOIN_REGRET),
    "q_accuracy_groupings": (accuracy_groupings, ACCURACY_GROUPINGS),
    "q_agreement_deviation": (agreement_deviation, AGREEMENT_DEVIATION),
    "q_frequency_baseline": (frequency_baseline, FREQUENCY_BASELINE),
    "q_sampling_weights": (sampling_weights, SAMPLING_WEIGHTS),
    "q_weighted_draw": (weighted_draw, WEIGHTED_DRAW),
    "q_epoch_order": (epoch_order, EPOCH_ORDER),
    "q_prefix_subset": (prefix_subset, PREFIX_SUBSET),
    "q_shard_modulo": (shard_modulo, SHARD_MODULO),
    "q_exploration": (exploration, EXPLORATION),
    "q_masked_choice": (masked_choice, MASKED_CHOICE),
    "q_permutation_consistency": (permutation_consistency, PERMUTATION_CONSISTENCY),
    "q_pair_identity": (pair_identity, PAIR_IDENTITY),
}
