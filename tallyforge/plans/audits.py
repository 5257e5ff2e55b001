"""Audits of decision logs over the data tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import audit
from ..sources.tables import load
from .statistics import r, rounded

_SPLIT_SQL = """CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END"""


def split_assign(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders go to one split."""
    orders = load(spark, d, "orders", "o_custkey")
    return orders.groupBy(hashing.split_of(hashing.text_key(F.lit("split"), "o_custkey")).alias("split")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("o_custkey").alias("groups")
    )


SPLIT_ASSIGN = f"""
WITH o AS (SELECT o_custkey, ('0x' || substr(sha256('split|' || o_custkey), 1, 8))::BIGINT % 100 AS b FROM orders)
SELECT {_SPLIT_SQL} AS split, count(*)::BIGINT AS rows, count(DISTINCT o_custkey)::BIGINT AS groups FROM o GROUP BY 1
"""


def split_isolation(spark: SparkSession, d: str) -> DataFrame:
    """A split by row leaks orders; one by order doesn't."""
    lines = load(spark, d, "lineitem", "l_orderkey", "l_linenumber")
    by_row = lines.withColumn("split", hashing.split_of(hashing.text_key("l_orderkey", "l_linenumber")))
    by_group = lines.withColumn("split", hashing.split_of(hashing.text_key("l_orderkey")))
    parts = [
        audit.leaks(t, "l_orderkey").agg(F.count(F.lit(1)).alias("leaking_groups")).select(F.lit(n).alias("split_by"), "leaking_groups")
        for n, t in (("row", by_row), ("group", by_group))
    ]
    return parts[0].unionByName(parts[1])


SPLIT_ISOLATION = f"""
WITH l AS (SELECT l_orderkey, ('0x' || substr(sha256(l_orderkey || '|' || l_linenumber), 1, 8))::BIGINT % 100 AS b, ('0x' || substr(sha256(l_orderkey::VARCHAR), 1, 8))::BIGINT % 100 AS g FROM lineitem),
s AS (SELECT l_orderkey, {_SPLIT_SQL} AS by_row, {_SPLIT_SQL.replace('b <', 'g <')} AS by_group FROM l)
SELECT 'row' AS split_by, count(*)::BIGINT AS leaking_groups FROM (SELECT l_orderkey FROM s GROUP BY 1 HAVING count(DISTINCT by_row) > 1)
UNION ALL SELECT 'group', count(*)::BIGINT FROM (SELECT l_orderkey FROM s GROUP BY 1 HAVING count(DISTINCT by_group) > 1)
"""


def contiguity(spark: SparkSession, d: str) -> DataFrame:
    """Conversations whose turns aren't 0..n-1 (every seventh has its first turn taken off)."""
    turns = load(spark, d, "conversations", "conv_id", "turn").where("NOT (conv_id % 7 = 0 AND turn = 0)")
    return audit.gaps(turns, "conv_id", "turn")


CONTIGUITY = """
SELECT conv_id, count(*)::BIGINT AS n, min(turn) AS least, max(turn) AS most, count(DISTINCT turn)::BIGINT AS different
FROM conversations WHERE NOT (conv_id % 7 = 0 AND turn = 0) GROUP BY 1
HAVING min(turn) <> 0 OR max(turn) <> count(*) - 1 OR count(DISTINCT turn) <> count(*)
"""


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return audit.duplicates(load(spark, d, "lineitem", "l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


DUPLICATE_KEYS = """
SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
"""


def kind_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Rows by kind, rows where behaviour differs from the target, and value summaries."""
    from ..functions.stats import numeric_summary

    e = load(spark, d, "events", "event_id", "event_type", "value")
    explored = hashing.bucket(F.concat(F.lit("explore|"), F.col("event_id")), 5) == 0
    counts = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.count_if(explored).alias("exploratory"))
    return rounded(counts.join(numeric_summary(e, "value", "event_type").drop("count"), "event_type"))


KIND_COVERAGE = """
WITH k AS (SELECT event_type, count(*)::BIGINT AS n, (count(*) FILTER (WHERE ('0x' || substr(sha256('explore|' || event_id), 1, 8))::BIGINT % 5 = 0))::BIGINT AS x,
  avg(value) AS av, list_sort(list(value)) AS s FROM events GROUP BY 1)
SELECT event_type, n AS rows, x AS exploratory, round(s[1], 6) AS minimum, round(av, 6) AS mean, round(s[n // 2 + 1], 6) AS median,
  round(s[least(floor(n * 0.95::DOUBLE)::BIGINT, n - 1) + 1], 6) AS p95, round(s[n], 6) AS maximum FROM k
"""


def target_coverage_pivot(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem", "l_orderkey", "l_returnflag")
    lines = lines.withColumn("split", hashing.split_of(hashing.text_key("l_orderkey")))
    return audit.coverage(lines, "l_returnflag", "split", ["train", "validation", "test"], "l_orderkey")


TARGET_COVERAGE_PIVOT = f"""
WITH l AS (SELECT l_returnflag, l_orderkey, ('0x' || substr(sha256(l_orderkey::VARCHAR), 1, 8))::BIGINT % 100 AS b FROM lineitem),
s AS (SELECT *, {_SPLIT_SQL} AS split FROM l)
SELECT l_returnflag, (count(*) FILTER (WHERE split = 'train'))::BIGINT AS train, (count(*) FILTER (WHERE split = 'validation'))::BIGINT AS validation,
  (count(*) FILTER (WHERE split = 'test'))::BIGINT AS test, count(*)::BIGINT AS rows, count(DISTINCT l_orderkey)::BIGINT AS groups FROM s GROUP BY 1
"""

_EXPECTED = {"A": ["F"], "N": ["F", "O"], "R": ["F"], "X": ["O"]}


def method_set(spark: SparkSession, d: str) -> DataFrame:
    """Line status by return flag against what is expected; X is expected and absent."""
    found = audit.value_sets(load(spark, d, "lineitem", "l_returnflag", "l_linestatus"), "l_returnflag", "l_linestatus", _EXPECTED)
    return found.select(
        "l_returnflag", F.coalesce(F.array_join("found", ","), F.lit("")).alias("found"), F.coalesce(F.array_join("expected", ","), F.lit("")).alias("expected"), "holds"
    )


METHOD_SET = """
WITH h AS (SELECT l_returnflag, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS found FROM lineitem GROUP BY 1),
w AS (SELECT * FROM (VALUES ('A', 'F'), ('N', 'F,O'), ('R', 'F'), ('X', 'O')) t(l_returnflag, expected))
SELECT l_returnflag, coalesce(found, '') AS found, coalesce(expected, '') AS expected, coalesce(found = expected, false) AS holds FROM h FULL JOIN w USING (l_returnflag)
"""

_VALUES = ("l_discount", "l_tax", "l_quantity")


def _margins(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem", "l_returnflag", *_VALUES)
    values = F.array("l_discount", "l_tax", F.col("l_quantity") / 1000)
    return lines.select("l_returnflag", F.round(audit.margin(values), 9).alias("margin"))


def margin_top2(spark: SparkSession, d: str) -> DataFrame:
    return _margins(spark, d).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"), r(F.avg("margin")).alias("mean_margin"), F.min("margin").alias("least"), F.max("margin").alias("most")
    )


_MARGIN_SQL = """WITH v AS (SELECT l_returnflag, list_reverse_sort([l_discount, l_tax, l_quantity / 1000]) AS s FROM lineitem),
m AS (SELECT l_returnflag, round(s[1] - s[2], 9) AS margin FROM v)"""
MARGIN_TOP2 = f"""
{_MARGIN_SQL}
SELECT l_returnflag, count(*)::BIGINT AS rows, round(avg(margin), 6) AS mean_margin, min(margin) AS least, max(margin) AS most FROM m GROUP BY 1
"""


def margin_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a margin strictly below each threshold."""
    return _margins(spark, d).groupBy("l_returnflag").agg(
        *[F.count_if(F.col("margin") < t).alias(f"below_{str(t).replace('.', '_')}") for t in (0.001, 0.005, 0.01)]
    )


MARGIN_THRESHOLDS = f"""
{_MARGIN_SQL}
SELECT l_returnflag, (count(*) FILTER (WHERE margin < 0.001))::BIGINT AS below_0_001, (count(*) FILTER (WHERE margin < 0.005))::BIGINT AS below_0_005,
  (count(*) FILTER (WHERE margin < 0.01))::BIGINT AS below_0_01 FROM m GROUP BY 1
"""


def missing_reference(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = load(spark, d, "documents", "doc_id", "source"), load(spark, d, "labels", "doc_id")
    return audit.missing(docs, labels, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("missing"))


MISSING_REFERENCE = """
SELECT source, count(*)::BIGINT AS missing FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1
"""


def key_set_equality(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders against customers in the table: both one-sided differences."""
    customers = load(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    orders = load(spark, d, "orders").where("o_custkey % 10 <> 3").select(F.col("o_custkey").alias("k")).distinct()
    return audit.key_sets_differ(customers, orders, "k")


KEY_SET_EQUALITY = """
WITH a AS (SELECT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey % 10 <> 3)
SELECT k, 'left' AS only_in FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)
"""


def vocabulary_missing(spark: SparkSession, d: str) -> DataFrame:
    """Roles that a fixed vocabulary hasn't, by conversation."""
    roles = load(spark, d, "conversations", "conv_id", "role").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    gone = F.array_sort(F.array_except("roles", F.array(F.lit("user"), F.lit("assistant"))))
    return roles.select("conv_id", F.array_join(gone, ",").alias("missing")).where("missing <> ''")


VOCABULARY_MISSING = """
SELECT conv_id, string_agg(role, ',' ORDER BY role) AS missing FROM (SELECT DISTINCT conv_id, role FROM conversations WHERE role NOT IN ('user', 'assistant')) GROUP BY 1
"""

QUERIES = {
    "q_split_assign": (split_assign, SPLIT_ASSIGN),
    "q_split_isolation": (split_isolation, SPLIT_ISOLATION),
    "q_contiguity": (contiguity, CONTIGUITY),
    "q_duplicate_keys": (duplicate_keys, DUPLICATE_KEYS),
    "q_kind_coverage": (kind_coverage, KIND_COVERAGE),
    "q_target_coverage_pivot": (target_coverage_pivot, TARGET_COVERAGE_PIVOT),
    "q_method_set": (method_set, METHOD_SET),
    "q_margin_top2": (margin_top2, MARGIN_TOP2),
    "q_margin_thresholds": (margin_thresholds, MARGIN_THRESHOLDS),
    "q_missing_reference": (missing_reference, MISSING_REFERENCE),
    "q_key_set_equality": (key_set_equality, KEY_SET_EQUALITY),
    "q_vocabulary_missing": (vocabulary_missing, VOCABULARY_MISSING),
}
