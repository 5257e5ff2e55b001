"""Decision logs written and read back, shards, manifests, reports and labels.

A user stands for a shoe, an event for a decision, a nation for an experiment's shard. What
is written goes to the shared folder, a new place each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cards, hashing, kelly, stats, text
from ..operators import evaluation, labels, runner, sampling
from ..sources import decisions, reports
from ..sources.tables import load, new_folder
from .statistics import r, rounded

_KINDS = ("bet", "insurance", "play")


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Decisions in the schema of ``sources.decisions``."""
    e = load(spark, d, "events", "event_id", "user_id", "event_type")
    e = e.withColumn("decision_index", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long"))
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("event_id") % 3 + 1).cast("int"))
    legal = F.array(F.lit("<A>"), F.lit("<B>"))

    def value(token: str, numerator):
        return F.struct(F.lit(token).alias("token"), F.struct(numerator.alias("numerator"), F.lit(10).cast("long").alias("denominator")).alias("expected_profit"))

    metadata = F.struct(
        F.array(*[F.lit(c).cast("long") for c in cards.SIX_DECKS]).alias("shoe_composition"),
        F.lit(1).cast("long").alias("unseen_unavailable"),
        F.concat(F.lit("exact-"), kind).alias("evaluation_method"),
        legal.alias("legal_target_tokens"),
        F.array(value("<A>", F.col("event_id") % 11 - 5), value("<B>", F.col("event_id") % 7 - 3)).alias("action_values"),
    )
    target = F.when(F.col("event_id") % 2 == 0, "<A>").otherwise("<B>")
    rows = e.select(
        F.lit(1).cast("long").alias("schema_version"),
        F.lit("events").alias("dataset_id"),
        F.col("user_id").alias("shoe_id"),
        (F.col("user_id") * 7919).cast("decimal(20,0)").alias("shoe_seed"),
        hashing.split_of(hashing.text_key("user_id")).alias("split"),
        F.floor(F.col("decision_index") / 4).alias("round_index"),
        "decision_index",
        kind.alias("kind"),
        F.array_repeat(F.col("event_type"), (F.col("event_id") % 4 + 1).cast("int")).alias("input_tokens"),
        target.alias("target_token"),
        F.when(F.col("event_id") % 7 == 0, "<A>").otherwise(target).alias("behavior_token"),
        F.from_json(F.to_json(metadata), decisions.schema()["metadata"].dataType).alias("metadata"),
    )
    return rows


_LOG = """d AS (SELECT event_id, user_id AS shoe_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS decision_index,
  CASE event_id % 3 WHEN 0 THEN 'bet' WHEN 1 THEN 'insurance' ELSE 'play' END AS kind, event_type, event_id % 4 + 1 AS tokens,
  CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split,
  CASE WHEN event_id % 2 = 0 THEN '<A>' ELSE '<B>' END AS target, CASE WHEN event_id % 7 = 0 OR event_id % 2 = 0 THEN '<A>' ELSE '<B>' END AS behavior,
  (event_id % 11 - 5) / 10 AS a, (event_id % 7 - 3) / 10 AS b_value
  FROM (SELECT *, ('0x' || substr(sha256(user_id::VARCHAR), 1, 8))::BIGINT % 100 AS b FROM events))"""


def log_scan(spark: SparkSession, d: str) -> DataFrame:
    """A log written as canonical JSON by split and read back, typed and checked."""
    folder = new_folder(spark, "log")
    decisions.write_split_files(_log(spark, d), folder)
    rows = decisions.read_decisions(spark, folder)
    values = F.transform("metadata.action_values", lambda a: F.round(decisions.fraction(a["expected_profit"]), 6))
    return rows.select(
        "shoe_id",
        F.col("shoe_seed").cast("string").alias("shoe_seed"),
        "decision_index",
        "round_index",
        "split",
        "kind",
        F.array_join("input_tokens", " ").alias("tokens"),
        "target_token",
        "behavior_token",
        F.array_join("metadata.legal_target_tokens", " ").alias("legal"),
        F.aggregate("metadata.shoe_composition", F.lit(0).cast("long"), lambda s, c: s + c).alias("cards"),
        F.element_at(values, 1).alias("value_a"),
        F.element_at(values, 2).alias("value_b"),
        F.col("metadata.monte_carlo").isNull().alias("exact"),
    )


LOG_SCAN = f"""WITH {_LOG}
SELECT shoe_id, (shoe_id * 7919)::VARCHAR AS shoe_seed, decision_index, decision_index // 4 AS round_index, split, kind,
  array_to_string(list_transform(range(tokens), lambda i: event_type), ' ') AS tokens, target AS target_token, behavior AS behavior_token,
  '<A> <B>' AS legal, 312::BIGINT AS cards, round(a, 6) AS value_a, round(b_value, 6) AS value_b, true AS exact FROM d
"""


def log_training_rows(spark: SparkSession, d: str) -> DataFrame:
    """What a model may see of the training split, read from that split's folder only."""
    folder = new_folder(spark, "log")
    decisions.write_decisions(_log(spark, d), folder)
    rows = decisions.training_rows(decisions.read_split(spark, folder, "train"))
    return rows.select(
        "shoe_id", "decision_index", "kind", F.size("input_tokens").alias("tokens"), "target_token", F.size("legal_tokens").alias("legal")
    )


LOG_TRAINING_ROWS = f"""WITH {_LOG}
SELECT shoe_id, decision_index, kind, tokens::INTEGER AS tokens, target AS target_token, 2::INTEGER AS legal FROM d WHERE split = 'train'
"""


def log_splits(spark: SparkSession, d: str) -> DataFrame:
    """Each split read by itself: rows, shoes, first and last decision."""
    folder = new_folder(spark, "log")
    decisions.write_decisions(_log(spark, d), folder)
    out = None
    for split in decisions.SPLITS:
        part = decisions.read_split(spark, folder, split).agg(
            F.lit(split).alias("split"), F.count(F.lit(1)).alias("rows"), F.countDistinct("shoe_id").alias("shoes"), F.max("decision_index").alias("last")
        )
        out = part if out is None else out.unionByName(part)
    return out


LOG_SPLITS = f"""WITH {_LOG}
SELECT s.split, count(shoe_id)::BIGINT AS rows, count(DISTINCT shoe_id)::BIGINT AS shoes, max(decision_index) AS last
FROM (VALUES ('train'), ('validation'), ('test')) s(split) LEFT JOIN d USING (split) GROUP BY 1
"""


def log_shards(spark: SparkSession, d: str) -> DataFrame:
    """A log made shard by shard: five of eight, then the rest, then assembled in order."""
    folder = new_folder(spark, "shards")
    log = _log(spark, d).drop("metadata", "input_tokens")
    shoes = load(spark, d, "events", "user_id").select(F.col("user_id").alias("shoe_id")).distinct()

    def make(units: DataFrame) -> DataFrame:
        return log.join(units, "shoe_id", "left_semi")

    first = runner.generate(spark, folder, shoes, make, {"log": "events"}, 8, limit=5)
    again = runner.generate(spark, folder, shoes, make, {"log": "events"}, 8)
    rows = runner.assemble(spark, folder, shoes, 8)
    return rows.select("shoe_id", "decision_index", "kind", "target_token", *[F.lit(x).alias(n) for n, x in (("first", first["written"]), ("resumed", again["resumed"]))])


LOG_SHARDS = f"""WITH {_LOG}
SELECT shoe_id, decision_index, kind, target AS target_token, 5::INTEGER AS first, 5::INTEGER AS resumed FROM d
"""


def quality_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Of the quality report: rows, explored ones and input lengths by kind."""
    return rounded(reports.quality(_log(spark, d))["kinds"])


QUALITY_KINDS = f"""WITH {_LOG}, l AS (SELECT kind, count(*) AS n, list_sort(list(tokens)) AS s, avg(tokens) AS av, count(*) FILTER (WHERE behavior <> target) AS x FROM d GROUP BY 1)
SELECT kind, n::BIGINT AS rows, x::BIGINT AS exploratory, s[1]::DOUBLE AS minimum, round(av, 6) AS mean, s[n // 2 + 1]::DOUBLE AS median,
  s[least(n - 1, floor(0.95::DOUBLE * n)::BIGINT) + 1]::DOUBLE AS p95, s[n]::DOUBLE AS maximum FROM l
"""


def quality_totals(spark: SparkSession, d: str) -> DataFrame:
    """Of the quality report: totals, margins and how many rows break a rule."""
    parts = reports.quality(_log(spark, d))
    margins = parts["margins"].select("below_0_001", "below_0_005", "below_0_01", r("mean").alias("mean_margin"), r("median").alias("median_margin"), r("p95").alias("p95_margin"))
    breaches = parts["breaches"].agg(F.count(F.lit(1)).alias("breaches"))
    return parts["totals"].join(F.broadcast(margins)).join(F.broadcast(breaches))  # one row each


QUALITY_TOTALS = f"""WITH {_LOG}, m AS (SELECT round(abs(a - b_value), 9) AS margin FROM d WHERE kind = 'play'),
s AS (SELECT count(*) AS n, list_sort(list(margin)) AS s, avg(margin) AS av, count(*) FILTER (WHERE margin < 0.001) AS x, count(*) FILTER (WHERE margin < 0.005) AS y, count(*) FILTER (WHERE margin < 0.01) AS z FROM m)
SELECT count(*)::BIGINT AS rows, count(DISTINCT shoe_id)::BIGINT AS shoes, 1::BIGINT AS datasets, 1::BIGINT AS schema_versions,
  count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE split = 'validation') AS validation_rows, count(*) FILTER (WHERE split = 'test') AS test_rows,
  (SELECT x FROM s) AS below_0_001, (SELECT y FROM s) AS below_0_005, (SELECT z FROM s) AS below_0_01, (SELECT round(av, 6) FROM s) AS mean_margin,
  (SELECT round(s[n // 2 + 1], 6) FROM s) AS median_margin, (SELECT round(s[least(n - 1, floor(0.95::DOUBLE * n)::BIGINT) + 1], 6) FROM s) AS p95_margin, 0::BIGINT AS breaches FROM d
"""


def manifest_shoes(spark: SparkSession, d: str) -> DataFrame:
    """Validation shoes of a manifest of the nations, one document."""
    n = load(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    shoe = F.struct(
        F.col("n_nationkey").cast("long").alias("shoe_id"),
        (F.col("n_nationkey") * 31).cast("long").alias("seed"),
        F.element_at(F.array(*[F.lit(s) for s in decisions.SPLITS]), F.col("n_nationkey") % 3 + 1).alias("split"),
        F.split("n_name", "").alias("cards"),
        (F.col("n_regionkey") + 200).cast("long").alias("cut_card_position"),
    )
    whole = n.agg(F.array_sort(F.collect_list(shoe)).alias("shoes")).select(F.lit(1).alias("schema_version"), F.lit("nations").alias("dataset_id"), "shoes")
    path = new_folder(spark, "manifest")
    decisions.canonical_json(whole).coalesce(1).write.text(path)
    rows = decisions.manifest_shoes(spark, path)
    return rows.select("dataset_id", "shoe_id", F.col("seed").cast("long").alias("seed"), "split", F.array_join("cards", "").alias("cards"), "cut_card_position")


MANIFEST_SHOES = """
SELECT 'nations' AS dataset_id, n_nationkey::BIGINT AS shoe_id, (n_nationkey * 31)::BIGINT AS seed, 'validation' AS split, n_name AS cards, (n_regionkey + 200)::BIGINT AS cut_card_position
FROM nation WHERE n_nationkey % 3 = 1
"""


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """A shard's report for each nation, written as JSON and read back."""
    c = load(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    bins = c.groupBy("c_nationkey", "c_mktsegment").agg(*stats.estimate(F.col("c_acctbal")))
    own = F.struct("mean", "standard_error", "sample_count")
    by_bin = bins.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", own))).alias("bins"))
    all_ = c.groupBy("c_nationkey").agg(*stats.estimate(F.col("c_acctbal"))).select("c_nationkey", own.alias("paired_advantage"))
    policies = F.create_map(F.lit("model"), F.col("bins"), F.lit("control"), F.col("bins"))
    whole = all_.join(by_bin, "c_nationkey").select(
        (F.col("c_nationkey") * 10).alias("shoe_start"),
        F.lit(10).alias("shoe_count"),
        F.lit(7).alias("simulation_seed"),
        "paired_advantage",
        F.create_map(F.lit("segment"), policies).alias("breakdowns"),
    )
    folder = new_folder(spark, "reports")
    texts = whole.select("shoe_start", F.to_json(F.struct(*whole.columns)).alias("value")).repartition("shoe_start")
    texts.sortWithinPartitions("shoe_start").write.partitionBy("shoe_start").option("maxRecordsPerFile", 1).text(folder)
    return decisions.report_slices(spark, f"{folder}/*")


_REPORTS = """e AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS mean, coalesce(stddev_samp(c_acctbal) / sqrt(count(*)), 0) AS se, count(*) AS n FROM customer GROUP BY ALL),
a AS (SELECT c_nationkey, avg(c_acctbal) AS mean, coalesce(stddev_samp(c_acctbal) / sqrt(count(*)), 0) AS se, count(*) AS n FROM customer GROUP BY ALL)"""


def report_slices(spark: SparkSession, d: str) -> DataFrame:
    rows = _reports(spark, d).select("shoe_start", "shoe_count", "simulation_seed", "paired_advantage.*")
    return rounded(rows)


REPORT_SLICES = f"""WITH {_REPORTS}
SELECT (c_nationkey * 10)::BIGINT AS shoe_start, 10::BIGINT AS shoe_count, 7::BIGINT AS simulation_seed, round(mean, 6) AS mean, round(se, 6) AS standard_error, n::BIGINT AS sample_count FROM a
"""


def report_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Nested breakdowns of all reports as rows."""
    return rounded(decisions.breakdown_rows(_reports(spark, d)))


REPORT_BREAKDOWN = f"""WITH {_REPORTS}
SELECT (c_nationkey * 10)::BIGINT AS shoe_start, 'segment' AS category, p.policy, c_mktsegment AS bin, round(mean, 6) AS mean, round(se, 6) AS standard_error, n::BIGINT AS sample_count
FROM e, (VALUES ('model'), ('control')) p(policy)
"""


def aggregate_slices(spark: SparkSession, d: str) -> DataFrame:
    """All reports as one: pooled advantage, interval, verdict, and whether they fit together."""
    return rounded(evaluation.aggregated(_reports(spark, d)))


AGGREGATE_SLICES = f"""WITH {_REPORTS},
s AS (SELECT sum(n)::DOUBLE AS n, sum(n * mean) AS nm, sum((n - 1) * n * se * se) AS w, sum(n * mean * mean) AS q FROM a),
t AS (SELECT n, nm / n AS mean, sqrt(greatest(w + q - nm * nm / n, 0) / (n - 1) / n) AS se FROM s),
g AS (SELECT count(*) AS gaps FROM (SELECT c_nationkey, lag(c_nationkey) OVER (ORDER BY c_nationkey) AS p FROM a) WHERE c_nationkey <> p + 1)
SELECT round(mean, 6) AS mean, round(se, 6) AS standard_error, n::BIGINT AS sample_count, round(mean - 1.96 * se, 6) AS ci_low, round(mean + 1.96 * se, 6) AS ci_high,
  gaps::BIGINT AS gaps, 1::BIGINT AS seeds, (SELECT count(*) * 10 FROM a)::BIGINT AS shoes, CASE WHEN mean - 1.96 * se > 0 THEN 'model' WHEN mean + 1.96 * se < 0 THEN 'control' ELSE 'inconclusive' END AS verdict,
  gaps = 0 AS fits FROM t, g
"""


def apportionment(spark: SparkSession, d: str) -> DataFrame:
    """Units of three splits for totals from 10 to 400."""
    rows = [(n, *sampling.apportion(n, (0.7, 0.2, 0.1))) for n in range(10, 401)]
    return spark.createDataFrame(rows, "total long, train long, validation long, test long")


APPORTIONMENT = """
WITH t AS (SELECT range AS total FROM range(10, 401)), w AS (SELECT * FROM (VALUES (0, 7), (1, 2), (2, 1)) w(i, w)),
p AS (SELECT total, i, total * w // 10 AS whole, total * w % 10 AS rest FROM t, w),
q AS (SELECT *, total - sum(whole) OVER (PARTITION BY total) AS spare, row_number() OVER (PARTITION BY total ORDER BY rest DESC, i) AS k FROM p),
s AS (SELECT total, i, (whole + (k <= spare)::INTEGER)::BIGINT AS n FROM q)
SELECT total, max(n) FILTER (WHERE i = 0) AS train, max(n) FILTER (WHERE i = 1) AS validation, max(n) FILTER (WHERE i = 2) AS test FROM s GROUP BY 1
"""


def splitmix64(spark: SparkSession, d: str) -> DataFrame:
    """SplitMix64 outputs for states spread over 64 bits: multiples modulo 2^64, of ids of any size."""
    e = load(spark, d, "events", "event_id")
    e = e.select("event_id", hashing.product(F.col("event_id").cast("long"), 92233720368547).alias("state"))
    return e.select("event_id", F.hex(hashing.splitmix64(F.col("state"))).alias("output"))


_TWO = "18446744073709551616::UHUGEINT"
SPLITMIX64 = f"""
WITH a AS (SELECT event_id, ((event_id::UHUGEINT * 92233720368547 + {hashing.GAMMA}) % {_TWO})::UBIGINT AS z FROM events),
b AS (SELECT event_id, ((xor(z, z >> 30)::UHUGEINT % 4294967296 * {hashing.MIX_1} + (xor(z, z >> 30) >> 32)::UHUGEINT * {hashing.MIX_1} % 4294967296 * 4294967296) % {_TWO})::UBIGINT AS z FROM a),
c AS (SELECT event_id, ((xor(z, z >> 27)::UHUGEINT % 4294967296 * {hashing.MIX_2} + (xor(z, z >> 27) >> 32)::UHUGEINT * {hashing.MIX_2} % 4294967296 * 4294967296) % {_TWO})::UBIGINT AS z FROM b)
SELECT event_id, to_hex(xor(z, z >> 31)) AS output FROM c
"""


def padded_batches(spark: SparkSession, d: str) -> DataFrame:
    """Orders' line numbers in batches of 64, filled to length 16 on the right; a mask's sum."""
    l = load(spark, d, "lineitem", "l_orderkey", "l_linenumber").where("l_linenumber <= 7").distinct()
    rows = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("ids"))
    rows = sampling.batches(rows, 64, "l_orderkey")
    return rows.select("l_orderkey", "batch", "place", F.array_join(sampling.padded(F.col("ids"), 16).cast("array<string>"), " ").alias("padded"), F.size("ids").alias("mask"))


PADDED_BATCHES = """
WITH o AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS ids FROM lineitem WHERE l_linenumber <= 7 GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY l_orderkey) - 1 AS i FROM o)
SELECT l_orderkey, i // 64 AS batch, i % 64 AS place, array_to_string(list_concat(ids, list_transform(range(16 - len(ids)), lambda x: 0)), ' ') AS padded, len(ids)::INTEGER AS mask FROM n
"""

_BETS = {"<BET_MINIMUM>": 0.001, "<BET_LOW>": 0.005, "<BET_MEDIUM>": 0.009, "<BET_HIGH>": 0.013}


def bet_fraction_error(spark: SparkSession, d: str) -> DataFrame:
    """Fractions of bet tokens, and how far each is from a target."""
    p = load(spark, d, "part", "p_partkey", "p_size")
    token = F.element_at(F.array(*[F.lit(t) for t in _BETS]), (F.col("p_size") % 4 + 1).cast("int"))
    rows = p.select("p_partkey", token.alias("token"), (F.col("p_partkey") % 30 / 2000).alias("target"))
    found = kelly.token_fraction(F.col("token"), _BETS)
    return rows.select("p_partkey", "token", found.alias("fraction"), F.round(F.abs(found - F.col("target")), 9).alias("error"))


BET_FRACTION_ERROR = """
WITH f(i, token, fraction) AS (VALUES (0, '<BET_MINIMUM>', 0.001::DOUBLE), (1, '<BET_LOW>', 0.005), (2, '<BET_MEDIUM>', 0.009), (3, '<BET_HIGH>', 0.013))
SELECT p_partkey, token, fraction, round(abs(fraction - p_partkey % 30 / 2000), 9) AS error FROM part JOIN f ON p_size % 4 = i
"""


def label_store(spark: SparkSession, d: str) -> DataFrame:
    """Labels of orders' customers inserted or ignored, then those of their segments' rows: the
    first label of a key stays; lookups, hits and misses of the second insert."""
    o = load(spark, d, "orders", "o_orderkey", "o_custkey")
    store = labels.LabelStore(spark, new_folder(spark, "label-store"))
    even = o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").cast("string").alias("key")).distinct()
    every = o.select(F.col("o_custkey").cast("string").alias("key"))
    store.insert(even.withColumn("label", F.lit("first")), "0001")
    figures = labels.counters(every, store.table())
    won = store.insert(every.distinct().withColumn("label", F.lit("second")), "0002")
    counts = won.groupBy("label").agg(F.count(F.lit(1)).alias("keys"))
    return rounded(counts.join(F.broadcast(figures)))  # one row


LABEL_STORE = """
WITH k AS (SELECT o_custkey, count(*) AS n, bool_or(o_orderkey % 2 = 0) AS held FROM orders GROUP BY 1),
f AS (SELECT sum(n)::BIGINT AS lookups, sum(CASE WHEN held THEN n ELSE n - 1 END)::BIGINT AS hits, count(*) FILTER (WHERE NOT held) AS misses FROM k)
SELECT CASE WHEN held THEN 'first' ELSE 'second' END AS label, count(*)::BIGINT AS keys, lookups, hits, misses, round(hits / lookups, 6) AS hit_rate FROM k, f GROUP BY ALL
"""


def canonical_hands(spark: SparkSession, d: str) -> DataFrame:
    """Cards and finished hands in the order that stands for all orders."""
    l = load(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    hand = F.array(*[F.least(F.col(c) % 13 + 1, F.lit(10)).cast("int") for c in ("l_orderkey", "l_partkey", "l_suppkey")])

    def finished(n: int):
        x = F.col("l_partkey") + n * F.col("l_suppkey")
        return F.struct((x % 5 == 0).alias("surrendered"), (x % 3 == 0).alias("bust"), (x % 7 == 0).alias("natural"), (x % 10 + 12).alias("total"), (x % 2 + 1).alias("wager"))

    ordered = cards.finished_order(F.array(*[finished(n) for n in range(3)]))
    texts = F.transform(ordered, lambda h: F.concat_ws(":", *[h[c].cast("string") for c in ("surrendered", "bust", "natural", "total", "wager")]))
    rows = l.select(F.array_join(cards.canonical_hand(hand).cast("array<string>"), " ").alias("hand"), F.array_join(texts, " ").alias("finished"))
    return rows.groupBy("hand", "finished").agg(F.count(F.lit(1)).alias("rows"))


_FINISHED = ", ".join(
    "{{'a': x % 5 = 0, 'b': x % 3 = 0, 'c': x % 7 = 0, 'd': x % 10 + 12, 'e': x % 2 + 1}}".replace("{{", "{").replace("}}", "}").replace("x", f"(l_partkey + {n} * l_suppkey)")
    for n in range(3)
)
CANONICAL_HANDS = f"""
WITH s AS (SELECT list_sort([least(l_orderkey % 13 + 1, 10), least(l_partkey % 13 + 1, 10), least(l_suppkey % 13 + 1, 10)]) AS hand, list_sort([{_FINISHED}]) AS f FROM lineitem)
SELECT array_to_string(hand, ' ') AS hand, array_to_string(list_transform(f, lambda h: h.a || ':' || h.b || ':' || h.c || ':' || h.d || ':' || h.e), ' ') AS finished, count(*)::BIGINT AS rows FROM s GROUP BY ALL
"""


def int_lists(spark: SparkSession, d: str) -> DataFrame:
    """Configured lists of worker counts, parsed and checked."""
    p = load(spark, d, "part", "p_partkey", "p_size")
    written = F.concat_ws(",", F.col("p_size"), F.concat(F.lit(" "), F.col("p_size") + 1, F.lit(" ")), F.col("p_partkey") + 1000)
    return p.select("p_partkey", F.array_join(text.int_list(written).cast("array<string>"), "|").alias("numbers"))


INT_LISTS = "SELECT p_partkey, p_size || '|' || (p_size + 1) || '|' || (p_partkey + 1000) AS numbers FROM part"

QUERIES = {
    "q_log_scan": (log_scan, LOG_SCAN),
    "q_log_training_rows": (log_training_rows, LOG_TRAINING_ROWS),
    "q_log_splits": (log_splits, LOG_SPLITS),
    "q_log_shards": (log_shards, LOG_SHARDS),
    "q_quality_kinds": (quality_kinds, QUALITY_KINDS),
    "q_quality_totals": (quality_totals, QUALITY_TOTALS),
    "q_manifest_shoes": (manifest_shoes, MANIFEST_SHOES),
    "q_report_slices": (report_slices, REPORT_SLICES),
    "q_report_breakdown": (report_breakdown, REPORT_BREAKDOWN),
    "q_aggregate_slices": (aggregate_slices, AGGREGATE_SLICES),
    "q_apportionment": (apportionment, APPORTIONMENT),
    "q_splitmix64": (splitmix64, SPLITMIX64),
    "q_padded_batches": (padded_batches, PADDED_BATCHES),
    "q_bet_fraction_error": (bet_fraction_error, BET_FRACTION_ERROR),
    "q_label_store": (label_store, LABEL_STORE),
    "q_canonical_hands": (canonical_hands, CANONICAL_HANDS),
    "q_int_lists": (int_lists, INT_LISTS),
}
