"""Card rules, draws, tokens, labels and logs over the data tables.

Lines and events stand for hands: cards, dealer cards and options follow from their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cards, hashing
from ..operators import draws, labels, rounds, tokens
from ..sources.tables import load
from .statistics import r, rounded


def _card(x: Column) -> Column:
    """1..10 from a number, tens four times as often."""
    return F.least(x.cast("long") % 13 + 1, F.lit(10)).cast("int")


_LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


def _hands(spark: SparkSession, d: str) -> DataFrame:
    l = load(spark, d, "lineitem", *_LINE)
    a, b, c = _card(F.col("l_orderkey")), _card(F.col("l_partkey")), _card(F.col("l_suppkey") * 3)
    three = F.col("l_linenumber") % 2 == 0
    legal = F.when(three, F.array(F.lit("hit"), F.lit("stand"))).otherwise(
        F.array(F.lit("hit"), F.lit("stand"), F.lit("double"), F.lit("split"), F.lit("surrender"))
    )
    return l.select(
        F.when(three, F.array(a, b, c)).otherwise(F.array(a, b)).alias("hand"),
        _card(F.col("l_quantity")).alias("up"),
        F.array(_card(F.col("l_quantity")), _card(F.col("l_partkey") * 5), _card(F.col("l_orderkey") * 3)).alias("dealer3"),
        F.array(_card(F.col("l_quantity")), _card(F.col("l_partkey") * 5)).alias("dealer"),
        (F.col("l_orderkey") % 11 == 0).alias("surrendered"),
        (F.col("l_orderkey") % 5 == 0).alias("from_split"),
        legal.alias("legal"),
        ((F.col("l_orderkey") + F.col("l_partkey")) % 13 - 6).cast("int").alias("count"),
    )


_H = """h AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN [a, b, c] ELSE [a, b] END AS hand, up, [up, e] AS dealer, s AS surrendered, fs AS from_split,
  l_linenumber % 2 <> 0 AS two, cnt FROM (SELECT l_linenumber, least(l_orderkey % 13 + 1, 10) AS a, least(l_partkey % 13 + 1, 10) AS b, least(l_suppkey * 3 % 13 + 1, 10) AS c,
  least(l_quantity::BIGINT % 13 + 1, 10) AS up, least(l_partkey * 5 % 13 + 1, 10) AS e, l_orderkey % 11 = 0 AS s, l_orderkey % 5 = 0 AS fs, (l_orderkey + l_partkey) % 13 - 6 AS cnt FROM lineitem)),
v AS (SELECT *, list_sum(hand) AS hard, list_contains(hand, 1) AND list_sum(hand) + 10 <= 21 AS soft, list_sum(dealer) AS dhard,
  list_contains(dealer, 1) AND list_sum(dealer) + 10 <= 21 AS dsoft FROM h),
t AS (SELECT *, (hard + CASE WHEN soft THEN 10 ELSE 0 END)::INTEGER AS total, (dhard + CASE WHEN dsoft THEN 10 ELSE 0 END)::INTEGER AS dtotal,
  CASE WHEN up = 1 THEN 11 ELSE up END AS du FROM v)"""


def hand_value(spark: SparkSession, d: str) -> DataFrame:
    h = _hands(spark, d)
    hand = F.col("hand")
    rows = h.select(cards.total(hand).alias("total"), cards.is_soft(hand).alias("soft"), cards.is_natural(hand).alias("natural"), cards.is_pair(hand).alias("pair"))
    return rows.groupBy("total", "soft", "natural", "pair").agg(F.count(F.lit(1)).alias("hands"))


HAND_VALUE = f"""WITH {_H}
SELECT total, soft, two AND total = 21 AS natural, two AND hand[1] = hand[2] AS pair, count(*)::BIGINT AS hands FROM t GROUP BY ALL
"""


def settlement(spark: SparkSession, d: str) -> DataFrame:
    h = _hands(spark, d)
    rows = h.select(cards.outcome(F.col("hand"), F.col("dealer"), F.col("surrendered"), F.col("from_split")).alias("outcome"), F.lit(2.0).alias("wager"))
    rows = rows.select("outcome", cards.profit(F.col("outcome"), F.col("wager")).alias("profit"), cards.payout(F.col("outcome"), F.col("wager")).alias("payout"))
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("hands"), r(F.sum("profit")).alias("profit"), r(F.sum("payout")).alias("payout"))


SETTLEMENT = f"""WITH {_H},
n AS (SELECT *, two AND total = 21 AND NOT from_split AS nat, dtotal = 21 AS dnat FROM t),
o AS (SELECT CASE WHEN surrendered THEN 'surrender' WHEN total > 21 THEN 'bust' WHEN dnat THEN CASE WHEN nat THEN 'push' ELSE 'loss' END
  WHEN nat THEN 'natural' WHEN dtotal > 21 OR total > dtotal THEN 'win' WHEN total = dtotal THEN 'push' ELSE 'loss' END AS outcome FROM n)
SELECT outcome, count(*)::BIGINT AS hands, round(count(*) * CASE outcome WHEN 'surrender' THEN -1 WHEN 'bust' THEN -2 WHEN 'loss' THEN -2 WHEN 'natural' THEN 3 WHEN 'win' THEN 2 ELSE 0 END::DOUBLE, 6) AS profit,
  round(count(*) * CASE outcome WHEN 'surrender' THEN 1 WHEN 'bust' THEN 0 WHEN 'loss' THEN 0 WHEN 'natural' THEN 5 WHEN 'win' THEN 4 ELSE 2 END::DOUBLE, 6) AS payout FROM o GROUP BY 1
"""

_BASIC = """CASE
  WHEN two AND NOT soft AND ((total = 17 AND du = 11) OR (total = 16 AND du >= 9) OR (total = 15 AND du >= 10)) THEN 'surrender'
  WHEN two AND hand[1] = hand[2] AND (hand[1] IN (1, 8) OR (hand[1] = 9 AND du IN (2,3,4,5,6,8,9)) OR (hand[1] IN (2, 3, 7) AND du <= 7) OR (hand[1] = 6 AND du <= 6) OR (hand[1] = 4 AND du IN (5, 6))) THEN 'split'
  WHEN soft THEN CASE WHEN total >= 20 THEN 'stand' WHEN total = 19 THEN CASE WHEN two AND du = 6 THEN 'double' ELSE 'stand' END
    WHEN total = 18 THEN CASE WHEN two AND du <= 6 THEN 'double' WHEN du <= 8 THEN 'stand' ELSE 'hit' END
    WHEN two AND ((total = 17 AND du BETWEEN 3 AND 6) OR (total IN (15, 16) AND du BETWEEN 4 AND 6) OR (total IN (13, 14) AND du IN (5, 6))) THEN 'double' ELSE 'hit' END
  WHEN total >= 17 THEN 'stand' WHEN total >= 13 THEN CASE WHEN du <= 6 THEN 'stand' ELSE 'hit' END
  WHEN total = 12 THEN CASE WHEN du BETWEEN 4 AND 6 THEN 'stand' ELSE 'hit' END
  WHEN two AND (total = 11 OR (total = 10 AND du <= 9) OR (total = 9 AND du BETWEEN 3 AND 6)) THEN 'double' ELSE 'hit' END"""


def basic_table(spark: SparkSession, d: str) -> DataFrame:
    h = _hands(spark, d)
    rows = h.select(cards.total(F.col("hand")).alias("total"), "up", cards.basic_action(F.col("hand"), F.col("up"), F.col("legal")).alias("action"))
    return rows.groupBy("total", "up", "action").agg(F.count(F.lit(1)).alias("hands"))


BASIC_TABLE = f"""WITH {_H} SELECT total, up::INTEGER AS up, {_BASIC} AS action, count(*)::BIGINT AS hands FROM t GROUP BY ALL"""


def count_plays(spark: SparkSession, d: str) -> DataFrame:
    """Basic plays with the count indices over them, and the bet level of each count."""
    h = _hands(spark, d)
    rows = h.select("count", cards.bet_level(F.col("count")).alias("bet"), cards.count_action(F.col("hand"), F.col("up"), F.col("legal"), F.col("count")).alias("action"))
    return rows.groupBy("count", "bet", "action").agg(F.count(F.lit(1)).alias("hands"))


_INDEX_SQL = "".join(
    f"WHEN total = {t} AND du = {u}{' AND NOT two' if (t, u) in ((15, 10), (16, 9), (16, 10)) else ''} AND NOT soft THEN "
    f"CASE WHEN cnt >= {i} AND {'two' if a == 'double' else 'true'} THEN '{a}' WHEN cnt < {i} THEN 'hit' ELSE basic END\n  "
    for (t, u), (i, a) in cards.INDEX_PLAYS.items()
)
_SURRENDER_SQL = "".join(
    f"WHEN two AND NOT soft AND total = {t} AND du = {u} THEN CASE WHEN cnt >= {i} THEN 'surrender' ELSE 'hit' END\n  "
    for (t, u), i in cards.INDEX_SURRENDER.items()
)
COUNT_PLAYS = f"""WITH {_H}, b AS (SELECT *, {_BASIC} AS basic FROM t)
SELECT cnt::INTEGER AS count, CASE WHEN cnt >= 6 THEN 'high' WHEN cnt >= 4 THEN 'medium' WHEN cnt >= 2 THEN 'low' ELSE 'minimum' END AS bet,
  CASE {_SURRENDER_SQL}WHEN two AND hand[1] = 10 AND hand[2] = 10 AND ((du = 5 AND cnt >= 5) OR (du = 6 AND cnt >= 4)) THEN 'split'
  {_INDEX_SQL}ELSE basic END AS action, count(*)::BIGINT AS hands FROM b GROUP BY ALL
"""


def true_count(spark: SparkSession, d: str) -> DataFrame:
    """Floored true counts, negatives towards minus infinity."""
    e = load(spark, d, "events", "event_id").select((F.col("event_id") % 41 - 20).alias("running"), (F.col("event_id") % 300).alias("seen"))
    return e.groupBy("running", "seen").agg(F.max(cards.true_count(F.col("running"), F.col("seen"))).alias("true_count"))


TRUE_COUNT = """
SELECT event_id % 41 - 20 AS running, event_id % 300 AS seen, max(floor((event_id % 41 - 20) / ((312 - event_id % 300) / 52))::BIGINT) AS true_count FROM events GROUP BY 1, 2
"""


def insurance(spark: SparkSession, d: str) -> DataFrame:
    """Insurance over shoes that have lost some tens: value, choice and settlement."""
    e = load(spark, d, "events", "event_id").select((F.col("event_id") % 97).alias("tens"), (F.col("event_id") % 150 + 97).alias("left")).distinct()
    p = F.col("tens") / F.col("left")
    value, choice = draws.insurance(p)
    paid = cards.insurance_profit(F.lit(1.0), F.col("tens") % 2 == 0)
    return rounded(e.select("tens", "left", value.alias("value"), choice.alias("choice"), paid.alias("profit")))


INSURANCE = """
SELECT DISTINCT event_id % 97 AS tens, event_id % 150 + 97 AS "left", round((event_id % 97) / (event_id % 150 + 97) - (1 - (event_id % 97) / (event_id % 150 + 97)) / 2, 6) + 0.0::DOUBLE AS value,
  CASE WHEN 3 * (event_id % 97) > event_id % 150 + 97 THEN '<INSURANCE>' ELSE '<NO_INSURANCE>' END AS choice, CASE WHEN event_id % 97 % 2 = 0 THEN 1.0::DOUBLE ELSE -0.5 END AS profit FROM events
"""

_SHOE = "shoe AS (SELECT range AS card, CASE WHEN range = 10 THEN 96 ELSE 24 END AS n FROM range(1, 11))"


def draws_without_replacement(spark: SparkSession, d: str) -> DataFrame:
    out = draws.opening_draws(draws.composition(spark))
    return out.select("first", "dealer", "second", F.round("p", 12).alias("p"))


DRAWS_WITHOUT_REPLACEMENT = f"""WITH {_SHOE}
SELECT a.card::INTEGER AS first, b.card::INTEGER AS dealer, c.card::INTEGER AS second,
  round(a.n * (b.n - (a.card = b.card)::INTEGER) * (c.n - (a.card = c.card)::INTEGER - (b.card = c.card)::INTEGER) / (312.0::DOUBLE * 311 * 310), 12) AS p FROM shoe a, shoe b, shoe c
"""


def hidden_hole(spark: SparkSession, d: str) -> DataFrame:
    up = spark.range(1, 11).select(F.col("id").cast("int").alias("upcard"))
    out = draws.hidden_hole_draws(draws.composition(spark), up)
    natural = draws.dealer_natural(draws.composition(spark), up).withColumnRenamed("p", "natural")
    return out.join(natural, "upcard").select("upcard", "card", F.round("p", 12).alias("p"), F.round("natural", 12).alias("natural"))


HIDDEN_HOLE = f"""WITH {_SHOE}, x AS (SELECT u.card AS upcard, s.card, s.n, NOT ((u.card = 1 AND s.card = 10) OR (u.card = 10 AND s.card = 1)) AS ok FROM shoe u, shoe s),
e AS (SELECT *, sum(CASE WHEN ok THEN n ELSE 0 END) OVER (PARTITION BY upcard) AS e FROM x)
SELECT upcard::INTEGER AS upcard, card::INTEGER AS card, round(n * (e - ok::INTEGER) / (e * 311.0::DOUBLE), 12) AS p,
  round(CASE upcard WHEN 1 THEN 96 / 312.0::DOUBLE WHEN 10 THEN 24 / 312.0::DOUBLE ELSE 0 END, 12) AS natural FROM e
"""


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as dealt cards: history tokens and a bet query."""
    e = load(spark, d, "events", "event_id", "user_id")
    rank = F.element_at(F.array(*[F.lit(x) for x in ("A", "2", "3", "4", "5", "6", "7", "8", "9", "10", "J", "Q", "K")]), (F.col("event_id") % 13 + 1).cast("int"))
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", rank.alias("rank")))).alias("s"))
    return g.select("user_id", F.col("s.rank").alias("cards"))


_SEQ = """q AS (SELECT user_id, list(CASE WHEN k > 10 THEN '10' WHEN k = 1 THEN 'A' ELSE k::VARCHAR END ORDER BY event_id) AS cards FROM (SELECT user_id, event_id, event_id % 13 + 1 AS k FROM events) GROUP BY 1)"""


def token_ids(spark: SparkSession, d: str) -> DataFrame:
    s = _sequences(spark, d)
    seq = tokens.bet_input(F.col("cards"))
    return s.select("user_id", F.array_join(F.transform(tokens.encode(seq), lambda x: x.cast("string")), " ").alias("ids"), (tokens.decode(tokens.encode(seq)) == seq).alias("same"))


TOKEN_IDS = f"""WITH {_SEQ}
SELECT user_id, '11 ' || array_to_string(list_transform(cards, lambda c: CASE c WHEN 'A' THEN '1' ELSE c END), ' ') || ' 15' AS ids, true AS same FROM q
"""


def context_fit(spark: SparkSession, d: str) -> DataFrame:
    """Sequences in a window of 40: the oldest cards go, query and marker stay."""
    s = _sequences(spark, d)
    full = tokens.decision_input(F.col("cards"), F.slice("cards", 1, 2), F.element_at("cards", 1), F.lit(True))
    fit = tokens.fitted(full, 40)
    return s.select("user_id", F.size(full).alias("full"), F.size(fit).alias("kept"), F.array_join(fit, " ").alias("tokens"))


CONTEXT_FIT = f"""WITH {_SEQ},
f AS (SELECT user_id, cards, len(cards) + 8 AS n, greatest(0, len(cards) + 8 - 40) AS cut FROM q)
SELECT user_id, n::INTEGER AS full, (n - cut)::INTEGER AS kept,
  array_to_string(list_concat(['<HISTORY>'], cards[cut + 1:], ['<CURRENT_HAND>', '<PLAYER>', cards[1], cards[2], '<DEALER>', cards[1], '<PLAY_QUERY>']), ' ') AS tokens FROM f
"""


def context_history(spark: SparkSession, d: str) -> DataFrame:
    """A user's visible cards minus a hand of two (the cards 10 and 5), by value. All users."""
    e = load(spark, d, "events", "event_id", "user_id").withColumn("card", _card(F.col("event_id")))
    hand = e.select("user_id").distinct().withColumn("card", F.explode(F.array(F.lit(10), F.lit(5)))).select("user_id", "card")
    left = tokens.context_history(e, hand, "user_id", "event_id", "card")
    return left.select("user_id", "event_id", "card")


CONTEXT_HISTORY = """
WITH e AS (SELECT event_id, user_id, least(event_id % 13 + 1, 10)::INTEGER AS card FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, card ORDER BY event_id) AS i FROM e)
SELECT user_id, event_id, card FROM n WHERE i > CASE WHEN card IN (5, 10) THEN 1 ELSE 0 END
"""


def public_log(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events", "event_id", "event_type", "value").select(
        "event_id", "event_type", F.col("value").alias("hidden_card"), F.when(F.col("event_id") % 3 == 0, "hidden").otherwise("public").alias("visibility")
    )
    return tokens.public_events(e)


PUBLIC_LOG = "SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0"


def cache_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct state is labelled once and joined back."""
    l = load(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus", "l_quantity")
    label = F.sha2(F.concat_ws("|", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string")), 256)
    rows, table = labels.labelled(l, "play", ["l_returnflag", "l_linestatus", "l_quantity"], lambda s: s.withColumn("label", F.substring(label, 1, 8)))
    broken = labels.conflicts(table).agg(F.count(F.lit(1)).alias("conflicts"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("key").alias("states")).join(F.broadcast(broken))  # one row


CACHE_DEDUP = """
SELECT substr(sha256(l_returnflag || '|' || l_linestatus || '|' || l_quantity::INTEGER), 1, 8) AS label, count(*)::BIGINT AS rows,
  count(DISTINCT (l_returnflag, l_linestatus, l_quantity))::BIGINT AS states, 0::BIGINT AS conflicts FROM lineitem GROUP BY 1
"""


def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events", "event_id", "props")
    k = F.from_json("props", "k bigint")["k"]
    back = F.from_json(F.to_json(F.struct(k.alias("k"))), "k bigint")["k"]
    return e.select("event_id", k.alias("k"), k.eqNullSafe(back).alias("same"))


JSON_ROUNDTRIP = "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, true AS same FROM events"


def content_ids(spark: SparkSession, d: str) -> DataFrame:
    """Content address and 64-bit seed of each customer's configuration."""
    c = load(spark, d, "customer", "c_custkey", "c_mktsegment")
    key = hashing.text_key(F.lit("v6"), "c_custkey", "c_mktsegment")
    return c.select("c_custkey", hashing.content_id(F.lit("v6"), "c_custkey", "c_mktsegment").alias("content_id"), hashing.seed64(key).cast("string").alias("seed"))


CONTENT_IDS = """
SELECT c_custkey, substr(sha256('v6|' || c_custkey || '|' || c_mktsegment), 1, 16) AS content_id,
  (('0x' || substr(sha256('v6|' || c_custkey || '|' || c_mktsegment), 1, 16))::UBIGINT)::VARCHAR AS seed FROM customer
"""


def shoes(spark: SparkSession, d: str) -> DataFrame:
    """Ten seeded shoes: every card once, the cut between 70 and 80 per cent."""
    s = rounds.shoes(spark, 10, 20250725)
    return s.select("shoe_id", F.array_join(F.transform("cards", lambda c: c.cast("string")), " ").alias("cards"), "cut")


SHOES = """
WITH deck AS (SELECT i, CASE WHEN i < 216 THEN i // 24 + 1 ELSE 10 END AS c FROM (SELECT range AS i FROM range(312)))
SELECT s.range AS shoe_id, string_agg(c::VARCHAR, ' ' ORDER BY sha256('20250725|' || s.range || '|' || i)) AS cards,
  floor(312 * (0.7::DOUBLE + 0.1::DOUBLE * (('0x' || substr(sha256('20250725|' || s.range || '|cut'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)))::INTEGER AS cut FROM range(10) s, deck GROUP BY s.range
"""


def shoe_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Rounds of a hundred shoes by the basic table."""
    return rounds.shoe_rounds(rounds.shoes(spark, 100, 20250725).repartition(8, "shoe_id"))


def shoe_decisions(spark: SparkSession, d: str) -> DataFrame:
    return rounds.shoe_decisions(rounds.shoes(spark, 100, 20250725).repartition(8, "shoe_id"))


def dealer_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Exact dealer outcomes against each upcard, the upcard gone from six decks."""
    states = spark.range(1, 11).select(
        F.col("id").alias("state"),
        F.transform(F.array(*[F.lit(c) for c in cards.SIX_DECKS]), lambda n, i: n - F.when(i + 1 == F.col("id"), 1).otherwise(0)).alias("counts"),
        F.col("id").cast("int").alias("upcard"),
        F.lit(False).alias("peeked"),
    )
    return rounds.dealer_distributions(states.repartition(10, "state")).select("state", "outcome", F.round("p", 9).alias("p"))


_TWENTY_FOURS = ", ".join(f"CASE WHEN u = {v} THEN {c - 1} ELSE {c} END" for v, c in enumerate(cards.SIX_DECKS, 1))
DEALER_OUTCOMES = f"""
WITH RECURSIVE w(u, hard, ace, n, p, counts, done) AS (
  SELECT u::BIGINT, u::BIGINT, u = 1, 1, 1.0::DOUBLE, [{_TWENTY_FOURS}], false FROM range(1, 11) t(u)
  UNION ALL
  SELECT u, h, a, m, q, list_transform(counts, lambda k, i: CASE WHEN i = c THEN k - 1 ELSE k END),
    CASE WHEN m = 2 AND a AND h = 11 THEN true WHEN a AND h + 10 <= 21 THEN h + 10 >= 18 ELSE h >= 17 END
  FROM (SELECT u, hard + c AS h, ace OR c = 1 AS a, n + 1 AS m, p * counts[c] / (312 - n) AS q, counts, c FROM w, range(1, 11) r(c) WHERE NOT done))
SELECT u AS state, CASE WHEN n = 2 AND ace AND hard = 11 THEN 'natural' WHEN hard > 21 THEN 'bust' ELSE (CASE WHEN ace AND hard + 10 <= 21 THEN hard + 10 ELSE hard END)::VARCHAR END AS outcome,
  round(sum(p), 9) AS p FROM w WHERE done GROUP BY 1, 2
"""


def round_rollouts(spark: SparkSession, d: str) -> DataFrame:
    """Mean and error of 20,000 rollouts from each of 16 compositions without some tens."""
    from ..functions.stats import Z95

    states = spark.range(16).select(
        F.col("id").alias("state"),
        F.transform(F.array(*[F.lit(c) for c in cards.SIX_DECKS]), lambda n, i: n - F.when(i == 9, F.col("id").cast("int")).otherwise(0)).alias("counts"),
        F.lit(1).alias("unavailable"),
        (hashing.seed64(hashing.text_key(F.lit("rollout"), "id")) % 9007199254740993).cast("long").alias("seed"),
    )
    h = rounds.round_estimates(states.repartition(8, "state"), 20_000)
    x, n = F.col("half_units") / 2, F.col("n")
    out = h.groupBy("state").agg(F.sum(n).alias("rollouts"), (F.sum(n * x) / F.sum(n)).alias("mean"), (F.sum(n * x * x) / F.sum(n)).alias("square"))
    error = F.sqrt((F.col("square") - F.col("mean") * F.col("mean")) / F.col("rollouts"))
    return rounded(out.select("state", "rollouts", "mean", error.alias("standard_error"), (F.col("mean") - Z95 * error).alias("ci_low"), (F.col("mean") + Z95 * error).alias("ci_high")))


QUERIES = {
    "q_hand_value": (hand_value, HAND_VALUE),
    "q_settlement": (settlement, SETTLEMENT),
    "q_basic_table": (basic_table, BASIC_TABLE),
    "q_count_plays": (count_plays, COUNT_PLAYS),
    "q_true_count": (true_count, TRUE_COUNT),
    "q_insurance": (insurance, INSURANCE),
    "q_draws_without_replacement": (draws_without_replacement, DRAWS_WITHOUT_REPLACEMENT),
    "q_hidden_hole": (hidden_hole, HIDDEN_HOLE),
    "q_token_ids": (token_ids, TOKEN_IDS),
    "q_context_fit": (context_fit, CONTEXT_FIT),
    "q_context_history": (context_history, CONTEXT_HISTORY),
    "q_public_log": (public_log, PUBLIC_LOG),
    "q_cache_dedup": (cache_dedup, CACHE_DEDUP),
    "q_json_roundtrip": (json_roundtrip, JSON_ROUNDTRIP),
    "q_content_ids": (content_ids, CONTENT_IDS),
    "q_shoes": (shoes, SHOES),
    "q_shoe_rounds": (shoe_rounds, None),
    "q_shoe_decisions": (shoe_decisions, None),
    "q_dealer_outcomes": (dealer_outcomes, DEALER_OUTCOMES),
    "q_round_rollouts": (round_rollouts, None),
}


def paired_shoes(spark: SparkSession, d: str) -> DataFrame:
    """Betting by the count against a flat bet over 200 shoes."""
    from ..operators import experiments

    out = experiments.paired_shoes(rounds.shoes(spark, 200, 20260801).repartition(8, "shoe_id"))
    return out.select(*[r(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def composition_samples(spark: SparkSession, d: str) -> DataFrame:
    """Four stratified compositions from each of eight shoes."""
    from ..operators import experiments

    out = experiments.composition_samples(rounds.shoes(spark, 8, 20250725), 4, 5)
    return out.select("shoe_id", "stratum", "visible", r("penetration", 9).alias("penetration"), F.array_join(F.transform("counts", lambda c: c.cast("string")), ",").alias("counts"))


_LEFT = ", ".join(f"{96 if v == 10 else 24} - count(*) FILTER (WHERE o <= visible AND c = {v})" for v in range(1, 11))
COMPOSITION_SAMPLES = f"""
WITH deck AS (SELECT i, CASE WHEN i < 216 THEN i // 24 + 1 ELSE 10 END AS c FROM (SELECT range AS i FROM range(312))),
s AS (SELECT range AS shoe_id, greatest(0, floor(312 * (0.7::DOUBLE + 0.1::DOUBLE * (('0x' || substr(sha256('20250725|' || range || '|cut'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)))::INTEGER - 5) AS most FROM range(8)),
k AS (SELECT shoe_id, t.range AS stratum, floor(most * t.range / 4) AS low, floor(most * (t.range + 1) / 4) AS high FROM s, range(4) t),
v AS (SELECT shoe_id, stratum, (low + floor(('0x' || substr(sha256('5|' || shoe_id || '|' || stratum), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (high - low + 1)))::INTEGER AS visible FROM k),
o AS (SELECT shoe_id, c, row_number() OVER (PARTITION BY shoe_id ORDER BY sha256('20250725|' || shoe_id || '|' || i), c) AS o FROM s, deck)
SELECT shoe_id, stratum::INTEGER AS stratum, visible, round(visible / 312, 9) AS penetration, array_to_string([{_LEFT}], ',') AS counts
FROM v JOIN o USING (shoe_id) GROUP BY shoe_id, stratum, visible
"""


def dealer_settlement(spark: SparkSession, d: str) -> DataFrame:
    """Returns of finished totals against fixed dealer chances."""
    from ..operators import experiments

    chances = [("17", 0.14), ("18", 0.14), ("19", 0.13), ("20", 0.18), ("21", 0.07), ("bust", 0.29), ("natural", 0.05)]
    dealer = spark.createDataFrame(chances, "outcome string, p double")
    p = load(spark, d, "part", "p_partkey", "p_size")
    hands = p.select(F.col("p_partkey").alias("key"), (F.col("p_size") % 12 + 12).alias("total"), F.when(F.col("p_size") % 2 == 0, 2.0).otherwise(1.0).alias("wager"))
    return rounded(experiments.settled(hands, dealer))


DEALER_SETTLEMENT = """
WITH d AS (SELECT * FROM (VALUES (17, 0.14::DOUBLE), (18, 0.14), (19, 0.13), (20, 0.18), (21, 0.07), (0, 0.29), (99, 0.05)) t(score, p)),
h AS (SELECT p_partkey AS key, p_size % 12 + 12 AS total, CASE WHEN p_size % 2 = 0 THEN 2.0::DOUBLE ELSE 1.0 END AS wager FROM part)
SELECT key, CASE WHEN total > 21 THEN -wager WHEN total > score THEN wager WHEN total = score THEN 0 ELSE -wager END AS x, round(sum(p), 6) AS p FROM h, d GROUP BY 1, 2
"""


def sampling_error(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of sampled with exact choices on two-action states, one for each part, by
    sample budget."""
    from ..operators import experiments

    p = load(spark, d, "part", "p_partkey", "p_size")
    win = 0.45 + F.col("p_size") / 500
    even = F.struct(F.lit("stand").alias("action"), F.array(F.lit(-1.0), F.lit(1.0)).alias("x"), F.array(1 - win, win).alias("p"))
    safe = F.struct(F.lit("surrender").alias("action"), F.array(F.lit(0.0)).alias("x"), F.array(F.lit(1.0)).alias("p"))
    states = p.select(F.col("p_partkey").alias("state"), F.array(even, safe).alias("actions"), (2 * win - 1).alias("v"))
    values = states.select("state", F.explode(F.create_map(F.lit("stand"), F.col("v"), F.lit("surrender"), F.lit(0.0))).alias("action", "value"))
    dealt = states.drop("v").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "state")
    choices = experiments.sampled_choices(dealt, [100, 1_000, 10_000], 20, 7)
    return rounded(experiments.agreement_by_budget(choices, values))


def exact_states(spark: SparkSession, d: str) -> DataFrame:
    """Exact action values of the comparison states with small decision trees."""
    from ..operators import experiments

    names = ["hard 16 vs 10", "hard 17 vs A", "hard 15 vs 10", "three-card hard 16 vs 10"]
    s = experiments.states(spark, names)
    v = experiments.exact_values(s.repartition(4, "state"))
    return rounded(v.join(experiments.best_and_gap(v), "state").select("state", "action", "value", "best", "gap"))


def most_common(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.reports import most_common as ranked

    e = load(spark, d, "events", "event_id", "user_id")
    return ranked(e, "user_id", "event_id").select("user_id", "n", "first")


MOST_COMMON = "SELECT user_id, count(*)::BIGINT AS n, min(event_id) AS first FROM events GROUP BY 1"


def durations(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.reports import duration

    p = load(spark, d, "part", "p_partkey")
    seconds = F.when(F.col("p_partkey") % 10 == 0, None).otherwise(F.col("p_partkey") * F.col("p_partkey") / 8)
    return p.select("p_partkey", duration(seconds).alias("duration"))


DURATIONS = """
WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey * p_partkey / 8 END AS s FROM part)
SELECT p_partkey, CASE WHEN s IS NULL THEN 'unknown' WHEN s < 60 THEN printf('%.1fs', s) WHEN floor(floor(s) / 60) < 60 THEN printf('%dm %ds', floor(s)::BIGINT // 60, floor(s)::BIGINT % 60)
  ELSE printf('%dh %dm', floor(s)::BIGINT // 3600, floor(s)::BIGINT // 60 % 60) END AS duration FROM s
"""

QUERIES |= {
    "q_paired_shoes": (paired_shoes, None),
    "q_composition_samples": (composition_samples, COMPOSITION_SAMPLES),
    "q_dealer_settlement": (dealer_settlement, DEALER_SETTLEMENT),
    "q_sampling_error": (sampling_error, None),
    "q_exact_states": (exact_states, None),
    "q_most_common": (most_common, MOST_COMMON),
    "q_durations": (durations, DURATIONS),
}


def baseline_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of 60 shoes scored by the basic and the frequency baseline: overall, by kind
    and by target."""
    from ..operators import baselines, evaluation

    rows = rounds.shoe_decisions(rounds.shoes(spark, 60, 20250725).repartition(8, "shoe_id"))
    split = hashing.split_of(hashing.text_key("shoe_id"))
    train, held = rows.where(split == "train"), rows.where(split != "train")
    parts = []
    for name, scored in (("basic", baselines.basic(held)), ("frequency", baselines.frequency(train, held))):
        out = evaluation.accuracies(scored, "kind", "target", F.col("prediction") == F.col("target"))
        parts.append(rounded(out.select(F.lit(name).alias("baseline"), "level", "kind", "target", "rows", "hits", "accuracy")))
    return parts[0].unionByName(parts[1])


QUERIES |= {"q_baseline_accuracy": (baseline_accuracy, None)}


def labelled_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of four shoes with values, errors and targets of 1,000 rollouts an action."""
    from ..operators import labeling

    decisions = rounds.shoe_decisions(rounds.shoes(spark, 4, 20250725).repartition(4, "shoe_id"), with_state=True)
    out = labeling.labelled_decisions(decisions, 1_000, rounds.BET_OF)
    values = F.transform("action_values", lambda a: F.concat_ws(":", a["action"], F.round(a["value"], 6), F.round(a["error"], 6)))
    return out.select(
        "shoe_id", "round_index", "decision_index", "kind", "target_token", "behavior_token", r("half_kelly").alias("half_kelly"), F.array_join(values, " ").alias("action_values")
    )


def _small_shoes(spark: SparkSession) -> DataFrame:
    """Twelve shoes of some tens, nines, eights and twos."""
    i = F.col("id").cast("int")
    counts = [F.lit(0), 1 + i % 2, *[F.lit(0)] * 5, F.lit(2), 2 + F.floor(i / 4).cast("int"), F.lit(4)]
    return spark.range(12).select(F.col("id").alias("state"), F.array(*counts).alias("counts"))


def split_aces(spark: SparkSession, d: str) -> DataFrame:
    """Exact value of splitting aces against a six in small shoes."""
    from ..operators import solver

    states = _small_shoes(spark).select("state", "counts", F.array(F.lit(1), F.lit(1)).alias("hand"), F.lit(6).alias("upcard"))
    out = solver.solved_actions(states.repartition(4, "state")).where("action = 'split'")
    return out.select("state", F.round("value", 9).alias("value"))


SPLIT_ACES = """
WITH RECURSIVE s AS (SELECT range AS state, [0, 1 + range % 2, 0, 0, 0, 0, 0, 2, 2 + range // 4, 4] AS counts FROM range(12)),
a AS (SELECT state, list_transform(counts, lambda k, i: CASE WHEN i = h THEN k - 1 ELSE k END) AS counts, 6 + h AS hard, h = 1 AS ace, counts[h] / list_sum(counts) AS p FROM s, range(1, 11) t(h) WHERE counts[h] > 0),
b AS (SELECT state, list_transform(counts, lambda k, i: CASE WHEN i = c THEN k - 1 ELSE k END) AS counts, hard, ace, p * counts[c] / list_sum(counts) AS p, 11 + c AS one FROM a, range(1, 11) t(c) WHERE counts[c] > 0),
e AS (SELECT state, list_transform(counts, lambda k, i: CASE WHEN i = c THEN k - 1 ELSE k END) AS counts, hard, ace, p * counts[c] / list_sum(counts) AS p, one, 11 + c AS two FROM b, range(1, 11) t(c) WHERE counts[c] > 0),
w(state, one, two, hard, ace, p, counts, done) AS (
  SELECT state, one, two, hard, ace, p, counts, CASE WHEN ace AND hard + 10 <= 21 THEN hard + 10 >= 18 ELSE hard >= 17 END FROM e
  UNION ALL
  SELECT state, one, two, h, x, q, list_transform(counts, lambda k, i: CASE WHEN i = c THEN k - 1 ELSE k END), CASE WHEN x AND h + 10 <= 21 THEN h + 10 >= 18 ELSE h >= 17 END
  FROM (SELECT state, one, two, hard + c AS h, ace OR c = 1 AS x, p * counts[c] / list_sum(counts) AS q, counts, c FROM w, range(1, 11) r(c) WHERE NOT done AND counts[c] > 0)),
f AS (SELECT state, one, two, p, CASE WHEN hard > 21 THEN 0 WHEN ace AND hard + 10 <= 21 THEN hard + 10 ELSE hard END AS dealer FROM w WHERE done)
SELECT state, round(sum(p * (sign(one - dealer) + sign(two - dealer))), 9) AS value FROM f GROUP BY 1
"""


def solved_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Exact profits of whole rounds in small shoes of eights, nines and tens."""
    from ..operators import solver

    i = F.col("id").cast("int")
    counts = [*[F.lit(0)] * 7, 1 + i % 2, 2 + i % 3, 8 + i]
    states = spark.range(8).select(F.col("id").alias("state"), F.array(*counts).alias("counts"), F.lit(1).alias("unavailable"))
    return solver.solved_rounds(states.repartition(8, "state")).select("state", "half_units", F.round("p", 9).alias("p"))


QUERIES |= {
    "q_labelled_decisions": (labelled_decisions, None),
    "q_split_aces": (split_aces, SPLIT_ACES),
    "q_solved_rounds": (solved_rounds, None),
}
