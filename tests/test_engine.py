from __future__ import annotations

import math
import os
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import cards, hashing, kelly, stats
from tallyforge.operators import audit, distributions, draws, evaluation, labels, ordered, rounds, sampling, tokens, trajectory
from tallyforge.sources import decisions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# ---------------------------------------------------------------- hashing


def test_splitmix_matches_integers(spark):
    def step(x):
        m = (1 << 64) - 1
        v = (x + hashing.GAMMA) & m
        v = ((v ^ (v >> 30)) * hashing.MIX_1) & m
        v = ((v ^ (v >> 27)) * hashing.MIX_2) & m
        return v ^ (v >> 31)

    for x in (0, 1, 7, 2**31, 2**62, 2**63 - 1):
        got = one(spark, hashing.splitmix64(F.lit(x).cast("long"))) % (1 << 64)
        assert got == step(x)


def test_seed_is_the_first_eight_bytes(spark):
    import hashlib

    assert one(spark, hashing.seed64(F.lit("abc"))) == int.from_bytes(hashlib.sha256(b"abc").digest()[:8], "big")
    assert 0 <= one(spark, hashing.uniform(F.lit("abc"))) < 1


# ------------------------------------------------------------------ stats


def test_pooled_variance(spark):
    parts = spark.createDataFrame([(2.0, 1.0, 2), (6.0, 1.0, 2)], "mean double, standard_error double, sample_count long")
    r = stats.pooled(parts).first()
    assert r["mean"] == 4 and r["standard_error"] == pytest.approx(math.sqrt((20 / 3) / 4)) and r["sample_count"] == 4


def test_percentile_rules(spark):
    df = spark.range(1, 41).select(F.col("id").cast("double").alias("v"))
    a, b = (stats.numeric_summary(df, "v", rule=r).first() for r in ("truncated", "ceiling"))
    assert (a["p95"], b["p95"], a["median"], a["minimum"], a["maximum"], a["count"]) == (39, 38, 21, 1, 40, 40)
    with pytest.raises(ValueError):
        stats.rank_at("other", 0.5, F.lit(1))


def test_estimate_of_one_value_has_no_error(spark):
    r = spark.createDataFrame([(5.0,)], "v double").agg(*stats.estimate("v")).first()
    assert (r["standard_error"], r["ci_low"], r["ci_high"]) == (0, 5, 5)


# ------------------------------------------------------------------ kelly


def _outcomes(pairs):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(p)).alias("p")) for x, p in pairs])


def test_kelly(spark):
    assert one(spark, kelly.full_kelly(_outcomes([(-1, 0.4), (1, 0.6)]))) == pytest.approx(0.2, abs=1e-12)
    assert one(spark, kelly.full_kelly(_outcomes([(-1, 0.6), (1, 0.4)]))) == 0
    assert one(spark, kelly.full_kelly(_outcomes([(1, 1.0)]))) == 1
    assert one(spark, kelly.log_growth(_outcomes([(-1, 0.5), (1, 0.5)]), F.lit(1.0))) == -math.inf
    assert one(spark, kelly.nearest(F.lit(0.003), kelly.SELECTED_GRID)) == 0.001
    assert len(kelly.candidate_grids()) == 9 and kelly.candidate_grids()["fine"][-1] == 0.03


# ------------------------------------------------------------------ cards


@pytest.mark.parametrize(
    "ranks, total, soft",
    [("A K", 21, True), ("A A 9", 21, True), ("A 9 5", 15, False), ("10 6", 16, False), ("K Q 2", 22, False), ("A A A A", 14, True), ("5 5 A", 21, True)],
)
def test_hand_values(spark, ranks, total, soft):
    hand = F.array(*[cards.card_value(F.lit(x)) for x in ranks.split()])
    assert one(spark, cards.total(hand)) == total and one(spark, cards.is_soft(hand)) == soft


def _act(spark, hand, up, legal="hit stand double split surrender", count=None):
    h, l = F.array(*[F.lit(c) for c in hand]), F.array(*[F.lit(a) for a in legal.split()])
    return one(spark, cards.basic_action(h, F.lit(up), l) if count is None else cards.count_action(h, F.lit(up), l, F.lit(count)))


@pytest.mark.parametrize(
    "hand, up, action",
    [([10, 6], 10, "surrender"), ([8, 8], 9, "surrender"), ([8, 8], 8, "split"), ([1, 1], 1, "split"), ([1, 7], 2, "double"), ([1, 7], 9, "hit"), ([10, 2], 3, "hit"), ([10, 2], 4, "stand"), ([5, 6], 1, "double"), ([10, 10], 5, "stand"), ([9, 9], 7, "stand"), ([1, 8], 6, "double"), ([10, 7], 1, "surrender")],
)
def test_basic_table(spark, hand, up, action):
    assert _act(spark, hand, up) == action
    assert rounds._basic_choice(hand, up, "hit stand double split surrender".split()) == action


def test_basic_table_agrees_everywhere(spark):
    hands = [[a, b] for a in range(1, 11) for b in range(1, 11)] + [[a, b, c] for a in (1, 2, 5) for b in (2, 4, 7) for c in (1, 3, 9)]
    rows = [(h, u, l) for h in hands for u in range(1, 11) for l in (["hit", "stand"], ["hit", "stand", "double", "split", "surrender"][: 2 if len(h) > 2 else 5])]
    df = spark.createDataFrame(rows, "hand array<int>, up int, legal array<string>")
    for r in df.select("*", cards.basic_action(F.col("hand"), F.col("up"), F.col("legal")).alias("a")).collect():
        assert r["a"] == rounds._basic_choice(list(r["hand"]), r["up"], r["legal"]), r


def test_count_indices(spark):
    assert _act(spark, [10, 6], 10, "hit stand", 0) == "stand" and _act(spark, [10, 6], 10, "hit stand", -1) == "hit"
    assert _act(spark, [10, 10], 6, count=4) == "split" and _act(spark, [10, 10], 6, count=3) == "stand"
    assert _act(spark, [10, 5], 10, count=-1) == "hit" and _act(spark, [10, 5], 10, count=0) == "surrender"
    assert _act(spark, [10, 4], 10, count=3) == "surrender"
    assert one(spark, cards.true_count(F.lit(-1), F.lit(52))) == -1


def test_settlement(spark):
    def settle(player, dealer, gone=False, split=False):
        p, d = (F.array(*[F.lit(c) for c in x]) for x in (player, dealer))
        o = cards.outcome(p, d, F.lit(gone), F.lit(split))
        return one(spark, o), one(spark, cards.profit(o, F.lit(2.0))), one(spark, cards.payout(o, F.lit(2.0)))

    assert settle([1, 10], [10, 9]) == ("natural", 3, 5)
    assert settle([1, 10], [10, 9], split=True) == ("win", 2, 4)
    assert settle([1, 10], [1, 10]) == ("push", 0, 2)
    assert settle([10, 9], [1, 10]) == ("loss", -2, 0)
    assert settle([10, 6, 9], [10, 6, 9]) == ("bust", -2, 0)
    assert settle([10, 6], [10, 9], gone=True) == ("surrender", -1, 1)
    assert settle([10, 6], [10, 6, 8]) == ("win", 2, 4)


# --------------------------------------------------------- exact and rollouts


def _counts(*gone):
    c = list(cards.SIX_DECKS)
    for g in gone:
        c[g - 1] -= 1
    return tuple(c)


def test_published_values_of_sixteen_against_ten():
    v = rounds.action_values(_counts(10, 10, 6), (10, 6), 10)
    assert v["stand"] == pytest.approx(-0.540954, abs=5e-7)
    assert v["hit"] == pytest.approx(-0.534676, abs=5e-7)
    assert v["double"] == pytest.approx(-1.069351, abs=5e-7)


def test_dealer_against_exhaustive_fractions():
    counts = (1, 1, 0, 0, 2, 0, 0, 1, 0, 3)

    def play(c, hand):
        total = sum(hand) + (10 if 1 in hand and sum(hand) + 10 <= 21 else 0)
        soft = 1 in hand and sum(hand) + 10 <= 21
        if total > 21:
            return {"bust": Fraction(1)}
        if total > 17 or (total == 17 and not soft):
            return {str(total): Fraction(1)}
        out = {}
        for k in range(10):
            if c[k]:
                less = c[:k] + (c[k] - 1,) + c[k + 1 :]
                for o, p in play(less, hand + [k + 1]).items():
                    out[o] = out.get(o, 0) + p * Fraction(c[k], sum(c))
        return out

    want = {}
    for k in range(10):
        if counts[k]:
            less = counts[:k] + (counts[k] - 1,) + counts[k + 1 :]
            for o, p in play(less, [6, k + 1]).items():
                want[o] = want.get(o, 0) + p * Fraction(counts[k], sum(counts))
    got = dict(zip(("17", "18", "19", "20", "21", "bust", "natural"), rounds.dealer_distribution(counts, 6)))
    for o in got:
        assert got[o] == pytest.approx(float(want.get(o, 0)))


def test_rollouts_agree_with_exact_values():
    c = _counts(10, 10, 6)
    exact = rounds.action_values(c, (10, 6), 10)
    for action in ("stand", "hit", "double", "surrender"):
        p = rounds.simulate_action(c, (10, 6), 10, action, 5, 60_000) / 2
        assert p.mean() == pytest.approx(exact[action], abs=4 * p.std() / math.sqrt(len(p)) + 1e-9)


def test_rollouts_replay_and_bounds():
    a, b = (rounds.simulate_rounds(cards.SIX_DECKS, 1, 9, 4_000) for _ in range(2))
    assert (a == b).all() and a.min() >= -17 and a.max() <= 18
    assert (rounds.simulate_rounds(cards.SIX_DECKS, 1, 10, 4_000) != a).any()
    assert -0.03 < rounds.simulate_rounds(cards.SIX_DECKS, 1, 3, 60_000).mean() / 2 < 0.02
    with pytest.raises(ValueError):
        rounds.simulate_rounds([2] * 10, 0, 1, 10)


def test_shoe_rounds_match_rollout_rules(spark):
    s = rounds.shoes(spark, 6, 3)
    for r in s.collect():
        assert sorted(r["cards"]) == sorted(v for v in range(1, 11) for _ in range(cards.SIX_DECKS[v - 1]))
        assert 0.69 * 312 <= r["cut"] <= 0.8 * 312
    d = rounds.shoe_decisions(s)
    assert audit.gaps(d, "shoe_id", "decision_index").count() == 0
    assert d.where("NOT array_contains(legal, target)").count() == 0
    table = rounds.shoe_rounds(s)
    assert table.groupBy("shoe_id").agg(F.sum("decisions").alias("n")).join(d.groupBy("shoe_id").count(), "shoe_id").where("n <> count").count() == 0
    profit, log = rounds.Round([10, 6, 10, 10, 9], 0).play(rounds.basic_policy, [])
    assert profit == 1 and log[0][4] == "stand"


# -------------------------------------------------------------- operators


def test_running_sums_over_ranges(spark):
    rows = [(i, (i * 7919) % 500, i % 3, float(i % 11)) for i in range(2_000)]
    df = spark.createDataFrame(rows, "id long, o long, k long, v double").repartition(5)
    got = {r["id"]: r["s"] for r in ordered.running(df, F.col("o"), ["id"], {"s": F.col("v")}).collect()}
    at, want = 0.0, {}
    for i, o, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        at += v
        want[i] = at
    assert got == pytest.approx(want)
    kth = ordered.every_kth(df, F.col("o"), ["id"], 300)
    assert {r["row_index"] for r in kth.collect()} == {i for i in range(2_000) if i % 6 == 0} | {1_999}


def test_lag_and_balances(spark):
    df = spark.createDataFrame([(0, 1.0), (1, -1.0), (2, 0.5)], "i long, x double")
    out = trajectory.balances(df, F.col("i"), [], 1 + 0.001 * F.col("x"), 100.0).orderBy("i").collect()
    assert out[0]["balance_before"] == pytest.approx(100) and out[0]["balance_after"] == pytest.approx(100.1)
    assert out[2]["balance_before"] == pytest.approx(100.1 * 0.999)


def test_weights_and_apportionment(spark):
    df = spark.createDataFrame([("hit",)] * 4 + [("stand",)], "t string")
    got = {r["t"]: r["weight"] for r in sampling.balanced_weights(df, "t", 9.0).collect()}
    assert got == {"hit": 1, "stand": 2}
    assert {r["weight"] for r in sampling.balanced_weights(df, "t", 1.5).collect()} == {1, 1.5}
    assert sampling.apportion(10, [0.8, 0.1, 0.1]) == [8, 1, 1] and sampling.apportion(3, [0.8, 0.1, 0.1]) == [1, 1, 1]
    with pytest.raises(ValueError):
        sampling.apportion(2, [0.8, 0.1, 0.1])


def test_weighted_draws_follow_the_weights(spark):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(100)], "k long, w double")
    got = sampling.weighted_draws(df, "k", "w", 6_000, 3)
    assert got.count() == 6_000 and got.where("k % 4 = 0").count() == 0
    share = got.where("k % 4 = 3").count() / 6_000
    assert abs(share - 0.5) < 0.03


def test_permutation_keeps_the_items(spark):
    a = F.array(*[F.lit(i) for i in range(15)])
    p = one(spark, sampling.permuted_slice(a, F.lit(3), F.lit(8), F.lit("k")))
    assert p[:2] == [0, 1] and p[10:] == list(range(10, 15)) and sorted(p) == list(range(15)) and p != list(range(15))
    assert one(spark, sampling.padded(F.array(F.lit(1)), 3)) == [1, 0, 0]


def test_context_fit(spark):
    seq = "<HISTORY> 2 3 4 5 <CURRENT_HAND> <PLAYER> 10 <DEALER> 9 <PLAY_QUERY>".split()
    a = F.array(*[F.lit(t) for t in seq])
    assert one(spark, tokens.fitted(a, 9)) == [seq[0], *seq[3:]]
    assert one(spark, tokens.fitted(a, 11)) == seq
    with pytest.raises(Exception, match="longer than the window"):
        one(spark, tokens.fitted(a, 6))
    assert len(tokens.VOCABULARY) == 29
    with pytest.raises(Exception, match="unknown token"):
        one(spark, tokens.encode(F.array(F.lit("?"))))


def test_argmax_ties_and_masks(spark):
    v = F.array(*[F.lit(x) for x in (0.1, 0.7, 0.7, 0.2)])
    assert one(spark, evaluation.argmax(v)) == 1
    assert one(spark, evaluation.masked_argmax(v, F.array(F.lit(2), F.lit(1), F.lit(0)))) == 2
    assert one(spark, evaluation.regret(v, F.lit(3))) == pytest.approx(0.5)


def test_references_must_be_unique_and_there(spark):
    p = spark.createDataFrame([(1, 2)], "k long, c long")
    for r in ([(2, 1.0)], [(1, 1.0), (1, 2.0)]):
        with pytest.raises(Exception, match="not exactly one reference"):
            evaluation.referenced(p, spark.createDataFrame(r, "k long, v double"), "k").collect()


def test_paired_needs_equal_keys(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 3.0)], "k long, v double")
    assert evaluation.paired(a, a.withColumn("v", F.col("v") - 1), "k", "v").first()["verdict"] == "left"
    with pytest.raises(Exception, match="different keys"):
        evaluation.paired(a, a.where("k = 1"), "k", "v").collect()


def test_distribution_checks(spark):
    d = distributions.from_weights(spark.createDataFrame([(1, 0.5, 1.0), (1, 0.5, 1.0), (1, -1.0, 2.0), (1, 9.0, 0.0)], "k long, v double, w double"), ["k"], F.col("v"), F.col("w"))
    assert sorted((r["x"], r["p"]) for r in d.collect()) == [(-1, 0.5), (0.5, 0.5)]
    assert distributions.broken(d, ["k"]).count() == 0
    assert distributions.flat(distributions.nested(d, ["k"]), ["k"]).count() == 2


def test_draws_sum_to_one(spark):
    total = draws.opening_draws(draws.composition(spark, [1, 0, 2, 0, 0, 0, 0, 0, 0, 3])).agg(F.sum("p")).first()[0]
    assert total == pytest.approx(1)
    up = spark.range(1, 11).select(F.col("id").cast("int").alias("upcard"))
    sums = draws.hidden_hole_draws(draws.composition(spark), up).groupBy("upcard").agg(F.sum("p").alias("p")).collect()
    assert all(r["p"] == pytest.approx(1) for r in sums)
    with pytest.raises(ValueError):
        draws.composition(spark, [1])


def test_labels_are_computed_once(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "i long, s long")
    rows, table = labels.labelled(df, "play", ["s"], lambda s: s.withColumn("label", F.col("s") * 10))
    assert table.count() == 3 and rows.where("label <> s * 10").count() == 0
    again, both = labels.labelled(df.withColumn("s", F.col("s") + 1), "play", ["s"], lambda s: s.withColumn("label", F.col("s") * 10), known=table)
    assert both.count() == 4 and again.count() == 30 and labels.conflicts(both).count() == 0


# -------------------------------------------------------------- decision logs


def _decision(shoe, index, kind="play", split="train", target="<HIT>", **changed):
    action = {"token": "<HIT>", "expected_profit": {"numerator": 1, "denominator": 10}}
    other = {"token": "<STAND>", "expected_profit": {"numerator": 0, "denominator": 1}}
    meta = {"shoe_composition": [24] * 9 + [96], "unseen_unavailable": 1, "evaluation_method": "rational_exact_cdp", "legal_target_tokens": ["<HIT>", "<STAND>"], "action_values": [action, other]}
    row = {"schema_version": 6, "dataset_id": "d", "shoe_id": shoe, "shoe_seed": 2**63 + 5, "split": split, "round_index": 0, "decision_index": index, "kind": kind, "input_tokens": ["<HISTORY>"], "target_token": target, "behavior_token": "<HIT>", "metadata": meta | changed}
    return row


@pytest.fixture
def log(spark, tmp_path):
    import json

    def make(rows):
        for s in decisions.SPLITS:
            with open(tmp_path / f"{s}.jsonl", "w") as f:
                for r in rows:
                    if r["split"] == s or r.get("in") == s:
                        f.write(json.dumps({k: v for k, v in r.items() if k != "in"}) + "\n")
        return f"file://{tmp_path}"

    return make


def test_read_audit_and_write(spark, log, tmp_path):
    rows = [_decision(1, 0), _decision(1, 1), _decision(2, 0, split="validation"), _decision(3, 0, split="test")]
    df = decisions.read_decisions(spark, log(rows))
    assert df.count() == 4 and df.first()["shoe_seed"] == 2**63 + 5
    assert audit.faulty(df, audit.decision_faults()).count() == 0
    refs = decisions.references(df)
    assert {r["value"] for r in refs.collect()} == {0.1, 0.0}
    decisions.write_decisions(df, f"file://{tmp_path}/out")
    back = decisions.read_split(spark, f"file://{tmp_path}/out", "train")
    assert back.count() == 2
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    with pytest.raises(Exception):
        decisions.write_decisions(df, f"file://{tmp_path}/out")
    shards = df.select("shoe_id", "decision_index")
    assert decisions.assembled(df.select("shoe_id").distinct(), shards).count() == 4
    with pytest.raises(ValueError, match="shoe 3 has no shard"):
        decisions.assembled(df.select("shoe_id").distinct(), shards.where("shoe_id < 3"))


def test_negative_logs(spark, log):
    bad = [
        _decision(1, 0, target="<SPLIT>"),
        _decision(1, 1, shoe_composition=[1, 2]),
        _decision(1, 2, evaluation_method="seeded_monte_carlo_fixed_h17"),
        _decision(1, 3, legal_target_tokens=["<STAND>", "<HIT>"]),
        _decision(1, 3),
    ]
    df = decisions.read_decisions(spark, log(bad))
    got = {(r["decision_index"], f) for r in audit.faulty(df, audit.decision_faults()).collect() for f in r["faults"]}
    assert got == {(0, "target_legal"), (1, "composition"), (2, "round_rollouts"), (3, "legal_order")}
    assert audit.duplicates(df, "shoe_id", "decision_index").count() == 1
    assert audit.gaps(df, "shoe_id", "decision_index").count() == 1


def test_a_row_in_the_wrong_file_is_an_error(spark, log):
    with pytest.raises(Exception, match="is in the file of"):
        decisions.read_decisions(spark, log([_decision(1, 0) | {"in": "test"}])).collect()


def test_manifest_is_pinned(spark, tmp_path):
    folder = f"file://{tmp_path}/data"
    decisions.pinned(spark, folder, {"a": 1})
    decisions.pinned(spark, folder, {"a": 1})
    with pytest.raises(ValueError):
        decisions.pinned(spark, folder, {"a": 2})


def test_report_slices(spark, tmp_path):
    import json

    e = {"mean": 1.0, "standard_error": 0.5, "sample_count": 10}
    for i in range(3):
        data = {"shoe_count": 5, "simulation_seed": 1, "paired_advantage": e, "breakdowns": {"true_count": {"model": {"<=-3": e}}}}
        (tmp_path / f"r{i}.json").write_text(json.dumps(data | ({"shoe_start": 5 * i} if i else {})))
    s = decisions.report_slices(spark, f"file://{tmp_path}/*.json")
    assert sorted(r["shoe_start"] for r in s.collect()) == [0, 5, 10]
    assert trajectory.slice_gaps(s, "shoe_start", "shoe_count").count() == 0
    assert trajectory.slice_gaps(s.where("shoe_start <> 5"), "shoe_start", "shoe_count").count() == 1
    whole = evaluation.aggregated(s).first()
    assert whole["fits"] and whole["sample_count"] == 30 and whole["mean"] == 1 and whole["verdict"] == "model" and whole["shoes"] == 15
    assert not evaluation.aggregated(s.where("shoe_start <> 5")).first()["fits"]
    pooled = stats.pooled(decisions.breakdown_rows(s), "category", "policy", "bin").collect()
    assert len(pooled) == 1 and pooled[0]["sample_count"] == 30


# ------------------------------------------------------------------ catalogue

SMALL = "/root/testdata/sf0.001"


def _values(rows, columns):
    def text(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return f"{float(v):.7g}" if isinstance(v, (int, float, np.number)) or hasattr(v, "as_tuple") else str(v)

    return sorted(tuple(text(r[c]) for c in columns) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_queries_agree_with_their_sql(spark):
    import duckdb

    from tallyforge import catalogue

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    wrong = []
    for name, query in catalogue.QUERIES.items():
        df = query(spark, SMALL)
        rows = [r.asDict() for r in df.collect()]
        if name not in catalogue.SQL:
            assert rows, name
            continue
        found = con.sql(catalogue.SQL[name])
        columns = sorted(df.columns)
        if columns != sorted(found.columns):
            wrong.append(name)
            continue
        other = [dict(zip(found.columns, r)) for r in found.fetchall()]
        if _values(rows, columns) != _values(other, columns):
            wrong.append(name)
    assert not wrong


def test_quality_report(spark, log, tmp_path):
    import json

    from tallyforge.sources import reports

    rows = [_decision(1, 0), _decision(1, 1), _decision(2, 0, split="validation"), _decision(2, 0, split="validation")]
    parts = reports.quality(decisions.read_decisions(spark, log(rows)))
    assert parts["totals"].first()["shoes"] == 2 and parts["breaches"].where("what = 'duplicate'").count() == 1
    assert parts["margins"].first()["minimum"] == pytest.approx(0.1)
    report = reports.as_json(parts)
    held = json.loads(report.first()["value"])
    assert list(held) == sorted(parts) and held["totals"][0]["rows"] == 4
    reports.write_report(report, f"file://{tmp_path}/report")


def test_experiments(spark):
    from tallyforge.operators import experiments

    s = experiments.states(spark, ["hard 16 vs 10"])
    v = experiments.exact_values(s)
    best = experiments.best_and_gap(v).first()
    assert best["best"] == "surrender" and best["gap"] == pytest.approx(0.034676, abs=5e-7)
    samples = experiments.composition_samples(rounds.shoes(spark, 3, 1), 4, 2)
    assert samples.where("aggregate(counts, 0, (s, x) -> s + x) <> 312 - visible").count() == 0
    assert samples.count() == 12


def test_baselines(spark):
    from tallyforge.operators import baselines

    d = rounds.shoe_decisions(rounds.shoes(spark, 8, 4)).cache()
    plays = baselines.basic(d).where("kind = 'play'")
    assert plays.where("prediction <> target").count() == 0
    assert baselines.frequency(d, d).where("NOT array_contains(legal, prediction)").count() == 0
    top = baselines.frequency(d.where("kind = 'bet'"), d.where("kind = 'bet'")).select("prediction").distinct().collect()
    assert len(top) == 1
    level = F.when(F.col("kind") == "bet", F.when(F.col("target") == "high", 6).when(F.col("target") == "medium", 4).when(F.col("target") == "low", 2).otherwise(0)).otherwise(0)
    bets = baselines.counting(d.where("kind = 'bet'").withColumn("c", level), "c")
    assert bets.where("prediction <> target").count() == 0


def test_generation_stops_and_goes_on(spark, tmp_path):
    from tallyforge.operators import runner

    folder, s = f"file://{tmp_path}/run", rounds.shoes(spark, 6, 9)
    first = runner.generate(spark, folder, s, rounds.shoe_decisions, {"seed": 9}, 3, limit=2)
    assert first == {"shards": 3, "resumed": 0, "written": 2, "left": 1}
    with pytest.raises(ValueError, match="1 of 3 shards"):
        runner.assemble(spark, folder, s, 3)
    with pytest.raises(ValueError, match="another dataset"):
        runner.generate(spark, folder, s, rounds.shoe_decisions, {"seed": 10}, 3)
    assert runner.generate(spark, folder, s, rounds.shoe_decisions, {"seed": 9}, 3)["written"] == 1
    rows = runner.assemble(spark, folder, s, 3)
    whole = rounds.shoe_decisions(s)
    assert rows.exceptAll(whole).count() == 0 and whole.exceptAll(rows).count() == 0
