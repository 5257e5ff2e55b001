"""Experiments over shoes and states: paired policies, sampling error, composition samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cards as rules
from ..functions.hashing import text_key, uniform
from . import evaluation, rounds

#: The hands and dealer cards (ace 1) whose exact values are compared.
STATES = [
    ("hard 16 vs 10", (10, 6), 10),
    ("hard 16 vs 6", (10, 6), 6),
    ("hard 12 vs 4", (10, 2), 4),
    ("hard 11 vs 6", (5, 6), 6),
    ("hard 9 vs 2", (5, 4), 2),
    ("hard 12 vs 3", (7, 5), 3),
    ("hard 17 vs A", (10, 7), 1),
    ("hard 15 vs 10", (10, 5), 10),
    ("soft 18 vs 9", (1, 7), 9),
    ("soft 18 vs 6", (1, 7), 6),
    ("soft 17 vs 3", (1, 6), 3),
    ("soft 13 vs 5", (1, 2), 5),
    ("three-card hard 12 vs 2", (5, 3, 4), 2),
    ("three-card hard 16 vs 10", (10, 2, 4), 10),
]


def states(spark: SparkSession, only: list[str] | None = None) -> DataFrame:
    """The comparison states: state, name, counts (hand and upcard gone), hand, upcard, legal."""
    rows = []
    for i, (name, hand, up) in enumerate(STATES):
        counts = list(rules.SIX_DECKS)
        for c in (*hand, up):
            counts[c - 1] -= 1
        legal = ["hit", "stand"] + (["double", "surrender"] if len(hand) == 2 else [])
        if only is None or name in only:
            rows.append((i, name, counts, list(hand), up, legal))
    return spark.createDataFrame(rows, "state long, name string, counts array<int>, hand array<int>, upcard int, legal array<string>")


def exact_values(rows: DataFrame) -> DataFrame:
    """state -> action, value (in wagers), by exact recursion; one state a task at a time."""

    def run(frames):
        for f in frames:
            out = [
                (s, a, v)
                for s, c, h, u, legal in zip(f["state"], f["counts"], f["hand"], f["upcard"], f["legal"])
                for a, v in rounds.action_values(tuple(int(x) for x in c), tuple(int(x) for x in h), int(u)).items()
                if a in set(legal)
            ]
            yield pd.DataFrame(out, columns=["state", "action", "value"])

    return rows.select("state", "counts", "hand", "upcard", "legal").mapInPandas(run, "state long, action string, value double")


def best_and_gap(values: DataFrame) -> DataFrame:
    """Best action of each state and its margin over the next."""
    top = F.sort_array(F.collect_list(F.struct("value", "action")), asc=False)
    return values.groupBy("state").agg(top.alias("t")).select(
        "state", F.col("t")[0]["action"].alias("best"), F.col("t")[0]["value"].alias("best_value"), (F.col("t")[0]["value"] - F.col("t")[1]["value"]).alias("gap")
    )


def sampled_choices(dist: DataFrame, budgets: list[int], replications: int, seed: int) -> DataFrame:
    """Draws of each action's distribution (state, actions array<struct<action, x, p>>): for
    each state, budget and replication the action with the largest sample mean. A cell has
    its own seed, so cells run anywhere in any order."""

    def run(frames):
        for f in frames:
            out = []
            for s, actions, budget, rep in zip(f["state"], f["actions"], f["budget"], f["replication"]):
                rng = np.random.default_rng([seed, int(s), int(budget), int(rep)])
                means = [
                    (float(rng.multinomial(int(budget), np.asarray(a["p"], float) / np.sum(a["p"])) @ np.asarray(a["x"], float)) / budget, -i, a["action"])
                    for i, a in enumerate(actions)
                ]
                out.append((s, budget, rep, max(means)[2]))
            yield pd.DataFrame(out, columns=["state", "budget", "replication", "choice"])

    cells = dist.select("state", "actions", F.explode(F.array(*[F.lit(b) for b in budgets])).alias("budget"))
    cells = cells.withColumn("replication", F.explode(F.sequence(F.lit(0), F.lit(replications - 1))))
    return cells.mapInPandas(run, "state long, budget long, replication long, choice string")


def agreement_by_budget(choices: DataFrame, values: DataFrame, material: float = 0.01) -> DataFrame:
    """Per budget: agreement with the best action, overall and where the gap is material, and
    the regret of the choices."""
    best = best_and_gap(values)
    rows = choices.join(best, "state").join(values.withColumnRenamed("action", "choice"), ["state", "choice"])
    same, matters = F.col("choice") == F.col("best"), F.col("gap") >= material
    rows = rows.withColumn("regret", F.col("best_value") - F.col("value"))
    return rows.groupBy("budget").agg(
        F.count(F.lit(1)).alias("comparisons"),
        F.avg(same.cast("int")).alias("agreement"),
        F.count_if(matters).alias("material_comparisons"),
        F.try_divide(F.count_if(matters & same), F.count_if(matters)).alias("material_agreement"),
        F.avg("regret").alias("mean_regret"),
        F.max("regret").alias("maximum_regret"),
    )


def composition_samples(shoe_rows: DataFrame, strata: int, seed: int) -> DataFrame:
    """From each shoe one composition a stratum of its visible part: shoe_id, stratum,
    visible, penetration, counts of what is left."""
    cells = shoe_rows.withColumn("stratum", F.explode(F.sequence(F.lit(0), F.lit(strata - 1))))
    most = F.greatest(F.lit(0), F.col("cut") - 5)
    low, high = F.floor(most * F.col("stratum") / strata), F.floor(most * (F.col("stratum") + 1) / strata)
    u = uniform(text_key(F.lit(seed), "shoe_id", "stratum"))
    cells = cells.withColumn("visible", (low + F.floor(u * (F.greatest(low, high) - low + 1))).cast("int"))
    seen = F.slice("cards", F.lit(1), F.col("visible"))

    def left(value: int) -> Column:
        return F.lit(rules.SIX_DECKS[value - 1]) - F.size(F.filter(seen, lambda c: c == value))

    counts = F.array(*[left(v) for v in range(1, 11)])
    return cells.select("shoe_id", "stratum", "visible", (F.col("visible") / rules.CARDS_IN_SHOE).alias("penetration"), counts.alias("counts"))


def log_growth(rows: DataFrame, fraction: Column, policy: str) -> DataFrame:
    """Log growth of a bankroll by shoe under a bet."""
    return rows.groupBy("shoe_id").agg(F.sum(F.ln(1 + fraction * F.col("profit"))).alias("growth")).withColumn("policy", F.lit(policy))


def paired_shoes(shoe_rows: DataFrame, flat: float = 0.001) -> DataFrame:
    """Betting by the count against a flat bet over the same shoes: mean difference of log
    growth by shoe, its interval and the verdict."""
    played = rounds.shoe_rounds(shoe_rows)
    counted, same = log_growth(played, F.col("bet"), "count"), log_growth(played, F.lit(flat), "flat")
    return evaluation.paired(counted, same, "shoe_id", "growth")


def settled(hands: DataFrame, dealer: DataFrame) -> DataFrame:
    """Return distribution of finished hands (key, total, wager) against dealer outcomes
    (outcome, p; seven rows): key, x, p."""
    score = F.when(F.col("outcome").isin("bust"), 0).when(F.col("outcome") == "natural", 99).otherwise(F.col("outcome").try_cast("int"))
    rows = hands.crossJoin(F.broadcast(dealer.withColumn("score", score)))  # seven rows
    x = F.when(F.col("total") > 21, -F.col("wager")).when(F.col("total") > F.col("score"), F.col("wager")).when(F.col("total") == F.col("score"), F.lit(0.0)).otherwise(-F.col("wager"))
    return rows.groupBy("key", x.alias("x")).agg(F.sum("p").alias("p"))
