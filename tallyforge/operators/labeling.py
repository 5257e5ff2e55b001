"""Labels of decisions by rollouts: values, errors and the target of every distinct situation.

A situation is what is left of the shoe, the hand in order of its cards, the upcard and the
round's other hands. Each distinct one is computed once (``labels.labelled``), from a seed of
its own content, so that labels don't depend on which shoe or task met it.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kelly
from ..functions.cards import canonical_hand
from ..functions.hashing import seed64
from . import draws, rounds
from .labels import labelled

SITUATION = ["left", "hand", "upcard", "wager", "split", "waiting", "finished", "legal"]
LABEL = "target string, half_kelly double, action_values array<struct<action: string, value: double, error: double>>"


def _seed(key):
    return (seed64(key) % 9007199254740993).cast("long")


def _error(x: np.ndarray) -> float:
    """Population standard error, in wagers."""
    return float(x.std() / np.sqrt(len(x)) / 2)


def play_labels(states: DataFrame, rollouts: int, unavailable: int = 2) -> DataFrame:
    """(key, situation) -> key, label as JSON. All actions of a state share a seed, so their
    differences have less noise than they have; of equal values the first legal action wins."""

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                waiting = [tuple(int(c) for c in h) for h in r.waiting]
                finished = [(bool(h["surrendered"]), int(h["total"]), int(h["wager"])) for h in r.finished]
                values = []
                for a in r.legal:
                    x = rounds.simulate_action(
                        [int(c) for c in r.left], tuple(int(c) for c in r.hand), int(r.upcard), a, int(r.seed), rollouts,
                        unavailable, int(r.wager), bool(r.split), waiting, finished,
                    )
                    values.append({"action": a, "value": float(x.mean() / 2), "error": _error(x)})
                best = max(v["value"] for v in values)
                target = next(v["action"] for v in values if v["value"] == best)
                out.append((r.key, json.dumps({"target": target, "action_values": values})))
            yield pd.DataFrame(out, columns=["key", "label"])

    rows = states.withColumn("seed", _seed(F.col("key"))).select("key", *SITUATION, "seed")
    return rows.mapInPandas(run, "key string, label string")


def bet_labels(states: DataFrame, rollouts: int, fractions: dict[str, float], unavailable: int = 1) -> DataFrame:
    """(key, left) -> key, label as JSON: half the growth-optimal fraction of the rollouts'
    returns, and the bet nearest to it (of two, the smaller)."""
    rows = states.select(
        F.col("key").alias("state_key"), F.col("left").alias("counts"), F.lit(unavailable).alias("unavailable"), _seed(F.col("key")).alias("seed")
    ).withColumn("state", F.xxhash64("state_key"))

    def run(frames):
        for f in frames:
            for k, c, u, seed in zip(f["state_key"], f["counts"], f["unavailable"], f["seed"]):
                values, n = np.unique(rounds.simulate_rounds([int(x) for x in c], int(u), int(seed), rollouts), return_counts=True)
                yield pd.DataFrame({"key": k, "x": [(values / 2).tolist()], "p": [(n / rollouts).tolist()]})

    returns = rows.mapInPandas(run, "key string, x array<double>, p array<double>")
    outcomes = F.arrays_zip("x", "p")
    half = kelly.full_kelly(outcomes) / 2
    names = F.create_map(*[F.lit(v) for token, x in fractions.items() for v in (float(x), token)])
    target = names[kelly.nearest(half, list(fractions.values()))]
    return returns.select("key", F.to_json(F.struct(target.alias("target"), half.alias("half_kelly"))).alias("label"))


def labelled_decisions(decisions: DataFrame, rollouts: int, fractions: dict[str, float]) -> DataFrame:
    """Decisions with their situation (``rounds.shoe_decisions`` with state) and their labels:
    target_token, half_kelly (bets), action_values (plays and insurance)."""
    rows = decisions.withColumn("hand", canonical_hand(F.col("hand")))
    bets, _ = labelled(rows.where("kind = 'bet'"), "bet", ["left"], lambda s: bet_labels(s, rollouts, fractions))
    plays, _ = labelled(rows.where("kind = 'play'"), "play", SITUATION, lambda s: play_labels(s, rollouts))
    tens, left = F.col("left")[9], F.aggregate("left", F.lit(0), lambda s, c: s + c)
    value, choice = draws.insurance(tens / left)
    both = F.array(
        *[
            F.struct(F.lit(a).alias("action"), v.cast("double").alias("value"), F.lit(0.0).alias("error"))
            for a, v in (("<INSURANCE>", value), ("<NO_INSURANCE>", F.lit(0.0)))
        ]
    )
    insurances = rows.where("kind = 'insurance'").withColumn("label", F.to_json(F.struct(choice.alias("target"), both.alias("action_values"))))
    every = bets.drop("key").unionByName(plays.drop("key")).unionByName(insurances)
    label = F.from_json("label", LABEL)
    return every.select(
        "shoe_id", "round_index", "decision_index", "kind", "hand", "upcard", "legal",
        F.col("target").alias("behavior_token"), label["target"].alias("target_token"), label["half_kelly"].alias("half_kelly"),
        label["action_values"].alias("action_values"),
    )
