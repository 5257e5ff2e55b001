"""Labels of decisions by rollouts."""

from __future__ import annotations

import numpy as np
import pytest

from tallyforge.operators import labeling, rounds
from tallyforge.operators.solver import Finished, Hand, Solver, mean


def test_rollouts_with_other_hands_agree_with_exact_values():
    """Eights split: one hand stands at 18, one waits; all meet the same dealer. Few cards but
    tens, so that the basic table plays as the solver does."""
    counts = (0, 0, 0, 0, 0, 0, 0, 2, 4, 20)
    done = Finished.of(Hand.of((8, 10), split=True))
    exact = Solver().actions(counts, 7, Hand.of((8, 10), split=True), [Hand.of((8, 9), split=True)], [done])["stand"]
    x = rounds.simulate_action(counts, (8, 10), 7, "stand", 3, 60_000, 1, 2, True, [(8, 9)], [(False, 18, 2)])
    assert abs(x.mean() - mean(exact)) < 5 * x.std() / np.sqrt(len(x))
    lost = rounds.simulate_action(counts, (8, 10), 6, "stand", 3, 1_000, 1, 2, True, [], [(False, 24, 4), (True, 16, 2)])
    alone = rounds.simulate_action(counts, (8, 10), 6, "stand", 3, 1_000, 1, 2, True)
    assert (lost == alone - 4 - 1).all()


def test_bounded_draws_are_uniform():
    g = rounds.Rollouts([24] * 9 + [96], 1, 200_000)
    x = g.below(g.rows, np.full(g.n, 7, np.uint64))
    assert np.bincount(x.astype(int), minlength=7).min() > 200_000 / 7 * 0.97
    top = np.uint64((1 << 63) + 1)  # nearly half of all outputs must be drawn again
    y = g.below(g.rows, np.full(g.n, top, np.uint64)).astype(float)
    assert y.max() <= float(top) and abs(y.mean() / float(top) - 0.5) < 0.01


@pytest.fixture(scope="module")
def rows(spark):
    shoes = rounds.shoes(spark, 2, 7)
    decisions = rounds.shoe_decisions(shoes, with_state=True)
    return decisions.collect(), labeling.labelled_decisions(decisions, 200, rounds.BET_OF).collect()


def test_every_decision_has_its_label(rows):
    decisions, found = rows
    key = lambda r: (r["shoe_id"], r["decision_index"])
    assert sorted(map(key, decisions)) == sorted(map(key, found))
    for r in found:
        if r["kind"] == "bet":
            assert r["target_token"] in rounds.BET_OF and 0 <= r["half_kelly"] <= 0.5
            continue
        assert [a["action"] for a in r["action_values"]] == r["legal"]
        values = [a["value"] for a in r["action_values"]]
        assert r["target_token"] == r["legal"][values.index(max(values))] or r["kind"] == "insurance"
        assert all(a["error"] >= 0 for a in r["action_values"])


def test_states_account_for_every_card(rows):
    for r in rows[0]:
        if r["kind"] == "bet":
            assert sum(r["left"]) <= 312 and not r["waiting"] and not r["finished"]
        elif r["kind"] == "play":
            assert min(r["left"]) >= 0 and 1 + len(r["waiting"]) + len(r["finished"]) <= rounds.HANDS
            assert r["split"] or not (r["waiting"] or r["finished"])


def test_labels_replay(spark):
    decisions = rounds.shoe_decisions(rounds.shoes(spark, 1, 3), with_state=True).where("decision_index < 12")
    once, again = ({(r["decision_index"], str(r)) for r in labeling.labelled_decisions(x, 100, rounds.BET_OF).collect()} for x in (decisions, decisions.repartition(3)))
    assert once == again
