"""Exact rounds with splits against published cases, the plain recursion and brute force."""

from __future__ import annotations

import itertools
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import rounds
from tallyforge.operators.solver import Finished, Hand, Solver, mean, solved_actions, solved_rounds


def shoe(**n):
    """Counts of 1..10 from names such as c8=3."""
    return tuple(n.get(f"c{v}", 0) for v in range(1, 11))


@pytest.mark.parametrize(
    "hand, up, counts, action, sure",
    [
        ((10, 6), 10, shoe(c10=8), "surrender", -1),
        ((5, 6), 6, shoe(c10=8), "double", 4),
        ((5, 6), 6, shoe(c10=8), "hit", 2),
        ((8, 8), 6, shoe(c10=8), "split", 4),
        ((1, 1), 6, shoe(c10=6), "split", 4),
    ],
)
def test_sure_outcomes(hand, up, counts, action, sure):
    found = Solver(exact=True).actions(counts, up, Hand.of(hand))
    assert found[action] == ((sure, 1),)


def test_legal_actions():
    s = Solver()
    assert s.legal(Hand.of((5, 6), split=True), 1) == ["hit", "stand", "double"]
    assert s.legal(Hand.of((8, 8)), 0) == ["hit", "stand", "double", "split", "surrender"]
    assert "split" not in s.legal(Hand.of((8, 8), split=True), 3) and s.legal(Hand.of((1, 10)), 0) == []
    assert s.legal(Hand.of((2, 3, 4)), 0) == ["hit", "stand"]


def test_whole_rounds():
    assert Solver(exact=True).round(shoe(c10=30)) == ((0, 1),)
    mixed = Solver(hands=1, exact=True).round(shoe(c1=6, c10=20))
    assert sum(p for _, p in mixed) == 1 and len(mixed) > 1
    with pytest.raises(ValueError, match="too few"):
        Solver().round(shoe(c10=4))


def test_the_plain_recursion_gives_the_same_values():
    counts = [24] * 9 + [96]
    for c in (10, 6, 10):
        counts[c - 1] -= 1
    plain = rounds.action_values(tuple(counts), (10, 6), 10)
    found = Solver().actions(tuple(counts), 10, Hand.of((10, 6)))
    for a in ("hit", "stand", "double", "surrender"):
        assert abs(mean(found[a]) / 2 - plain[a]) < 1e-12
    assert abs(mean(found["hit"]) / 2 + 0.5352) < 5e-3 and max(found, key=lambda a: mean(found[a])) == "surrender"


def played_out(counts, up, hand, split_to, solver):
    """The mean of splitting once, with every order of the cards dealt one by one: the hole card
    first, then the two cards; hands of 17 or more stand, so that nothing else is drawn."""
    deck = [v for v, n in enumerate(counts, 1) for _ in range(n)]
    total = n = Fraction(0)
    for order in itertools.permutations(range(len(deck))):
        hole, *rest = (deck[i] for i in order)
        if {hole, up} == {1, 10}:
            continue
        one, two = Hand.of((hand, rest[0]), split=True), Hand.of((hand, rest[1]), split=True)
        dealer, at = [up, hole], 2
        while True:
            t, soft = rounds._total(sum(dealer), dealer.count(1))
            if t > 17 or (t == 17 and not soft):
                break
            dealer.append(rest[at])
            at += 1
        t = t if t <= 21 else 0
        total += Finished.of(one).profit(t) + Finished.of(two).profit(t)
        n += 1
    return total / n


def test_split_aces_by_all_orders_of_the_cards():
    counts = shoe(c8=2, c9=2, c10=2, c2=1)
    solver = Solver(exact=True)
    found = solver.actions(counts, 6, Hand.of((1, 1)))["split"]
    assert mean(found) == played_out(counts, 6, 1, 2, solver) and sum(p for _, p in found) == 1


def test_rounds_agree_with_rollouts():
    counts = shoe(c8=4, c9=4, c10=16)
    exact = mean(Solver().round(counts))
    assert sum(p for _, p in Solver().round(counts)) == pytest.approx(1)
    # best play is worth no less than the basic table's
    played = rounds.simulate_rounds(counts, 1, 5, 40_000)
    assert exact > played.mean() - 4 * played.std() / np.sqrt(len(played))


def test_states_as_rows(spark):
    rows = [(1, list(shoe(c10=8)), [8, 8], 6), (2, list(shoe(c10=8)), [5, 6], 6)]
    got = {(r["state"], r["action"]): (r["value"], r["best"]) for r in solved_actions(spark.createDataFrame(rows, "state long, counts array<int>, hand array<int>, upcard int")).collect()}
    assert got[1, "split"] == (2.0, True) and got[2, "double"] == (2.0, True) and not got[2, "hit"][1]
    table = spark.createDataFrame([(1, list(shoe(c10=30)), 1)], "state long, counts array<int>, unavailable int")
    assert [tuple(r) for r in solved_rounds(table).collect()] == [(1, 0, 1.0)]
    assert solved_rounds(table.where(F.lit(False))).count() == 0
