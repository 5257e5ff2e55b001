"""Exact values of rounds with splits: every line of play, every card, weighed by its chance.

A round is what is left of the shoe, the upcard, the hand to play, hands that wait and hands
that are finished. Its value is a distribution of the whole round's profit, since all hands
meet one dealer; the best action is that of the greatest mean, of equal ones the first in the
order hit, stand, double, split, surrender. Lines that meet in one state are computed once.

Chances are floats, or fractions where ``exact`` is asked for. The number of states grows with
the cards left: it is meant for shoes near their end and for late hands of full ones.

Rules are those of ``rounds``. Profits are in half wagers.
"""

from __future__ import annotations

from collections.abc import Iterable
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from .rounds import _hole_ok, _less, _total

ORDER = ("hit", "stand", "double", "split", "surrender")
Distribution = tuple[tuple[int, float | Fraction], ...]
_STATES = 400_000


class Hand(NamedTuple):
    """Its sum with aces as one, its aces, its cards, the card of a pair (else 0), its wager in
    half units, and whether it comes from a split."""

    hard: int
    aces: int
    cards: int
    pair: int
    wager: int = 2
    split: bool = False

    @classmethod
    def of(cls, cards: Iterable[int], wager: int = 2, split: bool = False) -> Hand:
        cards = list(cards)
        pair = cards[0] if len(cards) == 2 and cards[0] == cards[1] else 0
        return cls(sum(cards), cards.count(1), len(cards), pair, wager, split)

    def total(self) -> int:
        return _total(self.hard, self.aces)[0]

    def plus(self, card: int, times: int = 1) -> Hand:
        pair = card if self.cards == 1 and self.hard == card else 0
        return Hand(self.hard + card, self.aces + (card == 1), self.cards + 1, pair, self.wager * times, self.split)


class Finished(NamedTuple):
    """What the dealer's cards decide about a hand; in the order that stands for all orders."""

    gone: bool
    bust: bool
    total: int
    wager: int

    @classmethod
    def of(cls, hand: Hand, gone: bool = False) -> Finished:
        total = hand.total()
        return cls(gone, total > 21, 0 if gone or total > 21 else total, hand.wager)

    def profit(self, dealer: int) -> int:
        """``dealer``: a total, 0 when bust."""
        if self.gone:
            return -self.wager // 2
        if self.bust or self.total < dealer:
            return -self.wager
        return self.wager if self.total > dealer else 0


def mixed(parts: Iterable[tuple[float | Fraction, Distribution]]) -> Distribution:
    out: dict = {}
    for chance, part in parts:
        for x, p in part:
            out[x] = out.get(x, 0) + chance * p
    return tuple(sorted(out.items()))


def shifted(part: Distribution, by: int) -> Distribution:
    return tuple((x + by, p) for x, p in part)


def mean(part: Distribution) -> float | Fraction:
    return sum(x * p for x, p in part)


class Solver:
    """Solves rounds for one upcard rule set; holds what it has solved."""

    def __init__(self, hands: int = 4, exact: bool = False):
        self.hands, self.exact = hands, exact
        for name in ("dealer", "after", "best"):
            setattr(self, name, lru_cache(maxsize=_STATES)(getattr(self, f"_{name}")))

    def chance(self, n: int, of: int):
        return Fraction(n, of) if self.exact else n / of

    def draws(self, counts: tuple[int, ...], up: int):
        """Visible cards while the hole card is hidden and is no natural's."""
        all_, eligible = sum(counts), sum(n for c, n in enumerate(counts, 1) if _hole_ok(c, up, True))
        for card, n in enumerate(counts, 1):
            top = n * (eligible - (n > 0 and _hole_ok(card, up, True)))
            if top > 0:
                yield card, self.chance(top, eligible * (all_ - 1)), _less(counts, card)

    def _dealer(self, counts: tuple[int, ...], hard: int, aces: int) -> Distribution:
        """Totals of a dealer who plays on from two cards or more; 0 is bust."""
        total, soft = _total(hard, aces)
        if total > 17 or (total == 17 and not soft):
            return ((total if total <= 21 else 0, self.chance(1, 1)),)
        left = sum(counts)
        if not left:
            raise ValueError("the dealer must draw and no card is left")
        return mixed(
            (self.chance(n, left), self.dealer(_less(counts, c), hard + c, aces + (c == 1))) for c, n in enumerate(counts, 1) if n
        )

    def _settled(self, counts: tuple[int, ...], up: int, finished: tuple[Finished, ...]) -> Distribution:
        if all(h.gone or h.bust for h in finished):
            return ((sum(h.profit(0) for h in finished), self.chance(1, 1)),)
        eligible = sum(n for c, n in enumerate(counts, 1) if _hole_ok(c, up, True))
        if not eligible:
            raise ValueError("no hole card is possible")
        totals = mixed(
            (self.chance(n, eligible), self.dealer(_less(counts, c), up + c, (up == 1) + (c == 1)))
            for c, n in enumerate(counts, 1)
            if n and _hole_ok(c, up, True)
        )
        return mixed((p, ((sum(h.profit(t) for h in finished), self.chance(1, 1)),)) for t, p in totals)

    def _after(self, counts, up: int, waiting: tuple[Hand, ...], finished: tuple[Finished, ...]) -> Distribution:
        """The round once the hand to play is done with."""
        if waiting:
            return self.best(counts, up, waiting[0], waiting[1:], finished)
        return self._settled(counts, up, finished)

    def legal(self, hand: Hand, others: int) -> list[str]:
        """Of a hand to play; split aces never are, they take their card and are finished."""
        if hand.total() >= 21:
            return []
        two = hand.cards == 2
        may = {"hit": True, "stand": True, "double": two, "surrender": two and not hand.split}
        may["split"] = two and hand.pair > 0 and others + 1 < self.hands
        return [a for a in ORDER if may[a]]

    def actions(self, counts, up: int, hand: Hand, waiting=(), finished=()) -> dict[str, Distribution]:
        """The round's distribution for each legal action, played best from there on."""
        others = len(waiting) + len(finished)
        return {a: self.act(counts, up, hand, tuple(waiting), tuple(sorted(finished)), a) for a in self.legal(hand, others)}

    def act(self, counts, up: int, hand: Hand, waiting, finished, action: str) -> Distribution:
        done = lambda h, gone=False: tuple(sorted((*finished, Finished.of(h, gone))))
        if action == "stand":
            return self.after(counts, up, waiting, done(hand))
        if action == "surrender":
            return self.after(counts, up, waiting, done(hand, True))
        if action == "hit":
            return mixed((p, self.best(left, up, hand.plus(c), waiting, finished)) for c, p, left in self.draws(counts, up))
        if action == "double":
            return mixed((p, self.after(left, up, waiting, done(hand.plus(c, 2)))) for c, p, left in self.draws(counts, up))
        base = Hand(hand.pair, hand.pair == 1, 1, 0, hand.wager, True)
        parts = []
        for c, p, left in self.draws(counts, up):
            for d, q, rest in self.draws(left, up):
                one, two = base.plus(c), base.plus(d)
                if hand.pair == 1:  # one card on each ace
                    both = tuple(sorted((*finished, Finished.of(one), Finished.of(two))))
                    parts.append((p * q, self.after(rest, up, waiting, both)))
                else:
                    parts.append((p * q, self.best(rest, up, one, (two, *waiting), finished)))
        return mixed(parts)

    def _best(self, counts, up: int, hand: Hand, waiting: tuple[Hand, ...], finished: tuple[Finished, ...]) -> Distribution:
        found = None
        for a in self.legal(hand, len(waiting) + len(finished)):
            part = self.act(counts, up, hand, waiting, finished, a)
            if found is None or mean(part) > mean(found):
                found = part
        return found if found is not None else self.after(counts, up, waiting, tuple(sorted((*finished, Finished.of(hand)))))

    def round(self, counts: tuple[int, ...], unavailable: int = 1) -> Distribution:
        """A whole round before it is dealt; insurance is taken where it is worth more. The
        unavailable cards are among the counted ones, and nobody knows which they are."""
        if sum(counts) <= unavailable + 3:
            raise ValueError("too few cards for a round")
        every, parts = sum(counts), []
        for a, n in enumerate(counts, 1):
            one = _less(counts, a) if n else None
            for u, m in enumerate(one or (), 1):
                two = _less(one, u) if m else None
                for b, k in enumerate(two or (), 1):
                    if k:
                        p = self.chance(n, every) * self.chance(m, every - 1) * self.chance(k, every - 2)
                        parts.append((p, self._dealt(_less(two, b), u, (a, b))))
        return mixed(parts)

    def _dealt(self, counts: tuple[int, ...], up: int, cards: tuple[int, int]) -> Distribution:
        left = sum(counts)
        tens_or_aces = counts[9] if up == 1 else counts[0] if up == 10 else 0
        natural = self.chance(tens_or_aces, left)
        insured = up == 1 and 3 * counts[9] > left
        hand = Hand.of(cards)
        mine = hand.total() == 21
        parts = []
        if tens_or_aces:
            parts.append((natural, (((0 if mine else -2) + (2 if insured else 0), self.chance(1, 1)),)))
        if tens_or_aces < left:
            rest = ((3, self.chance(1, 1)),) if mine else self.best(counts, up, hand, (), ())
            parts.append((1 - natural, shifted(rest, -1 if insured else 0)))
        return mixed(parts)


def solved_actions(states: DataFrame, hands: int = 4) -> DataFrame:
    """States (state, counts, hand array<int>, upcard) after a peek -> state, action, value (in
    wagers), best."""

    def run(frames):
        for f in frames:
            solver = Solver(hands)
            rows = []
            for s, c, h, u in zip(f["state"], f["counts"], f["hand"], f["upcard"]):
                found = solver.actions(tuple(int(x) for x in c), int(u), Hand.of(int(x) for x in h))
                top = max(mean(d) for d in found.values())
                best = next(a for a, d in found.items() if mean(d) == top)
                rows += [(s, a, mean(d) / 2, a == best) for a, d in found.items()]
            yield pd.DataFrame(rows, columns=["state", "action", "value", "best"])

    return states.select("state", "counts", "hand", "upcard").mapInPandas(run, "state long, action string, value double, best boolean")


def solved_rounds(states: DataFrame, hands: int = 4) -> DataFrame:
    """Shoes (state, counts, unavailable) before a deal -> state, half_units, p."""

    def run(frames):
        for f in frames:
            solver = Solver(hands)
            rows = [
                (s, x, float(p))
                for s, c, n in zip(f["state"], f["counts"], f["unavailable"])
                for x, p in solver.round(tuple(int(x) for x in c), int(n))
                if p
            ]
            yield pd.DataFrame(rows, columns=["state", "half_units", "p"])

    return states.select("state", "counts", "unavailable").mapInPandas(run, "state long, half_units int, p double")
