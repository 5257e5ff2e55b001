"""Card game rules as columns. A card is a value from 1 (ace) to 10; a hand is an array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CARDS_IN_SHOE = 312
DECK = 52
#: Count of each value 1..10 in six decks.
SIX_DECKS = [24] * 9 + [96]


def card_value(rank: Column) -> Column:
    """Value of a rank label: A is 1; J, Q and K are 10."""
    return F.when(rank == "A", 1).when(rank.isin("J", "Q", "K"), 10).otherwise(rank.try_cast("int"))


def hard_total(hand: Column) -> Column:
    return F.aggregate(hand, F.lit(0), lambda s, c: s + c)


def is_soft(hand: Column) -> Column:
    return F.array_contains(hand, 1) & (hard_total(hand) + 10 <= 21)


def total(hand: Column) -> Column:
    """One ace counts eleven while that keeps the hand at 21 or below."""
    return hard_total(hand) + F.when(is_soft(hand), 10).otherwise(0)


def is_natural(hand: Column, from_split: Column | None = None) -> Column:
    two = (F.size(hand) == 2) & (total(hand) == 21)
    return two if from_split is None else two & ~from_split


def is_pair(hand: Column) -> Column:
    return (F.size(hand) == 2) & (F.element_at(hand, 1) == F.element_at(hand, 2))


def outcome(player: Column, dealer: Column, surrendered: Column, from_split: Column | None = None) -> Column:
    mine, theirs = total(player), total(dealer)
    natural = is_natural(player, from_split)
    return (
        F.when(surrendered, "surrender")
        .when(mine > 21, "bust")
        .when(is_natural(dealer), F.when(natural, "push").otherwise("loss"))
        .when(natural, "natural")
        .when((theirs > 21) | (mine > theirs), "win")
        .when(mine == theirs, "push")
        .otherwise("loss")
    )


def profit(result: Column, wager: Column) -> Column:
    return (
        F.when(result == "surrender", -wager / 2)
        .when(result.isin("bust", "loss"), -wager)
        .when(result == "natural", wager * 1.5)
        .when(result == "win", wager)
        .otherwise(wager * 0)
    )


def payout(result: Column, wager: Column) -> Column:
    return F.when(result.isin("bust", "loss"), wager * 0).otherwise(wager + profit(result, wager))


def insurance_profit(wager: Column, dealer_natural: Column) -> Column:
    return F.when(dealer_natural, wager).otherwise(-wager / 2)


def count_weight(card: Column) -> Column:
    """+1 for 2 to 6, -1 for tens and aces, else 0."""
    return F.when(card.between(2, 6), 1).when(card.isin(1, 10), -1).otherwise(0)


def running_count(cards: Column) -> Column:
    return F.aggregate(cards, F.lit(0), lambda s, c: s + count_weight(c))


def true_count(running: Column, seen: Column) -> Column:
    """Running count by decks left, towards minus infinity."""
    return F.floor(running / ((CARDS_IN_SHOE - seen) / DECK)).cast("long")


def bet_level(count: Column, low: int = 2, medium: int = 4, high: int = 6) -> Column:
    return F.when(count >= high, "high").when(count >= medium, "medium").when(count >= low, "low").otherwise("minimum")


def _upcard(card: Column) -> Column:
    return F.when(card == 1, 11).otherwise(card)


#: Fixed values of the basic table: dealer cards (ace 11) for which each hand acts.
SURRENDER = {17: [11], 16: [9, 10, 11], 15: [10, 11]}
SPLIT = {
    1: [2, 3, 4, 5, 6, 7, 8, 9, 10, 11],
    8: [2, 3, 4, 5, 6, 7, 8, 9, 10, 11],
    9: [2, 3, 4, 5, 6, 8, 9],
    7: [2, 3, 4, 5, 6, 7],
    6: [2, 3, 4, 5, 6],
    4: [5, 6],
    2: [2, 3, 4, 5, 6, 7],
    3: [2, 3, 4, 5, 6, 7],
}
SOFT_DOUBLE = {19: [6], 18: [2, 3, 4, 5, 6], 17: [3, 4, 5, 6], 16: [4, 5, 6], 15: [4, 5, 6], 14: [5, 6], 13: [5, 6]}
HARD_DOUBLE = {11: [2, 3, 4, 5, 6, 7, 8, 9, 10, 11], 10: [2, 3, 4, 5, 6, 7, 8, 9], 9: [3, 4, 5, 6]}
STAND_FROM = {13: [2, 3, 4, 5, 6], 14: [2, 3, 4, 5, 6], 15: [2, 3, 4, 5, 6], 16: [2, 3, 4, 5, 6], 12: [4, 5, 6]}
#: Fixed values of the count indices: (total, dealer) -> least true count to do it.
INDEX_SURRENDER = {(14, 10): 3, (15, 9): 2, (15, 10): 0, (15, 11): -1}
INDEX_SPLIT_TENS = {5: 5, 6: 4}
INDEX_PLAYS = {
    (16, 10): (0, "stand"),
    (15, 10): (4, "stand"),
    (10, 10): (4, "double"),
    (12, 3): (2, "stand"),
    (12, 2): (3, "stand"),
    (11, 11): (-1, "double"),
    (9, 2): (1, "double"),
    (10, 11): (3, "double"),
    (9, 7): (3, "double"),
    (16, 9): (5, "stand"),
    (13, 2): (-1, "stand"),
    (12, 4): (0, "stand"),
    (12, 5): (-2, "stand"),
    (12, 6): (-3, "stand"),
    (13, 3): (-2, "stand"),
}


def _listed(table: dict[int, list[int]], key: Column, dealer: Column) -> Column:
    found = F.lit(False)
    for k, dealers in table.items():
        found = found | ((key == k) & dealer.isin(dealers))
    return found


def _bound(value: Column, use) -> Column:
    """``use`` of a struct that is computed once a row."""
    return F.transform(F.array(value), use)[0]


def basic_action(hand: Column, dealer_card: Column, legal: Column) -> Column:
    """The basic table's action among the legal ones (an array of names)."""
    can = {a: F.array_contains(legal, a) for a in ("surrender", "split", "double")}

    def decide(h: Column) -> Column:
        t, soft, dealer = h["total"], h["soft"], h["dealer"]
        soft_action = (
            F.when(t >= 20, "stand")
            .when(can["double"] & _listed(SOFT_DOUBLE, t, dealer), "double")
            .when((t == 19) | ((t == 18) & (dealer <= 8)), "stand")
            .otherwise("hit")
        )
        hard_action = (
            F.when((t >= 17) | _listed(STAND_FROM, t, dealer), "stand")
            .when(can["double"] & _listed(HARD_DOUBLE, t, dealer), "double")
            .otherwise("hit")
        )
        return (
            F.when(can["surrender"] & ~soft & _listed(SURRENDER, t, dealer), "surrender")
            .when(can["split"] & is_pair(hand) & _listed(SPLIT, F.element_at(hand, 1), dealer), "split")
            .when(soft, soft_action)
            .otherwise(hard_action)
        )

    state = F.struct(total(hand).alias("total"), is_soft(hand).alias("soft"), _upcard(dealer_card).alias("dealer"))
    return _bound(state, decide)


#: Hands that are surrendered rather than played by their index.
_SURRENDER_FIRST = ((15, 10), (16, 9), (16, 10))


def _by_hand(table: dict, value) -> Column:
    """(total, dealer) -> a value of the table, as a map keyed by one number."""
    return F.create_map(*[F.lit(x) for (t, d), v in table.items() for x in (100 * t + d, value(v))])


def count_action(hand: Column, dealer_card: Column, legal: Column, count: Column) -> Column:
    """The basic action, overridden where a count index says so: each index table is looked up
    once by total and dealer card."""

    def can(action: Column | str) -> Column:
        return F.array_contains(legal, action)

    def decide(s: Column) -> Column:
        basic, here = s["basic"], s["here"]
        index = F.try_element_at(_by_hand(INDEX_PLAYS, lambda v: v[0]), here)
        action = F.try_element_at(_by_hand(INDEX_PLAYS, lambda v: v[1]), here)
        given_up = here.isin([100 * t + d for t, d in _SURRENDER_FIRST]) & can("surrender")
        played = (
            F.when((count >= index) & can(action), action).when((count < index) & can("hit"), "hit").otherwise(basic)
        )
        play = F.when(s["soft"] | index.isNull() | given_up, basic).otherwise(played)
        tens = F.try_element_at(F.create_map(*[F.lit(x) for i in INDEX_SPLIT_TENS.items() for x in i]), s["dealer"])
        splits = can("split") & is_pair(hand) & (F.element_at(hand, 1) == 10) & (count >= tens)
        least = F.try_element_at(_by_hand(INDEX_SURRENDER, lambda v: v), here)
        return (
            F.when(can("surrender") & ~s["soft"] & least.isNotNull(), F.when(count >= least, "surrender").otherwise("hit"))
            .when(F.coalesce(splits, F.lit(False)), "split")
            .otherwise(play)
        )

    dealer = _upcard(dealer_card)
    state = F.struct(
        is_soft(hand).alias("soft"),
        dealer.alias("dealer"),
        (100 * total(hand) + dealer).alias("here"),
        basic_action(hand, dealer_card, legal).alias("basic"),
    )
    return _bound(state, decide)


def canonical_hand(hand: Column) -> Column:
    """Cards in the one order that stands for all: by value, aces first."""
    return F.array_sort(hand)


def finished_order(hands: Column) -> Column:
    """Finished hands (structs) in the one order that stands for all: surrendered, bust, natural,
    total, wager; what else a struct holds doesn't count, and equal hands keep their places."""
    keyed = F.transform(
        hands,
        lambda h, i: F.struct(
            h["surrendered"].alias("a"), h["bust"].alias("b"), h["natural"].alias("c"), h["total"].alias("d"), h["wager"].alias("e"), i.alias("i"), h.alias("h")
        ),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["h"])


def penetration_bin(x: Column) -> Column:
    return F.when(x < 0.2, "0%-20%").when(x < 0.4, "20%-40%").when(x < 0.6, "40%-60%").otherwise("60%-80%")


def true_count_bin(c: Column) -> Column:
    return F.when(c <= -3, "<=-3").when(c <= -1, "-2 to -1").when(c <= 1, "0 to 1").when(c <= 3, "2 to 3").otherwise(">=4")


def high_share_bin(x: Column) -> Column:
    return F.when(x < 0.37, "<37%").when(x < 0.385, "37%-38.5%").when(x < 0.40, "38.5%-40%").otherwise(">=40%")
