"""Decision token sequences: vocabulary, encoding, context windows, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The model vocabulary; a token's place is its id.
CARDS = ["A", "2", "3", "4", "5", "6", "7", "8", "9", "10"]
STRUCTURE = ["<HISTORY>", "<CURRENT_HAND>", "<PLAYER>", "<DEALER>", "<BET_QUERY>", "<PLAY_QUERY>", "<INSURANCE_QUERY>"]
BETS = ["<BET_MIN>", "<BET_LOW>", "<BET_MEDIUM>", "<BET_HIGH>"]
PLAYS = ["<HIT>", "<STAND>", "<DOUBLE>", "<SPLIT>", "<SURRENDER>"]
INSURANCE = ["<INSURANCE>", "<NO_INSURANCE>"]
VOCABULARY = ["<PAD>", *CARDS, *STRUCTURE, *BETS, *PLAYS, *INSURANCE]


def _map(vocabulary: list[str], backwards: bool = False) -> Column:
    pairs = [(F.lit(i), F.lit(t)) if backwards else (F.lit(t), F.lit(i)) for i, t in enumerate(vocabulary)]
    return F.create_map(*[x for p in pairs for x in p])


def _looked_up(values: Column, table: Column, what: str) -> Column:
    def one(v: Column) -> Column:
        found = F.element_at(table, v)
        return F.coalesce(found, F.raise_error(F.concat(F.lit(f"unknown {what}: "), v.cast("string"))))

    return F.transform(values, one)


def encode(tokens: Column, vocabulary: list[str] = VOCABULARY) -> Column:
    return _looked_up(tokens, _map(vocabulary), "token")


def decode(ids: Column, vocabulary: list[str] = VOCABULARY) -> Column:
    return _looked_up(ids, _map(vocabulary, True), "id")


def missing(tokens: Column, vocabulary: list[str] = VOCABULARY) -> Column:
    return F.array_sort(F.array_except(tokens, F.array(*[F.lit(t) for t in vocabulary])))


def collapsed(rank: Column) -> Column:
    """Face cards as 10."""
    return F.when(rank.isin("J", "Q", "K"), "10").otherwise(rank)


def bet_input(history: Column) -> Column:
    return F.concat(F.array(F.lit("<HISTORY>")), F.transform(history, collapsed), F.array(F.lit("<BET_QUERY>")))


def decision_input(history: Column, hand: Column, dealer: Column, has_plays: Column) -> Column:
    query = F.when(has_plays, "<PLAY_QUERY>").otherwise("<INSURANCE_QUERY>")
    return F.concat(
        F.array(F.lit("<HISTORY>")),
        F.transform(history, collapsed),
        F.array(F.lit("<CURRENT_HAND>"), F.lit("<PLAYER>")),
        F.transform(hand, collapsed),
        F.array(F.lit("<DEALER>"), collapsed(dealer), query),
    )


def fitted(tokens: Column, window: int) -> Column:
    """The sequence in at most ``window`` tokens: the oldest cards after <HISTORY> go. One
    that doesn't begin with <HISTORY>, or whose rest alone is too long, is an error."""
    excess = F.size(tokens) - window
    bet = F.array_position(tokens, "<BET_QUERY>")
    hand = F.array_position(tokens, "<CURRENT_HAND>")
    rest = F.when(hand > 0, hand).otherwise(bet)  # place (from 1) where the history ends
    return (
        F.when(F.element_at(tokens, 1) != "<HISTORY>", F.raise_error(F.lit("a sequence begins with its history")))
        .when(rest < 1, F.raise_error(F.lit("a sequence has a query")))
        .when(excess <= 0, tokens)
        .when(rest - 2 < excess, F.raise_error(F.lit("what must stay is longer than the window")))
        .otherwise(F.concat(F.slice(tokens, 1, 1), F.slice(tokens, excess + 2, F.size(tokens))))
    )


def public_events(events: DataFrame, visibility: str = "visibility", secret: tuple[str, ...] = ("hidden_card",)) -> DataFrame:
    """Only what players see: public rows, without the secret columns."""
    return events.where(F.col(visibility) == "public").drop(visibility, *secret)


def context_history(visible: DataFrame, hand: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Visible cards minus those of the hand, as multisets: of equal cards the first ones
    go; the rest keep their order. Both tables have key and value, visible also order."""
    w = Window.partitionBy(key, value).orderBy(order)
    numbered = visible.withColumn("__i", F.row_number().over(w))
    taken = hand.groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"))
    joined = numbered.join(taken, [key, value], "left")
    return joined.where(F.col("__i") > F.coalesce(F.col("__n"), F.lit(0))).drop("__i", "__n")
