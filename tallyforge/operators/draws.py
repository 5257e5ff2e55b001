"""Draws from a composition: a table of ten rows (card, n), card 1 the ace, 10 the tens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cards import SIX_DECKS


def composition(spark: SparkSession, counts: list[int] | None = None) -> DataFrame:
    counts = SIX_DECKS if counts is None else counts
    if len(counts) != 10 or any(c < 0 for c in counts):
        raise ValueError("a composition is ten counts, none below 0")
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(counts)], "card int, n int")


def draws(shoe: DataFrame) -> DataFrame:
    """Each card that is left and the chance to draw it."""
    total = shoe.agg(F.sum("n").alias("total"))
    return shoe.where("n > 0").join(F.broadcast(total)).select("card", (F.col("n") / F.col("total")).alias("p"))  # one row


def opening_draws(shoe: DataFrame) -> DataFrame:
    """First player card, dealer card, second player card, without replacement: at most a
    thousand rows from the ten."""
    total = F.broadcast(shoe.agg(F.sum("n").alias("total")))

    def named(k: str) -> DataFrame:
        return shoe.select(F.col("card").alias(k), F.col("n").alias(f"n_{k}"))

    a, b, c = F.col("first"), F.col("dealer"), F.col("second")
    left_b = F.col("n_dealer") - F.when(a == b, 1).otherwise(0)
    left_c = F.col("n_second") - F.when(a == c, 1).otherwise(0) - F.when(b == c, 1).otherwise(0)
    t = F.col("total")
    rows = named("first").crossJoin(named("dealer")).crossJoin(named("second")).crossJoin(total)
    rows = rows.where((F.col("n_first") > 0) & (left_b > 0) & (left_c > 0))
    return rows.select("first", "dealer", "second", (F.col("n_first") * left_b * left_c / (t * (t - 1) * (t - 2))).alias("p"))


def hole_allowed(card: Column, upcard: Column, peeked: bool) -> Column:
    """After a peek without a natural an ace hides no ten and a ten no ace."""
    if not peeked:
        return F.lit(True)
    return ~(((upcard == 1) & (card == 10)) | ((upcard == 10) & (card == 1)))


def hidden_hole_draws(shoe: DataFrame, upcards: DataFrame, peeked: bool = True) -> DataFrame:
    """Chance of the next visible card while the hole card stays hidden, for each upcard
    (column upcard; at most ten): n (E - [allowed]) / (E (T - 1)), E allowed holes of T."""
    rows = shoe.crossJoin(upcards)  # ten rows by at most ten
    allowed = hole_allowed(F.col("card"), F.col("upcard"), peeked)
    sums = rows.groupBy("upcard").agg(F.sum(F.when(allowed, F.col("n")).otherwise(0)).alias("e"), F.sum("n").alias("t"))
    own = F.when(allowed, 1).otherwise(0)
    joined = rows.join(sums, "upcard")
    top = F.col("n") * (F.col("e") - own)
    return joined.where(top > 0).select("upcard", "card", (top / (F.col("e") * (F.col("t") - 1))).alias("p"))


def dealer_natural(shoe: DataFrame, upcards: DataFrame) -> DataFrame:
    """Chance that the hole card makes a natural."""
    rows = shoe.crossJoin(upcards)  # ten rows by at most ten
    wanted = F.when(F.col("upcard") == 1, 10).when(F.col("upcard") == 10, 1)
    hit = F.sum(F.when(F.col("card") == wanted, F.col("n")).otherwise(0))
    return rows.groupBy("upcard").agg((hit / F.sum("n")).alias("p"))


def insurance(probability: Column) -> tuple[Column, Column]:
    """Expected profit of taking it (in wagers), and the choice; a tie declines."""
    value = probability - (1 - probability) / 2
    return value, F.when(value > 0, "<INSURANCE>").otherwise("<NO_INSURANCE>")
