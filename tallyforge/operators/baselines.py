"""Policies that need no training, as predictions over decision rows.

Rows have kind, hand, upcard, legal (array of names) and target; cards count 1 to 10.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cards


def first_best(legal: Column, score_of: Column) -> Column:
    """The legal name with the largest score in a map; unknown ones score 0; the first wins."""
    tagged = F.transform(
        legal, lambda t, i: F.struct(F.coalesce(F.try_element_at(score_of, t), F.lit(0.0)).alias("v"), (-i).alias("i"), t.alias("t"))
    )
    return F.array_max(tagged)["t"]


def frequency(train: DataFrame, rows: DataFrame) -> DataFrame:
    """The legal target that training rows have most often. The counts are one row: targets
    are a fixed vocabulary."""
    counts = train.groupBy("target").agg(F.ln(F.count(F.lit(1)).cast("double")).alias("v"))
    table = counts.agg(F.map_from_entries(F.collect_list(F.struct("target", "v"))).alias("scores"))
    return rows.join(F.broadcast(table)).withColumn("prediction", first_best(F.col("legal"), F.col("scores"))).drop("scores")


def basic(rows: DataFrame) -> DataFrame:
    """The basic table; the least bet; no insurance."""
    play = cards.basic_action(F.col("hand"), F.col("upcard"), F.col("legal"))
    other = F.when(F.col("kind") == "bet", "minimum").otherwise("<NO_INSURANCE>")
    return rows.withColumn("prediction", F.when(F.col("kind") == "play", play).otherwise(other))


def counting(rows: DataFrame, count: str) -> DataFrame:
    """Count indices over the basic table, bets and insurance by the true count."""
    c = F.col(count)
    play = cards.count_action(F.col("hand"), F.col("upcard"), F.col("legal"), c)
    insured = F.when(c >= 3, "<INSURANCE>").otherwise("<NO_INSURANCE>")
    return rows.withColumn(
        "prediction", F.when(F.col("kind") == "play", play).when(F.col("kind") == "bet", cards.bet_level(c)).otherwise(insured)
    )
