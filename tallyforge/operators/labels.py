"""Labels computed once for each distinct state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import exists, stored


def state_key(kind: str, state: list[str]) -> Column:
    """Content address of a state: kind and SHA-256 of its canonical JSON."""
    return F.concat(F.lit(f"{kind}:"), F.sha2(F.to_json(F.struct(*sorted(state))), 256))


def labelled(
    df: DataFrame, kind: str, state: list[str], compute: Callable[[DataFrame], DataFrame], known: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows with their label, and the label table. Each distinct state that ``known`` (key,
    label) doesn't have is computed once, its label being written to the shared folder before
    anything reads it; ``compute`` takes (key, state...) and returns (key, label)."""
    keyed = df.withColumn("key", state_key(kind, state))
    states = keyed.select("key", *state).dropDuplicates(["key"])
    if known is None:
        table = stored(compute(states).select("key", "label"), "labels")
    else:
        new = stored(compute(states.join(known, "key", "left_anti")).select("key", "label"), "labels")
        table = known.select("key", "label").unionByName(new)
    return keyed.join(table, "key"), table


def conflicts(table: DataFrame) -> DataFrame:
    """Keys with different labels."""
    return table.groupBy("key").agg(F.countDistinct("label").alias("labels")).where("labels > 1")


class LabelStore:
    """Labels by key in a folder, insert or ignore: what is inserted first stays. Each insert is
    a batch of its own; of batches that race, the first in order of name wins, for all readers
    alike, so no lock is needed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self) -> DataFrame:
        """key, label: the winners."""
        if not exists(self.spark, self.folder):
            return self.spark.createDataFrame([], "key string, label string")
        rows = self.spark.read.schema("key string, label string, batch string").parquet(self.folder)
        return rows.groupBy("key").agg(F.min(F.struct("batch", "label"))["label"].alias("label"))

    def insert(self, labels: DataFrame, batch: str) -> DataFrame:
        """Add (key, label) where the key isn't there; gives the winners of the keys asked for.
        ``batch`` names the insert; names that grow with time let the earliest win."""
        labels = stored(labels.select("key", F.col("label").cast("string").alias("label")), "new-labels")
        fresh = labels.join(self.table(), "key", "left_anti").groupBy("key").agg(F.min("label").alias("label"))
        fresh.write.mode("errorifexists").parquet(f"{self.folder}/batch={batch}")
        return self.table().join(labels.select("key").distinct(), "key", "left_semi")


def counters(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """One row: lookups, hits, misses (distinct keys that must be computed), hits among rows and
    the rate. ``wanted`` has a key a lookup; a key that is computed serves its later lookups."""
    by_key = wanted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(known.select("key", F.lit(True).alias("held")), "key", "left")
    held = F.coalesce("held", F.lit(False))
    return by_key.agg(
        F.sum("n").alias("lookups"),
        F.sum(F.when(held, F.col("n")).otherwise(F.col("n") - 1)).alias("hits"),
        F.count_if(~held).alias("misses"),
    ).withColumn("hit_rate", F.try_divide("hits", "lookups"))
