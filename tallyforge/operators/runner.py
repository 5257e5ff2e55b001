"""Dataset generation that can stop and go on: shards are written once, then assembled."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.decisions import assembled, pinned
from ..sources.tables import exists
from .audit import gaps


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """Shards with a committed write, and the batch that holds each (of two, the first by name)."""
    if not exists(spark, f"{folder}/done"):
        return spark.createDataFrame([], "shard int, batch string")
    return spark.read.schema("shard int, batch string").parquet(f"{folder}/done").groupBy("shard").agg(F.min("batch").alias("batch"))


def generate(
    spark: SparkSession,
    folder: str,
    units: DataFrame,
    make: Callable[[DataFrame], DataFrame],
    manifest: dict,
    shards: int,
    limit: int | None = None,
    progress: Callable[[dict[str, int]], None] | None = None,
) -> dict[str, int]:
    """Write the shards that aren't there yet (at most ``limit`` of them) in one job.

    ``units`` has shoe_id; ``make`` turns units into decision rows. The manifest is written
    once; another one for the same folder is an error. A batch of shards counts from when its
    list is written, after its rows: one that failed midway is written anew. ``progress`` is
    told the figures before and after.
    """
    pinned(spark, folder, manifest)
    done = {r["shard"] for r in finished(spark, folder).collect()}  # one row a shard
    todo = [i for i in range(shards) if i not in done]
    todo = todo if limit is None else todo[:limit]
    tell = progress or (lambda figures: None)
    tell({"shards": shards, "done": len(done), "todo": len(todo)})
    if todo:
        batch = uuid.uuid4().hex
        shard = F.pmod("shoe_id", F.lit(shards)).cast("int")
        rows = make(units.where(shard.isin(todo))).withColumn("shard", shard)
        rows = rows.repartition(min(len(todo), 10_000), "shard").sortWithinPartitions("shard", "shoe_id", "decision_index")
        rows.write.partitionBy("shard").parquet(f"{folder}/shards/batch={batch}")
        listed = spark.createDataFrame([(i, batch) for i in todo], "shard int, batch string")
        listed.coalesce(1).write.mode("append").parquet(f"{folder}/done")
    figures = {"shards": shards, "resumed": len(done), "written": len(todo), "left": shards - len(done) - len(todo)}
    tell(figures)
    return figures


def assemble(spark: SparkSession, folder: str, units: DataFrame, shards: int) -> DataFrame:
    """All rows in order, once every shard is there, every unit has rows and every unit's
    decisions are numbered 0..n-1; else an error."""
    done = finished(spark, folder)
    missing = shards - done.where((F.col("shard") >= 0) & (F.col("shard") < shards)).count()
    if missing:
        raise ValueError(f"{missing} of {shards} shards aren't written")
    rows = spark.read.parquet(f"{folder}/shards").join(F.broadcast(done), ["shard", "batch"], "left_semi")  # one row a shard
    rows = rows.drop("shard", "batch")
    broken = gaps(rows, "shoe_id", "decision_index").limit(1).collect()  # one row decides
    if broken:
        raise ValueError(f"shoe {broken[0]['shoe_id']} has a gap")
    return assembled(units, rows)
