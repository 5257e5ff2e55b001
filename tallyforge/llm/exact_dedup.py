"""Exact deduplication by a stream with disk-backed keyed state that never expires.

The stream's state store (RocksDB, checkpointed to the shared folder) keeps for each text
digest how many rows had it, the largest identifier among them and the content locator of
that row (file and row index). Nothing is ever evicted: there is no watermark. Digests that
were hit more than once are then checked byte for byte against the texts themselves, and
texts that only share a digest are set apart.

Only DataFrame, SQL and Structured Streaming operations are used.

Defined results: null text counts as empty; empty texts equal each other; a null ``doc_id``
ranks below every other; of rows equal in text and ``doc_id`` the one with the largest
content locator stays; an empty table gives no rows; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, shared_path, sized, unused

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Small states would else take some megabytes of preallocated files each; all states of an
#: executor share one bound of native memory.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


def normalised(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


_SPECIAL = "\\*?[]{}"


def literal(path: str) -> str:
    """A path for readers that take patterns, with the characters of patterns escaped."""
    return "".join(f"\\{c}" if c in _SPECIAL else c for c in path)


def glob_of(path: str) -> str:
    """A pattern for exactly this path: file streams take one file only as a pattern."""
    path = path.rstrip("/")
    at = max(i for i, c in enumerate(path) if c.isalnum())
    return f"{literal(path[:at])}[{path[at]}]{literal(path[at + 1 :])}"


def _place() -> Column:
    return F.struct(
        F.col("doc_id").alias("doc_id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


@contextmanager
def _state_conf(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class StreamingDedup:
    """Keyed dedup state in ``state_dir``; feeding again goes on from what it holds.

    ``key`` makes the state's key of a text column; anything but a function of the text
    gives wrong groups, a weak one only more texts to check. ``batch_bytes`` is how much of
    the files one micro-batch takes; the state is committed after each.
    """

    def __init__(self, spark: SparkSession, state_dir: str | None = None, key=digest, batch_bytes: int = 1 << 40):
        self.batch_bytes = batch_bytes
        self.spark = spark
        self.state_dir = state_dir or shared_path(spark, "dedup-state")
        self.key = key

    def feed(self, path: str) -> None:
        """Run all of the Parquet table ``path`` that the state hasn't seen through it."""
        schema = self.spark.read.parquet(literal(path)).select("doc_id", "text").schema
        stream = (
            self.spark.readStream.schema(schema)
            .option("maxBytesPerTrigger", self.batch_bytes)
            .parquet(glob_of(path))
            .select(self.key(F.col("text")).alias("digest"), _place().alias("place"))
            .groupBy("digest")
            .agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("place"))
        )
        with _state_conf(self.spark):
            query = (
                stream.writeStream.outputMode("update")
                .format("noop")
                .option("checkpointLocation", self.state_dir)
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()

    def state(self) -> DataFrame:
        """The state as a table: digest, n, keep (doc_id, file, row)."""
        held = self.spark.read.format("statestore").load(self.state_dir)
        (key,), (count, place) = (held.schema[c].dataType.fieldNames() for c in ("key", "value"))
        return held.select(
            F.col("key")[key].alias("digest"),
            F.col("value")[count].alias("n"),
            F.col("value")[place].alias("keep"),
        )


def _by_bytes(docs: DataFrame) -> DataFrame:
    """One row for each text, compared by all its bytes. Equal texts merge in each task
    before anything is exchanged, so a text with very many copies moves once a task."""
    return docs.groupBy("text").agg(
        F.min("digest").alias("digest"),
        F.count(F.lit(1)).alias("n"),
        F.max("place").alias("keep"),
    )


def exact_dedup(
    spark: SparkSession, path: str, state_dir: str | None = None, key=digest, places: bool = False
) -> DataFrame:
    """One row for each row of the Parquet table ``path``: doc_id, keep_id, group_size, kept,
    text_sha256, keep_file and keep_row (the content locator of the row that stays), and with
    ``places`` file and row, its own."""
    dedup = StreamingDedup(spark, state_dir, key)
    dedup.feed(path)
    with _state_conf(spark):
        state = materialise(dedup.state(), "dedup-groups")
    docs = spark.read.parquet(literal(path)).select(
        "doc_id",
        normalised(F.col("text")).alias("text"),
        digest(F.col("text")).alias("sha256"),
        key(F.col("text")).alias("digest"),
        _place().alias("place"),
    )
    repeated = state.where("n > 1").select("digest")
    hits = docs.select("text", "digest", "place").join(sized(repeated), "digest", "left_semi")
    checked = materialise(_by_bytes(hits).drop("text"), "dedup-checked")
    clashes = checked.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    slim = docs.select("doc_id", "sha256", "digest", "place")
    rows = slim.join(state, "digest")
    if not clashes.isEmpty():  # different texts under one digest: grouped by their bytes
        mixed = clashes.select("digest")
        texts = docs.join(mixed, "digest", "left_semi")
        apart = texts.drop("digest").join(_by_bytes(texts), "text")
        rows = rows.join(mixed, "digest", "left_anti").unionByName(apart.select(rows.columns))
    keep, place = F.col("keep"), F.col("place")
    return rows.select(
        "doc_id",
        keep["doc_id"].alias("keep_id"),
        F.col("n").alias("group_size"),
        (keep["file"].eqNullSafe(place["file"]) & keep["row"].eqNullSafe(place["row"])).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
        keep["file"].alias("keep_file"),
        keep["row"].alias("keep_row"),
        *([place["file"].alias("file"), place["row"].alias("row")] if places else []),
    )


def table_path(docs: DataFrame) -> str:
    """The folder (or file) whose rows ``docs`` is; where it isn't just a table read from
    one, it is written to the shared folder first."""
    spark, files = docs.sparkSession, docs.inputFiles()
    plain = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    folders = {f.rpartition("/")[0] for f in files}
    if plain and len(files) == 1:
        return unquote(files[0])
    if plain and len(folders) == 1:
        return unquote(folders.pop())
    path = shared_path(spark, "dedup-input")
    docs.write.parquet(path)
    return path


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    spark, path = docs.sparkSession, table_path(docs)
    rows = materialise(exact_dedup(spark, path, places=True).select("file", "row", "kept"), "dedup-rows")
    file, row = unused(docs, "file"), unused(docs, "row")
    gone = rows.where("NOT kept").select(F.col("file").alias(file), F.col("row").alias(row))
    columns = [F.col(f"`{n}`") for n in docs.columns]
    place = [F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)]
    placed = spark.read.schema(docs.schema).parquet(literal(path)).select(*columns, *place)
    return placed.join(sized(gone), [file, row], "left_anti").select(*columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet").drop("keep_file", "keep_row")


OP2_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g USING (text)
"""
