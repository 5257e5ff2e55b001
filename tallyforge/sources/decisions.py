"""Decision logs: schema, readers, writers, manifests."""

from __future__ import annotations

import contextlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import exists

SPLITS = ("train", "validation", "test")
_FRACTION = "struct<numerator: bigint, denominator: bigint>"
_DISTRIBUTION = f"struct<outcomes: array<struct<profit: {_FRACTION}, probability: {_FRACTION}>>>"
_ROLLOUTS = (
    "struct<seed: decimal(20,0), rollouts: bigint, expected_profit_standard_error: double, "
    "expected_profit_confidence_interval_95: array<double>>"
)
_ACTION = (
    f"struct<token: string, expected_profit: {_FRACTION}, expected_log_growth: double, "
    f"return_distribution: {_DISTRIBUTION}, monte_carlo: {_ROLLOUTS}>"
)
_METADATA = (
    "struct<shoe_composition: array<bigint>, unseen_unavailable: bigint, evaluation_method: string, "
    f"legal_target_tokens: array<string>, action_values: array<{_ACTION}>, round_return_distribution: {_DISTRIBUTION}, "
    f"continuous_half_kelly: double, selected_bet_fraction: double, monte_carlo: {_ROLLOUTS}>"
)
DECISION_DDL = (
    "schema_version bigint, dataset_id string, shoe_id bigint, shoe_seed decimal(20,0), split string, round_index bigint, "
    "decision_index bigint, kind string, input_tokens array<string>, target_token string, behavior_token string, "
    f"metadata {_METADATA}"
)
MANIFEST_DDL = (
    "schema_version bigint, dataset_id string, shoes array<struct<shoe_id: bigint, seed: decimal(20,0), split: string, "
    "cards: array<string>, cut_card_position: bigint>>"
)


def schema(ddl: str = DECISION_DDL) -> T.StructType:
    return T._parse_datatype_string(ddl)  # noqa: SLF001


def read_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """All split files (<split>.jsonl, a file or a folder of parts); a row whose split isn't its
    file's is an error when read, as is a line that isn't a decision."""
    paths = [f"{folder}/{s}.jsonl" for s in SPLITS]
    lines = spark.read.text(paths).select("value", F.regexp_extract("_metadata.file_path", r"([^/]+)\.jsonl(?:/[^/]*)?$", 1).alias("__file"))
    rows = lines.select(F.from_json("value", schema(), {"mode": "FAILFAST"}).alias("r"), "__file").select("r.*", "__file")
    checked = F.when(F.col("split") == F.col("__file"), F.col("split")).otherwise(
        F.raise_error(F.concat_ws(" ", F.lit("a row of split"), F.col("split"), F.lit("is in the file of"), F.col("__file")))
    )
    return rows.withColumn("split", checked).drop("__file")


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """One split of a dataset written by ``write_decisions``: only its folder is read."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    return spark.read.parquet(f"{folder}/decisions").where(F.col("split") == split)


def training_rows(decisions: DataFrame) -> DataFrame:
    """What a model may see; the evaluation metadata isn't even read, its legal tokens apart."""
    return decisions.select(
        "shoe_id", "decision_index", "kind", "input_tokens", "target_token", F.col("metadata.legal_target_tokens").alias("legal_tokens")
    )


def fraction(c) -> F.Column:
    return c["numerator"].cast("double") / c["denominator"]


def references(decisions: DataFrame) -> DataFrame:
    """Evaluation rows by key: the value of each legal action, one row an action."""
    return decisions.select(
        "shoe_id", "decision_index", "kind", F.posexplode("metadata.action_values").alias("place", "a")
    ).select(
        "shoe_id",
        "decision_index",
        "kind",
        "place",
        F.col("a.token").alias("token"),
        F.coalesce(fraction(F.col("a.expected_profit")), F.col("a.expected_log_growth")).alias("value"),
    )


def manifest_shoes(spark: SparkSession, path: str, split: str = "validation") -> DataFrame:
    """Shoes of a manifest; evaluation may use the validation split only."""
    if split != "validation":
        raise ValueError("evaluation may use the validation split only")
    rows = spark.read.schema(schema(MANIFEST_DDL)).json(path, multiLine=True)
    return rows.select("dataset_id", F.inline("shoes")).where(F.col("split") == split)


def report_slices(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Reports of experiment shards; a missing shoe_start is 0."""
    ddl = (
        "shoe_start bigint, shoe_count bigint, simulation_seed bigint, paired_advantage struct<mean: double, standard_error: double, "
        "sample_count: bigint>, breakdowns map<string, map<string, map<string, struct<mean: double, standard_error: double, sample_count: bigint>>>>"
    )
    rows = spark.read.schema(schema(ddl)).json(paths, multiLine=True)
    return rows.withColumn("shoe_start", F.coalesce("shoe_start", F.lit(0).cast("long")))


def breakdown_rows(slices: DataFrame) -> DataFrame:
    """Nested maps as rows: category, policy, bin and its estimate."""
    a = slices.select("shoe_start", F.explode("breakdowns").alias("category", "by_policy"))
    b = a.select("shoe_start", "category", F.explode("by_policy").alias("policy", "by_bin"))
    return b.select("shoe_start", "category", "policy", F.explode("by_bin").alias("bin", "e")).select("shoe_start", "category", "policy", "bin", "e.*")


def _canonical(c: F.Column, kind: T.DataType) -> F.Column:
    """A value with the fields of all its structs, and the keys of its maps, in order."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        value = F.struct(*[_canonical(c[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(c.isNotNull(), value)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(F.transform_values(c, lambda _, v: _canonical(v, kind.valueType))))
        return F.map_from_entries(entries)
    return c


def canonical_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, compact, keys in order at every level and absent values left out."""
    whole = T.StructType([df.schema[c] for c in sorted(df.columns)])
    parts = [_canonical(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in whole]
    return df.select(F.to_json(F.struct(*parts)).alias("value"))


def write_decisions(decisions: DataFrame, folder: str) -> None:
    """Parquet by split; a dataset that is there already is an error. Rows of a shoe stay
    together and in order."""
    (
        decisions.repartition("split", "shoe_id")
        .sortWithinPartitions("split", "shoe_id", "decision_index")
        .write.mode("errorifexists")
        .partitionBy("split")
        .parquet(f"{folder}/decisions")
    )


def write_jsonl(decisions: DataFrame, folder: str) -> None:
    """JSON lines by split, rows in the order (shoe, decision) within a file."""
    text = decisions.select("split", "shoe_id", "decision_index", F.to_json(F.struct(*decisions.columns)).alias("value"))
    (
        text.repartitionByRange("split", "shoe_id")
        .sortWithinPartitions("split", "shoe_id", "decision_index")
        .select("split", "value")
        .write.mode("errorifexists")
        .partitionBy("split")
        .text(f"{folder}/jsonl")
    )


def write_split_files(decisions: DataFrame, folder: str) -> None:
    """Canonical JSON lines as <split>.jsonl, which ``read_decisions`` reads; each is a folder of
    parts, with the rows of a shoe together and in order."""
    for split in SPLITS:
        rows = decisions.where(F.col("split") == split).repartitionByRange("shoe_id").sortWithinPartitions("shoe_id", "decision_index")
        canonical_json(rows).write.mode("errorifexists").text(f"{folder}/{split}.jsonl")


def pinned(spark: SparkSession, folder: str, manifest: dict) -> None:
    """Write the manifest, or check that the one there is the same; else an error."""
    text = json.dumps(manifest, sort_keys=True, separators=(",", ":"))
    path = f"{folder}/manifest"
    if not exists(spark, path):
        with contextlib.suppress(AnalysisException):  # another driver may have written it meanwhile
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    # whoever wrote, and if two wrote at once, what is there must be this and nothing else
    if {r["value"] for r in spark.read.text(path).collect()} != {text}:
        raise ValueError("the folder holds another dataset")


def incomplete(manifest: DataFrame, shards: DataFrame) -> DataFrame:
    """Shoes of the manifest without a shard."""
    return manifest.select("shoe_id").join(shards.select("shoe_id"), "shoe_id", "left_anti")


def assembled(manifest: DataFrame, shards: DataFrame) -> DataFrame:
    """All rows in the order (shoe, decision), once every shoe has a shard; else an error."""
    gone = incomplete(manifest, shards).limit(1).collect()  # one row decides
    if gone:
        raise ValueError(f"shoe {gone[0]['shoe_id']} has no shard")
    return shards.orderBy("shoe_id", "decision_index")
