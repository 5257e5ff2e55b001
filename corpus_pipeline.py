"""A corpus pipeline: language ID, exact dedup, near dedup, decontamination, packing.

Each stage takes the documents that the one before kept and returns those it keeps, with
the columns of the table documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.decontaminate import drop_contaminated
from tallyforge.llm.exact_dedup import drop_duplicates
from tallyforge.llm.jaccard_join import drop_near_duplicates
from tallyforge.llm.language_id import keep_languages
from tallyforge.llm.packing import pack
from tallyforge.llm.shared import materialise

#: Languages to keep; None is every one that the labels of documents name.
LANGUAGES: list[str] | None = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are in no language of LANGUAGES go: those without a letter, those that are no
    nearer to any learned profile than what all share, and those of other languages."""
    return keep_languages(docs, LANGUAGES)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset."""
    return pack(docs, with_ids=False).drop("ids")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Language profiles and token ids can't be had in SQL; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
