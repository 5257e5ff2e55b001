"""Packing of tokenised documents into sequences by the sum-of-squares rule.

A piece goes where the sum over gaps g of N(g)^2 becomes smallest, N(g) being the number of
open sequences with g tokens left; a full sequence isn't open any more. Pieces come largest
first, so that the small ones fill what is left.

Documents longer than a sequence are cut; all pieces but the first are whole sequences.
The pieces are dealt into groups of ``group_pieces`` or so by hash; each group is packed by
itself in one pass that holds only its open sequences. Groups grow in number, not in size.

Defined results: null text is empty and gives one piece, the end token; repeated rows are
packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .shared import has_columns, materialise, released

CAPACITY = 1024
END = 2
GROUP_PIECES = 262_144
_FAR = np.int64(1) << 60


class SumOfSquares:
    """Packs lengths one at a time: place(length) -> (sequence number, offset)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n = np.zeros(capacity + 1, np.int64)  # open sequences by gap
        self.sequences = 0

    def place(self, length: int) -> tuple[int, int]:
        c, n = self.capacity, self.n
        if length == c:
            self.sequences += 1
            return self.sequences - 1, 0
        # N(g)^2 falls by 2N(g)-1 and N(g-length)^2 grows by 2N(g-length)+1, gap 0 apart
        here = n[length:c]
        change = np.where(here > 0, 2 * (n[: c - length] - here) + 2, _FAR)
        if here[0]:
            change[0] = 1 - 2 * here[0]
        g = int(change.argmin())
        if change[g] <= 2 * n[c - length] + 1:
            gap = g + length
            number = self.open[gap].pop()
            n[gap] -= 1
        else:
            gap, number = c, self.sequences
            self.sequences += 1
        left = gap - length
        if left:
            self.open[left].append(number)
            n[left] += 1
        return number, c - gap


def pieces(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of each piece of a document; only the first may be short."""
    first = length % capacity or capacity
    yield 0, min(first, length)
    for start in range(first, length, capacity):
        yield start, capacity


PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
PIECE_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
)


def _piece_rows(path: str | None, capacity: int, with_ids: bool):
    end = END.to_bytes(4, "little")

    def run(batches):
        enc = encoder(path)
        for b in batches:
            out: list[list] = [[] for _ in PIECE_SCHEMA]
            size = 0
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = enc.ids(text.as_py() or "").astype("<u4").tobytes() + end
                for number, (start, length) in enumerate(pieces(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    row = (doc_id, number, start, length, zlib.crc32(part), part if with_ids else None)
                    for column, v in zip(out, row):
                        column.append(v)
                    size += 1
                if size >= 20_000:
                    yield _batch(out)
                    out, size = [[] for _ in PIECE_SCHEMA], 0
            if size:
                yield _batch(out)

    return run


def _batch(columns: Iterable[list], schema: pa.Schema = PIECE_SCHEMA) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def tokenised_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    docs = has_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(released(_piece_rows(tokenizer, capacity, with_ids)), PIECE_DDL)


def _packed_rows(capacity: int):
    def run(batches):
        group, packer = None, None
        for b in batches:
            numbers, offsets = [], []
            for g, length in zip(b.column("group").to_pylist(), b.column("length").to_pylist()):
                if g != group:
                    group, packer = g, SumOfSquares(capacity)
                number, offset = packer.place(length)
                numbers.append((g << 40) + number)
                offsets.append(offset)
            b = b.drop_columns(["group"])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())],
                names=[*b.schema.names, "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = True, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, ids (little-endian
    unsigned 32-bit; null unless ``with_ids``), sequence_id and offset."""
    found = materialise(tokenised_pieces(docs, capacity, tokenizer, with_ids), "pieces")
    groups = max(1, -(-found.count() // group_pieces))
    order = [F.col("length").desc(), "doc_id", "piece", "start", "ids_crc32"]
    dealt = found.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return (
        dealt.repartition(groups, "group")
        .sortWithinPartitions("group", *order)
        .mapInArrow(released(_packed_rows(capacity)), f"{PIECE_DDL}, sequence_id long, offset long")
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False).drop("ids")
