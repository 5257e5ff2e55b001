"""Benchmark decontamination by winnowed fingerprints.

Of every ``SPAN - K + 1`` neighbouring k-gram hashes of a text the least is its fingerprint;
a document and an item that share ``SPAN`` words in a row share all those k-grams and so the
fingerprint: no shared span of that length is missed. Fingerprints that meet are extended to
both sides word by word, on the words themselves, and spans of ``SPAN`` words or more count.
Items shorter than ``SPAN`` words have one window, the whole item; documents are searched for
it at every position.

Items are the query set. They are dealt with in blocks of at most ``block_words`` words;
the index of a block is broadcast, and its size is bounded by that figure. Where there are
several blocks, the documents are read once for each and the hits of a document are merged.

Defined results: A-Z count as a-z; null and blank texts have no words and no hits; items
with a null ``item_id`` hit words but are not listed; repeated items and rows count as often
as they are there (an ``item_id`` is listed once); without items nothing is hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import batch, bounded, has_columns, materialise, released
from .wordhash import ALNUM, LOWER, grams, winnowed, words

SPAN = 10
K = 5
BLOCK_WORDS = 1_000_000
_RANGES = 1024  # of item hashes, by whose sizes items are dealt into blocks


class ItemIndex:
    """Fingerprints of a block of items: sorted hashes with item and place of each, and the
    same for the whole of each item shorter than ``span`` words."""

    def __init__(self, ids: list[str | None], texts: list[str], span: int = SPAN, k: int = K):
        self.span, self.k, self.ids = span, k, ids
        w = words(pa.array(texts, pa.string()), ALNUM)
        raw = w.data.tobytes().translate(LOWER)
        self.words = [
            [raw[a:b] for a, b in zip(w.start[lo:hi], w.end[lo:hi])] for lo, hi in zip(w.first, w.first[1:])
        ]
        g = grams(w.hash, k)
        valid = w.row[: len(g)] == w.row[len(w.row) - len(g) :]
        at = winnowed(g, valid, span - k + 1)
        at = at[np.argsort(g[at], kind="stable")]
        self.hash, self.item = g[at], w.row[at]
        self.place = at - w.first[self.item]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        counts = w.count()
        for length in range(1, span):
            items = np.flatnonzero(counts == length)
            if len(items):
                h = np.array([grams(w.hash[w.first[i] : w.first[i + 1]], length)[0] for i in items], np.uint64)
                order = np.argsort(h, kind="stable")
                self.short[length] = (h[order], items[order])

    def hits(self, column: pa.Array) -> tuple[np.ndarray, list[tuple[int, np.ndarray, set[int]]]]:
        """Word counts of the rows; for each row with hits its row number, the word ranges
        hit (one pair a line, merged) and the numbers of the items."""
        w = words(column, ALNUM)
        spans: dict[int, set[tuple[int, int]]] = {}
        found: dict[int, set[int]] = {}
        cache: tuple[int, list[bytes]] = (-1, [])

        def words_of(row: int) -> list[bytes]:
            nonlocal cache
            if cache[0] != row:
                lo, hi = w.first[row], w.first[row + 1]
                base = int(w.start[lo])
                text = w.data[base : w.end[hi - 1]].tobytes().translate(LOWER)
                cache = (row, [text[a - base : b - base] for a, b in zip(w.start[lo:hi].tolist(), w.end[lo:hi].tolist())])
            return cache[1]

        def matches(positions: np.ndarray, g: np.ndarray, known: np.ndarray) -> Iterator[tuple[int, int]]:
            """Pairs of a position and an entry of the sorted hashes that it equals."""
            if not len(known):
                return
            h = g[positions]
            lo = np.searchsorted(known, h, "left")
            met = np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == h)
            hi = np.searchsorted(known, h[met], "right")
            for p, a, b in zip(positions[met].tolist(), lo[met].tolist(), hi.tolist()):
                for e in range(a, b):
                    yield p, e

        g = grams(w.hash, self.k)
        valid = w.row[: len(g)] == w.row[len(w.row) - len(g) :]
        for p, e in matches(winnowed(g, valid, self.span - self.k + 1), g, self.hash):
            row, item, q = int(w.row[p]), int(self.item[e]), int(self.place[e])
            own, other = words_of(row), self.words[item]
            p -= int(w.first[row])
            if any(s <= p < t for s, t in spans.get((row, item, p - q), ())):
                continue  # inside a span that an earlier fingerprint was extended to
            a = 0
            while a < min(p, q) and own[p - a - 1] == other[q - a - 1]:
                a += 1
            b, most = 0, min(len(own) - p, len(other) - q)
            while b < most and own[p + b] == other[q + b]:
                b += 1
            if a + b >= self.span:
                spans.setdefault((row, item, p - q), set()).add((p - a, p + b))
                found.setdefault(row, set()).add(item)
        for length, (known, items) in self.short.items():
            g = grams(w.hash, length)
            inside = np.flatnonzero(w.row[: len(g)] == w.row[len(w.row) - len(g) :])
            for p, e in matches(inside, g, known):
                row, item = int(w.row[p]), int(items[e])
                p -= int(w.first[row])
                if words_of(row)[p : p + length] == self.words[item]:
                    spans.setdefault((row, item, p), set()).add((p, p + length))
                    found.setdefault(row, set()).add(item)
        by_row: dict[int, list[tuple[int, int]]] = {}
        for (row, _, _), s in spans.items():
            by_row.setdefault(row, []).extend(s)
        return w.count(), [(r, merged(by_row[r]), found[r]) for r in sorted(by_row)]


def merged(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Union of half-open ranges, in order."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return np.array(out, np.int64).reshape(-1, 2)


def _result(doc_id, n_words: int, ranges: np.ndarray, ids: list[str]) -> dict:
    ids = sorted(set(ids))
    n_hit = int((ranges[:, 1] - ranges[:, 0]).sum()) if len(ranges) else 0
    return {
        "doc_id": doc_id,
        "n_words": n_words,
        "n_hit": n_hit,
        "n_items": len(ids),
        "items_sha256": hashlib.sha256(",".join(ids).encode()).hexdigest(),
        "contaminated": n_hit > 0,
        "items": ids,
        "spans": [{"start": int(a), "end": int(b)} for a, b in ranges],
    }


DDL = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "items array<string>, spans array<struct<start: long, end: long>>"
)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("spans", _SPANS)]
)


def _hit_rows(index, only_hits: bool):
    empty = np.zeros((0, 2), np.int64)

    def run(batches):
        held = index.value
        for b in bounded(batches):
            counts, hits = held.hits(b.column("text"))
            at = {r: (ranges, items) for r, ranges, items in hits}
            ids = b.column("doc_id").to_pylist()
            rows = []
            for r in at if only_hits else range(len(ids)):
                ranges, items = at.get(r, (empty, ()))
                names = [held.ids[i] for i in items if held.ids[i] is not None]
                rows.append(_result(ids[r], int(counts[r]), ranges, names))
            if rows:
                yield batch(SCHEMA, **{f: [r[f] for r in rows] for f in SCHEMA.names})

    return run


def _item_blocks(items: DataFrame, block_words: int) -> tuple[DataFrame, int]:
    """Distinct items with a block number. A block holds 2 * ``block_words`` bytes of text and
    what its last item is longer (a word takes two bytes or more with the gap after it). Items
    are dealt by a running size: within ranges of their hash, plus the size of earlier ranges."""
    sized = (
        items.where("text is not null").distinct()
        .withColumn("size", F.octet_length("text") + F.lit(16))
        .where("size > 16")
        .withColumn("range", F.pmod(F.xxhash64("item_id", "text"), F.lit(_RANGES)))
    )
    sized = materialise(sized, "items")
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = sized.groupBy("range").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    running = F.sum("size").over(Window.partitionBy("range").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    dealt = sized.join(F.broadcast(ranges.drop("n")), "range").withColumn("upto", running + F.col("before") - F.col("size"))
    dealt = materialise(dealt.select("item_id", "text", F.floor(F.col("upto") / (2 * block_words)).alias("block")), "item-blocks")
    last = dealt.agg(F.max("block").alias("n")).first()["n"]
    return dealt, 1 if last is None else int(last) + 1


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, items (their ids) and spans (ranges of word numbers that are hit)."""
    spark = docs.sparkSession
    docs = has_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    items = has_columns(items, "item_id", "text").select(F.col("item_id").cast("string"), "text")
    blocked, blocks = _item_blocks(items, block_words)

    def index(block: int):
        rows = blocked.where(F.col("block") == block).select("item_id", "text").collect()  # bounded: one block
        held = ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows], span, k)
        return spark.sparkContext.broadcast(held)

    if blocks == 1:
        return docs.mapInArrow(released(_hit_rows(index(0), False)), DDL)
    docs = materialise(docs.withColumn("rid", F.monotonically_increasing_id()), "decontaminate-docs")
    return _merge_blocks(docs, [index(b) for b in range(blocks)])


def _merge_blocks(docs: DataFrame, indexes: list) -> DataFrame:
    """Hits of several blocks of items, merged by row."""
    keyed = docs.select(F.col("rid").alias("doc_id"), "text")
    found = keyed.mapInArrow(released(_hit_rows(indexes[0], True)), DDL)
    for i in indexes[1:]:
        found = found.unionByName(keyed.mapInArrow(released(_hit_rows(i, True)), DDL))
    joined = found.groupBy("doc_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("parts"),
    )
    joined = joined.select(
        F.col("doc_id").alias("rid"), "items", F.expr(
            "aggregate(parts, cast(array() as array<struct<start: bigint, end: bigint>>), (acc, x) -> "
            "CASE WHEN size(acc) > 0 AND x.start <= element_at(acc, -1).end THEN concat(slice(acc, 1, size(acc) - 1), "
            "array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))) "
            "ELSE concat(acc, array(named_struct('start', x.start, 'end', x.end))) END)"
        ).alias("spans"),
    )
    counts = keyed.mapInArrow(released(_count_rows), "rid long, n_words long")
    rows = docs.select("rid", "doc_id").join(counts, "rid").join(joined, "rid", "left")
    hit = F.expr("aggregate(spans, 0L, (acc, x) -> acc + x.end - x.start)")
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce(hit, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce(hit, F.lit(0)).__gt__(0).alias("contaminated"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start: bigint, end: bigint>>")).alias("spans"),
    )


def _count_rows(batches):
    for b in bounded(batches):
        n = words(b.column("text"), ALNUM).count()
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["rid", "n_words"])


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item hits; rows are matched within their partition."""
    spark = docs.sparkSession
    rows = has_columns(items, "item_id", "text").select(F.col("item_id").cast("string"), "text")
    blocked, blocks = _item_blocks(rows, BLOCK_WORDS)
    for block in range(blocks):
        found = blocked.where(F.col("block") == block).select("item_id", "text").collect()  # bounded: one block
        held = spark.sparkContext.broadcast(ItemIndex([r["item_id"] for r in found], [r["text"] for r in found]))
        docs = docs.mapInArrow(released(_clean_rows(held)), docs.schema)
    return docs


def _clean_rows(index):
    def run(batches):
        for b in bounded(batches):
            _, hits = index.value.hits(b.column("text"))
            keep = np.ones(b.num_rows, bool)
            keep[[r for r, _, _ in hits]] = False
            yield b.filter(pa.array(keep))

    return run


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, items).drop("items", "spans")


OP8_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
ic AS (SELECT item_id, ws, least(len(ws), 10) AS m FROM iw WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (SELECT item_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM ic)),
dp AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM ic) WHERE len(ws) >= m)),
hit AS (SELECT dp.doc_id, dp.i, dp.m, win.item_id FROM dp JOIN win ON dp.g = win.g AND dp.m = win.m),
pos AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
