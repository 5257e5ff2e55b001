"""Substring deduplication by line, paragraph and passage hashing.

Texts are split into units, which are normalised, hashed, and grouped with all equal units of
all documents. The occurrence ranked first, by (doc_id, place in the text), stays; the others
are removed. Offsets are characters of the original text. Kinds of units:

* lines, and paragraphs (lines between blank ones): in lower case, white-space runs as one
  space, ends trimmed. Of ``both``, a paragraph is a run of two or more lines that have words,
  so that a line and a paragraph of the same words are equal.
* ``passage``: windows of 26 words (runs of bytes but the six white-space ones, A-Z as a-z),
  wherever lines break. Lines can't catch a passage that stands within other lines, so windows
  are chosen by content: of every 25 neighbouring windows the one with the least order value
  (all of these on a tie). Two texts that share 50 words in a row share a chosen window, and
  neighbouring chosen windows overlap: of a repeated passage of 50 words or more all goes but
  at most 24 words at either end. A window doesn't repeat what it overlaps itself.

Removed ranges that overlap are one range. Each removed word is at an earlier place too, so
the earliest copy of any unit's words is never lost, even where it lies in units of several
kinds. Lines and paragraphs with fewer than ``min_words`` words stay everywhere.

The group of a very common unit is merged in each task before anything is exchanged, and the
join that follows is one that Spark can split; what comes together is one document's units.

Defined results: null text has no units, and stays null; a null doc_id ranks last; repeated
rows are different documents, the first row ranked first; an empty table gives no rows;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded, has_columns, materialise, released, settled
from .wordhash import LOWER, NON_SPACE, Words, winnowed, words

MIN_WORDS = 1
#: Words of a passage's window, and neighbouring windows of which one is chosen.
WINDOW, NEIGHBOURS = 26, 25
#: Order value of a window: its first words' values by these factors, by this modulus.
_FACTORS, _MODULUS = (1, 40503, 30011), 4294967291
_KNOWN = 1 << 20
_BREAKS = {"line": re.compile("\n"), "paragraph": re.compile(r"\n[ \t\r\f\v]*\n\s*")}
KINDS = {"line": ("line",), "paragraph": ("paragraph",), "both": ("both",), "passage": ("passage",), "all": ("both", "passage")}
UNIT_DDL = "rid long, doc_id long, start long, stop long, window boolean, digest binary"
UNIT_SCHEMA = pa.schema(
    [("rid", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("window", pa.bool_()), ("digest", pa.binary())]
)


def units(text: str, kind: str = "line") -> list[tuple[int, int]]:
    """Ranges of the units, without the breaks between them."""
    at, out = 0, []
    for m in _BREAKS[kind].finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return out


def normalised(unit: str) -> str:
    return " ".join(unit.lower().split())


def _spans(text: str, kind: str) -> list[tuple[int, int, list[str]]]:
    """Ranges of the units, with their words in lower case."""
    if kind != "both":
        return [(start, stop, text[start:stop].lower().split()) for start, stop in units(text, kind)]
    out, run = [], []
    for start, stop in [*units(text), (len(text), len(text))]:
        words = text[start:stop].lower().split()
        if words:
            run.append((start, stop, words))
            continue
        out += run
        if len(run) > 1:
            out.append((run[0][0], run[-1][1], [w for *_, part in run for w in part]))
        run = []
    return out


class Passages:
    """Chosen windows of a column's texts."""

    def __init__(self) -> None:
        self.values: dict[int, int] = {}  # word's hash -> its part of order values

    def order(self, w: Words, raw: bytes) -> np.ndarray:
        """Order value of the window at each word."""
        codes, hashes = pd.factorize(w.hash)
        firsts = np.full(len(hashes), len(codes), np.int64)
        np.minimum.at(firsts, codes, np.arange(len(codes)))
        if len(self.values) > _KNOWN:
            self.values.clear()
        known, value = self.values, np.empty(len(hashes), np.uint64)
        for k, (h, at) in enumerate(zip(hashes.tolist(), firsts.tolist())):
            v = known.get(h)
            if v is None:
                v = known[h] = int(hashlib.md5(raw[w.start[at] : w.end[at]]).hexdigest()[:8], 16)
            value[k] = v
        value = value[codes]
        n = max(0, len(value) - WINDOW + 1)
        out = np.zeros(n, np.uint64)
        for j, factor in enumerate(_FACTORS):
            out += value[j : j + n] * np.uint64(factor)
        return out % np.uint64(_MODULUS)

    def rows(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        w = words(b.column("text"), NON_SPACE)
        raw = w.data.tobytes().translate(LOWER)
        order = self.order(w, raw)
        at = winnowed(order, w.row[: len(order)] == w.row[len(w.row) - len(order) :], NEIGHBOURS)
        if not len(at):
            return
        start, stop, row = w.start[at], w.end[at + WINDOW - 1], w.row[at]
        digests = [
            hashlib.blake2b(b" ".join(raw[x:y].split()), digest_size=16, person=b"window").digest()
            for x, y in zip(start.tolist(), stop.tolist())
        ]
        chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80, dtype=np.int64)])
        base = chars[w.offsets[row]]
        rid, doc_id = (b.column(c).take(pa.array(row)) for c in ("rid", "doc_id"))
        columns = [rid, doc_id, chars[start] - base, chars[stop] - base, np.ones(len(at), bool), digests]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, UNIT_SCHEMA)], schema=UNIT_SCHEMA)


def _unit_rows(kind: str, min_words: int):
    def run(batches):
        passages = Passages()
        for b in bounded(batches):
            for one in KINDS[kind]:
                yield from passages.rows(b) if one == "passage" else _line_rows(b, one, min_words)

    return run


def _line_rows(b: pa.RecordBatch, kind: str, min_words: int) -> Iterator[pa.RecordBatch]:
    out: list[list] = [[] for _ in UNIT_SCHEMA]
    for rid, doc_id, text in zip(b.column("rid").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
        for start, stop, part in _spans(text.as_py() or "", kind):
            if len(part) < max(1, min_words):
                continue
            digest = hashlib.blake2b(" ".join(part).encode("utf-8", "surrogatepass"), digest_size=16).digest()
            for column, v in zip(out, (rid, doc_id, start, stop, False, digest)):
                column.append(v)
        if len(out[0]) >= 20_000:
            yield _batch(out)
            out = [[] for _ in UNIT_SCHEMA]
    if out[0]:
        yield _batch(out)


def _batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, UNIT_SCHEMA)], schema=UNIT_SCHEMA)


def repeated_units(rows: DataFrame, kind: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """Occurrences to remove: rid, start, stop, window, first_doc_id. ``rows``: rid, doc_id,
    text."""
    found = rows.mapInArrow(released(_unit_rows(kind, min_words)), UNIT_DDL)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", "start", "stop")
    first = materialise(  # as a table: a join of two plain exchanges can split a hot unit
        found.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first"))
        .where("n > 1")
        .select("digest", "first"),
        "repeated-units",
    )
    keep = F.col("first")
    later = (keep["rid"] != F.col("rid")) | (F.col("start") >= keep["stop"])
    return found.join(first, "digest").where(later).select("rid", "start", "stop", "window", keep["doc_id"].alias("first_doc_id"))


CLEAN_DDL = (
    "doc_id long, n_passages long, n_removed long, removed_chars long, "
    "removed array<struct<start: long, end: long, first_doc_id: long>>, first_doc_ids array<long>, text string"
)


def _cut(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without ``ranges``; with a range that is whole lines goes the break after it."""
    out, at = [], 0
    for start, stop in ranges:
        out.append(text[at:start])
        whole = (start == 0 or text[start - 1] == "\n") and text[stop : stop + 1] == "\n"
        at = stop + 1 if whole else stop
    out.append(text[at:])
    return "".join(out)


def _merged(removed: list[dict]) -> list[dict]:
    """Ranges in order; those that overlap as one, which names the document of its first."""
    out: list[dict] = []
    last = lambda x: (x["first_doc_id"] is None, x["first_doc_id"] or 0)
    for x in sorted(removed, key=lambda x: (x["start"], -x["end"], last(x))):
        if out and x["start"] < out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], x["end"])
        else:
            out.append({k: x[k] for k in ("start", "end", "first_doc_id")})
    return out


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first_doc_id", pa.int64())])


def _clean_rows(batches):
    for b in batches:
        found = [r or [] for r in b.column("removed").to_pylist()]
        removed = [_merged(r) for r in found]
        clean = [
            t.as_py() if not r else _cut(t.as_py(), [(x["start"], x["end"]) for x in r])
            for t, r in zip(b.column("text"), removed)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                pa.array([sum(x["window"] for x in r) for r in found], pa.int64()),
                pa.array([len(r) for r in removed], pa.int64()),
                pa.array([sum(x["end"] - x["start"] for x in r) for r in removed], pa.int64()),
                pa.array(removed, pa.list_(_SPAN)),
                pa.array([sorted({x["first_doc_id"] for x in r if x["first_doc_id"] is not None}) for r in removed], pa.list_(pa.int64())),
                pa.array(clean, pa.string()),
            ],
            names=["doc_id", "n_passages", "n_removed", "removed_chars", "removed", "first_doc_ids", "text"],
        )


def dedup_units(docs: DataFrame, kind: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_passages (windows that repeat), n_removed
    (ranges), removed_chars, removed (original ranges, and the document where the first unit of
    each stays), first_doc_ids, text (what is left). ``kind``: line, paragraph, both, passage
    or all."""
    rows = settled(has_columns(docs, "doc_id", "text"), "line-dedup-docs").select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), "text"
    )
    span = F.struct(F.col("start"), F.col("stop").alias("end"), F.col("first_doc_id"), F.col("window"))
    removed = repeated_units(rows, kind, min_words).groupBy("rid").agg(F.collect_list(span).alias("removed"))
    return rows.join(removed, "rid", "left").select("doc_id", "text", "removed").mapInArrow(released(_clean_rows), CLEAN_DDL)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines and paragraphs of any length and the passages that
    stand earlier; lists come as text so that SQL can compare them."""
    found = dedup_units(spark.read.parquet(f"{sf_dir}/documents.parquet"), "all")
    spans = F.transform("removed", lambda r: F.concat_ws(":", r["start"], r["end"], r["first_doc_id"]))
    return found.select(
        "doc_id",
        "n_passages",
        "n_removed",
        "removed_chars",
        F.array_join(spans, ",").alias("removed"),
        F.array_join(F.transform("first_doc_ids", lambda x: x.cast("string")), ",").alias("first_doc_ids"),
        "text",
    )


OP7_SQL = rf"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, i AS unit, parts[i] AS line,
    coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x) + 1)), 0)::BIGINT AS start
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM l)),
n AS (SELECT doc_id, unit, start, start + length(line) AS stop,
    trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS norm FROM u),
f AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM n WHERE norm <> ''),
g AS (SELECT doc_id, min(start) AS start, max(stop) AS stop, string_agg(norm, ' ' ORDER BY unit) AS norm
  FROM f GROUP BY doc_id, run HAVING count(*) > 1),
t AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, regexp_extract_all(text, '[\x20\x09-\x0D]+') AS gaps,
    regexp_matches(text, '^[\x20\x09-\x0D]') AS lead FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, i, ws[i] AS w, lead, length(ws[i]) AS size,
    CASE WHEN lead THEN length(gaps[i]) WHEN i > 1 THEN length(gaps[i - 1]) ELSE 0 END AS gap
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM t)),
y AS (SELECT doc_id, i, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w,
    (sum(gap + size) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS stop, size FROM x),
v AS (SELECT *, ('0x' || substr(md5(w), 1, 8))::BIGINT AS value FROM y),
o AS (SELECT doc_id, i, stop - size AS start, lead(stop, {WINDOW - 1}) OVER d AS stop,
    ({" + ".join(f"{a} * lead(value, {j}) OVER d" for j, a in enumerate(_FACTORS))}) % {_MODULUS} AS ord
  FROM v WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT *, CASE WHEN lead(ord, {NEIGHBOURS - 1}) OVER (PARTITION BY doc_id ORDER BY i) IS NOT NULL
    THEN min(ord) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {NEIGHBOURS - 1} FOLLOWING) END AS least
  FROM o WHERE stop IS NOT NULL),
q AS (SELECT *, max(least) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {NEIGHBOURS - 1} PRECEDING AND CURRENT ROW) AS chosen FROM p),
z AS (SELECT q.doc_id, q.start, q.stop, array_to_string(list_transform(ws[q.i:q.i + {WINDOW - 1}],
    lambda a: translate(a, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), ' ') AS norm
  FROM q JOIN t USING (doc_id) WHERE q.ord = q.chosen),
every AS (SELECT doc_id, start, stop, norm, false AS win FROM f UNION ALL SELECT doc_id, start, stop, norm, false FROM g
  UNION ALL SELECT doc_id, start, stop, norm, true FROM z),
k AS (SELECT doc_id, start, stop, win, first_value(doc_id) OVER d AS first_doc, first_value(stop) OVER d AS first_stop
  FROM every WINDOW d AS (PARTITION BY win, norm ORDER BY doc_id, start, stop)),
r AS (SELECT * FROM k WHERE first_doc <> doc_id OR start >= first_stop),
b AS (SELECT *, CASE WHEN start < max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop DESC, first_doc
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM r),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, stop DESC, first_doc ROWS UNBOUNDED PRECEDING) AS part FROM b),
m AS (SELECT doc_id, part, min(start) AS start, max(stop) AS stop, max(first_doc) FILTER (WHERE fresh = 1) AS first_doc FROM c GROUP BY doc_id, part),
e AS (SELECT m.doc_id, part, m.start, m.stop, first_doc, text, m.stop + CASE WHEN (m.start = 0 OR substr(text, m.start, 1) = chr(10))
    AND substr(text, m.stop + 1, 1) = chr(10) THEN 1 ELSE 0 END AS resume FROM m JOIN documents USING (doc_id)),
h AS (SELECT *, substr(text, 1 + coalesce(lag(resume) OVER (PARTITION BY doc_id ORDER BY part), 0),
    start - coalesce(lag(resume) OVER (PARTITION BY doc_id ORDER BY part), 0)) AS before FROM e),
s AS (SELECT doc_id, count(*)::BIGINT AS n_removed, sum(stop - start)::BIGINT AS removed_chars,
    string_agg(start || ':' || stop || ':' || first_doc, ',' ORDER BY part) AS removed,
    array_to_string(list_sort(list(DISTINCT first_doc)), ',') AS first_doc_ids,
    string_agg(before, '' ORDER BY part) || substr(any_value(text), 1 + max(resume)) AS text FROM h GROUP BY doc_id),
wins AS (SELECT doc_id, count(*)::BIGINT AS n_passages FROM r WHERE win GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_passages, 0)::BIGINT AS n_passages, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(removed_chars, 0)::BIGINT AS removed_chars, coalesce(removed, '') AS removed, coalesce(first_doc_ids, '') AS first_doc_ids,
  coalesce(s.text, d.text) AS text
FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN wins USING (doc_id)
"""
