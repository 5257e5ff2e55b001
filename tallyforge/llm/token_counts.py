"""Token counts that follow edits.

A document is cut into segments of whole pre-tokens, each with its character and token
count; a tree of sums stands over them. An edit re-encodes the segments that it touches and
as much around them as may change, and updates the sums above. Segments keep their places: where
an edit leaves fewer, places stay empty; where it makes more, the last place takes the rest,
and only when that is ``ROOM`` segments long the sums are laid out anew. The tree travels
with the document as two arrays, so counting goes on from it later.

A cut is safe where a letter, digit or mark, then one space, then a letter or digit meet:
the tokenizer's pattern always begins a pre-token at that space, whatever comes before or
after it (an added token of the tokenizer that holds a space would join the two: with such
a one a text is a single segment). Text without such a place is one segment, however long.

Defined results: null text is empty and has no tokens; an edit beyond the end applies at
the end; null fields of an edit count as 0 or empty; edits apply in the order given, each to
the text that the one before left; repeated rows are counted each; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .shared import has_columns, released

SEGMENT = 512
#: Segments that one place takes before the sums are laid out anew.
ROOM = 16
_CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


def cuts(text: str, size: int = SEGMENT) -> list[int]:
    """Starts of the segments: the first safe place at or after each ``size`` characters."""
    out, at = [0] if text else [], 0
    while (m := _CUT.search(text, at + size)) is not None:
        at = m.start()
        out.append(at)
    return out


class SumTree:
    """Sums over a row of numbers: prefix search and point changes in logarithmic time."""

    def __init__(self, values: np.ndarray):
        self.leaves = 1 << max(0, (len(values) - 1).bit_length())
        self.sums = np.zeros(2 * self.leaves, np.int64)
        self.sums[self.leaves : self.leaves + len(values)] = values
        level = self.leaves
        while level > 1:
            half = level // 2
            self.sums[half:level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level = half

    def total(self) -> int:
        return int(self.sums[1])

    def set(self, i: int, value: int) -> None:
        i += self.leaves
        change = value - int(self.sums[i])
        while i:
            self.sums[i] += change
            i //= 2

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds unit ``at``, and the sum before it."""
        i, before = 1, 0
        while i < self.leaves:
            i *= 2
            if at - before >= self.sums[i]:
                before += int(self.sums[i])
                i += 1
        return i - self.leaves, before


class EditableDocument:
    """A text in segments with trees of their characters and tokens."""

    def __init__(self, enc, text: str, chars: list[int] | None = None, tokens: list[int] | None = None, size: int = SEGMENT):
        self.enc, self.size, self.encoded, self.laid_out = enc, size if enc.cuttable else 1 << 60, 0, 0
        if chars is None or tokens is None:
            self.parts, self.tokens = self._encode(text)
        else:
            at = np.concatenate([[0], np.cumsum(np.asarray(chars, np.int64))]).tolist()
            self.parts = [text[a:b] for a, b in zip(at, at[1:])]
            self.tokens = list(tokens)
        self._build()

    def _encode(self, text: str) -> tuple[list[str], list[int]]:
        edges = [*cuts(text, self.size), len(text)]
        parts = [text[a:b] for a, b in zip(edges, edges[1:])]
        self.encoded += len(text)
        return parts, [self.enc.count(p) for p in parts]

    def _build(self) -> None:
        self.laid_out += 1
        self.char_tree = SumTree(np.array([len(p) for p in self.parts], np.int64))
        self.token_tree = SumTree(np.array(self.tokens, np.int64))

    def count(self) -> int:
        return self.token_tree.total()

    def edit(self, start: int, length: int, insert: str) -> None:
        """Replace ``length`` characters from ``start`` by ``insert``."""
        total = self.char_tree.total()
        start = min(max(0, start), total)
        stop = min(total, start + max(0, length))
        if not self.parts:
            self.parts, self.tokens = self._encode(insert)
            self._build()
            return
        last = len(self.parts) - 1
        first, before = self.char_tree.find(start)
        if first > last:  # at the very end
            first, before = last, total - len(self.parts[last])
        final = min(last, self.char_tree.find(max(start, stop - 1))[0])
        text = "".join(self.parts[first : final + 1])
        text = text[: start - before] + insert + text[stop - before :]
        # the cut before or after stays safe only if its letter and space are still there
        while first > 0 and not self._safe(self.parts[first - 1], text):
            first -= 1
            text = self.parts[first] + text
        while final < last and not self._safe(text, self.parts[final + 1]):
            final += 1
            text += self.parts[final]
        parts, tokens = self._encode(text)
        places = final - first + 1
        if len(parts) > places and sum(map(len, parts[places - 1 :])) > ROOM * self.size:
            self.parts[first : final + 1], self.tokens[first : final + 1] = parts, tokens
            self._build()
            return
        if len(parts) > places:
            parts[places - 1 :] = ["".join(parts[places - 1 :])]
            tokens[places - 1 :] = [sum(tokens[places - 1 :])]
        for i in range(places):
            p, t = (parts[i], tokens[i]) if i < len(parts) else ("", 0)
            self.parts[first + i], self.tokens[first + i] = p, t
            self.char_tree.set(first + i, len(p))
            self.token_tree.set(first + i, t)

    @staticmethod
    def _safe(left: str, right: str) -> bool:
        return bool(left) and len(right) > 1 and _CUT.match(left[-1] + right[:2], 1) is not None

    def text(self) -> str:
        return "".join(self.parts)


TREE_DDL = "doc_id long, text string, n_tokens long, seg_chars array<int>, seg_tokens array<int>"
_INTS = pa.list_(pa.int32())


def _tree_rows(path: str | None, size: int):
    def run(batches):
        enc = encoder(path)
        for b in batches:
            chars, tokens = [], []
            for text in b.column("text"):
                d = EditableDocument(enc, text.as_py() or "", size=size)
                chars.append([len(p) for p in d.parts])
                tokens.append(d.tokens)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text"), pa.array([sum(t) for t in tokens], pa.int64()), pa.array(chars, _INTS), pa.array(tokens, _INTS)],
                names=["doc_id", "text", "n_tokens", "seg_chars", "seg_tokens"],
            )

    return run


def count_trees(docs: DataFrame, tokenizer: str | None = None, size: int = SEGMENT) -> DataFrame:
    """Each document with its count and segment arrays: the trees' leaves."""
    rows = has_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(released(_tree_rows(tokenizer, size)), TREE_DDL)


EDITED_DDL = TREE_DDL + ", n_tokens_before long, n_edits long, encoded_chars long"


def _edited_rows(path: str | None, size: int):
    def run(batches):
        enc = encoder(path)
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            columns = (b.column(c).to_pylist() for c in ("text", "n_tokens", "seg_chars", "seg_tokens", "edits"))
            for text, before, chars, tokens, edits in zip(*columns):
                d = EditableDocument(enc, text or "", chars, tokens, size)
                for e in edits or ():
                    if e is not None:
                        d.edit(e["start"] or 0, e["length"] or 0, e["insert"] or "")
                values = (d.text(), d.count(), [len(p) for p in d.parts], d.tokens, before, len(edits or ()), d.encoded)
                for column, v in zip(out, values):
                    column.append(v)
            kinds = (pa.string(), pa.int64(), _INTS, _INTS, pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds))],
                names=["doc_id", "text", "n_tokens", "seg_chars", "seg_tokens", "n_tokens_before", "n_edits", "encoded_chars"],
            )

    return run


def apply_edits(trees: DataFrame, edits: Column, tokenizer: str | None = None, size: int = SEGMENT) -> DataFrame:
    """Trees of the edited texts. ``edits``: for each row an array of struct(start, length,
    insert) in characters; encoded_chars tells how much was encoded again."""
    rows = trees.select("doc_id", "text", "n_tokens", "seg_chars", "seg_tokens", edits.alias("edits"))
    return rows.mapInArrow(released(_edited_rows(tokenizer, size)), EDITED_DDL)


def edited_counts(docs: DataFrame, edits: Column, tokenizer: str | None = None, size: int = SEGMENT) -> DataFrame:
    """``count_trees`` and ``apply_edits`` in one pass over the texts."""
    rows = has_columns(docs.withColumn("edits", edits), "doc_id", "text", "edits").withColumn("doc_id", F.col("doc_id").cast("long"))
    trees, edited = _tree_rows(tokenizer, size), _edited_rows(tokenizer, size)

    def run(batches):
        for b in batches:
            for tree in trees([b]):
                yield from edited([tree.append_column("edits", b.column("edits"))])

    return rows.mapInArrow(released(run), EDITED_DDL)


def revision(text: Column) -> Column:
    """The edits of the query: a line put in the middle, the 40 characters at one quarter
    cut, a word swapped at three quarters."""
    n = F.coalesce(F.char_length(text), F.lit(0)).cast("long")

    def edit(start, length: int, insert: str) -> Column:
        return F.struct(start.cast("long").alias("start"), F.lit(length).cast("long").alias("length"), F.lit(insert).alias("insert"))

    return F.array(edit(F.floor(n / 2), 0, "\nRevised on review.\n"), edit(F.floor(n / 4), 40, ""), edit(F.floor(n * 3 / 4), 6, " amended "))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents before and after the edits of ``revision``."""
    edited = edited_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), revision(F.col("text")))
    return edited.select("doc_id", "n_tokens_before", F.col("n_tokens").alias("n_tokens_after"), "n_edits", "encoded_chars", F.size("seg_tokens").cast("long").alias("n_segments"))
