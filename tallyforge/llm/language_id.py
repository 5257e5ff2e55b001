"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its
letters' vectors, each permuted (rolled) once for every place it stands before the end. A
text's vector bundles (adds) those of all its n-grams, a language's prototype those of all
texts of that language to learn from. The language of a text is that of the prototype with
the largest cosine; prototypes are centred on their mean first, since what all languages
share tells none of them.

Letters are what Unicode calls letters, in lower case; any run of other characters is one
gap, a symbol of its own.

Defined results: null text and text without a letter is ``und`` with score 0; a score is the
cosine, from 0 (negative ones too) to 1; ties go to the first language in order of name;
rows with a null or empty ``lang`` teach nothing; with nothing to learn from, every text is
``und``; a null ``doc_id`` counts as not held out; other columns are ignored, whatever their
names. Labels are taken for languages up to ``MAX_LANGUAGES`` distinct ones, counted before
anything is collected; more are an error, since the model holds a vector for each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import has_columns, materialise, released

N = 3
DIMENSIONS = 1024
MAX_LANGUAGES = 20_000
UNDETERMINED = "und"
_GAP = 0
_PART = 1 << 20  # characters counted at a time
_ROWS = 256  # texts bundled at a time
_HELD = 40_000  # n-gram vectors held


class Space:
    """Vectors of letters and n-grams; all follow from the seed."""

    def __init__(self, n: int = N, dimensions: int = DIMENSIONS, seed: int = 11):
        self.n, self.dimensions, self.seed = n, dimensions, seed
        self.symbol = np.zeros(0x110000, np.int32)  # code point -> lower-case letter's, or the gap
        self.known = np.zeros(0x110000, bool)
        self.letters: dict[int, np.ndarray] = {}
        self.index: dict[int, int] = {}
        self.table = np.zeros((1024, dimensions), np.int8)

    def symbols(self, text: str) -> np.ndarray:
        """Letters' numbers and gaps, one gap for each run of other characters."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not self.known[points].all():
            for p in np.unique(points[~self.known[points]]).tolist():
                low = chr(p).lower()
                letter = unicodedata.category(chr(p))[0] == "L"
                self.symbol[p] = ord(low) if letter and len(low) == 1 else p if letter else _GAP
                self.known[p] = True
        s = self.symbol[points]
        if len(s):
            s = s[(s != _GAP) | np.concatenate([[True], s[:-1] != _GAP])]
        return s

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams as numbers, and how often each occurs; none without a letter."""
        codes, times = [], []
        tail = np.zeros(0, np.int32)
        for at in range(0, len(text), _PART):
            s = self.symbols(text[at : at + _PART])
            if at == 0:
                s = np.concatenate([[_GAP], s]).astype(np.int32)
                s = s[1:] if len(s) > 1 and s[1] == _GAP else s
            elif len(tail) and len(s) and tail[-1] == _GAP and s[0] == _GAP:
                s = s[1:]
            s = np.concatenate([tail, s])
            if at + _PART >= len(text) and len(s) and s[-1] != _GAP:
                s = np.concatenate([s, [_GAP]])
            tail = s[max(0, len(s) - self.n + 1) :]
            if len(s) >= self.n:
                code = np.zeros(len(s) - self.n + 1, np.int64)
                for j in range(self.n):
                    code = (code << 21) | s[j : j + len(code)]
                c, t = np.unique(code, return_counts=True)
                codes.append(c)
                times.append(t)
        if not codes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(codes) == 1:
            c, t = codes[0], times[0]
        else:
            c, back = np.unique(np.concatenate(codes), return_inverse=True)
            t = np.bincount(back, np.concatenate(times)).astype(np.int64)
        return c, t

    def letter(self, symbol: int) -> np.ndarray:
        v = self.letters.get(symbol)
        if v is None:
            bits = np.random.Generator(np.random.Philox(key=[self.seed, symbol])).integers(0, 2, self.dimensions)
            v = self.letters[symbol] = (2 * bits - 1).astype(np.int8)
        return v

    def gram(self, code: int) -> np.ndarray:
        v = np.ones(self.dimensions, np.int8)
        for j in range(self.n):
            v = v * np.roll(self.letter(code >> 21 * j & 0x1FFFFF), j)
        return v

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Places of the n-grams' vectors in the table; new ones are made."""
        new = [c for c in codes.tolist() if c not in self.index]
        if new:
            if len(self.index) + len(new) > max(_HELD, len(codes)):
                self.index.clear()
                new = codes.tolist()
            while len(self.index) + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for c in new:
                self.table[len(self.index)] = self.gram(c)
                self.index[c] = len(self.index)
        return np.fromiter(map(self.index.__getitem__, codes.tolist()), np.int64, len(codes))

    def bundles(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The vector of each text, as float32: one product of counts and n-gram vectors."""
        every = np.unique(np.concatenate([c for c, _ in counts])) if counts else np.zeros(0, np.int64)
        out = np.zeros((len(counts), self.dimensions), np.float32)
        for at in range(0, len(every), 4096):  # a text may hold any number of n-grams
            part = every[at : at + 4096]
            weights = np.zeros((len(counts), len(part)), np.float32)
            for i, (c, t) in enumerate(counts):
                lo, hi = np.searchsorted(c, part[0]), np.searchsorted(c, part[-1], "right")
                weights[i, np.searchsorted(part, c[lo:hi])] = t[lo:hi]
            own = self.rows(part)
            out += weights @ self.table[own].astype(np.float32)
        return out


def _has_letter(codes: np.ndarray) -> bool:
    return bool((codes != 0).any())


_spaces: dict[tuple, Space] = {}


def space(n: int, dimensions: int) -> Space:
    return _spaces.setdefault((n, dimensions), Space(n, dimensions))


def _profile_rows(n: int, dimensions: int):
    """Sums of this task's n-gram counts by language, as prototype parts."""

    def run(batches: Iterator[pa.RecordBatch]):
        sp = space(n, dimensions)
        sums: dict[str, np.ndarray] = {}
        counts: dict[str, dict[int, int]] = {}

        def fold(lang: str) -> None:
            own = counts.pop(lang)
            codes = np.array(sorted(own), np.int64)
            times = np.array([own[c] for c in codes.tolist()], np.int64)
            total = sums.setdefault(lang, np.zeros(dimensions, np.int64))
            for at in range(0, len(codes), 4096):
                part = codes[at : at + 4096]
                own_rows = sp.rows(part)
                product = times[at : at + 4096].astype(np.float64) @ sp.table[own_rows].astype(np.float64)
                total += np.rint(product).astype(np.int64)

        for b in batches:
            held: dict[str, list] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                c, t = sp.counts(text.as_py() or "")
                if len(c) and _has_letter(c):
                    held.setdefault(lang, []).append((c, t))
            for lang, parts in held.items():
                c, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                t = np.bincount(back, np.concatenate([t for _, t in parts])).astype(np.int64)
                own = counts.setdefault(lang, {})
                for code, times in zip(c.tolist(), t.tolist()):
                    own[code] = own.get(code, 0) + times
                if len(own) > 2 * _HELD:
                    fold(lang)
        for lang in list(counts):
            fold(lang)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))],
                names=["lang", "part"],
            )

    return run


def learn(docs: DataFrame, n: int = N, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order of name and their centred unit prototypes, from columns lang, text.

    One vector for each language and task is exchanged; one for each language is returned.
    """
    labelled = has_columns(docs, "lang", "text").where("lang is not null and lang <> ''")
    parts = materialise(
        labelled.mapInArrow(released(_profile_rows(n, dimensions)), "lang string, part array<long>"), "language-parts"
    )
    languages = parts.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} distinct values")
    sums = (
        parts.select("lang", F.posexplode("part").alias("i", "v"))
        .groupBy("lang", "i")
        .agg(F.sum("v").alias("v"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("v"))
        .orderBy("lang")
        .collect()
    )
    names = [r["lang"] for r in sums]
    if not names:
        return [], np.zeros((0, dimensions))
    vectors = np.array([[x["v"] for x in r["v"]] for r in sums], np.float64)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    if len(names) > 1:
        vectors -= vectors.mean(axis=0)
    return names, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


class Model:
    """Prototypes, to be broadcast; decide(texts) gives languages and cosines."""

    def __init__(self, names: list[str], prototypes: np.ndarray, n: int, dimensions: int):
        self.names, self.weights, self.n, self.dimensions = names, prototypes.T.astype(np.float32), n, dimensions

    def decide(self, texts: pa.Array) -> tuple[list[str | None], np.ndarray]:
        """Of each text the language with the largest cosine, which may be negative; ``und``
        without a letter, None where there are letters but no prototypes."""
        sp = space(self.n, self.dimensions)
        langs, cosines = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        held: list[tuple[int, tuple[np.ndarray, np.ndarray]]] = []

        def bundle() -> None:
            v = sp.bundles([c for _, c in held])
            norm = np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            for (i, _), row in zip(held, (v / norm) @ self.weights):
                best = int(row.argmax())
                langs[i], cosines[i] = self.names[best], float(row[best])
            held.clear()

        for i, t in enumerate(texts):
            counts = sp.counts(t.as_py() or "")
            if not (len(counts[0]) and _has_letter(counts[0])):
                continue
            if not self.names:
                langs[i] = None
                continue
            held.append((i, counts))
            if len(held) == _ROWS:
                bundle()
        if held:
            bundle()
        return langs, cosines


def _model(spark: SparkSession, names: list[str], prototypes: np.ndarray, n: int, dimensions: int):
    return spark.sparkContext.broadcast(Model(names, prototypes, n, dimensions))


def _predicted(model, texts: pa.Array) -> list[pa.Array]:
    """lang_pred and score."""
    langs, cosines = model.value.decide(texts)
    return [pa.array([x or UNDETERMINED for x in langs], pa.string()), pa.array(np.clip(cosines, 0.0, 1.0), pa.float64())]


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray, n: int = N, dimensions: int = DIMENSIONS) -> DataFrame:
    """``docs`` (which has a column text) with lang_pred and score; columns of these names
    that it has are replaced."""
    docs = docs.drop("lang_pred", "score")
    model = _model(docs.sparkSession, names, prototypes, n, dimensions)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        for b in batches:
            found = _predicted(model, b.column("text"))
            yield pa.RecordBatch.from_arrays([*b.columns, *found], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(released(run), f"{fields}, lang_pred string, score double")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score. Learns from the
    rows that aren't held out; predicts from the text alone."""
    model = _model(docs.sparkSession, *learn(docs.where(~held_out())), N, DIMENSIONS)
    rows = has_columns(docs.withColumn("held_out", held_out()), "doc_id", "held_out", "text")
    # the text goes no further than the prediction
    ddl = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"

    def run(batches):
        for b in batches:
            found = _predicted(model, b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), *found], names=["doc_id", "held_out", "lang_pred", "score"]
            )

    return rows.mapInArrow(released(run), ddl)


def keep_languages(docs: DataFrame, languages: list[str] | None = None, min_cosine: float = 0.0) -> DataFrame:
    """The rows of ``docs`` that are predicted to be in one of ``languages`` (all that are
    learned, unless given) with a cosine above ``min_cosine``: at 0, a text goes that is no
    nearer to any language than what all languages share is, and so does one without a letter.
    Without any labelled text nothing is known of languages; then texts without a letter go."""
    model = _model(docs.sparkSession, *learn(docs.where(~held_out())), N, DIMENSIONS)
    wanted = None if languages is None else frozenset(languages)

    def run(batches):
        for b in batches:
            langs, cosines = model.value.decide(b.column("text"))
            keep = [
                x is None or (x != UNDETERMINED and c > min_cosine and (wanted is None or x in wanted))
                for x, c in zip(langs, cosines.tolist())
            ]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
