import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm import bpe
from tallyforge.llm import packing as P

_TOKENIZER = Tokenizer.from_file(bpe.default_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", *"ab1 ,.'\n\t\r<|>é\xa0\x1c\x85　🙂"]), st.characters(exclude_categories=["Cs"])), max_size=60).map("".join))
def test_ids_are_those_of_the_tokenizer(text):
    assert bpe.encoder().ids(text).tolist() == _TOKENIZER.encode(text, add_special_tokens=False).ids


def test_added_tokens_have_their_own_ids():
    assert bpe.encoder().ids("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    for text in ("<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext", " <|endoftext|>\n"):
        assert bpe.encoder().ids(text).tolist() == _TOKENIZER.encode(text, add_special_tokens=False).ids


def test_a_file_whose_ids_are_no_ranks():
    path = bpe.default_path().replace("byte_bpe_50k", "word_bpe_49k")
    text = "Some <|startoftext|> text, <|endoftext|>twice"
    assert bpe.Encoder(path).ids(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=60))
def test_each_piece_goes_where_the_squares_are_least(lengths):
    s = P.SumOfSquares(12)
    gaps = {}  # sequence -> tokens left, if any
    for n in lengths:
        def squares(g):
            return sum(v * v for v in np.bincount(list(g.values()), minlength=13)[1:].tolist()) if g else 0

        options = [squares({**gaps, -1: 12 - n} if n < 12 else gaps)]
        options += [squares({k: v - (k == i) * n for k, v in gaps.items() if v - (k == i) * n > 0}) for i, v0 in gaps.items() if v0 >= n]
        number, offset = s.place(n)
        left = gaps.pop(number, 12)
        assert 12 - left == offset and left >= n
        if left > n:
            gaps[number] = left - n
        assert n == 12 or squares(gaps) == min(options)


def test_pieces():
    assert list(P.pieces(5, 8)) == [(0, 5)]
    assert list(P.pieces(8, 8)) == [(0, 8)]
    assert list(P.pieces(19, 8)) == [(0, 3), (3, 8), (11, 8)]


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def check(rows, texts, capacity):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for d, t in texts.items():
        ids = _TOKENIZER.encode(t or "", add_special_tokens=False).ids + [2]
        at = 0
        for i, r in enumerate(sorted(by_doc[d], key=lambda r: r["piece"])):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["piece"], r["start"], r["ids_crc32"]) == (i, at, zlib.crc32(part))
            assert r["ids"] is None or bytes(r["ids"]) == part
            assert i == 0 or r["length"] == capacity
            at += r["length"]
        assert at == len(ids) and (len(ids) > capacity or len(by_doc[d]) == 1)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_round_trip_and_tightness(docs):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["the", "of", "thering", "éan"]) for _ in range(rng.randint(0, 700))) for i in range(120)}
    texts |= {200: None, 201: "", 202: "word " * 9000, 203: "a <|endoftext|> b", None: "nobody"}
    table = docs([(d, t) for d, t in texts.items()])
    rows = rows_of(P.pack(table))
    used = check(rows, texts, 1024)
    least = -(-sum(r["length"] for r in rows) // 1024)
    assert used <= least * 1.05 + 1
    check(rows_of(P.pack(table, with_ids=False, group_pieces=20)), texts, 1024)


def test_repeated_rows_and_empty_table(docs):
    rows = rows_of(P.pack(docs([(1, "a b c"), (1, "a b c")])))
    assert len(rows) == 2 and {r["offset"] for r in rows} == {0, rows[0]["length"]}
    assert P.pack(docs([])).count() == 0
