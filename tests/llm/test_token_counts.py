import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import bpe
from tallyforge.llm import token_counts as T

ENC = bpe.encoder()
TEXT = st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", *"ab1 ,.'\n\t é\xa0s漢_ ab "]), max_size=120).map("".join)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(-3, 140), st.integers(-2, 60), TEXT), max_size=6))
def test_counts_follow_edits(text, edits):
    d = T.EditableDocument(ENC, text, size=8)
    assert d.count() == ENC.count(text) and d.text() == text
    for start, length, insert in edits:
        a = min(max(0, start), len(text))
        b = min(len(text), a + max(0, length))
        text = text[:a] + insert + text[b:]
        d.edit(start, length, insert)
        assert d.text() == text and d.count() == ENC.count(text)
        assert d.char_tree.total() == len(text) and d.tokens == [ENC.count(p) for p in d.parts]


def test_only_the_touched_region_is_encoded_again():
    text = " ".join(f"word{i}" for i in range(20_000))
    d = T.EditableDocument(ENC, text)
    d.encoded = 0
    d.edit(50_000, 3, "xyz")
    assert 0 < d.encoded < 3 * T.SEGMENT
    assert d.count() == ENC.count(d.text())


def test_edits_that_change_the_number_of_segments_change_sums_only():
    rng = random.Random(6)
    text = " ".join(f"word{i}" for i in range(20_000))
    d = T.EditableDocument(ENC, text)
    built = d.laid_out
    for _ in range(40):
        a, n, insert = rng.randrange(len(text)), rng.choice((0, 3, 2_000)), rng.choice(("", "xyz ", "more words of it " * 100))
        text = text[:a] + insert + text[a + n :]
        d.edit(a, n, insert)
        assert d.text() == text
    assert d.count() == ENC.count(text) and d.laid_out == built
    d.edit(5, 0, "a long insertion " * 2_000)
    assert d.laid_out == built + 1 and d.count() == ENC.count(d.text())


def test_one_segment_where_an_added_token_holds_a_space():
    class Joined:
        cuttable, ids, count = False, ENC.ids, ENC.count

    d = T.EditableDocument(Joined(), "word " * 1_000)
    assert len(d.parts) == 1
    d.edit(10, 2, "x y")
    assert len(d.parts) == 1 and d.count() == ENC.count(d.text())


def test_sum_tree():
    rng = random.Random(1)
    v = [rng.randint(0, 5) for _ in range(37)]
    t = T.SumTree(np.array(v))
    for _ in range(50):
        i = rng.randrange(37)
        v[i] = rng.randint(0, 5)
        t.set(i, v[i])
        assert t.total() == sum(v)
        for at in range(sum(v)):
            leaf, before = t.find(at)
            assert before == sum(v[:leaf]) and before <= at < before + v[leaf]


def test_query_against_full_recount(spark, docs, folder):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "thering,", "of\n", "é"]) for _ in range(rng.randint(0, 900)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "x" * 5_000), (104, "<|endoftext|> ab " * 99), (None, "a b"), (7, rows[7][1]), (103, "long text here " * 20_000)]
    table = docs(rows).withColumn("edits", F.lit(1))
    got = T.op3_token_counts(spark, folder(documents=table)).collect()

    def revised(t):
        t = t or ""
        n = len(t)
        t = t[: n // 2] + "\nRevised on review.\n" + t[n // 2 :]
        a = n // 4
        t = t[:a] + t[a + 40 :]
        a = min(len(t), n * 3 // 4)
        return t[:a] + " amended " + t[a + 6 :]

    want = sorted((str(d), ENC.count(t or ""), ENC.count(revised(t))) for d, t in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens_before"], r["n_tokens_after"]) for r in got) == want
    big = next(r for r in got if r["doc_id"] == 103)
    assert big["encoded_chars"] < 20 * T.SEGMENT


def test_nulls_in_edits_and_empty_table(spark, docs):
    trees = T.count_trees(docs([(1, "a b c d"), (2, None)]))
    edits = F.from_json(F.lit('[{"start":1,"length":2,"insert":null},null,{"start":null,"length":null,"insert":"z"}]'), "array<struct<start: long, length: long, insert: string>>")
    got = {r["doc_id"]: r["text"] for r in T.apply_edits(trees, edits).collect()}
    assert got == {1: "za c d", 2: "z"}
    assert T.apply_edits(T.count_trees(docs([])), edits).count() == 0


@pytest.mark.parametrize("text", ["", "a", " ", "a b" * 1000])
def test_cuts_are_starts(text):
    c = T.cuts(text, 16)
    assert c == sorted(set(c)) and (c[:1] == [0] if text else c == [])
