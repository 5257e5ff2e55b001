import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import jaccard_join as J
from tallyforge.llm import wordhash as W


def shingles(text, k=5):
    t = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(root(i), d))) for i, (d, _) in enumerate(rows))


def found(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 90))] for _ in range(n // 4)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.3:
            t += passage
        if rng.random() < 0.2:
            t = t[: rng.randint(0, len(t))]
        rows.append((i, (" " if i % 2 else "\n").join(t).upper() if i % 5 == 0 else " ".join(t)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, tokens", [(J.BLOCK_DOCS, J.BLOCK_TOKENS), (3, J.BLOCK_TOKENS), (J.BLOCK_DOCS, 300)])
def test_against_brute_force(docs, block, tokens):
    rows = corpus(block + tokens, 160)
    assert found(J.jaccard_classes(docs(rows), block_docs=block, block_tokens=tokens)) == brute(rows)


def test_nulls_empties_repeats_long_and_unicode(docs):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "é b c"), (5, "É b c"), (6, "a b"), (6, "a b"), (None, "a b"), (None, "zz"), (8, long), (7, long + " y"), (9, "one"), (10, "ONE")]
    assert found(J.jaccard_classes(docs(rows))) == brute(rows)
    assert J.jaccard_classes(docs([])).count() == 0


def test_hot_group_of_near_copies(docs):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(400):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(120)] = f"v{rng.randrange(50)}"
        rows.append((i, " ".join(t)))
    assert found(J.jaccard_classes(docs(rows))) == brute(rows)


def test_one_row_of_each_class_stays(docs):
    rows = corpus(1, 80)
    near = rows[0][1] + " more"
    rows += [(None, "lonely words here"), (None, near), (rows[0][0], near), (7, rows[3][1]), (7, rows[3][1]), (300, None), (300, "")]
    table = docs(rows).coalesce(1).withColumn("rid", F.lit("x")).withColumn("class", F.lit(1)).withColumn("_rid", F.lit(2))
    label = {}
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]
    for i, _, c in brute(numbered):
        label.setdefault(c, []).append(int(i))
    want = [min(v, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)) for v in label.values()]
    out = J.drop_near_duplicates(table)
    assert out.columns == table.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in out.collect()) == sorted(str(rows[i]) for i in want)
    clash = J.jaccard_classes(table.withColumn("key", F.lit(1)).withColumn("n", F.lit(1)))
    assert found(clash) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 25), min_size=0, max_size=20), min_size=2, max_size=14), st.integers(0, 2))
def test_link_classes_is_exact(raw, depth):
    """Random sets: the adaptive prefixes lose no link. ``head`` may be longer than needed."""
    sets = [sorted(set(s)) for s in raw if s]
    if len(sets) < 2:
        return
    df = {}
    for s in sets:
        for x in s:
            df[x] = df.get(x, 0) + 1
    n = np.array([len(s) for s in sets])
    tokens = [np.array(sorted((x for x in s if df[x] > 1), key=lambda x: (df[x], x)), np.uint64) for s in sets]
    need = J.needed(n, J.THRESHOLD)
    good = [i for i in range(len(sets)) if len(tokens[i]) >= need[i]]
    if len(good) < 2:
        return
    head = np.array([len(tokens[i]) - need[i] + 1 for i in good])
    label = J.link_classes([tokens[i] for i in good], n[good], head, None, J.THRESHOLD)
    parent = list(range(len(good)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(good)):
        for b in range(a):
            o = len(set(sets[good[a]]) & set(sets[good[b]]))
            if J.linked(o, len(sets[good[a]]), len(sets[good[b]]), J.THRESHOLD):
                parent[root(a)] = root(b)
    for a in range(len(good)):
        for b in range(a):
            assert (label[a] == label[b]) == (root(a) == root(b))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b.", max_size=30)), max_size=8))
def test_words_of_a_column(texts):
    w = W.words(pa.array(texts, pa.string()), W.NON_SPACE)
    seen = {}
    for row, text in enumerate(texts):
        raw = "".join(c.lower() if c.isascii() else c for c in text or "").encode()
        parts = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        assert w.count()[row] == len(parts)
        for part, h in zip(parts, w.hash[w.first[row] : w.first[row + 1]]):
            assert seen.setdefault(part, h) == h
    assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_place(monkeypatch):
    text = " ".join(f"word{i % 97}" for i in range(3000))
    whole = W.words(pa.array([text, "x", text]), W.NON_SPACE)
    monkeypatch.setattr(W, "_SLICE", 50)
    cut = W.words(pa.array(["pad", text]).slice(1), W.NON_SPACE)
    assert (whole.hash[:3000] == cut.hash).all() and (whole.hash[3001:] == cut.hash).all()
