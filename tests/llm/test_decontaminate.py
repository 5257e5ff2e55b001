import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate as D


def tokens(text):
    t = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items):
    out = []
    for d, text in docs:
        w, hit, ids = tokens(text), set(), set()
        for i, t in items:
            q = tokens(t)
            m = min(len(q), 10)
            grams = {tuple(q[a : a + m]) for a in range(len(q) - m + 1)} if q else set()
            for a in range(len(w) - m + 1 if m else 0):
                if tuple(w[a : a + m]) in grams:
                    hit |= set(range(a, a + m))
                    if i is not None:
                        ids.add(str(i))
        names = sorted(ids)
        out.append((str(d), len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def found(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect())


def data(seed):
    rng = random.Random(seed)
    w = [f"t{i}" for i in range(8)]
    items = [(i, " ".join(rng.choice(w) for _ in range(rng.choice([0, 1, 3, 7, 9, 10, 11, 25, 40])))) for i in range(30)]
    items += [(30, None), (None, " ".join(rng.choice(w) for _ in range(12))), (5, "Éa B7-c"), (31, items[7][1])]
    docs = []
    for i in range(60):
        t = [rng.choice(w) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            q = tokens(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(q) - 3))
            t[len(t) // 2 : len(t) // 2] = q[a:]
        docs.append((i, ", ".join(t) if i % 2 else " ".join(t).upper()))
    return docs + [(100, None), (101, ""), (None, items[8][1]), (7, docs[7][1]), (102, "éA!b7 C"), (103, "x " * 40_000 + (items[9][1] or ""))], items


@pytest.mark.parametrize("block", [D.BLOCK_WORDS, 40])
def test_against_brute_force(spark, docs, block):
    rows, items = data(3)
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("block", F.lit(1))
    got = D.decontaminate(docs(rows).withColumn("rid", F.lit(0)), table, block_words=block)
    assert found(got) == brute(rows, items)
    for r in got.collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]


def test_empty_tables(spark, docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert found(D.decontaminate(docs([(1, "a b")]), items)) == brute([(1, "a b")], [])
    assert D.decontaminate(docs([]), items).count() == 0


def test_clean_documents_stay(spark, docs):
    rows, items = data(4)
    out = D.drop_contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == docs([]).columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(r[0] for r in brute(rows, items) if not r[5])
