import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from tallyforge.llm import queries
from tallyforge.llm.packing import pack
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard_join import brute as classes
from tests.llm.test_language_id import naive as languages
from tests.llm.test_packing import check


def corpus():
    rng = random.Random(12)
    words = "the of and to in is that it was for on are with as this they be at have from or had by".split()
    item = " ".join(rng.choice(words) for _ in range(25))
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 120))) for _ in range(40)]
    rows = []
    for i in range(120):
        t = rng.choice(base).split()
        if i % 3 == 0:
            t[rng.randrange(len(t))] = "changed"
        if i % 10 == 0:
            t[5:5] = item.split()[:14]
        rows.append((i, " ".join(t)))
    rows += [(200, None), (201, "12 34"), (202, rows[3][1]), (203, "")]
    return rows, [(1, item), (2, None)]


def brute(rows, items):
    cosine = languages([(d, t, "en") for d, t in rows])
    rows = [(d, t) for d, t in rows if cosine[d][1] > 0]
    last = {}
    for d, t in rows:
        last[t] = max(d, last.get(t, d))
    rows = [(d, t) for d, t in rows if last[t] == d]
    keep = {int(c) for _, _, c in classes(rows)}
    rows = [(d, t) for d, t in rows if d in keep]
    hit = {r[0] for r in contaminated(rows, items) if r[5]}
    return {d: t for d, t in rows if str(d) not in hit}


def test_stages_against_brute_force(spark, docs, folder):
    rows, items = corpus()
    place = folder(documents=docs(rows), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    want = brute(rows, items)
    got = [r.asDict() | {"ids": None} for r in P.run(spark, place).collect()]
    assert {r["doc_id"] for r in got} == set(want) and 0 < len(want) < len(rows)
    check(got, want, 1024)


def test_stages_are_as_declared(spark, docs, folder):
    rows, items = corpus()
    table = docs(rows)
    place = folder(documents=table, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, table, place).columns == table.columns
        assert stage(spark, table.limit(0), place).count() == 0
    assert "ids" in pack(table).columns


def test_stages_with_clashing_columns_and_without_labels(spark, docs, folder):
    rows, items = corpus()
    table = docs([(d, t, None) for d, t in rows])
    for name in ("score", "lang_pred", "__file", "__row", "file", "row", "rid", "key", "n", "digest", "kept", "item_id"):
        table = table.withColumn(name, F.lit("x"))
    place = folder(documents=table, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    docs_ = table
    for name, stage in P.STAGES[:-1]:
        docs_ = stage(spark, docs_, place)
        assert docs_.columns == table.columns, name
        docs_ = spark.createDataFrame(docs_.collect(), table.schema)
    assert {r["doc_id"] for r in docs_.collect()} == set(brute(rows, items))
    assert {r["doc_id"] for r in P.STAGES[-1][1](spark, docs_, place).collect()} == set(brute(rows, items))


def test_every_operator_has_its_query():
    assert sorted(q.split("_")[0] for q in queries.QUERIES) == sorted(f"op{i}" for i in range(1, 11))
    assert set(queries.SQL) <= set(queries.QUERIES)
