import pyarrow as pa

from tallyforge.llm import shared as S
from tallyforge.llm.components import connected


def test_settled_keeps_plain_tables_only(spark, tmp_path):
    spark.range(10).write.parquet(f"file://{tmp_path}/t")
    plain = spark.read.parquet(f"file://{tmp_path}/t").where("id > 2").selectExpr("id", "id + 1 AS Join")
    assert S.settled(plain, "t") is plain
    for df in (plain.repartition(3), plain.distinct(), plain.union(plain), plain.orderBy("id"), plain.limit(3)):
        out = S.settled(df, "t")
        assert out is not df and sorted(out.collect()) == sorted(df.collect())


def test_sized_broadcasts_only_up_to_its_bound(spark):
    left, right = spark.range(100), spark.range(20)
    for most, hint in ((20, True), (19, False)):
        plan = left.join(S.sized(right, most), "id")._jdf.queryExecution().analyzed().toString()
        assert ("strategy=broadcast" in plan) == hint


def test_bounded_slices():
    b = pa.RecordBatch.from_pydict({"text": ["a" * 5, None, "", "b" * 20, "c"], "i": [0, 1, 2, 3, 4]})
    parts = list(S.bounded([b, b.slice(0, 0)], size=8))
    assert [p.column("i").to_pylist() for p in parts] == [[0, 1, 2], [3], [4]]


def test_components(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, i) for i in range(1000, 1100)] + [(i, i + 1) for i in range(2000, 2040)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["key"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in linked}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_row_groups_streams():
    b = pa.RecordBatch.from_pydict({"k": [1, 1, 2], "v": [1, 2, 3]})
    c = pa.RecordBatch.from_pydict({"k": [2, 3], "v": [4, 5]})
    seen = []
    for (k,), rows in S.row_groups([b, c], ("k",)):
        seen.append((k, [next(rows)["v"]] if k == 1 else [r["v"] for r in rows]))
    assert seen == [(1, [1]), (2, [3, 4]), (3, [5])]
