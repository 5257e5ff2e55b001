import pytest
from pyspark.sql import functions as F

from tallyforge.llm import exact_dedup as X

ROWS = [(3, "a"), (9, "a"), (5, "a"), (1, None), (2, ""), (4, "b"), (4, "b"), (None, "c"), (7, "c"), (None, "d"), (8, "x" * 50_000), (6, "A"), (10, "a ")]


def result(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()))


def expected(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    return {k: (max([x for x in v if x is not None], default=None), len(v)) for k, v in groups.items()}


def check(df, rows):
    want = expected(rows)
    got = df.collect()
    assert len(got) == len(rows)
    kept = {}
    for r in got:
        kept.setdefault(r["text_sha256"], []).append(r["kept"])
    assert all(sum(v) == 1 for v in kept.values()) and len(kept) == len(want)
    have = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in got)
    assert have == sorted((str(d), str(want[t or ""][0]), want[t or ""][1]) for d, t in rows)


def test_groups_nulls_ties_repeats(spark, docs, folder):
    path = folder(documents=docs(ROWS)) + "/documents.parquet"
    check(X.exact_dedup(spark, path), ROWS)


def test_colliding_keys_are_told_apart_by_bytes(spark, docs, folder):
    path = folder(documents=docs(ROWS)) + "/documents.parquet"
    check(X.exact_dedup(spark, path, key=lambda c: F.concat(F.lit("same"), F.substring(X.digest(c), 1, 0))), ROWS)
    check(X.exact_dedup(spark, path, key=lambda c: F.substring(X.digest(c), 1, 1)), ROWS)


def test_empty_table_and_clashing_columns(spark, docs, folder):
    empty = docs([]).withColumn("digest", F.lit(1)).withColumn("place", F.lit("x"))
    path = folder(documents=empty) + "/documents.parquet"
    assert X.exact_dedup(spark, path).count() == 0


def test_drop_keeps_columns_and_one_row_a_text(spark, docs, folder):
    table = docs(ROWS).withColumn("keep", F.lit("k")).withColumn("n", F.lit(0)).withColumn("digest", F.lit("z"))
    path = folder(documents=table) + "/documents.parquet"
    for source in (spark.read.parquet(path), table, spark.read.parquet(path).where("n = 0")):
        out = X.drop_duplicates(source)
        assert out.columns == table.columns
        assert out.count() == len({t or "" for _, t in ROWS})


@pytest.mark.parametrize("names", [("__file", "__row"), ("file", "row"), ("_file", "FILE"), ("path", "_metadata_x")])
def test_drop_with_columns_of_its_own_names(docs, names):
    table = docs(ROWS)
    for n in names:
        table = table.withColumn(n, F.lit(1))
    out = X.drop_duplicates(table)
    assert out.columns == table.columns and out.count() == len({t or "" for _, t in ROWS})


@pytest.mark.parametrize("name", ["a[b]{c,d}*?/documents.parquet", "out/0", "a-"])
def test_paths_with_characters_of_patterns(docs, tmp_path, name):
    place = tmp_path / name
    docs(ROWS).coalesce(1).write.parquet(f"file://{tmp_path}/plain")
    place.parent.mkdir(exist_ok=True)
    (tmp_path / "plain").rename(place)
    spark = docs(ROWS).sparkSession
    check(X.exact_dedup(spark, f"file://{place}"), ROWS)
    assert X.drop_duplicates(spark.read.parquet(X.literal(f"file://{place}"))).count() == len({t or "" for _, t in ROWS})


def test_state_goes_on(spark, docs, folder, tmp_path):
    path = folder(documents=docs(ROWS)) + "/documents.parquet"
    first = X.StreamingDedup(spark, f"file://{tmp_path}/state", batch_bytes=1024)
    first.feed(path)
    docs([(99, "a"), (100, "new")]).write.mode("append").parquet(path)
    again = X.StreamingDedup(spark, f"file://{tmp_path}/state")
    again.feed(path)
    held = {r["keep"][0]: r["n"] for r in again.state().collect()}
    assert held[99] == 4 and held[100] == 1
