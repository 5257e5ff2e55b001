import io

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import warc as W


def test_archive_round_trip():
    records = [W.warc_record(i, f"http://x/{i}", f"<html>page {i} {'text ' * (i % 40)}</html>".encode(), None, None, False) for i in range(400)]
    out = io.BytesIO()
    a = W.Archive(out)
    for r in records:
        a.add(r)
    a.close()
    data = out.getvalue()
    assert data[:4] == W.MAGIC.to_bytes(4, "little") and 0 < int.from_bytes(data[4:8], "little") <= W.DICTIONARY_BYTES
    for chunk in (1, 7, 1 << 20):
        if chunk > 1 or len(data) < 200_000:
            assert list(W.read_archive(io.BytesIO(data), chunk)) == records
    import zstandard

    size = int.from_bytes(data[4:8], "little")
    held = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    first = zstandard.ZstdDecompressor(dict_data=held).decompressobj().decompress(data[8 + size :])
    assert first == records[0]  # a frame of its own
    with pytest.raises(ValueError):
        list(W.read_archive(io.BytesIO(data[:-3])))
    with pytest.raises(ValueError):
        list(W.read_archive(io.BytesIO(data[8 + size :])))


ROWS = [(5, "u5", "same"), (2, "u2", "same"), (9, "u9", "same"), (1, "u1", None), (3, None, ""), (4, "a b\n", "<p>é</p>"), (None, "n", "same"), (7, "u7", "twice"), (7, "u7", "twice"), (8, "u8", "x" * 300_000), (None, "m", "alone")]


def test_query_against_brute_force(spark, folder):
    table = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("n", F.lit(2))
    got = W.op9_warc(spark, folder(pages=table)).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for p, _, h in ROWS:
        groups.setdefault(h or "", []).append(p)
    have = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got)
    want = []
    for h, ids in groups.items():
        ids = sorted(ids, key=lambda p: (p is None, p or 0))
        raw = h.encode()
        for i, p in enumerate(ids):
            want.append((str(p), len(raw), W.payload_digest(raw), "revisit" if i else "response", str(ids[0]) if i else "None"))
    assert have == sorted(want)


def test_small_payloads_need_not_be_revisited(spark, folder, tmp_path):
    table = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    place = f"file://{tmp_path}/archives"
    manifest = W.write_archives(table, place, revisit_from=5)
    got = W.read_archives(manifest, place).collect()
    assert sum(r["record_type"] == "revisit" for r in got) == 1  # of "twice"; the others are shorter
    assert manifest.agg(F.sum("records")).first()[0] == len(ROWS)
    refers = [r for r in got if r["record_type"] == "revisit"]
    ids = {r["record_id"] for r in got if r["record_type"] == "response"}
    assert all(r["refers_to_record"] in ids for r in refers)


def test_empty_table(spark, folder):
    table = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.op9_warc(spark, folder(pages=table)).count() == 0
