"""WARC archives compressed record by record with a dictionary of their own.

A writer task makes one archive: it trains a Zstandard dictionary from the first records (at
most ``SAMPLE_BYTES`` of them), puts it into a leading skippable frame (magic 0x184D2A5D)
and compresses each record into a frame of its own, so any record can be read alone.

Of pages with equal payloads of ``revisit_from`` bytes or more, the one with the smallest
page_id is archived as response; the others are revisits of it, without the payload.

Archives go to the shared folder, each under a temporary name first, then renamed: a task
that runs twice leaves one archive. They are read back as a stream of frames.

Defined results: null html is an empty payload; a null page_id ranks above every other; of
rows equal in page_id and payload one is the response; an empty table gives no archive and
no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batch, has_columns, materialise, released, settled, shared_path

MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
_CRLF = b"\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{kind}')}>"


def _uri(url: str | None) -> str:
    return "".join(c if c > " " else "%%%02X" % ord(c) for c in url or "") or "about:blank"


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, revisit: bool) -> bytes:
    kind = "revisit" if revisit else "response"
    block = _HTTP if revisit else _HTTP + payload
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, url, kind)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if revisit:
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, refers_url, "response")),
            ("WARC-Refers-To-Target-URI", _uri(refers_url)),
        ]
        if refers_to is not None:
            head.append(("X-Refers-To-Page-Id", str(refers_to)))
    lines = b"".join(f"{k}: {v}".encode() + _CRLF for k, v in head)
    return b"WARC/1.1" + _CRLF + lines + _CRLF + block + _CRLF + _CRLF


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, found, rest = data.partition(_CRLF + _CRLF)
    version, *lines = head.split(_CRLF)
    if version != b"WARC/1.1" or not found:
        raise ValueError("not a WARC record")
    fields = dict(line.decode().split(": ", 1) for line in lines)
    length = int(fields["Content-Length"])
    if rest[length:] != _CRLF + _CRLF:
        raise ValueError("the record's length is wrong")
    return fields, rest[:length]


# ------------------------------------------------------------------------- archives


def train(samples: list[bytes]) -> bytes:
    """A dictionary from records; the records themselves where they are too few to train."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


class Archive:
    """Writes records to a stream; the dictionary comes from the first ones."""

    def __init__(self, out):
        self.out, self.waiting, self.size, self.compressor, self.records = out, [], 0, None, 0

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.compressor is not None:
            self.out.write(self.compressor.compress(record))
            return
        self.waiting.append(record)
        self.size += len(record)
        if self.size >= SAMPLE_BYTES:
            self.begin()

    def begin(self) -> None:
        import zstandard

        held = train(self.waiting)
        self.out.write(MAGIC.to_bytes(4, "little") + len(held).to_bytes(4, "little") + held)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(held), write_checksum=True)
        for r in self.waiting:
            self.out.write(self.compressor.compress(r))
        self.waiting = []

    def close(self) -> None:
        if self.compressor is None:
            self.begin()


def read_archive(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Records of an archive, one at a time; ``source`` has read(n)."""
    import zstandard

    head = _exactly(source, 8)
    if int.from_bytes(head[:4], "little") != MAGIC:
        raise ValueError("no dictionary frame leads this archive")
    held = zstandard.ZstdCompressionDict(_exactly(source, int.from_bytes(head[4:], "little")))
    left = b""
    while left or (left := source.read(chunk)):
        frame = zstandard.ZstdDecompressor(dict_data=held).decompressobj()
        out = io.BytesIO()
        while True:
            out.write(frame.decompress(left))
            if frame.eof:
                left = frame.unused_data
                break
            left = source.read(chunk)
            if not left:
                raise ValueError("the archive ends within a record")
        yield out.getvalue()


def _exactly(source, n: int) -> bytes:
    parts = []
    while n and (part := source.read(n)):
        parts.append(part)
        n -= len(part)
    if n:
        raise ValueError("the archive ends too soon")
    return b"".join(parts)


def _store(uri: str):
    """File system and path of a folder: local, HDFS, S3 and what else Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


MANIFEST_DDL = "archive string, records long, bytes long"


def _writer(folder: str):
    def run(batches):
        from pyspark import TaskContext

        store, root = _store(folder)
        task = TaskContext.get()
        name = f"{root}/pages-{task.partitionId():06d}.warc.zst"
        trial = f"{name}.{task.taskAttemptId()}.tmp"
        out = archive = None
        for b in batches:
            for r in b.to_pylist():
                if archive is None:
                    out = store.open_output_stream(trial, compression=None)
                    archive = Archive(out)
                archive.add(warc_record(r["page_id"], r["url"], (r["html"] or "").encode(), r["to_id"], r["to_url"], r["revisit"]))
        if archive is None:
            return
        archive.close()
        size = out.tell()
        out.close()
        store.move(trial, name)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([archive.records], pa.int64()), pa.array([size], pa.int64())],
            names=["archive", "records", "bytes"],
        )

    return run


def write_archives(pages: DataFrame, folder: str, revisit_from: int = 0) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) below ``folder``; returns archive, records, bytes."""
    spark = pages.sparkSession
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    pages = settled(has_columns(pages, "page_id", "url", "html"), "warc-pages")
    rows = pages.select(
        F.col("page_id").cast("long"), "url", "html", F.monotonically_increasing_id().alias("rid")
    ).withColumn("key", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "rid", "url"))
    sized = F.octet_length(F.coalesce("html", F.lit(""))) >= revisit_from
    groups = rows.where(sized).groupBy("key").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    copied = materialise(groups.where("n > 1").select("key", "first"), "warc-copied")
    decided = rows.join(copied, "key", "left").select(
        "page_id",
        "url",
        "html",
        F.col("first.page_id").alias("to_id"),
        F.col("first.url").alias("to_url"),
        F.coalesce(F.col("first.rid") != F.col("rid"), F.lit(False)).alias("revisit"),
    )
    return materialise(decided.mapInArrow(released(_writer(folder)), MANIFEST_DDL), "warc-manifest")


RECORD_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_id string, refers_to_record string"
RECORD_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("record_id", pa.string()), ("refers_to_record", pa.string())]
)


def _reader(folder: str):
    def run(batches):
        store, _ = _store(folder)
        for b in batches:
            for name in b.column("archive").to_pylist():
                out: dict[str, list] = {f: [] for f in RECORD_SCHEMA.names}
                with store.open_input_stream(name, compression=None) as source:
                    for data in read_archive(source):
                        fields, block = parse_record(data)
                        said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        length = int(fields["X-Payload-Length"])
                        if fields["WARC-Type"] == "response":
                            payload = block[block.index(_CRLF + _CRLF) + 4 :]
                            if (len(payload), payload_digest(payload)) != (length, said):
                                raise ValueError(f"{name}: a payload isn't what its record says")
                        to = fields.get("X-Refers-To-Page-Id")
                        page = fields.get("X-Page-Id")
                        values = (
                            None if page is None else int(page), length, said, fields["WARC-Type"],
                            None if to is None else int(to), name, fields["WARC-Record-ID"], fields.get("WARC-Refers-To"),
                        )
                        for f, v in zip(RECORD_SCHEMA.names, values):
                            out[f].append(v)
                        if len(out["page_id"]) >= 5_000:
                            yield batch(RECORD_SCHEMA, **out)
                            out = {f: [] for f in RECORD_SCHEMA.names}
                if out["page_id"]:
                    yield batch(RECORD_SCHEMA, **out)

    return run


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each record of the archives listed, every payload checked."""
    spread = manifest.select("archive").repartition(max(1, manifest.count()))
    return spread.mapInArrow(released(_reader(folder)), RECORD_DDL)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS keep FROM p GROUP BY html),
d AS (SELECT p.page_id, f.keep, strlen(p.html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(string_split(sha1(p.html), ''), lambda c:
    right('000' || bin(strpos('0123456789abcdef', c)::INTEGER - 1), 4)), '') AS bits FROM p JOIN f USING (html))
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(list_sum(list_transform(range(1, 6), lambda j: (bits[i * 5 + j])::INTEGER * (1 << (5 - j)))) + 1)::INTEGER]), '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM d
"""
