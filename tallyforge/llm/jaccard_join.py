"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Documents with equal shingle sets form one class from the start. For the others:

1. Every set's shingles go to buckets by hash range, packed: a bucket learns in how many
   places each shingle occurs, and tells the documents about the shingles that occur twice
   or more. Shingles of one document only can't link anything; they are the rarest and so
   take the first places of the document's prefix.
2. A set of n shingles needs ``ceil(threshold * n)`` common ones with any partner, so a
   document with fewer repeated shingles than that has none and drops out. For the others
   the repeated shingles in the order (frequency, hash) make the prefix; documents that
   share a shingle of their shortest prefix meet in one candidate component.
3. Within a component each document, in order of size, lengthens its prefix as long as the
   estimated cost falls: l more places need l common prefix shingles with a candidate (a
   pair with enough overlap shares at least l shingles of the two l-prefixes). Candidates
   in the class that the document has reached already aren't verified again. The rest are
   verified by the exact size of the intersection.

A component beyond ``block_docs`` documents or ``block_tokens`` shingles is dealt out as pairs of blocks, every pair of
blocks being one task, and the classes found are merged afterwards: exact at any size.

Nothing is sampled or capped. Shingles are known by 52 bits of a 64-bit hash, sets by 128
bits; a false match needs two different shingles of the two documents to agree in 52 bits.

Defined results: A-Z count as a-z; words are runs of bytes other than 0x20 and 0x09-0x0D;
with fewer words than ``k`` the whole sequence is one shingle; null, empty and blank texts
have the empty set and link with nothing; repeated rows link with each other; a null
``doc_id`` never names a class that has another; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected
from .shared import bounded, has_columns, materialise, released, row_groups, session_conf, settled, shuffle_partitions, sized, unused
from .wordhash import NON_SPACE, grams, mix, words

K = 5
THRESHOLD = (75, 100)
_DROP = np.uint64(12)
_SPAN = 52
FLUSH = 1_000_000
BUCKET = 4_000_000
BLOCK_DOCS = 8_192
BLOCK_TOKENS = 8_000_000
MAX_LENGTHEN = 8


def shingle_sets(text: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes, sorted."""
    w = words(text, NON_SPACE)
    g = grams(w.hash, k) >> _DROP
    for r in range(len(text)):
        a, b = int(w.first[r]), int(w.first[r + 1])
        if b - a >= k:
            yield np.unique(g[a : b - k + 1])
        elif b > a:
            yield mix(grams(w.hash[a:b], b - a) + np.uint64(b - a)) >> _DROP
        else:
            yield np.zeros(0, np.uint64)


def set_digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def needed(n, threshold: tuple[int, int]):
    """Least overlap of a set of n elements with any partner."""
    num, den = threshold
    return (num * n + den - 1) // den


def linked(overlap, a, b, threshold: tuple[int, int]):
    num, den = threshold
    return den * overlap >= num * (a + b - overlap)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of an array with equal-ranking bytes together: compresses well."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""


def _unplanes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(b, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def pack_sorted(h: np.ndarray) -> bytes:
    return _planes(np.diff(h, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(b, np.uint64), dtype=np.uint64) if b else np.zeros(0, np.uint64)


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16 if not len(x) or x.max() < 65536 else np.uint32)


def _pack_small(x: np.ndarray) -> bytes:
    x = _narrow(x)
    return bytes([x.dtype.itemsize]) + _planes(x)


def _unpack_small(b: bytes) -> np.ndarray:
    return _unplanes(b[1:], np.uint16 if b[0] == 2 else np.uint32).astype(np.int64)


def _runs(h: np.ndarray) -> np.ndarray:
    """Start of each run of equal values in a sorted array; its length at the end."""
    if not len(h):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])


# ---------------------------------------------------------------- documents -> sets

DOC_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary())])


def _doc_rows(k: int):
    def run(batches):
        for b in bounded(batches):
            n, keys = [], []
            for tokens in shingle_sets(b.column("text"), k):
                n.append(len(tokens))
                keys.append(set_digest(tokens) if len(tokens) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary())],
                schema=DOC_SCHEMA,
            )

    return run


# ------------------------------------------------ shingles -> buckets by hash range

TOKEN_SCHEMA = pa.schema(
    [("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.int64()), ("a", pa.binary()), ("b", pa.binary())]
)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(_SPAN - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _token_rows(k: int, buckets: int):
    """Packed shingles by bucket, a blob being what a task holds at a time. Kind 0: the hashes
    and how many of the blob's sets have each; kind 1: which sets those are, by number; kind
    2, once a blob: the sets' keys and sizes. A hot shingle is one hash a blob in kind 0."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        seen: set[bytes] = set()
        parts: list[np.ndarray] = []
        table: list[bytes] = []
        held = blob = 0

        def flush():
            nonlocal parts, table, held, blob
            if not parts:
                return
            sizes = np.array([len(p) for p in parts])
            h = np.concatenate(parts)
            order = np.argsort(h, kind="stable")
            h, doc = h[order], np.repeat(np.arange(len(parts), dtype=np.int32), sizes)[order]
            number = (task << 24) + blob
            blob += 1
            edge = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
            for bucket in np.flatnonzero(np.diff(edge)).tolist():
                lo, hi = edge[bucket], edge[bucket + 1]
                starts = _runs(h[lo:hi])
                yield batch_of(
                    TOKEN_SCHEMA,
                    [bucket, bucket],
                    [0, 1],
                    [number, number],
                    [pack_sorted(h[lo:hi][starts[:-1]]), b""],
                    [_pack_small(np.diff(starts)), _pack_small(doc[lo:hi])],
                )
            yield batch_of(TOKEN_SCHEMA, [number % buckets], [2], [number], [b"".join(table)], [_planes(sizes.astype(np.uint32))])
            parts, table, held = [], [], 0

        for b in bounded(batches):
            for tokens in shingle_sets(b.column("text"), k):
                if not len(tokens) or (key := set_digest(tokens)) in seen:
                    continue
                seen.add(key)
                parts.append(tokens)
                table.append(key)
                held += len(tokens)
                if held >= FLUSH:
                    yield from flush()
        yield from flush()

    return run


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


REPEATED_SCHEMA = pa.schema([("blob", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("at", pa.binary()), ("h", pa.binary()), ("df", pa.binary())])


def _repeated_rows(batches):
    """Of a bucket, the shingles that occur twice or more, for each blob that has some."""
    for _, rows in row_groups(batches, ("bucket",)):
        heads: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        df = None
        for r in rows:
            if r["kind"] == 0:
                heads[r["blob"]] = (unpack_sorted(r["a"]), _unpack_small(r["b"]))
                continue
            if r["kind"] == 2:
                yield batch_of(REPEATED_SCHEMA, [r["blob"]], [r["a"]], [r["b"]], [None], [None], [None])
                continue
            if df is None:
                h = np.concatenate([x for x, _ in heads.values()])
                n = np.concatenate([x for _, x in heads.values()])
                order = np.argsort(h, kind="stable")
                h, n = h[order], n[order]
                starts = _runs(h)
                total = np.add.reduceat(n, starts[:-1])
                df = (h[starts[:-1]][total > 1], total[total > 1])
            hashes, counts = heads.pop(r["blob"])
            if not len(df[0]):
                continue
            place = np.minimum(np.searchsorted(df[0], hashes), len(df[0]) - 1)
            shared = df[0][place] == hashes
            if shared.any():
                at = _unpack_small(r["b"])[np.repeat(shared, counts)]
                h = np.repeat(hashes[shared], counts[shared])
                freq = np.repeat(df[1][place][shared], counts[shared])
                yield batch_of(REPEATED_SCHEMA, [r["blob"]], [None], [None], [_pack_small(at)], [pack_sorted(h)], [_pack_small(freq)])


VIABLE_SCHEMA = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("tokens", pa.binary()), ("head", pa.int64()), ("m", pa.int64())])


def _viable_rows(threshold: tuple[int, int]):
    """Sets with enough repeated shingles for a partner: those shingles, rarest first, and
    the length of the shortest prefix. A set that is in several blobs is there for each."""

    def run(batches):
        for _, rows in row_groups(batches, ("blob",)):
            doc, h, df = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            ids = n_of = None
            for r in rows:
                if r["ids"] is not None:
                    ids = np.frombuffer(r["ids"], dtype="V16")
                    n_of = _unplanes(r["sizes"], np.uint32).astype(np.int64)
                else:
                    doc.append(_unpack_small(r["at"]))
                    h.append(unpack_sorted(r["h"]))
                    df.append(_unpack_small(r["df"]))
            doc, h, df = np.concatenate(doc), np.concatenate(h), np.concatenate(df)
            order = np.lexsort((h, df, doc))
            doc, h = doc[order], h[order]
            edge = np.searchsorted(doc, np.arange(len(ids) + 1))
            repeated, need = np.diff(edge), needed(n_of, threshold)
            good = np.flatnonzero(repeated >= need)
            for lo in range(0, len(good), 2000):
                pick = good[lo : lo + 2000]
                yield batch_of(
                    VIABLE_SCHEMA,
                    [ids[i].tobytes() for i in pick],
                    n_of[pick],
                    [h[edge[i] : edge[i + 1]].tobytes() for i in pick],
                    (repeated - need + 1)[pick],
                    repeated[pick],
                )

    return run


def _unique_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 16-byte ids, where each is first, and each entry's place among them."""
    two = ids.view(np.uint64).reshape(-1, 2)
    order = np.lexsort((two[:, 1], two[:, 0]))
    s = two[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]).any(axis=1)
    to = np.empty(len(s), np.int64)
    to[order] = np.cumsum(fresh) - 1
    return ids[order[fresh]], order[fresh], to


# --------------------------------------------------- prefixes -> candidate components

EDGE_SCHEMA = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("least", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])


def _stars(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of entries sorted by (h, doc): each hash, its least document, and distinct edges from
    the other documents to the least one, thinned to a forest towards the smallest."""
    starts = _runs(h)
    least = doc[starts[:-1]]
    low = np.repeat(least, np.diff(starts))
    label = np.arange(int(doc.max()) + 1 if len(doc) else 0)
    while True:  # each document takes the smallest label in its buckets
        old = label.copy()
        value = np.minimum.reduceat(label[doc], starts[:-1]) if len(doc) else label[:0]
        np.minimum.at(label, doc, np.repeat(value, np.diff(starts)))
        np.minimum.at(label, low, label[doc])
        label = label[label]
        if (label == old).all():
            break
    moved = np.flatnonzero(label != np.arange(len(label)))
    return h[starts[:-1]], least, moved, label[moved]


def _prefix_rows(buckets: int):
    """Edges within this task's documents, and each prefix shingle with one document."""

    def run(batches):
        held: list[tuple[bytes, np.ndarray]] = []
        size = 0

        def flush():
            nonlocal held, size
            if not held:
                return
            held.sort(key=lambda x: x[0])
            lengths = np.array([len(x) for _, x in held])
            h, doc = np.concatenate([x for _, x in held]), np.repeat(np.arange(len(held)), lengths)
            order = np.argsort(h, kind="stable")
            hashes, least, a, b = _stars(h[order], doc[order])
            ids = [k for k, _ in held]
            for lo in range(0, len(a), 10_000):
                x, y = a[lo : lo + 10_000], b[lo : lo + 10_000]
                nothing = [None] * len(x)
                yield batch_of(EDGE_SCHEMA, nothing, nothing, nothing, [ids[i] for i in x], [ids[i] for i in y])
            edge = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
            table = np.frombuffer(b"".join(ids), dtype="V16")
            for bucket in np.flatnonzero(np.diff(edge)):
                lo, hi = edge[bucket], edge[bucket + 1]
                yield batch_of(EDGE_SCHEMA, [int(bucket)], [pack_sorted(hashes[lo:hi])], [table[least[lo:hi]].tobytes()], [None], [None])
            held, size = [], 0

        for b in batches:
            for key, tokens, head in zip(*(b.column(c) for c in ("key", "tokens", "head"))):
                prefix = np.frombuffer(tokens.as_py(), np.uint64)[: head.as_py()]
                held.append((key.as_py(), prefix))
                size += len(prefix)
                if size >= FLUSH:
                    yield from flush()
        yield from flush()

    return run


PAIR_SCHEMA = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _bucket_edges(batches):
    for _, rows in row_groups(batches, ("bucket",)):
        h, ids = [], []
        for r in rows:
            h.append(unpack_sorted(r["h"]))
            ids.append(np.frombuffer(r["least"], dtype="V16"))
        own, _, doc = _unique_ids(np.concatenate(ids))
        h = np.concatenate(h)
        order = np.lexsort((doc, h))
        _, _, a, b = _stars(h[order], doc[order])
        for lo in range(0, len(a), 10_000):
            yield batch_of(PAIR_SCHEMA, [own[i].tobytes() for i in a[lo : lo + 10_000]], [own[i].tobytes() for i in b[lo : lo + 10_000]])


# ------------------------------------------------------------------------ components


def link_classes(
    tokens: list[np.ndarray], n: np.ndarray, head: np.ndarray, side: np.ndarray | None, threshold: tuple[int, int]
) -> np.ndarray:
    """Class label of each set: the sets reachable by links share one.

    ``tokens`` are the repeated shingles in the global order; ``head`` is the length of the
    shortest prefix. With ``side``, only pairs of different sides are looked at.
    """
    count = len(tokens)
    order = np.lexsort((np.arange(count), n))  # small sets first
    label = np.arange(count)
    if count < 2:
        return label
    lengths = np.array([len(t) for t in tokens])
    _, ids = np.unique(np.concatenate(tokens), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(lengths)])
    ids_of = [ids[first[i] : first[i + 1]] for i in range(count)]
    rank = np.empty(count, np.int64)
    rank[order] = np.arange(count)
    # postings of all prefixes, with the level that each place stands for
    longest = np.minimum(lengths, head + MAX_LENGTHEN - 1)
    owner = np.repeat(np.arange(count), longest)
    place = np.concatenate([np.arange(m) for m in longest])
    token = np.concatenate([ids_of[i][: longest[i]] for i in range(count)])
    level = np.maximum(place - head[owner] + 2, 1)
    sort = np.argsort(token, kind="stable")
    token, owner, level = token[sort], owner[sort], level[sort]
    edge = np.searchsorted(token, np.arange(int(ids.max()) + 2))
    mark = np.zeros(int(ids.max()) + 1, bool)
    num, den = threshold
    for i in order:
        mine = ids_of[i]
        lists = [slice(edge[t], edge[t + 1]) for t in mine[: head[i]]]
        who = np.concatenate([owner[s] for s in lists])
        deep = np.concatenate([level[s] for s in lists])
        best, best_cost, depth = None, np.inf, 1
        while True:  # lengthen the prefix while that is estimated to cost less
            seen = np.bincount(who[deep <= depth], minlength=count)
            found = np.flatnonzero(seen >= depth)
            cost = len(who) + len(found) * (len(mine) + 8)
            if cost >= best_cost:
                break
            best, best_cost = found, cost
            more = head[i] + depth - 1
            if depth == MAX_LENGTHEN or more >= len(mine):
                break
            s = slice(edge[mine[more]], edge[mine[more] + 1])
            who, deep = np.concatenate([who, owner[s]]), np.concatenate([deep, level[s]])
            depth += 1
        found = best[rank[best] < rank[i]]
        found = found[den * n[found] >= num * n[i]]
        if side is not None:
            found = found[side[found] != side[i]]
        found = found[label[found] != label[i]]
        if not len(found):
            continue
        mark[mine] = True
        found = found[np.argsort(-n[found], kind="stable")]
        while len(found):
            j, found = found[0], found[1:]
            if linked(int(mark[ids_of[j]].sum()), int(n[i]), int(n[j]), threshold):
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
                found = found[label[found] != low]
        mark[mine] = False
    return label


def _component_rows(threshold: tuple[int, int]):
    def run(batches):
        for (_, i, j), rows in row_groups(batches, ("comp", "i", "j")):
            rows = list({r["key"]: r for r in rows}.values())  # a set may come from several blobs
            rows.sort(key=lambda r: r["key"])
            tokens = [np.frombuffer(r["tokens"], np.uint64) for r in rows]
            n, head = np.array([r["n"] for r in rows]), np.array([r["head"] for r in rows])
            side = np.array([r["block"] for r in rows]) if i != j else None
            label = link_classes(tokens, n, head, side, threshold)
            moved = np.flatnonzero(label != np.arange(len(label)))
            if len(moved):
                yield batch_of(PAIR_SCHEMA, [rows[x]["key"] for x in moved], [rows[label[x]]["key"] for x in moved])

    return run


def jaccard_classes(
    docs: DataFrame,
    k: int = K,
    threshold: tuple[int, int] = THRESHOLD,
    block_docs: int = BLOCK_DOCS,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    with session_conf(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="1000"):
        return _classes(docs, k, threshold, block_docs, block_tokens)


def _classes(docs: DataFrame, k: int, threshold: tuple[int, int], block_docs: int, block_tokens: int) -> DataFrame:
    spark = docs.sparkSession
    docs = settled(has_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), "jaccard-input")
    slim = materialise(docs.mapInArrow(released(_doc_rows(k)), "doc_id long, n long, key binary"), "jaccard-docs")
    total = slim.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = max(shuffle_partitions(spark), -(-total // BUCKET))
    tokens = docs.select("text").mapInArrow(
        released(_token_rows(k, parts)), "bucket int, kind int, blob long, a binary, b binary"
    )
    repeated = (
        tokens.repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "kind", "blob")
        .mapInArrow(released(_repeated_rows), "blob long, ids binary, sizes binary, at binary, h binary, df binary")
    )
    viable = materialise(
        repeated.repartition(parts, "blob")
        .sortWithinPartitions("blob")
        .mapInArrow(released(_viable_rows(threshold)), "key binary, n long, tokens binary, head long, m long"),
        "jaccard-viable",
    )
    stars = materialise(
        viable.select("key", "tokens", "head").mapInArrow(
            released(_prefix_rows(parts)), "bucket int, h binary, least binary, a binary, b binary"
        ),
        "jaccard-prefixes",
    )
    edges = stars.where("a is not null").select("a", "b").union(
        stars.where("bucket is not null")
        .select("bucket", "h", "least")
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(released(_bucket_edges), "a binary, b binary")
    )
    comps = connected(edges)
    lengths = viable.groupBy("key").agg(F.max("m").alias("m"))
    sizes = comps.join(lengths, "key").groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("m").alias("total"))
    blocks = F.greatest(F.ceil(F.col("size") / block_docs), F.ceil(F.col("total") / block_tokens))
    grouped = (
        comps.join(sizes, "root")
        .withColumn("blocks", blocks.cast("int"))
        .join(viable.drop("m"), "key")
        .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.col("root").alias("comp"),
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
            "block",
            "key",
            "n",
            "tokens",
            "head",
        )
    )
    links = (
        grouped.repartition(parts, "comp", "i", "j")
        .sortWithinPartitions("comp", "i", "j")
        .mapInArrow(released(_component_rows(threshold)), "a binary, b binary")
    )
    classes = materialise(connected(links), "jaccard-classes")
    rows = slim.join(classes, "key", "left").withColumn("class", F.coalesce("root", "key"))
    # as tables: Spark can split the joins, and a class may hold any share of the rows
    rows = materialise(rows.select("doc_id", "n", "class"), "jaccard-rows")
    least = materialise(
        rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least")), "jaccard-least"
    )
    return rows.join(least, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class of ``docs`` stays: that with the smallest doc_id (null ranks last),
    of rows with one doc_id the first. Rows without words are classes of their own."""
    docs = settled(docs, "jaccard-input")
    rid = unused(docs, "rid")
    numbered = docs.withColumn(rid, F.monotonically_increasing_id())
    classes = jaccard_classes(numbered.select(F.col(rid).alias("doc_id"), "text"))
    found = materialise(classes.select(F.col("doc_id").alias("rid"), F.col("component_id").alias("class")), "jaccard-found")
    ids = numbered.select(F.col(rid).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    kept = found.join(ids, "rid").groupBy("class").agg(F.min(rank)["rid"].alias("rid"))
    gone = materialise(found.select("rid").join(kept.select("rid"), "rid", "left_anti"), "jaccard-gone")
    columns = [F.col(f"`{n}`") for n in docs.columns]
    return numbered.join(sized(gone.withColumnRenamed("rid", rid)), rid, "left_anti").select(*columns)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * o >= 75 * (na + nb - o)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(r.y) AS component_id
FROM s JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, s.sh
"""
