"""Shared-folder tables and Arrow helpers used by the corpus operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only where the session names no shared folder (tests, local runs).
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    root = root or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (root or LOCAL_CHECKPOINTS).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back; cuts lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Operators after which the rows of a partition may come in another order when run again.
_UNSETTLED = re.compile(
    r"^[\s:+|-]*~?(?:Repartition|RebalancePartitions|Aggregate|Join|Sort|Window|Deduplicate|Distinct|Sample|GlobalLimit|"
    r"LocalLimit|Offset|Union|Generate|MapIn|FlatMap|CoGroup|ArrowEval|BatchEval|Except|Intersect)",
    re.M,
)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself where it is rows of a table as read, filtered or projected; else a table
    of it. Row numbers given to it are then the same in every job."""
    return materialise(df, name) if _UNSETTLED.search(df._jdf.queryExecution().analyzed().toString()) else df


#: Most rows (of a key or two) that are broadcast; they are counted first.
BROADCAST_ROWS = 262_144


def sized(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``table``, to be broadcast if it has at most ``most`` rows; a join shuffles beyond."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def has_columns(df: DataFrame, *names: str) -> DataFrame:
    """Project the named columns; a missing one is an error that says so."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df.select(*[df[n] for n in names])


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema
    )


def release_memory() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run: Callable) -> Callable:
    """A function for mapInArrow that gives freed memory back at the end of each task."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return whole


@contextmanager
def session_conf(spark: SparkSession, **values: str):
    """Session settings (dots written as double underscores) for what is run inside."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bounded(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes of a text column (a row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        if b.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(lengths.astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, before + size, "right")))
            yield b.slice(at, to - at)
            at = to


def row_groups(
    batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]
) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows with equal keys out of batches sorted by them.

    Rows are handed out one at a time, so a long run is never held as a whole; a run that
    its consumer leaves early is skipped.
    """

    def rows():
        for b in batches:
            names = b.schema.names
            columns = [b.column(i) for i in range(len(names))]
            for i in range(b.num_rows):
                yield {n: c[i].as_py() for n, c in zip(names, columns)}

    import itertools

    for key, run in itertools.groupby(rows(), key=lambda r: tuple(r[k] for k in keys)):
        yield key, run
        for _ in run:
            pass


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)  # noqa: SLF001
