"""Running sums and row numbers over a global order, without one task that sees all rows.

Rows are cut into ranges of the order at approximate quantiles; a window runs within each
range, and what the ranges before it add up to is joined to it. As many rows as ranges, a
number fixed beforehand, are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def with_range(df: DataFrame, order: Column, ranges: int = RANGES, name: str = "range") -> DataFrame:
    """Adds the number of the row's range; equal values of ``order`` share one."""
    x = order.cast("double")
    points = [i / ranges for i in range(1, ranges)]
    cuts = df.agg(F.percentile_approx(x, points, 1000).alias("c")).first()["c"] or []
    edges = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    return df.withColumn(name, F.size(F.filter(edges, lambda e: e < x)))


def running(
    df: DataFrame, order: Column, ties: list[str], sums: dict[str, Column], keys: list[str] | None = None, inclusive: bool = True
) -> DataFrame:
    """Adds for each name of ``sums`` the sum of its column over all rows up to this one in
    the order (``order``, then ``ties``), within ``keys`` if given."""
    keys = keys or []
    values = {f"__{n}": c for n, c in sums.items()}
    df = with_range(df.withColumns(values), order, name="__range").withColumn("__order", order)
    steps = Window.partitionBy(*keys, "__range").orderBy("__order", *ties)
    frame = steps.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    totals = df.groupBy(*keys, "__range").agg(*[F.sum(v).alias(f"{v}_t") for v in values])
    before = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__range").alias("__r"),
        *[F.coalesce(F.sum(f"{v}_t").over(before), F.lit(0)).alias(f"{v}_o") for v in values],
    )
    within = df.withColumns({f"{v}_w": F.coalesce(F.sum(v).over(frame), F.lit(0)) for v in values})
    on = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = within.join(offsets if keys else F.broadcast(offsets), on)
    out = joined.withColumns({n: F.col(f"__{n}_w") + F.col(f"__{n}_o") for n in sums})
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def numbered(df: DataFrame, order: Column, ties: list[str], name: str = "row_index") -> DataFrame:
    """Row numbers from 0 in a global order."""
    return running(df, order, ties, {name: F.lit(1).cast("long")}, inclusive=False)


def every_kth(df: DataFrame, order: Column, ties: list[str], limit: int) -> DataFrame:
    """Every k-th row, k = rows // limit (1 at least), and the last one."""
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / limit)).cast("long")
    return (
        numbered(df, order, ties)
        .join(F.broadcast(total))  # one row
        .where((F.col("row_index") % step == 0) | (F.col("row_index") == F.col("__n") - 1))
        .drop("__n")
    )
