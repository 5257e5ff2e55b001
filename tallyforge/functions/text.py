"""Texts of configuration as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_list(text: Column) -> Column:
    """Comma-separated positive whole numbers, each once, as an array; else an error when run."""
    parts = F.transform(F.split(text, ",", -1), lambda p: F.trim(p))
    numbers = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), p.try_cast("int")))
    sound = F.forall(numbers, lambda n: F.coalesce(n > 0, F.lit(False)))
    single = F.size(F.array_distinct(numbers)) == F.size(numbers)
    return (
        F.when(text.isNull() | ~sound, F.raise_error(F.concat(F.lit("not comma-separated positive integers: "), F.coalesce(text, F.lit("null")))))
        .when(~single, F.raise_error(F.concat(F.lit("a number is there twice: "), text)))
        .otherwise(numbers)
    )
