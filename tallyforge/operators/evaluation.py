"""Scoring of decisions against references, and paired experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import estimate, numeric_summary, pooled, verdict


def argmax(values: Column) -> Column:
    """Place (from 0) of the largest value; the first of equal ones."""
    tagged = F.transform(values, lambda v, i: F.struct(v.alias("v"), (-i).alias("i")))
    return -F.array_max(tagged)["i"]


def masked_argmax(scores: Column, legal: Column) -> Column:
    """The legal id with the largest score (ids index ``scores`` from 0); the first in the
    legal order wins ties."""
    tagged = F.transform(legal, lambda t, i: F.struct(F.get(scores, t).alias("v"), (-i).alias("i"), t.alias("id")))
    return F.array_max(tagged)["id"]


def cross_entropy(scores: Column, legal: Column, target: Column) -> Column:
    """Negative log-probability of the target among the legal ids."""
    own = F.transform(legal, lambda t: F.get(scores, t))
    top = F.array_max(own)
    total = F.aggregate(own, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    return top + F.ln(total) - F.get(scores, target)


def regret(values: Column, chosen: Column) -> Column:
    """Best value minus that of the chosen place (from 0)."""
    return F.array_max(values) - F.get(values, chosen)


def referenced(predictions: DataFrame, references: DataFrame, *key: str) -> DataFrame:
    """Predictions with their references; a key that is missing or there twice is an error
    when the rows are read."""
    once = references.groupBy(*key).agg(
        F.count(F.lit(1)).alias("__n"),
        F.first(F.struct(*[c for c in references.columns if c not in key])).alias("__r"),
    )
    joined = predictions.join(once, list(key), "left")
    message = F.concat_ws(" ", F.lit("not exactly one reference for"), *[F.col(k).cast("string") for k in key])
    checked = F.when(F.coalesce(F.col("__n"), F.lit(0)) == 1, F.col("__r")).otherwise(F.raise_error(message))
    return joined.select(*predictions.columns, checked.alias("__r")).select(*predictions.columns, "__r.*")


def accuracies(df: DataFrame, kind: str, target: str, correct: Column, loss: Column | None = None) -> DataFrame:
    """Rows, hits and accuracy overall, by kind and by target, in one pass."""
    df = df.select(F.col(kind).alias("kind"), F.col(target).alias("target"), correct.cast("int").alias("hit"), (loss if loss is not None else F.lit(0.0)).alias("loss"))
    sets = df.groupingSets([[], ["kind"], ["target"]], "kind", "target")
    return sets.agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("rows"),
        F.sum("hit").alias("hits"),
        F.avg("hit").alias("accuracy"),
        F.avg("loss").alias("loss"),
    )


def agreement(model: Column, control: Column, target: Column) -> list[Column]:
    """Aggregates: how often model and control agree, and the accuracy of each where they do
    and where they don't (null where there is no such row)."""
    same = model == control
    return [
        F.count_if(same).alias("agreements"),
        F.count_if(~same).alias("deviations"),
        F.try_divide(F.count_if(same), F.count(F.lit(1))).alias("agreement"),
        F.try_divide(F.count_if(same & (model == target)), F.count_if(same)).alias("accuracy_agreeing"),
        F.try_divide(F.count_if(~same & (model == target)), F.count_if(~same)).alias("model_accuracy_deviating"),
        F.try_divide(F.count_if(~same & (control == target)), F.count_if(~same)).alias("control_accuracy_deviating"),
    ]


def regret_summary(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Rows, mean, 95th percentile (ceiling rule) and maximum; no value may be null."""
    out = numeric_summary(df, value, *keys, rule="ceiling")
    return out.select(*keys, F.col("count").alias("rows"), "mean", "p95", "maximum")


def paired(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Mean difference of two policies over the same keys, its interval and the verdict; a
    key that only one side has is an error when run."""
    both = left.select(F.col(key), F.col(value).alias("l")).join(right.select(F.col(key), F.col(value).alias("r")), key, "full_outer")
    gone = F.col("l").isNull() | F.col("r").isNull()
    difference = F.when(gone, F.raise_error(F.lit("the policies have different keys"))).otherwise(F.col("l") - F.col("r"))
    out = both.agg(*estimate(difference))
    return out.withColumn("verdict", verdict(F.col("ci_low"), F.col("ci_high"), "left", "right"))


def mismatches(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keys whose rows differ in some column (nulls equal), or that one side hasn't."""
    a = left.select(*key, F.struct(*columns).alias("a"))
    b = right.select(*key, F.struct(*columns).alias("b"))
    both = a.join(b, key, "full_outer")
    differ = F.lit(False)
    for c in columns:
        differ = differ | ~F.col("a")[c].eqNullSafe(F.col("b")[c])
    return both.where(F.col("a").isNull() | F.col("b").isNull() | differ).select(*key)


def aggregated(slices: DataFrame) -> DataFrame:
    """Shard reports (shoe_start, shoe_count, simulation_seed, paired_advantage) as one: the
    pooled advantage, its interval, the verdict, and whether the slices fit together."""
    from .trajectory import slice_gaps

    breaks = slice_gaps(slices, "shoe_start", "shoe_count").agg(F.count(F.lit(1)).alias("gaps"))
    seeds = slices.agg(F.countDistinct("simulation_seed").alias("seeds"), F.sum("shoe_count").alias("shoes"))
    one = pooled(slices.select("paired_advantage.*"))
    out = one.join(F.broadcast(breaks)).join(F.broadcast(seeds))  # one row each
    return out.withColumn("verdict", verdict(F.col("ci_low"), F.col("ci_high"), "model", "control")).withColumn(
        "fits", (F.col("gaps") == 0) & (F.col("seeds") == 1)
    )
