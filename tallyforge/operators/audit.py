"""Integrity and coverage audits; a check returns the rows that break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def gaps(df: DataFrame, group: str, index: str) -> DataFrame:
    """Groups whose indices aren't 0..n-1, each once."""
    found = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(index).alias("least"),
        F.max(index).alias("most"),
        F.countDistinct(index).alias("different"),
    )
    return found.where("least <> 0 OR most <> n - 1 OR different <> n")


def leaks(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups with rows in several splits."""
    return (
        df.groupBy(group)
        .agg(F.min(split).alias("first_split"), F.max(split).alias("last_split"))
        .where("first_split <> last_split")
    )


def missing(keys: DataFrame, reference: DataFrame, *on: str) -> DataFrame:
    return keys.join(reference.select(*on), list(on), "left_anti")


def key_sets_differ(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    a = missing(left, right, *on).select(*on).withColumn("only_in", F.lit("left"))
    return a.unionByName(missing(right, left, *on).select(*on).withColumn("only_in", F.lit("right")))


def coverage(df: DataFrame, target: str, split: str, splits: list[str], group: str) -> DataFrame:
    """Rows by target and split (0 where there are none) and distinct groups by target."""
    counts = [F.count_if(F.col(split) == s).alias(s) for s in splits]
    return df.groupBy(target).agg(*counts, F.count(F.lit(1)).alias("rows"), F.countDistinct(group).alias("groups"))


def value_sets(df: DataFrame, kind: str, value: str, expected: dict[str, list[str]]) -> DataFrame:
    """The set of values of each kind, and whether it is what is expected; a kind that is
    expected but absent fails too."""
    have = df.groupBy(kind).agg(F.array_sort(F.collect_set(value)).alias("found"))
    want = df.sparkSession.createDataFrame(
        [(k, sorted(v)) for k, v in expected.items()], f"{kind} string, expected array<string>"
    )
    both = have.join(F.broadcast(want), kind, "full_outer")  # the literal table is small
    return both.withColumn("holds", F.coalesce(F.col("found") == F.col("expected"), F.lit(False)))


def margin(values: Column) -> Column:
    """Best minus second best of an array; null for fewer than two."""
    s = F.sort_array(values, asc=False)
    return F.when(F.size(values) >= 2, F.element_at(s, 1) - F.element_at(s, 2))


def decision_faults() -> dict[str, Column]:
    """What breaks a decision row, as predicates over the columns of ``sources.decisions``."""
    m, values = F.col("metadata"), F.col("metadata.action_values")
    both = F.exists(values, lambda a: a["expected_profit"].isNull() == a["expected_log_growth"].isNull())
    order = F.transform(values, lambda a: a["token"]) != m["legal_target_tokens"]

    def rollout_fault(r: Column) -> Column:
        ci = r["expected_profit_confidence_interval_95"]
        return r.isNotNull() & (
            (r["seed"] < 0)
            | (r["seed"] > F.lit("18446744073709551615").cast("decimal(20,0)"))
            | (r["rollouts"] <= 0)
            | (r["expected_profit_standard_error"] < 0)
            | (F.size(ci) != 2)
            | (ci[0] > ci[1])
        )

    method = m["evaluation_method"]
    whole = method == "seeded_monte_carlo_fixed_h17"
    per_action = method == "seeded_monte_carlo_fixed_continuation_h17"
    every = F.forall(values, lambda a: a["monte_carlo"].isNotNull())
    some = F.exists(values, lambda a: a["monte_carlo"].isNotNull())
    composition = m["shoe_composition"]
    return {
        "one_objective": both,
        "legal_order": order,
        "no_legal_target": F.size(m["legal_target_tokens"]) == 0,
        "target_legal": ~F.array_contains(m["legal_target_tokens"], F.col("target_token")),
        "behavior_legal": ~F.array_contains(m["legal_target_tokens"], F.col("behavior_token")),
        "legal_unique": F.size(F.array_distinct(m["legal_target_tokens"])) != F.size(m["legal_target_tokens"]),
        "input_empty": F.size("input_tokens") == 0,
        "composition": (F.size(composition) != 10) | F.exists(composition, lambda c: c < 0),
        "unavailable": m["unseen_unavailable"] < 0,
        "round_rollouts": (whole != m["monte_carlo"].isNotNull()) | rollout_fault(m["monte_carlo"]),
        "action_rollouts": (per_action & ~every) | (~per_action & some) | F.exists(values, lambda a: rollout_fault(a["monte_carlo"])),
    }


def faulty(df: DataFrame, faults: dict[str, Column]) -> DataFrame:
    """Rows that break something, with the names of what they break."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in faults.items()]))
    return df.withColumn("faults", names).where(F.size("faults") > 0)
