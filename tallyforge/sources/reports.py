"""Reports as one-row tables and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import numeric_summary
from ..operators import audit
from .decisions import SPLITS, fraction


def duration(seconds: Column) -> Column:
    """12.3s, 4m 5s or 1h 2m; unknown where there is none."""
    whole = F.floor(seconds).cast("long")
    minutes = F.floor(whole / 60).cast("long")
    return (
        F.when(seconds.isNull(), "unknown")
        .when(seconds < 60, F.format_string("%.1fs", seconds.cast("double")))
        .when(minutes < 60, F.format_string("%dm %ds", minutes, whole % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(minutes / 60).cast("long"), minutes % 60))
    )


def most_common(df: DataFrame, value: str, order: str) -> DataFrame:
    """Values by count, most first; of equal counts the one that occurs first."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first")


def quality(decisions: DataFrame) -> dict[str, DataFrame]:
    """The parts of a quality report, each a small table: totals, kinds, targets, methods,
    margins and standard errors. Breaches are in ``breaches``, which should be empty."""
    d = decisions
    margin = audit.margin(F.transform("metadata.action_values", lambda a: fraction(a["expected_profit"])))
    play = d.where(F.col("kind") == "play").select(margin.alias("margin"), "metadata")
    errors = play.select(F.explode("metadata.action_values.monte_carlo.expected_profit_standard_error").alias("error"))
    bets = d.where(F.col("kind") == "bet").select(F.col("metadata.monte_carlo.expected_profit_standard_error").alias("error"))
    length = d.select("kind", F.size("input_tokens").cast("double").alias("tokens"))
    kinds = d.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("behavior_token") != F.col("target_token")).alias("exploratory"))
    breaches = (
        audit.duplicates(d, "shoe_id", "decision_index").select(F.lit("duplicate").alias("what"), "shoe_id")
        .unionByName(audit.gaps(d, "shoe_id", "decision_index").select(F.lit("gap").alias("what"), "shoe_id"))
        .unionByName(audit.leaks(d, "shoe_id").select(F.lit("leak").alias("what"), "shoe_id"))
        .unionByName(audit.faulty(d, audit.decision_faults()).select(F.explode("faults").alias("what"), "shoe_id"))
    )
    return {
        "totals": d.agg(
            F.count(F.lit(1)).alias("rows"),
            F.countDistinct("shoe_id").alias("shoes"),
            F.countDistinct("dataset_id").alias("datasets"),
            F.countDistinct("schema_version").alias("schema_versions"),
            *[F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in SPLITS],
        ),
        "kinds": kinds.join(numeric_summary(length, "tokens", "kind").drop("count"), "kind"),
        "targets": audit.coverage(d, "target_token", "split", list(SPLITS), "shoe_id"),
        "methods": d.groupBy("kind").agg(F.array_sort(F.collect_set("metadata.evaluation_method")).alias("methods")),
        "margins": play.agg(*[F.count_if(F.col("margin") < t).alias(f"below_{str(t).replace('.', '_')}") for t in (0.001, 0.005, 0.01)]).join(
            F.broadcast(numeric_summary(play, "margin")), how="left"  # one row each
        ),
        "action_errors": numeric_summary(errors, "error"),
        "bet_errors": numeric_summary(bets, "error"),
        "breaches": breaches,
    }


def as_json(parts: dict[str, DataFrame]) -> DataFrame:
    """One row: the parts, small tables all, as one JSON text with its keys in order."""
    out = None
    for name in sorted(parts):
        df = parts[name]
        column = df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*sorted(df.columns))))).alias("j")).select(
            F.concat(F.lit(f'"{name}":'), "j").alias("j")
        )
        out = column.withColumn("k", F.lit(name)) if out is None else out.unionByName(column.withColumn("k", F.lit(name)))
    joined = out.agg(F.array_sort(F.collect_list(F.struct("k", "j"))).alias("p"))
    return joined.select(F.concat(F.lit("{"), F.array_join("p.j", ","), F.lit("}")).alias("value"))


def write_report(report: DataFrame, path: str) -> None:
    """One JSON file; a report that is there already is an error."""
    report.coalesce(1).write.mode("errorifexists").text(path)
