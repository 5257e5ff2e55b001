"""Distribution algebra, growth and bet sizing over the data tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kelly
from ..operators import distributions
from ..sources.tables import load
from .statistics import r, rounded


def _dist(spark: SparkSession, d: str) -> DataFrame:
    """By supplier: half-unit profits from -2 to 3, weighted by lines."""
    lines = load(spark, d, "lineitem", "l_suppkey", "l_linenumber", "l_quantity")
    x = ((F.col("l_quantity").cast("int") * 7 + F.col("l_linenumber")) % 6 - 2) / 2
    return distributions.from_weights(lines, ["l_suppkey"], x, F.lit(1.0))


_DIST = """c AS (SELECT l_suppkey, ((l_quantity::INTEGER * 7 + l_linenumber) % 6 - 2) / 2.0::DOUBLE AS x, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2),
dist AS (SELECT l_suppkey, x, w / sum(w) OVER (PARTITION BY l_suppkey) AS p FROM c)"""


def dist_from_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_dist(spark, d), "x")


DIST_FROM_PAIRS = f"WITH {_DIST} SELECT l_suppkey, x, round(p, 6) AS p FROM dist"


def _mixture(spark: SparkSession, d: str) -> DataFrame:
    suppliers = load(spark, d, "supplier", "s_suppkey", "s_nationkey")
    n = suppliers.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("c"))
    weights = suppliers.join(n, "s_nationkey").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"), (1 / F.col("c")).alias("w")
    )
    return distributions.mixture(_dist(spark, d), weights, "l_suppkey", ["nation"])


_MIX = f"""{_DIST}, n AS (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY 1),
mix AS (SELECT s.s_nationkey AS nation, x, sum(p / c) AS p FROM dist JOIN supplier s ON s.s_suppkey = l_suppkey JOIN n USING (s_nationkey) GROUP BY 1, 2)"""


def dist_mixture(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_mixture(spark, d), "x")


DIST_MIXTURE = f"WITH {_MIX} SELECT nation, x, round(p, 6) AS p FROM mix"


def dist_shift(spark: SparkSession, d: str) -> DataFrame:
    return rounded(distributions.shift(_mixture(spark, d), F.lit(-0.5)), "x")


DIST_SHIFT = f"WITH {_MIX} SELECT nation, x - 0.5 AS x, round(p, 6) AS p FROM mix"


def dist_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(distributions.moments(_dist(spark, d), ["l_suppkey"]))


DIST_MOMENTS = f"""WITH {_DIST}
SELECT l_suppkey, round(sum(x * p), 6) AS mean, round(sum(x * x * p) - sum(x * p) * sum(x * p), 6) AS variance, min(x) AS minimum, round(sum(p), 6) AS total, count(*)::BIGINT AS outcomes FROM dist GROUP BY 1
"""


def dist_checks(spark: SparkSession, d: str) -> DataFrame:
    """Distributions with a probability taken away: every third supplier's largest value."""
    dist = _dist(spark, d).where("NOT (l_suppkey % 3 = 0 AND x = 1.5)")
    return rounded(distributions.broken(dist, ["l_suppkey"]))


DIST_CHECKS = f"""WITH {_DIST}
SELECT l_suppkey, round(sum(p), 6) AS total, round(min(p), 6) AS least FROM dist WHERE NOT (l_suppkey % 3 = 0 AND x = 1.5) GROUP BY 1 HAVING abs(sum(p) - 1) > 1e-10 OR min(p) <= 0
"""


def support_union(spark: SparkSession, d: str) -> DataFrame:
    dist = _dist(spark, d)
    return distributions.support_union([dist.where("l_suppkey % 2 = 0 AND x < 0"), dist.where("l_suppkey % 2 = 1")])


SUPPORT_UNION = f"WITH {_DIST} SELECT x FROM dist WHERE l_suppkey % 2 = 0 AND x < 0 UNION SELECT x FROM dist WHERE l_suppkey % 2 = 1"


def log_growth_grid(spark: SparkSession, d: str) -> DataFrame:
    """Growth of each supplier's distribution at each fraction of the selected grid, and at
    one that ruins."""
    nested = distributions.nested(_dist(spark, d), ["l_suppkey"])
    grid = F.explode(F.array(*[F.lit(f) for f in (*kelly.SELECTED_GRID, 1.0)])).alias("fraction")
    rows = nested.select("l_suppkey", "outcomes", grid)
    g = kelly.log_growth(F.col("outcomes"), F.col("fraction"))
    return rows.select("l_suppkey", "fraction", F.when(g == kelly.MINUS_INFINITY, None).otherwise(F.round(g, 6)).alias("growth"), (g == kelly.MINUS_INFINITY).alias("ruin"))


LOG_GROWTH_GRID = f"""WITH {_DIST}, g AS (SELECT unnest([0.001::DOUBLE, 0.005, 0.009, 0.013, 1.0]) AS f),
s AS (SELECT l_suppkey, f, min(1 + f * x) AS low, sum(CASE WHEN 1 + f * x > 0 THEN p * ln(1 + f * x) END) AS v FROM dist, g GROUP BY 1, 2)
SELECT l_suppkey, f AS fraction, CASE WHEN low > 0 THEN round(v, 6) END AS growth, low <= 0 AS ruin FROM s
"""


def _two_point(spark: SparkSession, d: str) -> DataFrame:
    """Even money by part: the chance of winning is given by its size."""
    p = load(spark, d, "part", "p_partkey", "p_size")
    win = 0.4 + F.col("p_size") / 200
    both = F.array(F.struct(F.lit(-1.0).alias("x"), (1 - win).alias("p")), F.struct(F.lit(1.0).alias("x"), win.alias("p")))
    return p.select("p_partkey", both.alias("outcomes"))


def kelly_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Full and half Kelly by bisection, the nearest grid fraction, and what it costs."""
    rows = _two_point(spark, d).withColumn("full", kelly.full_kelly(F.col("outcomes")))
    rows = rows.withColumn("half", F.col("full") / 2).withColumn("bet", kelly.nearest(F.col("half"), kelly.SELECTED_GRID))
    loss = kelly.recorded_log_growth(F.col("outcomes"), F.col("half")) - kelly.recorded_log_growth(F.col("outcomes"), F.col("bet"))
    return rounded(rows.select("p_partkey", "full", "half", "bet", F.abs(F.col("bet") - F.col("half")).alias("error"), loss.alias("regret")))


KELLY_SIZES = """
WITH w AS (SELECT p_partkey, 0.4::DOUBLE + p_size / 200.0::DOUBLE AS w FROM part), k AS (SELECT p_partkey, w, greatest(0, 2 * w - 1) AS f FROM w),
b AS (SELECT p_partkey, w, f, list_min(list_transform([0.001::DOUBLE, 0.005, 0.009, 0.013], lambda g: {'d': abs(g - f / 2), 'g': g})).g AS b FROM k)
SELECT p_partkey, round(f, 6) AS full, round(f / 2, 6) AS half, round(b, 6) AS bet, round(abs(b - f / 2), 6) AS error,
  round(w * ln(1 + f / 2) + (1 - w) * ln(1 - f / 2) - w * ln(1 + b) - (1 - w) * ln(1 - b), 6) AS regret FROM b
"""


def nearest_grid(spark: SparkSession, d: str) -> DataFrame:
    """Nearest grid value; ties (multiples of the half step) go to the smaller."""
    p = load(spark, d, "part", "p_partkey", "p_size")
    target = F.col("p_size") / 8
    return p.select("p_partkey", target.alias("target"), kelly.nearest(target, [1.0, 2.0, 3.0, 4.5, 6.0]).alias("nearest"))


NEAREST_GRID = """
SELECT p_partkey, p_size / 8 AS target, list_min(list_transform([1.0::DOUBLE, 2, 3, 4.5, 6], lambda g: {'d': abs(g - p_size / 8), 'g': g})).g AS nearest FROM part
"""


def grid_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Candidate grids by rounding error: mean, 95th percentile, and parts by fraction with
    the empty fractions."""
    p = load(spark, d, "part", "p_partkey", "p_retailprice").select((F.col("p_retailprice") / 60000).alias("target"))
    parts = []
    for name, grid in kelly.candidate_grids().items():
        parts.append(p.select(F.lit(name).alias("grid"), F.lit(len(grid)).alias("size"), "target", kelly.nearest(F.col("target"), grid).alias("f")))
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    rows = rows.withColumn("error", F.abs(F.col("f") - F.col("target")))
    return rows.groupBy("grid", "size").agg(
        F.round(F.avg("error"), 9).alias("mean_error"),
        F.round(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY error)"), 9).alias("p95_error"),
        (F.first("size") - F.countDistinct("f")).cast("long").alias("unused"),
    )


_GRIDS = ", ".join(f"('{n}', [{', '.join(f'{x!r}::DOUBLE' for x in g)}])" for n, g in kelly.candidate_grids().items())
GRID_COMPARISON = f"""
WITH g AS (SELECT * FROM (VALUES {_GRIDS}) t(grid, fs)),
e AS (SELECT grid, fs, list_min(list_transform(fs, lambda f: {{'d': abs(f - p_retailprice / 60000), 'f': f}})) AS b FROM g, part)
SELECT grid, len(fs)::INTEGER AS size, round(avg(b.d), 9) AS mean_error, round(quantile_disc(b.d, 0.95), 9) AS p95_error, (len(fs) - count(DISTINCT b.f))::BIGINT AS unused FROM e GROUP BY grid, fs
"""


def upper_triangle_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = distributions.upper_pairs(load(spark, d, "nation"), "n_nationkey", "n_regionkey")
    return pairs.groupBy("l_n_regionkey", "r_n_regionkey").agg(F.count(F.lit(1)).alias("pairs"), F.sum("weight").cast("long").alias("weight"))


UPPER_TRIANGLE_PAIRS = """
SELECT a.n_regionkey AS l_n_regionkey, b.n_regionkey AS r_n_regionkey, count(*)::BIGINT AS pairs, sum(CASE WHEN a.n_nationkey = b.n_nationkey THEN 1 ELSE 2 END)::BIGINT AS weight
FROM nation a JOIN nation b ON a.n_nationkey <= b.n_nationkey GROUP BY 1, 2
"""

QUERIES = {
    "q_dist_from_pairs": (dist_from_pairs, DIST_FROM_PAIRS),
    "q_dist_mixture": (dist_mixture, DIST_MIXTURE),
    "q_dist_shift": (dist_shift, DIST_SHIFT),
    "q_dist_moments": (dist_moments, DIST_MOMENTS),
    "q_dist_checks": (dist_checks, DIST_CHECKS),
    "q_support_union": (support_union, SUPPORT_UNION),
    "q_log_growth_grid": (log_growth_grid, LOG_GROWTH_GRID),
    "q_kelly": (kelly_sizes, KELLY_SIZES),
    "q_nearest_grid": (nearest_grid, NEAREST_GRID),
    "q_grid_comparison": (grid_comparison, GRID_COMPARISON),
    "q_upper_triangle_pairs": (upper_triangle_pairs, UPPER_TRIANGLE_PAIRS),
}
