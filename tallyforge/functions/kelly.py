"""Growth of a bankroll under a return distribution held as array<struct<x, p>>."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUS_INFINITY = float("-inf")


def mean(outcomes: Column) -> Column:
    return F.aggregate(outcomes, F.lit(0.0), lambda s, o: s + o["x"] * o["p"])


def log_growth(outcomes: Column, fraction: Column) -> Column:
    """Sum of p ln(1 + f x); minus infinity where an outcome ruins."""
    ruin = F.exists(outcomes, lambda o: 1.0 + fraction * o["x"] <= 0)
    safe = F.aggregate(
        outcomes,
        F.lit(0.0),
        lambda s, o: s + o["p"] * F.log(F.greatest(1.0 + fraction * o["x"], F.lit(1e-300))),
    )
    return F.when(ruin, F.lit(MINUS_INFINITY)).otherwise(safe)


def recorded_log_growth(outcomes: Column, fraction: Column) -> Column:
    """The same by log1p and without the guard: an outcome of ruin gives null."""
    return F.aggregate(outcomes, F.lit(0.0), lambda s, o: s + o["p"] * F.log1p(fraction * o["x"]))


def full_kelly(outcomes: Column, maximum: float = 1.0, steps: int = 80) -> Column:
    """The fraction from 0 to the largest allowed whose growth is greatest: 0 without a positive
    mean, never beyond what the worst outcome allows.

    Growth is concave, so its slope s falls and Newton's step s / -s' leads to its root from
    anywhere near it. Each step also tells on which side of the fraction the root lies; a
    step that leaves what is left of the interval gives way to the middle of it.
    """
    worst = F.array_min(F.transform(outcomes, lambda o: o["x"]))
    ruin = F.when(worst < 0, -1.0 / worst).otherwise(F.lit(float("inf")))
    top = F.least(F.lit(float(maximum)), ruin * (1.0 - 1e-12))

    def slope(f: Column) -> Column:
        """s and -s' at f."""
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

        def add(sums: Column, o: Column) -> Column:
            t = o["x"] / (1.0 + f * o["x"])
            return F.struct((sums["s"] + o["p"] * t).alias("s"), (sums["c"] + o["p"] * t * t).alias("c"))

        return F.aggregate(outcomes, zero, add)

    def step(at: Column, _: Column) -> Column:
        def moved(g: Column) -> Column:
            low = F.when(g["s"] > 0, at["f"]).otherwise(at["low"])
            high = F.when(g["s"] > 0, at["high"]).otherwise(at["f"])
            newton = at["f"] + F.try_divide(g["s"], g["c"])
            inside = newton.isNotNull() & (newton >= low) & (newton <= high)
            return F.struct(
                F.when(inside, newton).otherwise((low + high) / 2).alias("f"), low.alias("low"), high.alias("high")
            )

        return F.transform(F.array(slope(at["f"])), moved)[0]

    start = F.struct(F.lit(0.0).alias("f"), F.lit(0.0).alias("low"), top.alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda at: at["f"])


def nearest(target: Column, grid: list[float]) -> Column:
    """The grid value nearest to the target; of two equally near, the smaller."""
    options = F.array(*[F.lit(float(g)) for g in sorted(grid)])
    return F.array_min(
        F.transform(options, lambda g: F.struct(F.abs(g - target).alias("distance"), g.alias("value")))
    )["value"]


def linear_grid(least: float, most: float, step: float) -> list[float]:
    """Multiples of a step above ``least``, and both ends: decimals, so no sum drifts."""
    first, last, by = (Decimal(str(x)) for x in (least, most, step))
    return sorted({*map(float, (first + by * i for i in range(int((last - first) / by) + 1))), float(last)})


#: The grids of bet fractions that are compared.
SELECTED_GRID = [0.001, 0.005, 0.009, 0.013]


def candidate_grids() -> dict[str, list[float]]:
    return {
        "selected-four-token": SELECTED_GRID,
        "five-token": [0.001, 0.003, 0.006, 0.009, 0.013],
        "six-token": [0.001, 0.0025, 0.005, 0.0075, 0.01, 0.013],
        "compact": linear_grid(0.001, 0.02, 0.005),
        "balanced": linear_grid(0.001, 0.025, 0.0025),
        "fine": linear_grid(0.001, 0.03, 0.001),
        "higher-floor": linear_grid(0.0025, 0.025, 0.0025),
        "wider-cap": linear_grid(0.001, 0.04, 0.005),
        "hybrid": [0.001, 0.0025, 0.005, 0.0075, 0.01, 0.015, 0.02, 0.03],
    }


def token_fraction(token: Column, fractions: dict[str, float]) -> Column:
    """The bankroll fraction of a bet token; an unknown token is an error when run."""
    known = F.create_map(*[F.lit(x) for item in fractions.items() for x in item])
    found = F.try_element_at(known, token)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown bet token "), token)).cast("double"))
