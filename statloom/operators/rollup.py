"""Season roll-ups: event rows to one row of measures for each entity and season, for all entities at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_DIGITS = 9


def season_rollup(events: DataFrame, keys: list[str], measures: dict[str, Column], eligible: Column | None = None) -> DataFrame:
    return (events if eligible is None else events.where(eligible)).groupBy(*keys).agg(*(c.alias(n) for n, c in measures.items()))


def opponents(events: DataFrame, fixture: str, side: str, measures: list[str]) -> DataFrame:
    """Each event row with the other sides' measures of the same fixture, as opp_<measure>."""
    other = events.select(F.col(fixture).alias("_f"), F.col(side).alias("_s"), *(F.col(m).alias(f"opp_{m}") for m in measures))
    return events.join(other, (F.col(fixture) == F.col("_f")) & (F.col(side) != F.col("_s"))).drop("_f", "_s")


def weighted_points(weights: dict[str, float]) -> Column:
    """Sum of weight times measure; null measures count zero; two decimals."""
    return F.round(sum((F.lit(w) * F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m, w in weights.items()), F.lit(0.0)), 2)


def rate_siblings(long: DataFrame, keys: list[str], registry: DataFrame) -> DataFrame:
    """Rate-adjusted twins of flagged stats. registry: stat, suffix, denominator, formula, factor, and digits (0 to MOST_DIGITS; four where the column is absent).

    Formulas: div_mul (value / denominator * factor), mul_div (value * factor / denominator), div, mul. Twins read the
    input only, so they never cascade; without a denominator above zero there is none.
    """
    below = long.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("stat").alias("denominator"), F.col("value").alias("d"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    joined = long.join(F.broadcast(registry), "stat").alias("l").join(below.alias("b"), [*on, F.col("l.denominator") == F.col("b.denominator")]).where("d > 0")
    v, d, f = F.col("value"), F.col("d"), F.col("factor")
    made = F.when(F.col("formula") == "div_mul", v / d * f).when(F.col("formula") == "mul_div", v * f / d).when(F.col("formula") == "div", v / d).when(F.col("formula") == "mul", v * f)
    rounded = F.coalesce(*(F.when(F.col("digits") == k, F.round(made, k)) for k in range(MOST_DIGITS + 1)), made) if "digits" in registry.columns else F.round(made, 4)
    return joined.select(*keys, F.concat("stat", "suffix").alias("stat"), rounded.alias("value"))
