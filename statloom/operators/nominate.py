"""Reported results against known fixtures: nearest in time, in either orientation, with sides and scores put right.

Fixtures and reports meet by unordered pair of teams and by two-day step of time, so no pair of teams is dealt to one
task with its whole history. Reports of one fixture that contradict each other change nothing.

Defined results: a report with a missing team, two equal teams or no time is refused; a fixture without a time is never
near; equal distances go to the smaller fixture; a report far from every fixture makes a new one at its own time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import ranked_first

DAYS = 2
FINAL = ("completed", "seeded")


def _step(at: Column) -> Column:
    return F.floor(F.unix_micros(at.cast("timestamp")) / (DAYS * 86_400_000_000)).cast("long")


def starting_year(at: Column) -> Column:
    """A season is named by the year it begins in, in July."""
    return F.year(at) - (F.month(at) < 7).cast("int")


def nominated(reports: DataFrame, fixtures: DataFrame) -> DataFrame:
    """reports: article, at, home, away, home_goals, away_goals; fixtures: fixture, at, home, away, status, home_score, away_score.

    article, outcome, fixture, swapped, home_score and away_score (as the fixture has its sides), status, season (of new ones).
    """
    pair = lambda t: [F.least(f"{t}.home", f"{t}.away").alias("low"), F.greatest(f"{t}.home", f"{t}.away").alias("high")]
    refused = F.when(F.col("home").isNull() | F.col("away").isNull(), "team_unresolved").when(F.col("home") == F.col("away"), "same_team").when(F.col("at").isNull(), "no_time")
    told = reports.withColumn("refused", refused)
    r = told.where("refused is null").alias("r")
    r = r.select("r.article", F.col("r.at").alias("said"), F.col("r.home").alias("h"), "home_goals", "away_goals", *pair("r")).withColumn("step", F.explode(F.array(*(_step(F.col("said")) + k for k in (-1, 0, 1)))))
    f = fixtures.alias("f").select("fixture", "at", F.col("f.home").alias("fixture_home"), "status", "home_score", "away_score", *pair("f")).withColumn("step", _step(F.col("at")))
    away = F.abs(F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("said").cast("timestamp")))
    met = r.join(f, ["low", "high", "step"]).withColumn("away_by", away).where(F.col("away_by") <= DAYS * 86_400_000_000)
    swapped = F.col("fixture_home") != F.col("h")
    want = F.struct(F.when(swapped, F.col("away_goals")).otherwise(F.col("home_goals")).alias("home"), F.when(swapped, F.col("home_goals")).otherwise(F.col("away_goals")).alias("away"))
    near = ranked_first(met, ["article"], [F.asc("away_by"), F.asc("fixture")]).select("article", "fixture", "status", "home_score", "away_score", swapped.alias("swapped"), want.alias("want"))
    said = near.groupBy("fixture").agg(F.countDistinct("want").alias("kinds"))
    same = F.col("status").isin(*FINAL) & F.col("home_score").eqNullSafe(F.col("want.home")) & F.col("away_score").eqNullSafe(F.col("want.away"))
    judged = near.join(said, "fixture").withColumn("verdict", F.when(F.col("kinds") > 1, "contradictory").when(same, "already_correct").otherwise("corrected"))
    out = told.alias("t").join(judged.alias("j"), "article", "left")
    outcome = F.coalesce("refused", "verdict", F.lit("created"))
    new, right = F.col("outcome") == "created", F.col("outcome") == "corrected"
    return out.withColumn("outcome", outcome).select(
        "article",
        "outcome",
        "fixture",
        "swapped",
        F.when(new, F.col("home_goals")).when(right, F.col("want.home")).otherwise(F.col("home_score")).alias("home_score"),
        F.when(new, F.col("away_goals")).when(right, F.col("want.away")).otherwise(F.col("away_score")).alias("away_score"),
        F.when(new | (right & (F.col("status") != "seeded")), "completed").otherwise(F.col("status")).alias("status"),
        F.when(new, starting_year(F.col("t.at"))).alias("season"),
    )
