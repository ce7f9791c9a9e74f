"""The derivations of a season as a chain: each step is written, and the next one reads what was written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import cohort
from ..session import written
from . import season

LEAST_GAMES = 20  # of those whose ratings the others are measured by


def percentiles(done: dict[str, DataFrame]) -> DataFrame:
    """Each stat's percentile among all of its season."""
    ranked = cohort.percent_ranks(done["stats"], ["season", "stat"], S.key_of(F.col("value")), "rank")
    inverse = F.when(F.col("stat") == "returns", 1 - F.col("rank")).otherwise(F.col("rank"))
    return ranked.select("l_suppkey", "season", "n_nationkey", "games", "stat", F.round(100 * inverse, 1).alias("pct"))


def composites(done: dict[str, DataFrame]) -> DataFrame:
    """The mean of an entity's percentiles, in exact decimals."""
    mean = F.sum(F.col("pct").cast("decimal(18,1)")).cast("double") / F.count("*")
    return done["percentiles"].groupBy("l_suppkey", "season", "n_nationkey", "games").agg(F.round(mean, 4).alias("composite"))


def ratings(done: dict[str, DataFrame]) -> DataFrame:
    """Scores against mean and deviation of those with enough games; a grouped aggregate, so no season is dealt to one task."""
    c = done["composites"]
    exact = F.col("composite").cast("decimal(18,4)")
    sums = c.where(F.col("games") >= LEAST_GAMES).groupBy("season").agg(F.count("*").alias("n"), F.sum(exact).cast("double").alias("s"), F.sum((exact * exact).cast("decimal(28,8)")).cast("double").alias("q"))
    spread = sums.select("season", F.round(F.col("s") / F.col("n"), 6).alias("mean"), F.round(F.sqrt(F.greatest(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2, F.lit(0.0))), 6).alias("deviation"))
    scored = c.join(spread, "season", "left").withColumn("rating", S.t_score(F.col("composite"), F.col("mean"), F.col("deviation")))
    return scored.select("l_suppkey", "season", "n_nationkey", "games", "composite", "rating")


def team_ratings(done: dict[str, DataFrame]) -> DataFrame:
    """A nation's season: its members' ratings, weighted by games."""
    weighted = F.sum((F.col("rating").cast("decimal(18,1)") * F.col("games")).cast("decimal(28,1)")).cast("double")
    return done["ratings"].where("rating is not null").groupBy("season", "n_nationkey").agg(F.count("*").alias("members"), F.round(weighted / F.sum("games"), 4).alias("team_rating"))


def standings(done: dict[str, DataFrame]) -> DataFrame:
    """Each rating's percentile in its season, beside the rating of its team."""
    rated = done["ratings"].where("rating is not null")
    ranked = cohort.percent_ranks(rated, ["season"], S.key_of(F.col("rating")), "rank").withColumn("rating_pct", F.round(100 * F.col("rank"), 1))
    return ranked.join(done["team_ratings"], ["season", "n_nationkey"]).select("l_suppkey", "season", "composite", "rating", "rating_pct", "team_rating", "members")


STEPS: tuple[Callable[[dict[str, DataFrame]], DataFrame], ...] = (percentiles, composites, ratings, team_ratings, standings)


def chain(stats: DataFrame) -> dict[str, DataFrame]:
    """All steps in their order, as tables that were written: each reads those before it by name."""
    done = {"stats": written(stats, "stats")}
    for step in STEPS:
        done[step.__name__] = written(step(done), step.__name__)
    return done


def recompute_season(spark, d):
    """The last step's table, read back."""
    return chain(season.long(spark, d))["standings"]


def recompute_counts(spark, d):
    """How many rows each step wrote."""
    done = chain(season.long(spark, d))
    counts = [done[step.__name__].agg(F.lit(i).alias("step"), F.lit(step.__name__).alias("name"), F.count("*").alias("updated")) for i, step in enumerate(STEPS, 1)]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


QUERIES = {f.__name__: f for f in (recompute_season, recompute_counts)}

_CHAIN = f"""WITH {season.LONG},
percentiles AS (
    SELECT l_suppkey, season, n_nationkey, games, stat,
        round(100 * CASE WHEN stat = 'returns' THEN 1 - percent_rank() OVER w ELSE percent_rank() OVER w END, 1) AS pct
    FROM lg WINDOW w AS (PARTITION BY season, stat ORDER BY CAST(value AS DECIMAL(18,6)))
),
composites AS (
    SELECT l_suppkey, season, n_nationkey, games, round(CAST(sum(CAST(pct AS DECIMAL(18,1))) AS DOUBLE) / count(*), 4) AS composite
    FROM percentiles GROUP BY ALL
),
sums AS (
    SELECT season, count(*) AS n, CAST(sum(CAST(composite AS DECIMAL(18,4))) AS DOUBLE) AS s,
        CAST(sum(CAST(composite AS DECIMAL(18,4)) * CAST(composite AS DECIMAL(18,4))) AS DOUBLE) AS q
    FROM composites WHERE games >= {LEAST_GAMES} GROUP BY season
),
spread AS (SELECT season, round(s / n, 6) AS mean, round(sqrt(greatest(q / n - (s / n) * (s / n), 0)), 6) AS deviation FROM sums),
ratings AS (
    SELECT c.*, CASE WHEN deviation <> 0 THEN round(least(greatest(50 + 10 * (composite - mean) / deviation, 1.0::DOUBLE), 99.0::DOUBLE), 1) END AS rating
    FROM composites c LEFT JOIN spread USING (season)
),
team_ratings AS (
    SELECT season, n_nationkey, count(*) AS members,
        round(CAST(sum(CAST(rating AS DECIMAL(18,1)) * games) AS DOUBLE) / sum(games), 4) AS team_rating
    FROM ratings WHERE rating IS NOT NULL GROUP BY ALL
),
standings AS (
    SELECT l_suppkey, season, composite, rating, round(100 * percent_rank() OVER (PARTITION BY season ORDER BY CAST(rating AS DECIMAL(18,6))), 1) AS rating_pct,
        team_rating, members
    FROM ratings JOIN team_ratings USING (season, n_nationkey) WHERE rating IS NOT NULL
)"""

ORACLES = {
    "recompute_season": f"{_CHAIN} SELECT * FROM standings",
    "recompute_counts": f"{_CHAIN} " + " UNION ALL ".join(f"SELECT {i} AS step, '{s.__name__}' AS name, count(*) AS updated FROM {s.__name__}" for i, s in enumerate(STEPS, 1)),
}
