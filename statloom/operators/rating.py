"""Rating engine: z-scores of datapoints over an eligible population, composites, percentiles by scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import key_of
from ..session import written
from .cohort import percent_ranks, scoped


def eligible(stats: DataFrame, thresholds: DataFrame, keys: list[str], group: str) -> DataFrame:
    """keys and eligible: whether every threshold (group, stat, least) of the row's group is met; a group without thresholds has none."""
    met = stats.join(F.broadcast(thresholds), [group, "stat"], "right").where(F.col(keys[0]).isNotNull())
    got = met.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("value") >= F.col("least"), F.lit(False))).alias("ok"), F.count("*").alias("n"))
    wanted = thresholds.groupBy(group).agg(F.count("*").alias("wanted"))
    every = stats.select(*keys, group).distinct()
    return every.join(got, keys, "left").join(F.broadcast(wanted), group, "left").select(*keys, F.coalesce(F.col("ok") & (F.col("n") == F.col("wanted")), F.lit(False)).alias("eligible"))


def zscores(points: DataFrame, population: list[str]) -> DataFrame:
    """points (value, sign, eligible) with z against the eligible of the same population; 0 without deviation."""
    of = F.when(F.col("eligible"), F.col("value"))
    measured = points.groupBy(*population).agg(F.avg(of).alias("_mean"), F.stddev_pop(of).alias("_deviation"))  # combined before the shuffle
    joined = points.alias("p").join(measured.alias("m"), [F.col(f"p.{c}").eqNullSafe(F.col(f"m.{c}")) for c in population])
    z = F.coalesce((F.col("value") - F.col("_mean")) / F.nullif(F.col("_deviation"), F.lit(0.0)), F.lit(0.0))
    return joined.select(*(f"p.{c}" for c in points.columns), (F.col("sign") * z).alias("z"))


def composite(points: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of signed z over the datapoints that count (in_comp)."""
    return points.groupBy(*keys).agg(F.round(F.sum(F.when(F.col("in_comp"), F.col("z")).otherwise(0.0)), 4).alias("composite"))


def bundle(points: DataFrame, keys: list[str], population: list[str], scopes: dict) -> DataFrame:
    """Each datapoint's z, and its percentile in every scope; ineligible rows get 50 + 10 z (1 to 99) and no scope ranks."""
    z = written(zscores(points, population), "zscores")
    rows = scoped(z.where("eligible"), scopes)
    ranked = percent_ranks(rows, [*population, "scope", "cohort"], key_of(F.col("z")), "_rank").withColumn("pct", F.round(100 * F.col("_rank"), 1)).drop("_rank")
    rest = z.where("not eligible").select(*z.columns, F.lit("none").alias("scope"), F.lit(None).cast("string").alias("cohort"), F.round(F.least(F.greatest(50 + 10 * F.col("z"), F.lit(1.0)), F.lit(99.0)), 1).alias("pct"))
    return ranked.unionByName(rest)
