"""Entity graph: co-mention edges, typed edges, decay, trajectories, heat. Every clock is an explicit as_of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import trajectory


def age_days(at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp_ltz")) - F.unix_micros(at.cast("timestamp_ltz"))) / F.lit(86_400_000_000.0)


def recency(age: Column, days: float, sources: Column, enough: float, recent: Column, total: Column) -> Column:
    """100 e^(-age/days) (0.6 min(1, sources/enough) + 0.4 recent/total), between 0 and 100."""
    mix = 0.6 * F.least(F.lit(1.0), sources / F.lit(enough)) + 0.4 * recent / F.nullif(total.cast("double"), F.lit(0.0))
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * F.exp(-age / F.lit(days)) * mix))


def co_mentions(mentions: DataFrame, as_of: Column, window_days: int = 90, recent_days: int = 14, decay_days: float = 21.0) -> DataFrame:
    """Edges (a < b) between entities named by the same article. mentions: article, entity, source, at.

    Articles name few entities, so pairs stay linear in mentions; aggregation combines before the shuffle.
    """
    m = mentions.where(age_days(F.col("at"), as_of) <= window_days).dropDuplicates(["article", "entity"])
    pairs = m.alias("x").join(m.alias("y"), (F.col("x.article") == F.col("y.article")) & (F.col("x.entity") < F.col("y.entity")))
    e = pairs.select(F.col("x.entity").alias("a"), F.col("y.entity").alias("b"), F.col("x.source").alias("source"), F.col("x.at").alias("at"))
    g = e.groupBy("a", "b").agg(F.count("*").alias("mentions"), F.countDistinct("source").alias("sources"), F.max("at").alias("last_at"), F.count_if(age_days(F.col("at"), as_of) <= recent_days).alias("recent"))
    return g.withColumn("strength", F.round(recency(age_days(F.col("last_at"), as_of), decay_days, F.col("sources"), 5, F.col("recent"), F.col("mentions")), 4))


def decay_upsert(before: DataFrame, now: DataFrame) -> DataFrame:
    """(a, b, strength, trajectory, present): edges missing now fall to zero; a change of ten either way names the trajectory."""
    j = before.select("a", "b", F.col("strength").alias("s0")).join(now.select("a", "b", F.col("strength").alias("s1")), ["a", "b"], "full")
    after = F.coalesce("s1", F.lit(0.0))
    return j.select("a", "b", after.alias("strength"), trajectory(after - F.coalesce("s0", F.lit(0.0))).alias("trajectory"), F.col("s1").isNotNull().alias("present"))


def typed_strength(weight_sum: Column, sources: Column, recent: Column, total: Column, age: Column) -> Column:
    """100 e^(-age/21) (0.5 evidence + 0.3 volume + 0.2 recent share), a whole number from 0 to 100."""
    mix = 0.5 * F.least(F.lit(1.0), weight_sum / 4) + 0.3 * F.least(F.lit(1.0), F.greatest(sources, F.lit(1)) / F.lit(3.0)) + 0.2 * recent / F.greatest(total, F.lit(1))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(100 * F.exp(-age / 21.0) * mix).cast("int")))


def reliability(confirmed: Column, prior: float = 5.0) -> Column:
    return 100 * confirmed / (confirmed + F.lit(prior))
