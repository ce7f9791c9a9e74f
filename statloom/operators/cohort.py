"""Ranks within cohorts: percentiles over several scopes, composites, cold-start blending, leave-one-out means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import key_of
from ..session import written


def percentiles(long: DataFrame, cohort: list[str], value: str = "value", inverse: Column | None = None, name: str = "pct") -> DataFrame:
    """100 * percent_rank within (cohort), one decimal; lower is better where inverse holds. cohort includes the stat. Cohorts may have any size."""
    long = written(long, "cohorts")  # read to count and to rank
    sizes = long.groupBy(*cohort).agg(F.count("*").alias("sample_size"))
    ranked = percent_ranks(long, cohort, key_of(F.col(value)), "_rank").alias("r").join(sizes.alias("s"), [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in cohort])
    flipped = F.col("_rank") if inverse is None else F.when(inverse, 1 - F.col("_rank")).otherwise(F.col("_rank"))
    return ranked.select(*(f"r.{c}" for c in long.columns), "_rank", "sample_size").withColumn(name, F.round(100 * flipped, 1)).drop("_rank")


IN_ONE_TASK = 1 << 20  # rows of a cohort that a task may sort


def percent_ranks(df: DataFrame, cohort: list[str], value: Column, name: str, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """df with each row's percent_rank within its cohort, for cohorts of any size.

    A window sorts a whole cohort in one task, which is well while the largest one, counted first, has in_one_task rows at
    most. Beyond that, with the same result, equal values are counted (most of it before the shuffle),
    the counts are dealt out by ranges of (cohort, value), and each range's running sum begins with what the ranges before
    it hold; rows get the place of their value by a join. Nulls are a value of their own, the smallest.
    """
    if (df.groupBy(*cohort).count().agg(F.max("count")).first()[0] or 0) <= in_one_task:
        return df.withColumn(name, F.percent_rank().over(Window.partitionBy(*cohort).orderBy(value)))
    keyed = df.withColumn("_v", value)
    counts = keyed.groupBy(*cohort, "_v").agg(F.count("*").alias("_c"))
    dealt = written(counts.repartitionByRange(*cohort, "_v").withColumn("_p", F.spark_partition_id()), "ranks")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_p", *cohort).agg(F.sum("_c").alias("_s"))
    starts = parts.select("_p", *cohort, F.coalesce(F.sum("_s").over(before(Window.partitionBy(*cohort).orderBy("_p"))), F.lit(0)).alias("_o"), F.sum("_s").over(Window.partitionBy(*cohort)).alias("_n"))
    same = lambda a, b, columns: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns]
    local = dealt.withColumn("_b", F.coalesce(F.sum("_c").over(before(Window.partitionBy("_p", *cohort).orderBy("_v"))), F.lit(0)))
    placed = local.alias("l").join(starts.alias("s"), same("l", "s", ["_p", *cohort])).select(*(f"l.{c}" for c in [*cohort, "_v"]), (F.col("_b") + F.col("_o")).alias("_below"), "_n")
    ranked = keyed.alias("k").join(placed.alias("p"), same("k", "p", [*cohort, "_v"]))
    return ranked.select(*(f"k.{c}" for c in df.columns), F.when(F.col("_n") > 1, F.col("_below") / (F.col("_n") - 1)).otherwise(0.0).alias(name))


def scoped(long: DataFrame, scopes: dict[str, Column]) -> DataFrame:
    """One row for each scope that has a cohort: columns scope and cohort. One window then ranks all scopes."""
    rows = F.array(*(F.struct(F.lit(n).alias("scope"), c.cast("string").alias("cohort")) for n, c in scopes.items()))
    return long.withColumn("_s", F.explode(rows)).select(*long.columns, "_s.scope", "_s.cohort").where("cohort is not null")


def cold_start(df: DataFrame, current: str, games: str, window: Column, *anchors: str, default: float = 50.0) -> Column:
    """current, blended with the first anchor that is known while games are fewer than window."""
    anchor = F.coalesce(*(F.col(a) for a in anchors), F.lit(default))
    share = F.col(games) / window
    return F.when(F.col(games) < window, (1 - share) * anchor + share * F.col(current)).otherwise(F.col(current))


def leave_one_out(df: DataFrame, cohort: list[str], value: str) -> Column:
    """Mean of the others in the cohort; null if there are none. Sums are exact to six decimals, so their order is nothing to it."""
    w, exact = Window.partitionBy(*cohort), F.col(value).cast("decimal(18,6)")
    return (F.sum(exact).over(w) - exact).cast("double") / F.nullif((F.count(value).over(w) - 1).cast("double"), F.lit(0.0))


def crossings(before: DataFrame, after: DataFrame, keys: list[str], marks: tuple[int, ...] = (90, 95, 99), jump: float = 10) -> DataFrame:
    """Percentiles that passed a mark, or rose by jump at least. Columns: keys, old_pct, new_pct, crossed (highest mark, else null)."""
    joined = after.select(*keys, F.col("pct").alias("new_pct")).join(before.select(*keys, F.col("pct").alias("old_pct")), keys)
    crossed = F.greatest(*(F.when((F.col("old_pct") < m) & (F.col("new_pct") >= m), m) for m in marks), F.lit(None).cast("int"))
    return joined.withColumn("crossed", crossed).where(F.col("crossed").isNotNull() | (F.col("new_pct") - F.col("old_pct") >= jump))
