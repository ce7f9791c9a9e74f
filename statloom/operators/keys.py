"""Latest or first row of a key, merges without MERGE, thinning of append-only tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_first(df: DataFrame, keys: list[str], order: list[Column], n: int | None = 1, place: str | None = None) -> DataFrame:
    """The first n rows (None: all) of each key in the given order (which must break its own ties), with their number from 1 on as place if that is given."""
    name = place or "_place"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked if n is None else ranked.where(F.col(name) <= n)
    return kept if place else kept.drop(name)


def latest_per_key(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key; equal times go to the larger tie."""
    return ranked_first(df, keys, [F.col(at).desc_nulls_last(), F.col(tie).desc_nulls_last()])


def first_per_key(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    return ranked_first(df, keys, [F.col(at).asc_nulls_last(), F.col(tie).asc_nulls_last()])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """old merged with new: one full outer join. A key's new row wins; columns of keep_old stay if the new value is null."""
    o, n = old.alias("o"), new.alias("n")
    on = reduce(Column.__and__, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys))
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    pick = []
    for c in old.columns:
        if c in keys or c in keep_old:
            pick.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        else:
            pick.append(F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return o.join(n, on, "full").select(*pick)


def changed_only(latest: DataFrame, now: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of now that differ, null-safely, from the latest stored row of their key: what a debounced append writes."""
    same = reduce(Column.__and__, (F.col(f"l.{c}").eqNullSafe(F.col(f"n.{c}")) for c in [*keys, *values]))
    return now.alias("n").join(latest.alias("l"), same, "left_anti")


def thin_daily(df: DataFrame, keys: list[str], at: str, tie: str, before: Column) -> DataFrame:
    """Rows older than before keep the last of each key and day; newer rows all stay."""
    day = F.to_date(at)
    place = F.row_number().over(Window.partitionBy(*keys, F.col("_day")).orderBy(F.col(at).desc(), F.col(tie).desc()))
    return df.withColumn("_day", day).withColumn("_place", place).where((F.col(at) >= before) | (F.col("_place") == 1)).drop("_day", "_place")


def top_ranked(df: DataFrame, by: str, n: int) -> DataFrame:
    """Rows of rank n or better (rank int, ties share one) by a column, largest first. Only those reach the last task."""
    edge = df.orderBy(F.desc(by)).limit(n).agg(F.min(by).alias("_edge"))
    best = df.crossJoin(F.broadcast(edge)).where(F.col(by) >= F.col("_edge")).drop("_edge")
    return best.withColumn("rank", F.rank().over(Window.orderBy(F.desc(by))).cast("int")).where(F.col("rank") <= n)
