"""How measures move: last-minus-first slopes, least-squares trajectories, shrunken matchup effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_minus_first(df: DataFrame, keys: list[str], at: str, tie: str, value: str, least: int, name: str) -> DataFrame:
    """Last value less the first, of keys with at least so many rows. Equal times are told apart by tie."""
    when = F.struct(at, tie)
    return df.groupBy(*keys).agg(F.count("*").alias("_n"), (F.max_by(value, when) - F.min_by(value, when)).alias(name)).where(F.col("_n") >= least).drop("_n")


def blend(a: DataFrame, b: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Mean of the slopes that are present, three decimals."""
    present = F.array_compact(F.array(x, y))
    return a.join(b, keys, "full").withColumn("score", F.round(F.aggregate(present, F.lit(0.0), lambda s, v: s + v) / F.size(present), 3))


def trajectory(df: DataFrame, key: str, at: str, tie: str, value: str, share: float = 0.1, least: int = 3, most: int = 16, edge: float = 0.25) -> DataFrame:
    """Least-squares slope over the last tenth of a key's rows (3 to 16), and its name; 0 where there is one."""
    w = Window.partitionBy(key)
    n = F.least(F.greatest(F.round(share * F.count("*").over(w)), F.lit(least)), F.lit(most))
    place = F.row_number().over(w.orderBy(F.desc(at), F.desc(tie)))
    last = df.withColumns({"_n": n, "_p": place}).where("_p <= _n").withColumn("_x", -F.col("_p").cast("double"))
    got = last.groupBy(key).agg(F.count("*").alias("n"), F.round(F.coalesce(F.regr_slope(value, F.col("_x")), F.lit(0.0)), 6).alias("slope"))
    return got.withColumn("trend", F.when(F.col("slope") > edge, "rising").when(F.col("slope") < -edge, "falling").otherwise("steady"))


def shrunk(adjusted: Column, n: Column, recent: Column, same_side: Column) -> tuple[Column, Column]:
    """Effect times n / (n + 5), and its reliability of 100."""
    shrink = n / (n + F.lit(5.0))
    return adjusted * shrink, 100 * shrink * (0.5 + 0.5 * recent / n) * (0.5 + 0.5 * same_side)
