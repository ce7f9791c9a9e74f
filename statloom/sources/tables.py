"""Reading tables and the sinks that batch jobs use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import new_path


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def append_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def rebuild(df: DataFrame, path: str, *partition_by: str) -> None:
    """Rewrites the partitions that df has and leaves the others (all, without partition columns)."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """A projection that readers share: written under a new path, so that a path being read is never overwritten."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
