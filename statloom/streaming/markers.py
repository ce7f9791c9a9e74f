"""Dirty markers: a derived table kept current by deriving only the keys that an arrival changed.

Rows come in arrivals, may come twice, and may replace earlier rows of their id. Each arrival is compared with what is
stored; the keys of rows that are new or differ in value are marked, and only those are derived again. Stored and derived rows
lie in buckets of their key. An arrival reads and overwrites the buckets of its marked keys alone, so a few keys cost
a few buckets. An arrival that is run again finds nothing changed and writes nothing.

Defined results: rows without id are left out; rows without key or value are stored and mark nothing; of rows with one id in an arrival the last by
``order`` counts; an empty arrival changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import keys
from ..session import written
from ..sources.tables import rebuild

BUCKETS = 64
_MARKS = "first_marked long, last_marked long, times long, _bucket int"


class Kept:
    """A base table, what is derived from it by key, and the markers of its keys, all under one folder."""

    def __init__(self, home: str, schema: T.StructType, id: str, key: str, value: str, order: str, derive: Callable[[DataFrame], DataFrame], derived: T.StructType, buckets: int = BUCKETS):
        self.home, self.schema, self.id, self.key, self.value, self.order = home, schema, id, key, value, order
        self.derive, self.derived, self.buckets = derive, derived, buckets

    def _read(self, spark, name: str) -> DataFrame:
        if name == "marks":
            schema = T.StructType([self.schema[self.key], *T._parse_datatype_string(_MARKS).fields])
        else:
            schema = T.StructType([*(self.schema if name == "base" else self.derived).fields, T.StructField("_bucket", T.IntegerType())])
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("_bucket").parquet(f"{self.home}/{name}")
        return spark.read.schema(schema).parquet(f"{self.home}/{name}")

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def arrival(self, batch: DataFrame, number: int) -> int:
        """Takes in a batch; how many keys were derived again."""
        spark = batch.sparkSession
        own = keys.ranked_first(batch.where(F.col(self.id).isNotNull()).select(*self.schema.fieldNames()), [self.id], [F.desc_nulls_last(self.order)])
        stored = self._read(spark, "base")
        changed = written(self._bucketed(keys.changed_only(stored.select(*self.schema.fieldNames()), own, [self.id], [c for c in self.schema.fieldNames() if c != self.id])), "changed")
        touched = [r[0] for r in changed.select("_bucket").distinct().collect()]  # as many as there are buckets at most
        if not touched:
            return 0
        gone = stored.join(changed.select(self.id, F.col(self.key).alias("_now")), self.id).where(~F.col(self.key).eqNullSafe(F.col("_now")))
        moved = written(gone.select(self.id, self.key, "_bucket"), "moved")  # ids that change their key leave the old one's bucket
        touched += [r[0] for r in moved.select("_bucket").distinct().collect()]
        before = stored.where(F.col("_bucket").isin(touched))
        base = written(before.join(changed.select(self.id), self.id, "left_anti").unionByName(changed), "base")
        valued = changed.where(F.col(self.value).isNotNull()).select(self.key, "_bucket").unionByName(moved.select(self.key, "_bucket"))
        marked = written(valued.where(F.col(self.key).isNotNull()).distinct(), "marked")
        again = self._bucketed(self.derive(base.drop("_bucket").join(marked.select(self.key), self.key, "left_semi")).select(*self.derived.fieldNames()))
        rest = self._read(spark, "derived").where(F.col("_bucket").isin(touched)).join(marked.select(self.key), self.key, "left_anti")
        derived = written(rest.unionByName(again), "derived")
        old = self._read(spark, "marks").where(F.col("_bucket").isin(touched))
        new = marked.select(self.key, F.lit(number).cast("long").alias("at"), F.col("_bucket").alias("_b"))
        marks = old.join(new, self.key, "full").select(
            self.key,
            F.coalesce("first_marked", "at").alias("first_marked"),
            F.coalesce("at", "last_marked").alias("last_marked"),
            (F.coalesce("times", F.lit(0)) + (F.col("at").isNotNull() & ~F.col("at").eqNullSafe(F.col("last_marked"))).cast("long")).alias("times"),
            F.coalesce("_bucket", "_b").alias("_bucket"),
        )
        marks = written(marks, "marks")
        # The base comes after what is derived: a batch that is cut short before it finds the same rows changed when it is run again.
        had, has = ({r[0] for r in df.select("_bucket").distinct().collect()} for df in (self._read(spark, "derived").where(F.col("_bucket").isin(touched)), derived))
        for name, rows in (("derived", derived), ("marks", marks), ("base", base)):
            rebuild(rows, f"{self.home}/{name}", "_bucket")
        for bucket in had - has:  # a bucket without rows isn't overwritten by itself
            spark.createDataFrame([], self.derived).write.mode("overwrite").parquet(f"{self.home}/derived/_bucket={bucket}")
        return marked.count()

    def follow(self, stream: DataFrame, again: bool = False) -> None:
        """Takes in all that the stream has, batch by batch; with again, every batch twice."""

        def take(batch: DataFrame, number: int) -> None:
            batch = written(batch, "arrival")
            self.arrival(batch, number)
            if again:
                self.arrival(batch, number)

        stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{self.home}/stream").trigger(availableNow=True).start().awaitTermination()

    def rows(self, spark) -> DataFrame:
        return self._read(spark, "derived").drop("_bucket")

    def markers(self, spark) -> DataFrame:
        return self._read(spark, "marks").drop("_bucket")
