"""An inverted index as a table: which rows hold a token, laid out so that a search reads only the buckets it needs.

Rows (bucket, token, id) lie in one folder a bucket, sorted by token, so a search for tokens reads the folders of their
buckets, and in their files only row groups whose tokens reach that far. Containment of many arrays starts
from each array's rarest token, whose holders are its candidates, and checks those against their whole sets: frequent
tokens are never joined.

Defined results: an empty or null array is contained in every row; tokens that repeat count once; null tokens count as
absent; rows without id are left out; a token that no row holds leaves its array without a match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import new_path

BUCKETS = 32


def bucket_of(token: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def as_set(tokens: Column) -> Column:
    return F.array_distinct(F.array_compact(F.coalesce(tokens, F.array().cast("array<string>"))))


class Index:
    """Postings of a table's token arrays, and the sets themselves, under one folder."""

    def __init__(self, rows: DataFrame, id: str, tokens: Column, buckets: int = BUCKETS):
        self.spark, self.buckets, home = rows.sparkSession, buckets, new_path(rows.sparkSession, "index")
        self.kind = dict(rows.dtypes)[id]
        sets = rows.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), as_set(tokens).alias("tokens"))
        sets.write.option("compression", "zstd").parquet(f"{home}/sets")
        self.sets = self.spark.read.schema(sets.schema).parquet(f"{home}/sets")
        each = self.sets.select("id", F.explode("tokens").alias("token")).withColumn("bucket", bucket_of("token", buckets))
        dealt = each.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8)))  # a bucket with a frequent token is several files
        dealt.sortWithinPartitions("bucket", "token", "id").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{home}/postings")
        self.postings = self.spark.read.schema(f"id {self.kind}, token string, bucket int").parquet(f"{home}/postings")

    def holders(self, *tokens: str) -> DataFrame:
        """Ids of the rows that hold all of a few tokens given by the caller."""
        wanted = sorted(set(tokens))
        if not wanted:
            return self.sets.select("id")
        places = [r.b for r in self.spark.createDataFrame([(t,) for t in wanted], "t string").select(bucket_of("t", self.buckets).alias("b")).distinct().collect()]
        read = self.postings.where(F.col("bucket").isin(places) & F.col("token").isin(wanted))
        return read.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("id")

    def containing(self, arrays: DataFrame, key: str, tokens: Column) -> DataFrame:
        """(key, id) for each of a table's arrays and each row that holds all of it."""
        wanted = arrays.select(F.col(key).alias("key"), as_set(tokens).alias("wanted"))
        each = wanted.select("key", F.explode("wanted").alias("token")).withColumn("bucket", bucket_of("token", self.buckets))
        asked = each.select("bucket", "token").distinct()
        found = self.postings.join(asked, ["bucket", "token"], "left_semi").groupBy("token").agg(F.count("*").alias("n"))
        rarest = each.join(found, "token", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "bucket")).alias("r"))
        starts = rarest.where("r.n > 0").select("key", "r.token", "r.bucket")
        candidates = starts.join(self.postings, ["bucket", "token"]).select("key", "id").join(wanted, "key")
        checked = candidates.join(self.sets, "id").where(F.size(F.array_except("wanted", "tokens")) == 0)
        everywhere = wanted.where(F.size("wanted") == 0).select("key").join(self.sets.select("id"), F.lit(True))
        return checked.select("key", "id").unionByName(everywhere).withColumnRenamed("key", key)


