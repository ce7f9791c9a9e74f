"""The same operators over streams: file sources, watermarked windows, debounced and queued work with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import new_path

RETRY_SECONDS = (30, 120, 600, 1800)
MOST_ATTEMPTS = 5


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = 1) -> DataFrame:
    """The files of a folder as a stream; that many a batch, all new ones if None."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)


def run_once(stream: DataFrame, name: str, mode: str = "append", home: str | None = None) -> DataFrame:
    """Everything available through the stream into a Parquet table in the shared folder (append), exactly once.

    home: where results and marks lie, so that a later run goes on from there; a new folder by default.
    """
    spark = stream.sparkSession
    home = home or new_path(spark, name)
    out, mark = f"{home}/rows", f"{home}/marks"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def store(batch: DataFrame, number: int) -> None:  # idempotent: a batch that is run again writes the same folder
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", mark).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def daily_counts(stream: DataFrame, at: str, key: str, late: str = "2 days") -> DataFrame:
    """Tumbling days with a watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 day"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("day"), key, "n", "total")


def sessions(stream: DataFrame, at: str, key: str, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Quiet-period sessions with a watermark."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def firsts_of_day(stream: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    """keys and day, once each. The day is a window of the watermarked time, so its rows leave the state when the watermark passes it; later ones are dropped."""
    days = stream.withWatermark(at, late).withColumn("_day", F.window(at, "1 day"))
    return days.dropDuplicates([*keys, "_day"]).select(*keys, F.col("_day.start").alias("day"))


def debounced(stream: DataFrame, key: str, version: str, order: str) -> DataFrame:
    """Rows whose version differs from the last one let through for their key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for v, o in zip(rows["version"], rows["ord"], strict=True):
            if v != last:
                out.append((k[0], v, o))
                last = v
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "version", "ord"])

    order_in, order = order, "ord"
    named = stream.select(F.col(key).cast("string").alias("key"), F.col(version).cast("string").alias("version"), F.col(order_in).cast("long").alias("ord"))
    return named.groupBy("key").applyInPandasWithState(step, "key string, version string, ord long", "version string", "append", GroupStateTimeout.NoTimeout)


class Work:
    """One key of the durable queue: (status, version, attempts)."""

    def __init__(self, status: str = "none", version: str | None = None, attempts: int = 0):
        self.status, self.version, self.attempts = status, version, attempts

    def take(self, event: str, version: str) -> tuple[str, int]:
        """What an event leads to, and after how many seconds the work is due."""
        wait = 0
        if event == "enqueue":
            if self.status == "none" or version != self.version:  # a new version reopens work in any state, also running work
                self.status, self.version, self.attempts = "pending", version, 0
        elif event == "claim" and self.status == "pending":
            self.status, self.attempts = "running", self.attempts + 1
        elif event == "complete" and self.status == "running":
            self.status = "done"
        elif event == "fail" and self.status == "running":
            if self.attempts >= MOST_ATTEMPTS:
                self.status = "parked"
            else:
                self.status, wait = "pending", RETRY_SECONDS[min(self.attempts, len(RETRY_SECONDS)) - 1]
        elif event in ("defer", "release") and self.status == "running":
            self.status, self.attempts = "pending", max(0, self.attempts - 1)  # neither costs an attempt
        return self.status, wait


def queue(stream: DataFrame) -> DataFrame:
    """key, ord, event, version -> each event's status and wait. State is one small row a key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        work = Work(*state.get) if state.exists else Work()
        out = []
        for r in pd.concat(list(batches)).sort_values("ord").itertuples():
            status, wait = work.take(r.event, r.version)
            out.append((k[0], r.ord, status, wait, work.attempts))
        state.update((work.status, work.version, work.attempts))
        yield pd.DataFrame(out, columns=["key", "ord", "status", "wait", "attempts"])

    return stream.groupBy("key").applyInPandasWithState(step, "key string, ord long, status string, wait int, attempts int", "status string, version string, attempts int", "append", GroupStateTimeout.NoTimeout)


def barrier(stream: DataFrame, key: str, stage: str, order: str, stages: int) -> DataFrame:
    """(key, ord): when a key's last stage settles. State is the set of settled stages, dropped once all are."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, done = state.get if state.exists else ([], False)
        seen, out = set(seen), []
        for r in pd.concat(list(batches)).sort_values("ord").itertuples():
            if not done:
                seen.add(r.stage)
                done = len(seen) == stages
                if done:
                    out.append((k[0], r.ord))
        state.update((sorted(seen) if not done else [], done))
        yield pd.DataFrame(out, columns=["key", "ord"])

    named = stream.select(F.col(key).cast("string").alias("key"), F.col(stage).cast("string").alias("stage"), F.col(order).cast("long").alias("ord"))
    return named.groupBy("key").applyInPandasWithState(step, "key string, ord long", "seen array<string>, done boolean", "append", GroupStateTimeout.NoTimeout)


def throttled(stream: DataFrame, key: str, order: str, least: int) -> DataFrame:
    """(key, ord): rows at least that far after the last one let through of their key; the first always is. State is one number a key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = state.get[0] if state.exists else None, []
        for o in pd.concat(list(batches))["ord"].sort_values():
            if last is None or o >= last + least:
                last = int(o)
                out.append((k[0], last))
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "ord"])

    named = stream.where(F.col(order).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("ord"))
    return named.groupBy("key").applyInPandasWithState(step, "key string, ord long", "last long", "append", GroupStateTimeout.NoTimeout)


def crossings(stream: DataFrame, key: str, value: str, order: str, edges: tuple[float, ...] = (90.0, 95.0, 99.0)) -> DataFrame:
    """(key, ord, level): rows that stand above more edges than the row before them of their key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = state.get[0] if state.exists else 0, []
        for r in pd.concat(list(batches)).sort_values("ord").itertuples():
            level = sum(r.value >= e for e in edges)
            if level > last:
                out.append((k[0], r.ord, level))
            last = level
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "ord", "level"])

    named = stream.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"), F.col(order).cast("long").alias("ord"))
    return named.groupBy("key").applyInPandasWithState(step, "key string, ord long, level int", "last int", "append", GroupStateTimeout.NoTimeout)
