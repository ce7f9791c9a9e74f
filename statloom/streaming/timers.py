"""The work queue with timers: work falls due by itself, and finished work leaves the state.

Each key is one piece of work: pending until it is due, then ready; a claim makes it running; completion deletes its
state. A failure waits 30 s, 2 min, 10 min, then 30 min, and the fifth parks the work: that is emitted, and its state
goes as well. Deferred or released work is pending again at no cost. A new input version reopens work in any state, its
timer moved. Time is the events' own: a timer fires once the watermark has passed it, whether or not rows of its key come.

Needs the RocksDB state store (``prepare`` sets it). Late rows, older than the watermark, are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RETRY_SECONDS = (30, 120, 600, 1800)
MOST_ATTEMPTS = 5
OUT = "key string, at timestamp, ord long, what string, attempts int"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class WorkQueue(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.work = handle.getValueState("work", "status string, version string, attempts int, due long")

    def _settle(self, before: tuple | None, after: tuple | None) -> None:
        """One write of the state and of its timer, however many rows changed it. A timer stands where due isn't zero."""
        old, new = (x[3] if x else 0 for x in (before, after))
        if old and old != new:
            self.handle.deleteTimer(old)
        if new and old != new:
            self.handle.registerTimer(new)
        if after is None and before is not None:
            self.work.clear()
        elif after != before:
            self.work.update(after)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        before = self.work.get()
        before = None if before is None else tuple(before)
        held = before
        lists = ([frame[c].tolist() for c in ("at", "ord", "event", "version", "delay")] for frame in rows)
        for at, number, event, given, delay in sorted((r for columns in lists for r in zip(*columns, strict=True)), key=lambda r: r[:2]):
            now = at.value // 1_000_000
            status, version, attempts, due = held or ("none", None, 0, 0)
            if status == "pending" and due <= now:  # it fell due before this row, though the watermark isn't there yet
                status = "ready"
                out.append(self._due(key, due, attempts))
                held = (status, version, attempts, 0)
            if event == "enqueue" and (status == "none" or given != version):
                held = ("pending", given, 0, now + 1000 * int(delay))
                out.append((key[0], at, number, "pending", 0))
            elif event == "claim" and status == "ready":
                held = ("running", version, attempts, 0)
                out.append((key[0], at, number, "running", attempts))
            elif event == "complete" and status == "running":
                held = None
                out.append((key[0], at, number, "done", attempts))
            elif event == "fail" and status == "running":
                attempts += 1
                held = None if attempts >= MOST_ATTEMPTS else ("pending", version, attempts, now + 1000 * RETRY_SECONDS[min(attempts, len(RETRY_SECONDS)) - 1])
                out.append((key[0], at, number, "parked" if attempts >= MOST_ATTEMPTS else "waiting", attempts))
            elif event in ("defer", "release") and status == "running":
                held = ("pending", version, attempts, now + 1000 * int(delay))
                out.append((key[0], at, number, "pending", attempts))
        self._settle(before, held)
        if out:
            yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.work.get()
        if held is not None and held[0] == "pending":
            status, version, attempts, due = held
            self.work.update(("ready", version, attempts, 0))
            yield self._rows([self._due(key, due, attempts)])

    @staticmethod
    def _due(key: tuple, due: int, attempts: int) -> tuple:
        return key[0], pd.Timestamp(due, unit="ms"), None, "due", attempts

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(out, columns=["key", "at", "ord", "what", "attempts"])
        return found.astype({"at": "datetime64[us]", "ord": "Int64", "attempts": "int32"})

    def close(self) -> None:
        pass


def timed_queue(stream: DataFrame, late: str = "0 seconds") -> DataFrame:
    """key, at, ord, event, version, delay (seconds until the work is due) -> what happened, and what fell due, in any order."""
    return stream.withWatermark("at", late).groupBy("key").transformWithStateInPandas(WorkQueue(), OUT, "Append", "EventTime")
