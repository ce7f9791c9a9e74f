"""Streams with timers, expiring state and dirty markers."""

import datetime
import json

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom import catalog
from statloom.session import new_path
from statloom.streaming import markers, streams, timers

SF = "/root/testdata/sf0.001"


def utc(seconds):
    return datetime.datetime.fromtimestamp(seconds, datetime.UTC).replace(tzinfo=None)


def worked(commands):
    """What a queue does with (key, at in seconds, ord, event, version, delay), sorted; the watermark ends at the last of all."""
    held, out = {}, []
    last = max((c[1] for c in commands), default=0)

    def due(key, now):
        w = held.get(key)
        if w and w["status"] == "pending" and w["due"] <= now:
            w["status"] = "ready"
            out.append((key, w["due"], None, "due", w["attempts"]))

    for key, at, number, event, version, delay in sorted(commands, key=lambda c: (c[1], c[2])):
        due(key, at)
        w = held.get(key)
        if event == "enqueue" and (w is None or w["version"] != version):
            held[key] = {"status": "pending", "version": version, "attempts": 0, "due": at + delay}
            out.append((key, at, number, "pending", 0))
        elif event == "claim" and w and w["status"] == "ready":
            w["status"] = "running"
            out.append((key, at, number, "running", w["attempts"]))
        elif w and w["status"] == "running":
            if event == "complete":
                del held[key]
                out.append((key, at, number, "done", w["attempts"]))
            elif event == "fail":
                w["attempts"] += 1
                if w["attempts"] == 5:
                    del held[key]
                else:
                    w["status"], w["due"] = "pending", at + (30, 120, 600, 1800)[w["attempts"] - 1]
                out.append((key, at, number, "parked" if w["attempts"] == 5 else "waiting", w["attempts"]))
            elif event == "release":
                w["status"], w["due"] = "pending", at + delay
                out.append((key, at, number, "pending", w["attempts"]))
    for key in held:
        due(key, last)
    return sorted(out, key=repr)


def test_timed_queue(spark):
    names = {"signup": "enqueue", "view": "enqueue", "click": "claim", "purchase": "complete"}
    rows = duckdb.sql(f"SELECT event_id, user_id, event_type FROM read_parquet('{SF}/events.parquet')").fetchall()
    commands = [(str(u), 1_700_000_000 + 10 * i, i, names.get(kind) or ("fail" if i % 2 == 0 else "release"), str(i % 3), i % 4 * 300) for i, u, kind in rows]
    got = [(r.key, int(r.at.replace(tzinfo=datetime.UTC).timestamp()), r.ord, r.what, r.attempts) for r in catalog.queries()["timed_queue"](spark, SF).collect()]
    assert sorted(got, key=repr) == worked(commands)
    assert {"due", "pending", "running", "done", "waiting"} <= {r[3] for r in got}


def test_finished_work_leaves_the_state_and_timers_fire_alone(spark):
    timers.prepare(spark)
    source, out, marks = (new_path(spark, n) for n in ("work", "out", "marks"))
    shape = "key string, at timestamp, ord long, event string, version string, delay long"
    fails = [e for i in range(5) for e in ((2000 + 4000 * i, "claim"), (2010 + 4000 * i, "fail"))]
    arrivals = [
        [("a", 0, "enqueue"), ("b", 0, "enqueue"), ("c", 0, "enqueue")],
        [("a", 100, "claim"), ("b", 100, "claim"), ("a", 110, "complete"), ("b", 110, "fail")],
        [("x", 1000, "claim")],  # of no work: it only moves the clock, and b falls due
        *([("c", at, event)] for at, event in fails),
        [("x", 30_000, "claim")],
    ]
    commands, sizes = [], []
    for n, rows in enumerate(arrivals):
        part = [(k, 1_700_000_000 + at, 100 * n + i, event, "1", 0) for i, (k, at, event) in enumerate(rows)]
        commands += part
        spark.createDataFrame([(k, utc(at), *rest) for k, at, *rest in part], shape).write.mode("append").parquet(source)
        q = timers.timed_queue(streams.file_stream(spark, source, shape, None)).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        q.awaitTermination()
        sizes.append(json.loads(q.lastProgress.json)["stateOperators"][0]["numRowsTotal"])
    got = [(r.key, int(r.at.replace(tzinfo=datetime.UTC).timestamp()), r.ord, r.what, r.attempts) for r in spark.read.schema(timers.OUT).parquet(out).collect()]
    assert sorted(got, key=repr) == worked(commands)
    assert [r[3:] for r in got if r[0] == "b" and r[3] == "due"] == [("due", 0), ("due", 1)]
    assert [r for r in got if r[3] == "parked"][0][4] == 5
    assert sizes[-1] < max(sizes)  # a is done and c is parked: only b is left


def test_late_rows_of_days_that_are_over(spark):
    source, home = new_path(spark, "days"), new_path(spark, "firsts")
    shape = "user_id long, event_type string, ts timestamp"
    day = lambda n: datetime.datetime(2024, 1, 1, 5) + datetime.timedelta(days=n)
    for rows in ([(1, "a", day(0)), (1, "a", day(0))], [(1, "a", day(150))], [(1, "a", day(0)), (2, "b", day(0)), (1, "a", day(120))], [(1, "a", day(150)), (1, "a", day(120))]):
        spark.createDataFrame(rows, shape).write.mode("append").parquet(source)
        got = streams.run_once(streams.firsts_of_day(streams.file_stream(spark, source, shape, None), "ts", ["user_id", "event_type"], "60 days"), "firsts", home=home)
    assert sorted((r.user_id, (r.day - datetime.datetime(2024, 1, 1)).days) for r in got.collect()) == [(1, 0), (1, 120), (1, 150)]


@pytest.fixture
def kept(spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    derived = T.StructType([T.StructField("k", T.StringType()), T.StructField("total", T.LongType())])
    change = lambda rows: rows.where("v is not null").groupBy("k").agg(F.sum("v").alias("total"))
    return markers.Kept(new_path(spark, "kept"), schema, "id", "k", "v", "id", change, derived, buckets=3)


def test_only_changed_keys_are_derived_again(spark, kept):
    batch = lambda *rows: spark.createDataFrame(rows, "id long, k string, v long")
    totals = lambda: {r.k: r.total for r in kept.rows(spark).collect()}
    assert kept.arrival(batch(), 0) == 0 and totals() == {}
    first = batch((1, "a", 1), (2, "a", 2), (3, "b", 5), (4, None, 7), (None, "a", 9), (5, "c", None))
    assert kept.arrival(first, 1) == 2 and totals() == {"a": 3, "b": 5}
    assert kept.arrival(first, 2) == 0 and totals() == {"a": 3, "b": 5}  # again: nothing
    assert kept.arrival(batch((3, "b", 5), (2, "a", 4)), 3) == 1 and totals() == {"a": 5, "b": 5}
    assert kept.arrival(batch((3, "d", 5)), 4) == 2 and totals() == {"a": 5, "d": 5}  # a row that moves to another key
    assert {(r.k, r.first_marked, r.last_marked, r.times) for r in kept.markers(spark).collect()} == {("a", 1, 3, 2), ("b", 1, 4, 2), ("d", 4, 4, 1)}
