"""Stream queries: everything available, through the streaming engine; results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_path
from ..sources.tables import table
from ..streaming import markers, timers
from ..streaming import streams as st


ARRIVALS = 4


def _through(spark, d, build, name, mode="append"):
    """What build makes of the events table as a stream, which comes in arrivals in the order of ids (rows without one come with the first).

    The query stops after each arrival and starts again from its marks, as after a failure: state and output go on.
    Each arrival is written with the partitions that the table is read in, and is a batch of its own.
    """
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    source, home = new_path(spark, "events"), new_path(spark, name)
    low, high = e.agg(F.min("event_id"), F.max("event_id")).first()
    low, step = low or 0, ((high or 0) - (low or 0)) // ARRIVALS + 1
    for i in range(ARRIVALS):
        part = F.col("event_id").between(low + i * step, low + (i + 1) * step - 1)
        e.where(part if i else part | F.col("event_id").isNull()).write.mode("append").parquet(source)
        got = st.run_once(build(st.file_stream(spark, source, e.schema, None)), name, mode, home)
    return got


def stream_daily_series(spark, d):
    """Whole result of the tumbling days, in complete mode: the last batch's table."""
    got = _through(spark, d, lambda s: s.groupBy(F.window("ts", "1 day").start.alias("day"), "event_type").agg(F.count("*").alias("n")), "daily", "complete")
    return got.where(F.col("batch") == got.agg(F.max("batch")).first()[0]).select(F.to_date("day").alias("day"), "event_type", "n")


def debounce_stream(spark, d):
    """Of each user's events in order, those whose kind differs from the last let through."""
    return _through(spark, d, lambda s: st.debounced(s, "user_id", "event_type", "event_id"), "debounced").select(F.col("key").cast("long").alias("user_id"), F.col("ord").alias("event_id"))


def queue_state(spark, d):
    """Events as queue commands: signup and view enqueue, click claims, purchase completes, error fails."""
    command = F.when(F.col("event_type").isin("signup", "view"), "enqueue").when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "purchase", "complete").otherwise("fail")
    named = lambda s: s.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("ord"), command.alias("event"), (F.col("event_id") % 3).cast("string").alias("version"))
    return _through(spark, d, lambda s: st.queue(named(s)), "queue")


def stream_sessions(spark, d):
    """Quiet-period sessions; the last batch's table."""
    got = _through(spark, d, lambda s: st.sessions(s, "ts", "user_id"), "sessions", "complete")
    return got.where(F.col("batch") == got.agg(F.max("batch")).first()[0]).select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "n")


def barrier_stream(spark, d):
    """The event with which a user's fifth kind of event is first seen."""
    got = _through(spark, d, lambda s: st.barrier(s, "user_id", "event_type", "event_id", 5), "barrier")
    return got.select(F.col("key").cast("long").alias("user_id"), F.col("ord").alias("event_id"))


def crossing_stream(spark, d):
    """Events that cross more of 90, 95 and 99 than the user's event before."""
    got = _through(spark, d, lambda s: st.crossings(s, "user_id", "value", "event_id"), "crossings")
    return got.select(F.col("key").cast("long").alias("user_id"), F.col("ord").alias("event_id"), "level")


def stream_first_of_day(spark, d):
    """A user's kinds of event of each day, once each. A day leaves the state once the watermark, 60 days behind the newest event, has passed it; rows of such days are dropped."""
    firsts = lambda s: st.firsts_of_day(s, "ts", ["user_id", "event_type"], "60 days")
    return _through(spark, d, firsts, "firsts").select("user_id", "event_type", F.to_date("day").alias("day"))


def timed_queue(spark, d):
    """Events as queue commands, ten seconds apart: signup and view enqueue, click claims, purchase completes, error fails or releases; what falls due comes out by itself."""
    timers.prepare(spark)
    i, kind = F.col("event_id"), F.col("event_type")
    event = F.when(kind.isin("signup", "view"), "enqueue").when(kind == "click", "claim").when(kind == "purchase", "complete").when(i % 2 == 0, "fail").otherwise("release")
    named = lambda s: s.where(i.isNotNull()).select(F.col("user_id").cast("string").alias("key"), F.timestamp_seconds(1_700_000_000 + 10 * i).alias("at"), i.alias("ord"), event.alias("event"), (i % 3).cast("string").alias("version"), (i % 4 * 300).alias("delay"))
    return _through(spark, d, lambda s: timers.timed_queue(named(s)), "timed").select("key", F.col("at").cast("timestamp_ntz").alias("at"), "ord", "what", "attempts")


CORRECTED = 50  # events of such ids come again with twice their value


def _followed(spark, d):
    """Users' value changes, kept current through four arrivals, one of corrections, and one that repeats the first; every batch is run twice."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("value").cast("double").alias("value"))
    low, high = e.agg(F.min("event_id"), F.max("event_id")).first()
    low, step = low or 0, ((high or 0) - (low or 0)) // ARRIVALS + 1
    part = F.floor((F.col("event_id") - low) / step)
    arrivals = [e.where(part == i) for i in range(ARRIVALS)]
    fixed = F.col("event_id") % CORRECTED == 0
    arrivals += [e.where(fixed).withColumn("value", 2 * F.col("value")), e.where((part == 0) & ~fixed)]
    change = lambda rows: rows.where("value is not null").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max_by("value", "event_id") - F.min_by("value", "event_id"), 6).alias("change")).where("n >= 3")
    schema = T.StructType([T.StructField(c, t) for c, t in (("event_id", T.LongType()), ("user_id", T.LongType()), ("value", T.DoubleType()))])
    derived = T.StructType([T.StructField(c, t) for c, t in (("user_id", T.LongType()), ("n", T.LongType()), ("change", T.DoubleType()))])
    kept = markers.Kept(new_path(spark, "kept"), schema, "event_id", "user_id", "value", "event_id", change, derived, buckets=8)
    source = new_path(spark, "arrivals")
    for rows in arrivals:
        rows.select(*(F.col(f.name).cast(f.dataType) for f in schema)).write.mode("append").parquet(source)
        kept.follow(st.file_stream(spark, source, schema, None), again=True)
    return kept


def incremental_changes(spark, d):
    return _followed(spark, d).rows(spark)


def refresh_markers(spark, d):
    """Which arrival first and last had a user's change derived again, and how many did."""
    return _followed(spark, d).markers(spark)


def stream_enriched(spark, d):
    """A stream joined with a table: events of users who are customers, by market segment."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return _through(spark, d, lambda s: s.join(c, "user_id").select("event_id", "c_mktsegment"), "enriched")


def throttle_stream(spark, d):
    """A user's events that set off a refresh: the first, then each that comes 500 ids or more after the last that did."""
    got = _through(spark, d, lambda s: st.throttled(s, "user_id", "event_id", 500), "throttled")
    return got.select(F.col("key").cast("long").alias("user_id"), F.col("ord").alias("event_id"))


QUERIES = {f.__name__: f for f in (stream_daily_series, debounce_stream, queue_state, stream_sessions, barrier_stream, crossing_stream, stream_first_of_day, stream_enriched, throttle_stream, timed_queue, incremental_changes, refresh_markers)}

ORACLES = {
    "stream_daily_series": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "debounce_stream": "SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type",
    "stream_sessions": """WITH e AS (SELECT *, coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600000000 AS INTEGER), 1) AS new FROM events),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""",
    "barrier_stream": "WITH f AS (SELECT user_id, event_type, min(event_id) AS first_ FROM events GROUP BY ALL) SELECT user_id, max(first_) AS event_id FROM f GROUP BY user_id HAVING count(*) = 5",
    "crossing_stream": """WITH l AS (SELECT user_id, event_id, CAST(value >= 90 AS INTEGER) + CAST(value >= 95 AS INTEGER) + CAST(value >= 99 AS INTEGER) AS level FROM events), b AS (SELECT *, coalesce(lag(level) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS before_ FROM l)
      SELECT user_id, event_id, level FROM b WHERE level > before_""",
    "stream_first_of_day": "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events",
    "throttle_stream": "WITH RECURSIVE t AS (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id UNION ALL SELECT t.user_id, min(e.event_id) FROM t JOIN events e ON e.user_id = t.user_id AND e.event_id >= t.event_id + 500 GROUP BY t.user_id, t.event_id) SELECT user_id, event_id FROM t",
    "stream_enriched": "SELECT event_id, c_mktsegment FROM events JOIN customer ON c_custkey = user_id",
    "incremental_changes": """
WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 50 = 0 THEN 2 * value ELSE value END AS value FROM events WHERE value IS NOT NULL)
SELECT user_id, count(*) AS n, round(arg_max(value, event_id) - arg_min(value, event_id), 6) AS change FROM e GROUP BY user_id HAVING count(*) >= 3
""",
    "refresh_markers": """
WITH b AS (SELECT min(event_id) AS low, (max(event_id) - min(event_id)) // 4 + 1 AS step FROM events),
m AS (
    SELECT user_id, (event_id - low) // step AS arrival FROM events, b WHERE value IS NOT NULL
    UNION ALL SELECT user_id, 4 FROM events WHERE event_id % 50 = 0 AND value <> 0
)
SELECT user_id, min(arrival) AS first_marked, max(arrival) AS last_marked, count(DISTINCT arrival) AS times FROM m GROUP BY user_id
""",
}
