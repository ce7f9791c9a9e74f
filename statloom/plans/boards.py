"""Page and board queries: latest-then-filter and filter-then-latest rules, trends, results, stories, upkeep."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import text as X
from ..operators import cohort, keys, story
from ..sources.tables import table
from .season import SEASONS, seasons


def as_of():
    return F.lit("2024-01-31").cast("timestamp")


def hours_old(at: str):
    return (F.unix_micros(as_of()) - F.unix_micros(F.col(at).cast("timestamp_ltz"))) / F.lit(3_600_000_000.0)


def _events(spark, d):
    return table(spark, d, "events")


def board_latest_then_filter(spark, d):
    """Newest row of each user in 96 hours; error rows are markers that hide what was before; ranked by value."""
    e = keys.latest_per_key(_events(spark, d).where(hours_old("ts") <= 96), ["user_id"], "ts", "event_id").where("event_type <> 'error'")
    return keys.top_ranked(e.select("user_id", "event_id", S.key_of(F.col("value")).alias("k")), "k", 50).drop("k")


def board_filter_then_latest(spark, d):
    """Archive rule: markers drop out first, so what was before them shows."""
    e = keys.latest_per_key(_events(spark, d).where("event_type <> 'error'"), ["user_id"], "ts", "event_id")
    return e.select("user_id", "event_id", F.round("value", 4).alias("value"))


def board_null_bucket_rank(spark, d):
    """Customers of a segment by their rating (orders over 10 only are rated); unrated ones have no rank."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    c = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("rating", F.when(F.col("n") > 10, F.col("total")))
    w = Window.partitionBy("c_mktsegment", F.col("rating").isNull()).orderBy(F.desc("rating"), "c_custkey")
    return c.select("c_custkey", "c_mktsegment", "rating", F.when(F.col("rating").isNotNull(), F.row_number().over(w)).cast("int").alias("rank"))


def board_risers_fallers(spark, d):
    """The ten largest rises and falls between a user's two newest values."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = _events(spark, d).withColumns({"p": F.row_number().over(w), "before": F.lead("value").over(w)}).where("p = 1 and before is not null")
    m = e.select("user_id", F.round(F.col("value") - F.col("before"), 4).alias("delta"))
    both = m.select("user_id", "delta", F.explode(F.array(F.struct(F.lit("riser").alias("side"), F.col("delta").alias("k")), F.struct(F.lit("faller").alias("side"), (-F.col("delta")).alias("k")))).alias("s")).select("user_id", "delta", "s.side", "s.k")
    return keys.ranked_first(both, ["side"], [F.desc("k"), F.asc("user_id")], 10).select("side", "user_id", "delta")


def leaderboard(spark, d):
    """Two kinds of entities on one board: totals ranked within each kind, the best 25."""
    c = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn("kind", F.lit("customer"))
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("total")).withColumn("kind", F.lit("supplier"))
    return keys.ranked_first(c.unionByName(s), ["kind"], [F.desc("total"), F.asc("id")], 25)


def trends_last3(spark, d):
    """Each supplier's last three fixtures beside its season and its peers without it."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    e = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).where(F.year("o_orderdate") == 2000).groupBy("l_suppkey", "l_orderkey", "o_orderdate").agg(F.sum("l_quantity").alias("q"))
    own = e.groupBy("l_suppkey").agg(F.sum("q").alias("s"), F.count("*").alias("n"))
    last = keys.ranked_first(e, ["l_suppkey"], [F.desc("o_orderdate"), F.desc("l_orderkey")], 3).groupBy("l_suppkey").agg(F.avg("q").alias("last3"))
    place = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    w = Window.partitionBy("s_nationkey")
    j = own.join(last, "l_suppkey").join(place, "l_suppkey")
    return j.select("l_suppkey", F.round("last3", 4).alias("last3"), F.round(F.col("s") / F.col("n"), 4).alias("season"), F.round(F.try_divide(F.sum("s").over(w) - F.col("s"), F.sum("n").over(w) - F.col("n")), 4).alias("peers"))


def team_results_wdl(spark, d):
    """Nations meet in an order's first two lines: result from the first's point of view, summed over fixtures."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    line = table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "s_nationkey", "l_quantity")
    h, a = line.where("l_linenumber = 1").alias("h"), line.where("l_linenumber = 2").alias("a")
    m = h.join(a, F.col("h.l_orderkey") == F.col("a.l_orderkey")).where("h.s_nationkey <> a.s_nationkey")
    side = lambda x, y: F.struct(F.col(f"{x}.s_nationkey").alias("team"), F.col(f"{x}.l_quantity").alias("f"), F.col(f"{y}.l_quantity").alias("g"))
    r = m.select(F.explode(F.array(side("h", "a"), side("a", "h"))).alias("r")).select("r.*")
    return r.groupBy("team").agg(F.count("*").alias("played"), F.count_if(F.col("f") > F.col("g")).alias("won"), F.count_if(F.col("f") == F.col("g")).alias("drawn"), F.count_if(F.col("f") < F.col("g")).alias("lost"), F.sum(F.when(F.col("f") > F.col("g"), 3).when(F.col("f") == F.col("g"), 1).otherwise(0)).alias("points"))


def daily_series(spark, d):
    return _events(spark, d).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def hourly_windows(spark, d):
    """Tumbling six-hour windows."""
    return _events(spark, d).groupBy(F.window("ts", "6 hours").start.alias("started")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def session_gaps(spark, d):
    """Sessions: a user's events no more than six hours apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp_ltz")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp_ltz"))).over(w)
    e = _events(spark, d).withColumn("new", F.coalesce((gap > 6 * 3_600_000_000).cast("int"), F.lit(1))).withColumn("session", F.sum("new").over(w))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def named_scopes(spark, d):
    """Rows of each named time scope (1, 3, 7, 14 and 30 days)."""
    scopes = F.array(*(F.struct(F.lit(f"d{n}").alias("scope"), F.lit(n * 24.0).alias("hours")) for n in (1, 3, 7, 14, 30)))
    e = _events(spark, d).select("user_id", hours_old("ts").alias("age"), F.explode(scopes).alias("s")).where("age <= s.hours")
    return e.groupBy("s.scope").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def retention_thinning(spark, d):
    """Rows over ten days old keep the last of each user and day."""
    return keys.thin_daily(_events(spark, d), ["user_id"], "ts", "event_id", F.lit("2024-01-20").cast("timestamp")).select("event_id", "user_id", "event_type")


def stale_product_reconcile(spark, d):
    """Users whose newest purchase (the product) is older than any of its inputs: newest click, view or signup."""
    at = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    e = _events(spark, d).groupBy("user_id").agg(at("purchase").alias("product"), F.greatest(at("click"), at("view"), at("signup")).alias("newest"))
    return e.where("newest is not null and (product is null or product < newest)").select("user_id", "newest", F.col("product").isNull().alias("never"))


def pipeline_stats(spark, d):
    """Per day: rows, share of users seen, median staleness in hours."""
    e = _events(spark, d)
    users = e.agg(F.countDistinct("user_id").alias("every"))
    g = e.withColumn("age", hours_old("ts")).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("u"), F.round(F.expr("percentile(age, 0.5)"), 6).alias("median_age"))
    return g.crossJoin(F.broadcast(users)).select("day", "n", F.round(100.0 * F.col("u") / F.col("every"), 4).alias("coverage"), "median_age")


def catch_up_notices(spark, d):
    """Users at the ninetieth percentile of value in their kind of event without a purchase since."""
    e = _events(spark, d)
    ranked = cohort.percent_ranks(e, ["event_type"], S.key_of(F.col("value")), "rank")
    r = ranked.withColumn("pct", 100 * F.col("rank")).where("pct >= 90").alias("r")
    sent = e.where("event_type = 'purchase'").select(F.col("user_id").alias("u"), F.col("ts").alias("t")).alias("s")
    return r.join(sent, (F.col("user_id") == F.col("u")) & (F.col("t") >= F.col("ts")), "left_anti").select("event_id", "user_id")


def story_list(spark, d):
    """Conversations as stories: heat = turns / (1 + age), the cast by role, the newest text's size."""
    c = table(spark, d, "conversations")
    top = keys.ranked_first(c, ["conv_id"], [F.desc("turn")]).select("conv_id", F.length("text").alias("last_chars"))
    g = c.groupBy("conv_id").agg(F.count("*").alias("reports"), F.max("turn").alias("latest"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("cast_list"))
    return g.join(top, "conv_id").select("conv_id", "reports", "cast_list", "last_chars", F.round(F.col("reports") / (1.0 + F.col("latest")), 6).alias("heat"))


def packet_compile(spark, d):
    """Claims of a conversation: byte-identical ones go to the first turn; six at most, with a fingerprint of each."""
    c = table(spark, d, "conversations").withColumn("h", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32))
    first = keys.ranked_first(c, ["conv_id", "h"], [F.asc("turn")])
    return keys.ranked_first(first, ["conv_id"], [F.asc("turn")], 6).select("conv_id", "turn", "h")


def part_progress(spark, d):
    """Per user and week: entries, peak and last value, and the trajectory against the week before."""
    e = _events(spark, d).withColumn("week", F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 7).cast("int"))
    g = e.groupBy("user_id", "week").agg(F.count("*").alias("entries"), F.round(F.max("value"), 4).alias("peak"), F.round(F.max_by("value", F.struct("ts", "event_id")), 4).alias("last"))
    before = F.lag("last").over(Window.partitionBy("user_id").orderBy("week"))
    return g.withColumn("trajectory", S.trajectory(F.col("last") - F.coalesce(before, F.lit(0.0))))


def conviction_ladder(spark, d):
    e = _events(spark, d)
    return e.select("event_id", S.conviction(F.col("value") - 50).alias("conviction"), S.direction(F.col("value") - 50).alias("direction"), S.band(F.col("value")).alias("band"))


def notability(spark, d):
    """Best percentile, number of percentiles of 85 and more, and composite of a supplier's season."""
    s = seasons(spark, d).where("season = 2000")
    p = lambda c: F.round(100 * F.percent_rank().over(Window.partitionBy("season").orderBy(S.key_of(F.col(c)))), 1)
    r = s.select("l_suppkey", F.array(p("qty"), p("revenue"), p("lines")).alias("p"))
    high = F.size(F.filter("p", lambda x: x >= 85)).cast("double")
    mean = F.aggregate("p", F.lit(0.0), lambda a, x: a + x) / 3
    return r.select("l_suppkey", X.notability(F.array_max("p"), high, mean).alias("notability"))


def omen_ladder(spark, d):
    """Signs of three pillars: agreeing pairs of all, 50 or less is a crossroads, else the common direction."""
    s = seasons(spark, d)
    w = Window.partitionBy("l_suppkey").orderBy("season")
    delta = lambda c: F.signum(F.col(c).cast("double") - F.lag(c).over(w).cast("double"))
    p = s.select("l_suppkey", "season", delta("qty").alias("a"), delta("revenue").alias("b"), delta("returns").alias("c")).where("a is not null")
    agree = sum(((F.col(x) == F.col(y)) & (F.col(x) != 0)).cast("int") for x, y in (("a", "b"), ("a", "c"), ("b", "c")))
    share = F.greatest(F.round(100.0 * agree / 3), F.lit(1.0)).cast("int")
    return p.select("l_suppkey", "season", share.alias("convergence"), F.when(share <= 50, "crossroads").when(F.col("a") + F.col("b") + F.col("c") > 0, "ascendant").otherwise("descendant").alias("omen"))


def queue_view(spark, d):
    """Outstanding work by kind and status: only the newest row of a key counts; five failures park it."""
    w = Window.partitionBy("user_id", "event_type")
    e = _events(spark, d).withColumn("attempts", F.count("*").over(w))
    q = keys.latest_per_key(e, ["user_id", "event_type"], "ts", "event_id")
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("attempts") >= 5, "parked").otherwise("pending")
    return q.groupBy("event_type", status.alias("status")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    board_latest_then_filter, board_filter_then_latest, board_null_bucket_rank, board_risers_fallers, leaderboard, trends_last3, team_results_wdl, daily_series, hourly_windows, session_gaps,
    named_scopes, retention_thinning, stale_product_reconcile, pipeline_stats, catch_up_notices, story_list, packet_compile, part_progress, conviction_ladder, notability, omen_ladder, queue_view,
)}

_AGE = "((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 3600000000.0::DOUBLE)"

ORACLES = {
    "board_latest_then_filter": f"WITH l AS (SELECT * FROM events WHERE {_AGE} <= 96 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT * FROM (SELECT user_id, event_id, CAST(rank() OVER (ORDER BY CAST(value AS DECIMAL(18,6)) DESC) AS INTEGER) AS rank FROM l WHERE event_type <> 'error') WHERE rank <= 50",
    "board_filter_then_latest": "SELECT user_id, event_id, round(value, 4) AS value FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "board_null_bucket_rank": "WITH o AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL), c AS (SELECT c_custkey, c_mktsegment, CASE WHEN n > 10 THEN total END AS rating FROM customer LEFT JOIN o ON c_custkey = o_custkey) SELECT *, CAST(CASE WHEN rating IS NOT NULL THEN row_number() OVER (PARTITION BY c_mktsegment, rating IS NULL ORDER BY rating DESC, c_custkey) END AS INTEGER) AS rank FROM c",
    "board_risers_fallers": """WITH e AS (SELECT user_id, value, row_number() OVER w AS p, lead(value) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)), m AS (SELECT user_id, round(value - before, 4) AS delta FROM e WHERE p = 1 AND before IS NOT NULL),
      b AS (SELECT 'riser' AS side, user_id, delta, delta AS k FROM m UNION ALL SELECT 'faller', user_id, delta, -delta FROM m) SELECT side, user_id, delta FROM b QUALIFY row_number() OVER (PARTITION BY side ORDER BY k DESC, user_id) <= 10""",
    "leaderboard": "WITH u AS (SELECT o_custkey AS id, round(sum(o_totalprice), 2) AS total, 'customer' AS kind FROM orders GROUP BY ALL UNION ALL SELECT l_suppkey, round(sum(l_extendedprice), 2), 'supplier' FROM lineitem GROUP BY ALL) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY kind ORDER BY total DESC, id) <= 25",
    "trends_last3": """WITH e AS (SELECT l_suppkey, l_orderkey, o_orderdate, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) = 2000 GROUP BY ALL), own AS (SELECT l_suppkey, sum(q) AS s, count(*) AS n FROM e GROUP BY ALL),
      la AS (SELECT l_suppkey, avg(q) AS last3 FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY o_orderdate DESC, l_orderkey DESC) <= 3) GROUP BY ALL)
      SELECT l_suppkey, round(last3, 4) AS last3, round(s / n, 4) AS season, round((sum(s) OVER w - s) / nullif(sum(n) OVER w - n, 0), 4) AS peers FROM own JOIN la USING (l_suppkey) JOIN supplier ON s_suppkey = l_suppkey WINDOW w AS (PARTITION BY s_nationkey)""",
    "team_results_wdl": """WITH l AS (SELECT l_orderkey, l_linenumber, s_nationkey, l_quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), m AS (SELECT h.s_nationkey AS ht, a.s_nationkey AS at_, h.l_quantity AS hq, a.l_quantity AS aq FROM l h JOIN l a ON h.l_orderkey = a.l_orderkey AND h.l_linenumber = 1 AND a.l_linenumber = 2 AND h.s_nationkey <> a.s_nationkey),
      r AS (SELECT ht AS team, hq AS f, aq AS g FROM m UNION ALL SELECT at_, aq, hq FROM m) SELECT team, count(*) AS played, count(*) FILTER (WHERE f > g) AS won, count(*) FILTER (WHERE f = g) AS drawn, count(*) FILTER (WHERE f < g) AS lost, CAST(sum(CASE WHEN f > g THEN 3 WHEN f = g THEN 1 ELSE 0 END) AS BIGINT) AS points FROM r GROUP BY team""",
    "daily_series": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
    "hourly_windows": "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS started, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "session_gaps": "WITH e AS (SELECT *, coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 21600000000 AS INTEGER), 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM e) SELECT user_id, session, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM s GROUP BY ALL",
    "named_scopes": f"SELECT 'd' || n_ AS scope, count(*) AS n, count(DISTINCT user_id) AS users FROM events CROSS JOIN (SELECT unnest([1, 3, 7, 14, 30]) AS n_) WHERE {_AGE} <= n_ * 24 GROUP BY n_",
    "retention_thinning": "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE ts >= TIMESTAMP '2024-01-20' OR p = 1",
    "stale_product_reconcile": "WITH g AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'purchase') AS product, greatest(max(ts) FILTER (WHERE event_type = 'click'), max(ts) FILTER (WHERE event_type = 'view'), max(ts) FILTER (WHERE event_type = 'signup')) AS newest FROM events GROUP BY user_id) SELECT user_id, newest, product IS NULL AS never FROM g WHERE newest IS NOT NULL AND (product IS NULL OR product < newest)",
    "pipeline_stats": f"SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(100.0::DOUBLE * count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events), 4) AS coverage, round(quantile_cont({_AGE}, 0.5), 6) AS median_age FROM events GROUP BY 1",
    "catch_up_notices": "WITH r AS (SELECT *, 100 * percent_rank() OVER (PARTITION BY event_type ORDER BY CAST(value AS DECIMAL(18,6))) AS pct FROM events) SELECT event_id, user_id FROM r WHERE pct >= 90 AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'purchase' AND s.user_id = r.user_id AND s.ts >= r.ts)",
    "story_list": "WITH t AS (SELECT conv_id, CAST(len(text) AS INTEGER) AS last_chars FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1), g AS (SELECT conv_id, count(*) AS reports, max(turn) AS latest, string_agg(DISTINCT role, ',' ORDER BY role) AS cast_list FROM conversations GROUP BY conv_id) SELECT conv_id, reports, cast_list, last_chars, round(reports / (1.0::DOUBLE + latest), 6) AS heat FROM g JOIN t USING (conv_id)",
    "packet_compile": "WITH f AS (SELECT conv_id, turn, left(sha256(text), 32) AS h FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, left(sha256(text), 32) ORDER BY turn) = 1) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 6",
    "part_progress": """WITH e AS (SELECT *, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0) AS INTEGER) AS week FROM events), g AS (SELECT user_id, week, count(*) AS entries, round(max(value), 4) AS peak, round(arg_max(value, (ts, event_id)), 4) AS last FROM e GROUP BY ALL), b AS (SELECT *, last - coalesce(lag(last) OVER (PARTITION BY user_id ORDER BY week), 0) AS d FROM g)
      SELECT * EXCLUDE (d), CASE WHEN d >= 10 THEN 'heating' WHEN d <= -10 THEN 'cooling' ELSE 'developing' END AS trajectory FROM b""",
    "conviction_ladder": """SELECT event_id, CAST((CAST(abs(x) >= 5 AS INTEGER) + CAST(abs(x) >= 20 AS INTEGER) + CAST(abs(x) >= 35 AS INTEGER) + CAST(abs(x) >= 55 AS INTEGER) + CAST(abs(x) >= 80 AS INTEGER)) * sign(x) AS INTEGER) AS conviction, CASE WHEN x >= 10 THEN 'rising' WHEN x <= -10 THEN 'falling' ELSE 'steady' END AS direction,
      CASE WHEN value >= 90 THEN 'elite' WHEN value >= 75 THEN 'strong' WHEN value >= 60 THEN 'above average' WHEN value >= 50 THEN 'average' WHEN value >= 35 THEN 'below average' ELSE 'poor' END AS band FROM (SELECT event_id, value, value - 50 AS x FROM events)""",
    "notability": f"""WITH {SEASONS}, p AS (SELECT l_suppkey, round(100 * percent_rank() OVER (ORDER BY CAST(qty AS DECIMAL(18,6))), 1) AS a, round(100 * percent_rank() OVER (ORDER BY CAST(revenue AS DECIMAL(18,6))), 1) AS b, round(100 * percent_rank() OVER (ORDER BY CAST(lines AS DECIMAL(18,6))), 1) AS c FROM st WHERE season = 2000)
      SELECT l_suppkey, CAST(round(least(greatest(0.6::DOUBLE * greatest(a, b, c) + least(30.0::DOUBLE, 10.0::DOUBLE * (CAST(a >= 85 AS INTEGER) + CAST(b >= 85 AS INTEGER) + CAST(c >= 85 AS INTEGER))) + least(greatest(0.4::DOUBLE * ((a + b + c) / 3 - 50), -10.0::DOUBLE), 10.0::DOUBLE), 0.0::DOUBLE), 100.0::DOUBLE)) AS INTEGER) AS notability FROM p""",
    "omen_ladder": f"""WITH {SEASONS}, p AS (SELECT l_suppkey, season, sign(qty - lag(qty) OVER w) AS a, sign(revenue - lag(revenue) OVER w) AS b, sign(returns - lag(returns) OVER w) AS c FROM st WINDOW w AS (PARTITION BY l_suppkey ORDER BY season)), s AS (SELECT *, CAST(greatest(round(100.0::DOUBLE * (CAST(a = b AND a <> 0 AS INTEGER) + CAST(a = c AND a <> 0 AS INTEGER) + CAST(b = c AND b <> 0 AS INTEGER)) / 3), 1) AS INTEGER) AS convergence FROM p WHERE a IS NOT NULL)
      SELECT l_suppkey, season, convergence, CASE WHEN convergence <= 50 THEN 'crossroads' WHEN a + b + c > 0 THEN 'ascendant' ELSE 'descendant' END AS omen FROM s""",
    "queue_view": "WITH q AS (SELECT event_type, count(*) OVER (PARTITION BY user_id, event_type) AS attempts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS p FROM events) SELECT event_type, CASE WHEN event_type = 'purchase' THEN 'done' WHEN attempts >= 5 THEN 'parked' ELSE 'pending' END AS status, count(*) AS n FROM q WHERE p = 1 GROUP BY ALL",
}
