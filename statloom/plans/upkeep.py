"""Bookkeeping queries: fixtures, box scores, work queues, cadence, story upkeep and candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import boxscore, keys, rollup
from ..sources.tables import table


def as_of():
    return F.lit("2024-01-31").cast("timestamp")


def today():
    return F.lit("2001-08-01").cast("timestamp")


def _events(spark, d):
    return table(spark, d, "events")


def pending_fixtures(spark, d):
    """The fifty fixtures that have been due longest: open, two days past their start, fewer than three tries."""
    o = table(spark, d, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") <= today() - F.expr("interval 2 days"))).withColumn("attempts", (F.col("o_orderkey") % 5).cast("int"))
    return o.where("attempts < 3").orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_orderdate", "attempts")


def fixture_upsert(spark, d):
    """Incoming fixtures merged over stored ones; unknown scores and dates keep what is stored."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("fixture"), F.col("o_orderstatus").alias("status"), F.round("o_totalprice", 2).alias("score"))
    stored = o.where("fixture % 3 <> 0").withColumn("status", F.lit("scheduled"))
    incoming = o.where("fixture % 2 = 0").withColumn("score", F.when(F.col("fixture") % 4 != 0, F.col("score") + 1))
    return keys.upsert(stored, incoming, ["fixture"], keep_old=("score",))


def _payload(spark, d):
    """Each order's lines as a payload of the flat layout: suppliers are teams, the first two lines' the two sides."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("total"))
    side = lambda n: F.max(F.when(F.col("l_linenumber") == n, F.col("l_suppkey")))
    sides = line.groupBy("l_orderkey").agg(side(1).alias("home"), side(2).alias("away"))
    final = F.when(F.col("o_orderstatus") != "P", F.col("total"))
    game = F.struct(F.col("l_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("home").alias("home_team_id"), F.col("away").alias("visitor_team_id"), final.alias("home_team_score"), (final - 1).alias("visitor_team_score"))
    own = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.format_string("%d:%02d", F.col("l_quantity").cast("int"), F.col("l_linenumber") * 7).alias("min"), F.col("l_quantity").alias("pts"), F.struct(F.col("l_partkey").alias("id")).alias("player"), F.struct(F.col("l_suppkey").alias("id")).alias("team"), game.alias("game"))
    rows = line.join(sides, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("l_orderkey").agg(F.to_json(F.struct(F.struct(F.collect_list(own).alias("data")).alias("stats"))).alias("payload"))


def boxscore_parse(spark, d):
    """Payloads back to rows."""
    rows = boxscore.flat_rows(_payload(spark, d))
    return rows.select("fixture", "line", "player", "team", F.round("minutes", 6).alias("minutes"), "points", "home", "away")


def _nested(spark, d):
    """Each order's lines as a payload of the nested layout: parts are players; every line has an event, and its supplier a total of its own."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"))
    line = line.repartition("l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "q", "l_partkey"))).alias("lines"))  # lines are dealt out as they are, what stands around them is made then
    each = lambda made: F.transform("lines", lambda x: F.struct(*(c.alias(n) for n, c in made(x["l_partkey"], x["l_suppkey"], x["q"], x["l_linenumber"]).items())))
    coded = lambda code, value: F.struct(F.struct(F.lit(code).alias("code")).alias("type"), F.struct(value.cast("string").alias("value")).alias("data"))
    details = lambda q: F.array(coded("minutes-played", q), coded("goals", q % 3), coded("rating", F.when(q % 5 == 0, F.lit("n/a")).otherwise(q.cast("string"))))
    own = each(lambda part, supplier, q, n: {"l_linenumber": n, "l_suppkey": supplier, "q": q, "player_id": part, "team_id": F.when(q % 2 == 0, supplier), "team": F.struct(supplier.alias("id")), "details": details(q)})
    event = each(lambda part, supplier, q, n: {"player_id": part, "type_id": 14 + q % 9, "related_player_id": part})
    total = each(lambda part, supplier, q, n: {"participant_id": supplier, "type": F.struct(F.lit("corners").alias("code")), "data": F.struct(F.lit(7).alias("value"))})
    score = each(lambda part, supplier, q, n: {"participant_id": supplier, "score": F.struct((q % 4).alias("goals"))})
    data = F.struct(F.col("l_orderkey").alias("id"), own.alias("lineups"), event.alias("events"), total.alias("statistics"), score.alias("scores"))
    return line.select("l_orderkey", F.to_json(F.struct(data.alias("data"))).alias("payload"))


def boxscore_nested_players(spark, d):
    return boxscore.nested_rows(_nested(spark, d), one_each=True)[0]


def boxscore_nested_teams(spark, d):
    """Teams' stats, and their scores as one more."""
    _, teams, scores = boxscore.nested_rows(_nested(spark, d), one_each=True)
    return teams.unionByName(scores.select("fixture", "team", F.lit("score").alias("stat"), F.col("score").cast("double").alias("value")))


def boxscore_verdicts(spark, d):
    return boxscore.verdicts(boxscore.flat_rows(_payload(spark, d)))


def boxscore_typed(spark, d):
    """Payloads of (type, value) pairs as bags, added up by team and type."""
    line = table(spark, d, "lineitem")
    pair = lambda t, v: F.struct(F.lit(t).alias("type"), v.cast("double").alias("value"))
    details = F.array(pair("qty", F.lit(0)), pair("qty", F.col("l_quantity")), pair("number", F.col("l_linenumber")))
    one = F.struct(F.col("l_partkey").alias("player_id"), F.col("l_suppkey").alias("team_id"), details.alias("details"))
    sent = line.groupBy("l_orderkey").agg(F.to_json(F.struct(F.struct(F.col("l_orderkey").alias("id"), F.collect_list(one).alias("lineups")).alias("data"))).alias("payload"))
    bag = boxscore.typed_bags(sent).select("team", F.explode("bag").alias("stat", "value"))
    return bag.groupBy("team", "stat").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def boxscore_version(spark, d):
    """A version string of each fixture's input: its status and its lines in order; equal inputs, equal versions."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: F.concat_ws(":", x.l_linenumber, x.l_partkey, x.l_suppkey)), ",").alias("lines"))
    o = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select("o_orderkey", F.substring(F.sha2(F.concat_ws("|", "o_orderstatus", "lines").cast("binary"), 256), 1, 32).alias("version"))


def packet_fanout(spark, d):
    """Work that a day's packet of a user sets off: tags are kinds of events, stages subscribe to tags."""
    tags = _events(spark, d).select("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("tag")).distinct()
    wants = spark.createDataFrame([("purchase", "transfer"), ("click", "form"), ("view", "form"), ("signup", "profile"), ("purchase", "oracle"), ("click", "oracle")], "tag string, stage string")
    return tags.join(F.broadcast(wants), "tag").select("user_id", "day", "stage").distinct()


def claim_batch(spark, d):
    """The next ten pieces of work of each stage: rank first, then kinds in order, then the oldest."""
    q = keys.latest_per_key(_events(spark, d), ["user_id", "event_type"], "ts", "event_id").withColumn("rank", (F.col("user_id") % 3).cast("int"))
    w = Window.partitionBy("event_type").orderBy("rank", F.col("user_id") % 2, "ts", "event_id")
    return q.withColumn("place", F.row_number().over(w)).where("place <= 10").select("event_type", "place", "user_id", "event_id")


def backoff_ladder(spark, d):
    """When failed work may run again (30 s, 2, 10, 30 and 30 minutes); five failures park it."""
    e = _events(spark, d).where("event_type = 'error'").groupBy("user_id").agg(F.count("*").cast("int").alias("attempts"), F.max("ts").alias("failed_at"))
    wait = F.when(F.col("attempts") <= 1, 30).when(F.col("attempts") == 2, 120).when(F.col("attempts") == 3, 600).otherwise(1800)
    return e.select("user_id", "attempts", (F.col("attempts") >= 5).alias("parked"), F.when(F.col("attempts") < 5, F.unix_seconds(F.col("failed_at").cast("timestamp_ltz")) + wait).alias("runs_at"))


def barrier_ready(spark, d):
    """Users whose five inputs are settled; a failed one counts as settled."""
    e = _events(spark, d).where("ts >= timestamp'2024-01-24'").groupBy("user_id").agg(F.countDistinct("event_type").alias("settled"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return e.select("user_id", "settled", (F.col("settled") == 5).alias("ready"), (F.col("failed") > 0).alias("with_failure"))


def adaptive_cadence(spark, d):
    """Seconds between sweeps by the arrivals of each hour: many slow them down."""
    e = _events(spark, d).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    return e.select("hour", "n", F.when(F.col("n") > 10, 120).when(F.col("n") < 3, 30).otherwise(60).alias("seconds"))


def quiet_period(spark, d):
    """Bursts of a user's events with quiet hours of three or more after them, and when each is due."""
    w = F.session_window("ts", "3 hours")
    g = _events(spark, d).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))
    return g.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("due_at"), "n", "last_id")


def latest_runs(spark, d):
    """Each job's newest run, and how many of its runs failed."""
    e = _events(spark, d)
    last = keys.latest_per_key(e, ["user_id"], "ts", "event_id").select("user_id", F.col("event_id").alias("run"), F.col("event_type").alias("status"))
    return last.join(e.groupBy("user_id").agg(F.count("*").alias("runs"), F.count_if(F.col("event_type") == "error").alias("failed")), "user_id")


def health_counts(spark, d):
    """One row for each table that a page needs: rows, and whether it is healthy."""
    out = None
    for name, least in (("supplier", 1), ("customer", 1), ("orders", 100), ("events", 1_000_000_000)):
        one = table(spark, d, name).agg(F.lit(name).alias("name"), F.count("*").alias("n")).withColumn("status", F.when(F.col("n") >= least, "healthy").otherwise("degraded"))
        out = one if out is None else out.unionByName(one)
    return out


def seal_stories(spark, d):
    """Customers' open stories are sealed by the first finished order after the first mention; casts close with them."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    seen = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_seen"), F.count("*").alias("entries"))
    done = o.where("o_orderstatus = 'F'").alias("t").join(seen.alias("s"), "o_custkey").where("t.o_orderdate > s.first_seen")
    truth = keys.first_per_key(done.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", F.col("o_orderkey").alias("sealed_by"), F.col("o_orderdate").alias("sealed_at"))
    after = F.count_if(F.col("o.o_orderdate") > F.col("t.sealed_at")).alias("closed_edges")
    edges = o.alias("o").join(truth.alias("t"), "o_custkey").groupBy("o_custkey").agg(after)
    return seen.join(truth, "o_custkey", "left").join(edges, "o_custkey", "left").select("o_custkey", F.when(F.col("sealed_by").isNotNull(), "resolved").otherwise("open").alias("status"), "sealed_by", "closed_edges")


def dormant_stories(spark, d):
    """Stories by how long they have been quiet: over a fortnight is dormant; the busier of equal parts leads."""
    g = _events(spark, d).where("ts < timestamp'2024-01-20'").groupBy("user_id", "event_type").agg(F.max("ts").alias("at"), F.count("*").alias("n"))
    days = F.datediff(F.lit("2024-01-20").cast("date"), F.col("at"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    return g.select("user_id", "event_type", F.when(days >= 14, "dormant").otherwise("active").alias("status"), (F.row_number().over(w) == 1).alias("leads"))


def nominate_candidates(spark, d):
    """One candidate for each name: two mentions at least; those seen before come back after thirty days only."""
    p = table(spark, d, "part").select(S.normal_name(F.concat_ws(" ", "p_brand", "p_type")).alias("norm"), "p_partkey")
    m = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    edge = F.lit("2001-07-01").cast("timestamp")
    g = m.groupBy("norm").agg(F.count("*").alias("mentions"), F.countDistinct("l_orderkey").alias("articles"), F.max(F.when(F.col("o_orderdate") < edge, F.col("o_orderdate"))).alias("before"), F.max("o_orderdate").alias("last"))
    action = F.when(F.col("articles") < 2, "wait").when(F.col("before").isNull(), "open").when(F.datediff("last", "before") >= 30, "reopen").otherwise("known")
    return g.select("norm", "mentions", "articles", action.alias("action"))


def person_accumulation(spark, d):
    """Mentions, sources and span of each entity; a mention of an article that is known already doesn't count again."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    m = table(spark, d, "lineitem").select("l_partkey", "l_orderkey").distinct().join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return m.groupBy("l_partkey").agg(F.count("*").alias("mentions"), F.countDistinct("o_orderpriority").alias("sources"), F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("span"), F.min_by("l_orderkey", F.struct("o_orderdate", "l_orderkey")).alias("first_article"))


def possession_adjusted(spark, d):
    """A supplier's returns weighed by what its opponents of the fixture hold: v * 50 / max(share, 30)."""
    line = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("v"))
    total = Window.partitionBy("l_orderkey")
    share = 100 * (F.sum("q").over(total) - F.col("q")) / F.sum("q").over(total)
    g = line.withColumn("opponent", share).groupBy("l_suppkey").agg(F.sum("v").alias("v"), F.avg("opponent").alias("o"))
    return g.select("l_suppkey", F.round(F.col("v") * 50 / F.greatest("o", F.lit(30.0)), 6).alias("adjusted"))


def missing_products(spark, d):
    """Customers with orders, placed in an open one, that have no finished order: what a nightly run would make."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    rated = o.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 3")
    return rated.join(o.where("o_orderstatus = 'O'"), "o_custkey", "left_semi").join(o.where("o_orderstatus = 'P'"), "o_custkey", "left_anti")


def wins_over_opponents(spark, d):
    """Fixtures and the share of them in which a supplier's best line beats every opponent's."""
    best = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_quantity").alias("q"))
    met = rollup.opponents(best, "l_orderkey", "l_suppkey", ["q"]).groupBy("l_orderkey", "l_suppkey").agg(F.bool_and(F.col("q") > F.col("opp_q")).alias("won"))
    return met.groupBy("l_suppkey").agg(F.count("*").alias("played"), F.round(100.0 * F.count_if("won") / F.count("*"), 6).alias("win_pct"))


QUERIES = {f.__name__: f for f in (
    pending_fixtures, fixture_upsert, boxscore_parse, boxscore_nested_players, boxscore_nested_teams, boxscore_verdicts, boxscore_typed, boxscore_version, packet_fanout, claim_batch, backoff_ladder, barrier_ready, adaptive_cadence,
    quiet_period, latest_runs, health_counts, seal_stories, dormant_stories, nominate_candidates, person_accumulation, possession_adjusted, missing_products, wins_over_opponents,
)}

_SIDES = "sd AS (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_suppkey END) AS home, max(CASE WHEN l_linenumber = 2 THEN l_suppkey END) AS away FROM lineitem GROUP BY l_orderkey)"

_NESTED = """WITH l AS (SELECT l_orderkey AS fixture, l_linenumber AS n, l_partkey AS player, l_suppkey AS team, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
last AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY fixture, player ORDER BY n DESC, team DESC, q DESC) = 1),
own AS (
    SELECT fixture, player, team, 'minutes-played' AS stat, q AS value FROM last
    UNION ALL SELECT fixture, player, team, 'goals', q % 3 FROM last
    UNION ALL SELECT fixture, player, team, 'rating', q FROM last WHERE q % 5 <> 0
),
e AS (
    SELECT fixture, player, CASE q % 9 WHEN 0 THEN 'goals' WHEN 2 THEN 'penalty_goals' WHEN 3 THEN 'penalties_missed' WHEN 5 THEN 'yellow_cards' WHEN 6 THEN 'red_cards' WHEN 7 THEN 'red_cards' END AS stat FROM l
    UNION ALL SELECT fixture, player, 'assists' FROM l WHERE q % 9 = 0
),
counted AS (SELECT e.fixture, e.player, team, stat, 1 AS value FROM e JOIN last ON e.fixture = last.fixture AND e.player = last.player WHERE stat IS NOT NULL),
players AS (SELECT fixture, player, team, stat, CAST(sum(value) AS DOUBLE) AS value FROM (SELECT * FROM own UNION ALL SELECT * FROM counted) GROUP BY ALL)"""

ORACLES = {
    "boxscore_nested_players": f"{_NESTED} SELECT * FROM players",
    "boxscore_nested_teams": f"""{_NESTED}
SELECT fixture, team, stat, sum(value) AS value FROM (SELECT fixture, team, stat, value FROM players UNION ALL SELECT DISTINCT fixture, team, 'corners', 7 FROM l) GROUP BY ALL
UNION ALL SELECT fixture, team, 'score', CAST(max(q % 4) AS DOUBLE) FROM l GROUP BY ALL""",
    "pending_fixtures": "SELECT o_orderkey, o_orderdate, CAST(o_orderkey % 5 AS INTEGER) AS attempts FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '2001-08-01' - INTERVAL 2 DAY AND o_orderkey % 5 < 3 ORDER BY o_orderdate, o_orderkey LIMIT 50",
    "fixture_upsert": """WITH s AS (SELECT o_orderkey AS fixture, round(o_totalprice, 2) AS score FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS fixture, o_orderstatus AS status, CASE WHEN o_orderkey % 4 <> 0 THEN round(o_totalprice, 2) + 1 END AS score FROM orders WHERE o_orderkey % 2 = 0)
      SELECT fixture, coalesce(n.status, 'scheduled') AS status, coalesce(n.score, s.score) AS score FROM s FULL JOIN n USING (fixture)""",
    "boxscore_parse": f"WITH {_SIDES} SELECT l_orderkey AS fixture, l_orderkey * 10 + l_linenumber AS line, l_partkey AS player, l_suppkey AS team, round(floor(l_quantity) + l_linenumber * 7 / 60.0::DOUBLE, 6) AS minutes, l_quantity AS points, home, away FROM lineitem JOIN sd USING (l_orderkey)",
    "boxscore_verdicts": f"WITH {_SIDES} SELECT l_orderkey AS fixture, count(*) AS players, CASE WHEN max(home) IS NULL OR max(away) IS NULL THEN 'missing_team' WHEN max(o_orderstatus) = 'P' THEN 'no_score' ELSE 'ok' END AS verdict FROM lineitem JOIN sd USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey",
    "boxscore_typed": "SELECT l_suppkey AS team, 'qty' AS stat, count(*) AS n, round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, 'number', count(*), CAST(sum(l_linenumber) AS DOUBLE) FROM lineitem GROUP BY 1",
    "boxscore_version": "SELECT o_orderkey, left(sha256(o_orderstatus || '|' || string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey)), 32) AS version FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus",
    "packet_fanout": "SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, stage FROM events JOIN (VALUES ('purchase', 'transfer'), ('click', 'form'), ('view', 'form'), ('signup', 'profile'), ('purchase', 'oracle'), ('click', 'oracle')) w(tag, stage) ON tag = event_type",
    "claim_batch": """WITH q AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
      SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY user_id % 3, user_id % 2, ts, event_id) AS INTEGER) AS place, user_id, event_id FROM q QUALIFY place <= 10""",
    "backoff_ladder": """WITH g AS (SELECT user_id, CAST(count(*) AS INTEGER) AS attempts, max(ts) AS at_ FROM events WHERE event_type = 'error' GROUP BY user_id)
      SELECT user_id, attempts, attempts >= 5 AS parked, CASE WHEN attempts < 5 THEN CAST(floor(epoch_us(at_) / 1000000.0::DOUBLE) AS BIGINT) + CASE attempts WHEN 1 THEN 30 WHEN 2 THEN 120 WHEN 3 THEN 600 ELSE 1800 END END AS runs_at FROM g""",
    "barrier_ready": "SELECT user_id, count(DISTINCT event_type) AS settled, count(DISTINCT event_type) = 5 AS ready, bool_or(event_type = 'error') AS with_failure FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY user_id",
    "adaptive_cadence": "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, CASE WHEN count(*) > 10 THEN 120 WHEN count(*) < 3 THEN 30 ELSE 60 END AS seconds FROM events GROUP BY 1",
    "quiet_period": """WITH e AS (SELECT *, coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 10800000000 AS INTEGER), 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
      SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 3 HOUR AS due_at, count(*) AS n, max(event_id) AS last_id FROM s GROUP BY user_id, k""",
    "latest_runs": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS run, arg_max(event_type, (ts, event_id)) AS status, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY user_id",
    "health_counts": """WITH n AS (SELECT 'supplier' AS name, count(*) AS n, 1 AS least_ FROM supplier UNION ALL SELECT 'customer', count(*), 1 FROM customer UNION ALL SELECT 'orders', count(*), 100 FROM orders UNION ALL SELECT 'events', count(*), 1000000000 FROM events)
      SELECT name, n, CASE WHEN n >= least_ THEN 'healthy' ELSE 'degraded' END AS status FROM n""",
    "seal_stories": """WITH s AS (SELECT o_custkey, min(o_orderdate) AS first_seen FROM orders GROUP BY ALL), t AS (SELECT o_custkey, o_orderkey AS sealed_by, o_orderdate AS sealed_at FROM orders JOIN s USING (o_custkey) WHERE o_orderstatus = 'F' AND o_orderdate > first_seen QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1)
      SELECT o_custkey, CASE WHEN max(sealed_by) IS NULL THEN 'open' ELSE 'resolved' END AS status, max(sealed_by) AS sealed_by, CASE WHEN max(sealed_by) IS NOT NULL THEN count(*) FILTER (WHERE o_orderdate > sealed_at) END AS closed_edges FROM orders LEFT JOIN t USING (o_custkey) GROUP BY o_custkey""",
    "dormant_stories": """WITH g AS (SELECT user_id, event_type, max(ts) AS at_, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY ALL)
      SELECT user_id, event_type, CASE WHEN date_diff('day', CAST(at_ AS DATE), DATE '2024-01-20') >= 14 THEN 'dormant' ELSE 'active' END AS status, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1 AS leads FROM g""",
    "nominate_candidates": """WITH p AS (SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS norm FROM part), m AS (SELECT norm, l_orderkey, o_orderdate FROM lineitem JOIN p ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
      g AS (SELECT norm, count(*) AS mentions, count(DISTINCT l_orderkey) AS articles, max(o_orderdate) FILTER (WHERE o_orderdate < TIMESTAMP '2001-07-01') AS before_, max(o_orderdate) AS last_ FROM m GROUP BY norm)
      SELECT norm, mentions, articles, CASE WHEN articles < 2 THEN 'wait' WHEN before_ IS NULL THEN 'open' WHEN date_diff('day', CAST(before_ AS DATE), CAST(last_ AS DATE)) >= 30 THEN 'reopen' ELSE 'known' END AS action FROM g""",
    "person_accumulation": """WITH m AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) SELECT l_partkey, count(*) AS mentions, count(DISTINCT o_orderpriority) AS sources, CAST(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS INTEGER) AS span,
      arg_min(l_orderkey, (o_orderdate, l_orderkey)) AS first_article FROM m JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey""",
    "possession_adjusted": """WITH f AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS q, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS v FROM lineitem GROUP BY ALL), o AS (SELECT *, 100 * (sum(q) OVER w - q) / sum(q) OVER w AS opp FROM f WINDOW w AS (PARTITION BY l_orderkey))
      SELECT l_suppkey, round(sum(v) * 50 / greatest(avg(opp), 30.0::DOUBLE), 6) AS adjusted FROM o GROUP BY l_suppkey""",
    "missing_products": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 3 AND bool_or(o_orderstatus = 'O') AND NOT bool_or(o_orderstatus = 'P')",
    "wins_over_opponents": """WITH b AS (SELECT l_orderkey, l_suppkey, max(l_quantity) AS q FROM lineitem GROUP BY ALL), m AS (SELECT x.l_orderkey, x.l_suppkey, bool_and(x.q > y.q) AS won FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey <> y.l_suppkey GROUP BY ALL)
      SELECT l_suppkey, count(*) AS played, round(100.0::DOUBLE * count(*) FILTER (WHERE won) / count(*), 6) AS win_pct FROM m GROUP BY l_suppkey""",
}
