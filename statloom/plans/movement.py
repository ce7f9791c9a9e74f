"""Momentum, matchups, graph and source queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import graph, keys, momentum
from ..sources.tables import table
from .season import EVENTS, events


def as_of():
    return F.lit("2001-08-01").cast("timestamp")


def momentum_blend(spark, d):
    """Users' value slope over 21 days, and customers' price slope over their last five orders, meant where both are known."""
    e = table(spark, d, "events").where(F.col("ts") >= F.lit("2024-01-09").cast("timestamp"))
    vibe = momentum.last_minus_first(e, ["user_id"], "ts", "event_id", "value", 3, "vibe")
    o = keys.ranked_first(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5)
    form = momentum.last_minus_first(o.withColumn("v", F.col("o_totalprice") / 1000).withColumnRenamed("o_custkey", "user_id"), ["user_id"], "o_orderdate", "o_orderkey", "v", 2, "form")
    return momentum.blend(vibe, form, ["user_id"], "vibe", "form").select("user_id", "score")


def ols_trajectory(spark, d):
    return momentum.trajectory(table(spark, d, "events"), "user_id", "ts", "event_id", "value")


def matchup_shrinkage(spark, d):
    """Suppliers against customers' nations: quantity beside what base and nation average let expect."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    g = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "c_nationkey", "l_quantity", (F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp")).cast("int").alias("recent"))
    base = g.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("base"), F.count("*").alias("games")).where("games >= 10")
    against = g.groupBy("c_nationkey").agg(F.avg("l_quantity").alias("opp"))
    league = g.agg(F.avg("l_quantity").alias("league"))
    j = g.join(base, "l_suppkey").join(F.broadcast(against), "c_nationkey").crossJoin(F.broadcast(league)).withColumn("over", F.col("l_quantity") - F.col("base") * F.col("opp") / F.col("league"))
    a = j.groupBy("l_suppkey", "c_nationkey").agg(F.count("*").alias("n"), F.sum("recent").alias("r"), F.avg("over").alias("m"), F.count_if(F.col("over") > 0).alias("up"), F.count_if(F.col("over") < 0).alias("down"))
    side = F.when(F.col("m") > 0, F.col("up") / F.col("n")).when(F.col("m") < 0, F.col("down") / F.col("n")).otherwise(0.5)
    effect, sure = momentum.shrunk(F.col("m"), F.col("n"), F.col("r"), side)
    return a.select("l_suppkey", "c_nationkey", "n", F.round(effect, 6).alias("effect"), F.round(sure, 6).alias("reliability"))


def _mentions(spark, d):
    o = table(spark, d, "orders")
    return table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("article"), F.col("l_suppkey").alias("entity"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("at"))


def co_mention_links(spark, d):
    return graph.co_mentions(_mentions(spark, d), as_of())


def link_decay_upsert(spark, d):
    """Edges of a month before merged with today's; those gone fall to zero."""
    m = _mentions(spark, d)
    then = F.lit("2001-06-01").cast("timestamp")
    return graph.decay_upsert(graph.co_mentions(m.where(F.col("at") <= then), then), graph.co_mentions(m, as_of()))


def pair_heat(spark, d):
    """Supplier and part named together in the last 14 days: e^(-age/72 h), sources of five, recent share."""
    o = table(spark, d, "orders")
    e = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "l_partkey", "o_orderpriority", F.col("o_orderdate").alias("at"))
    e = e.where(graph.age_days(F.col("at"), as_of()) <= 14)
    g = e.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("total"), F.countDistinct("o_orderpriority").alias("sources"), F.max("at").alias("last_at"), F.count_if(graph.age_days(F.col("at"), as_of()) <= 3).alias("recent"))
    return g.select("l_suppkey", "l_partkey", F.round(graph.recency(graph.age_days(F.col("last_at"), as_of()), 3.0, F.col("sources"), 5, F.col("recent"), F.col("total")), 6).alias("heat"))


def typed_links_weighted(spark, d):
    """User and kind of event (errors aside) of the last 90 days: evidence weights by kind, days for sources, sentiment weighted where there is one."""
    now = F.lit("2024-01-31").cast("timestamp")
    age = graph.age_days(F.col("ts"), now)
    e = table(spark, d, "events").withColumn("w", F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "click", 0.7).otherwise(0.4))
    felt = F.when(F.col("value") != 0, F.col("value"))
    g = e.where("event_type <> 'error'").where(age <= 90).groupBy("user_id", "event_type").agg(
        F.sum("w").alias("ws"), F.countDistinct(F.to_date("ts")).alias("days"), F.count_if(age <= 14).alias("recent"), F.count("*").alias("total"), F.max("ts").alias("last_at"),
        F.try_divide(F.sum(F.col("w") * felt), F.sum(F.when(felt.isNotNull(), F.col("w")))).alias("sentiment"),
    )
    return g.select("user_id", "event_type", graph.typed_strength(F.col("ws"), F.col("days"), F.col("recent"), F.col("total"), graph.age_days(F.col("last_at"), now)).alias("strength"), F.round("sentiment", 6).alias("sentiment"))


def source_performance(spark, d):
    """Clerks' priorities as sources: pairs named, confirmed by a finished order, how long before, reliability."""
    o = table(spark, d, "orders")
    m = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "l_partkey", F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("at"), "o_orderstatus")
    truth = m.where("o_orderstatus = 'F'").groupBy("l_suppkey", "l_partkey").agg(F.min("at").alias("moved"))
    first = m.groupBy("source", "l_suppkey", "l_partkey").agg(F.min("at").alias("said"))
    j = first.join(truth, ["l_suppkey", "l_partkey"], "left")
    lead = F.when(F.col("said") < F.col("moved"), graph.age_days(F.col("said"), F.col("moved")))
    g = j.groupBy("source").agg(F.count("*").alias("pairs"), F.count("moved").alias("confirmed"), F.count(lead).alias("early"), F.round(F.avg(lead), 6).alias("avg_lead"), F.round(F.max(lead), 6).alias("max_lead"))
    return g.withColumn("reliability", F.round(graph.reliability(F.col("confirmed").cast("double")), 6))


def transfer_ground_truth(spark, d):
    """Earliest finished move of a customer to a supplier's nation, out of two ledgers."""
    o = table(spark, d, "orders")
    a = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("player"), (F.col("o_orderkey") % 25).alias("team"), F.col("o_orderdate").alias("at"), F.lit("ledger").alias("origin"), F.col("o_orderkey").alias("id"))
    b = o.where("o_orderstatus = 'O' and o_totalprice > 100000").select(F.col("o_custkey").alias("player"), (F.col("o_orderkey") % 25).alias("team"), F.col("o_orderdate").alias("at"), F.lit("override").alias("origin"), F.col("o_orderkey").alias("id"))
    return keys.first_per_key(a.unionByName(b), ["player", "team"], "at", "id").select("player", "team", "origin", "id")


def current_identity(spark, d):
    """Column-wise: an override (newest urgent order), else the newest order, else the customer's own row."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    urgent = keys.latest_per_key(o.where("o_orderpriority = '1-URGENT'"), ["o_custkey"], "o_orderdate", "o_orderkey").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("k1"))
    newest = keys.latest_per_key(o, ["o_custkey"], "o_orderdate", "o_orderkey").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("k2"), F.col("o_orderstatus").alias("s2"))
    j = c.join(urgent, "c_custkey", "left").join(newest, "c_custkey", "left")
    return j.select("c_custkey", F.coalesce("k1", "k2", "c_custkey").alias("team"), F.coalesce("s2", F.lit("none")).alias("status"), F.when(F.col("k1").isNotNull(), "override").when(F.col("k2").isNotNull(), "roster").otherwise("legacy").alias("origin"))


def team_change_history(spark, d):
    """One row for each change of a customer's order status, with the one before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").withColumn("before", F.lag("o_orderstatus").over(w))
    return o.where("before is not null and before <> o_orderstatus").select("o_custkey", "o_orderkey", F.col("before").alias("from_team"), F.col("o_orderstatus").alias("to_team"))


def modal_vote_gate(spark, d):
    """Parts of a season and the region that most of their lines name: kept with two suppliers, three lines over two days or more, and sixty per cent of the votes."""
    own = ["l_partkey", "season"]
    e = events(spark, d)
    v = e.groupBy(*own, "n_regionkey").agg(F.count("*").alias("votes"))
    every = e.groupBy(*own).agg(F.count("*").alias("mentions"), F.countDistinct("l_suppkey").alias("sources"), F.date_diff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"))
    top = keys.ranked_first(v, own, [F.desc("votes"), F.asc("n_regionkey")])
    return top.join(every, own).where("sources >= 2 and mentions >= 3 and days >= 2 and votes >= 0.6 * mentions").select(*own, F.col("n_regionkey").alias("team"), "votes", "mentions")


def established_parts(spark, d):
    """Users as parts: finished (purchase seen) or five kinds of day, three entries and fourteen days."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.countDistinct(F.to_date("ts")).alias("sources"), F.count("*").alias("entries"), F.datediff(F.max("ts"), F.min("ts")).alias("span"), F.bool_or(F.col("event_type") == "purchase").alias("resolved"))
    return e.select("user_id", (F.col("resolved") | ((F.col("sources") >= 5) & (F.col("entries") >= 3) & (F.col("span") >= 14))).alias("established"))


def identity_ladder(spark, d):
    """Fail-closed decision ladder: the first rule that fails names the outcome."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    why = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") != "F", "not_final").when(F.col("o_totalprice") < 50000, "thin_evidence").when(F.col("c_acctbal") < 0, "blocked").otherwise("applied")
    return o.select("o_orderkey", why.alias("outcome"))


def nearest_fixture_range_join(spark, d):
    """Each urgent order's nearest other order of the customer within two days."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    u = o.where("o_orderpriority = '1-URGENT'").alias("u")
    gap = F.abs(graph.age_days(F.col("u.o_orderdate"), F.col("f.o_orderdate")))
    j = u.join(o.alias("f"), (F.col("u.o_custkey") == F.col("f.o_custkey")) & (F.col("u.o_orderkey") != F.col("f.o_orderkey")) & (gap <= 2)).select(F.col("u.o_orderkey").alias("k"), F.col("f.o_orderkey").alias("fixture"), F.round(gap, 6).alias("gap"))
    return keys.ranked_first(j, ["k"], [F.asc("gap"), F.asc("fixture")])


QUERIES = {f.__name__: f for f in (
    momentum_blend, ols_trajectory, matchup_shrinkage, co_mention_links, link_decay_upsert, pair_heat, typed_links_weighted, source_performance, transfer_ground_truth,
    current_identity, team_change_history, modal_vote_gate, established_parts, identity_ladder, nearest_fixture_range_join,
)}


def _age(at: str, as_of: str) -> str:
    return f"((epoch_us({as_of}) - epoch_us({at})) / 86400000000.0::DOUBLE)"


_TODAY, _THEN = "TIMESTAMP '2001-08-01'", "TIMESTAMP '2001-06-01'"


def _recency(last: str, as_of: str, days: float) -> str:
    return f"least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100 * exp(-{_age(last, as_of)} / {days}::DOUBLE) * (0.6::DOUBLE * least(1.0::DOUBLE, sources / 5.0::DOUBLE) + 0.4::DOUBLE * recent / nullif(total, 0))))"


def _links(name: str, as_of: str) -> str:
    return f"""m_{name} AS (SELECT DISTINCT l_orderkey AS article, l_suppkey AS entity, o_orderpriority AS source, o_orderdate AS at FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate <= {as_of} AND {_age('o_orderdate', as_of)} <= 90),
      g_{name} AS (SELECT x.entity AS a, y.entity AS b, count(*) AS total, count(DISTINCT x.source) AS sources, max(x.at) AS last_at, count(*) FILTER (WHERE {_age('x.at', as_of)} <= 14) AS recent FROM m_{name} x JOIN m_{name} y ON x.article = y.article AND x.entity < y.entity GROUP BY ALL),
      {name} AS (SELECT *, round({_recency('last_at', as_of, 21.0)}, 4) AS strength FROM g_{name})"""


ORACLES = {
    "momentum_blend": """WITH v AS (SELECT user_id, arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)) AS vibe FROM events WHERE ts >= TIMESTAMP '2024-01-09' GROUP BY user_id HAVING count(*) >= 3),
      o AS (SELECT o_custkey AS user_id, o_totalprice / 1000 AS v, o_orderdate, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5),
      f AS (SELECT user_id, arg_max(v, (o_orderdate, o_orderkey)) - arg_min(v, (o_orderdate, o_orderkey)) AS form FROM o GROUP BY user_id HAVING count(*) >= 2)
      SELECT user_id, round((coalesce(vibe, 0) + coalesce(form, 0)) / (CASE WHEN vibe IS NULL THEN 0 ELSE 1 END + CASE WHEN form IS NULL THEN 0 ELSE 1 END), 3) AS score FROM v FULL JOIN f USING (user_id)""",
    "ols_trajectory": """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p, least(greatest(round(0.1::DOUBLE * count(*) OVER (PARTITION BY user_id)), 3), 16) AS n FROM events),
      s AS (SELECT user_id, count(*) AS n, round(coalesce(regr_slope(value, -p::DOUBLE), 0), 6) AS slope FROM r WHERE p <= n GROUP BY user_id) SELECT *, CASE WHEN slope > 0.25 THEN 'rising' WHEN slope < -0.25 THEN 'falling' ELSE 'steady' END AS trend FROM s""",
    "matchup_shrinkage": """WITH g AS (SELECT l_suppkey, c_nationkey, l_quantity, o_orderdate >= TIMESTAMP '2000-01-01' AS recent FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
      b AS (SELECT l_suppkey, avg(l_quantity) AS base FROM g GROUP BY ALL HAVING count(*) >= 10), a AS (SELECT c_nationkey, avg(l_quantity) AS opp FROM g GROUP BY ALL), j AS (SELECT *, l_quantity - base * opp / (SELECT avg(l_quantity) FROM g) AS over_ FROM g JOIN b USING (l_suppkey) JOIN a USING (c_nationkey)),
      s AS (SELECT l_suppkey, c_nationkey, count(*) AS n, count(*) FILTER (WHERE recent) AS r, avg(over_) AS m, count(*) FILTER (WHERE over_ > 0) AS up, count(*) FILTER (WHERE over_ < 0) AS down FROM j GROUP BY ALL)
      SELECT l_suppkey, c_nationkey, n, round(m * n / (n + 5.0::DOUBLE), 6) AS effect, round(100 * (n / (n + 5.0::DOUBLE)) * (0.5::DOUBLE + 0.5::DOUBLE * r / n) * (0.5::DOUBLE + 0.5::DOUBLE * CASE WHEN m > 0 THEN up / n::DOUBLE WHEN m < 0 THEN down / n::DOUBLE ELSE 0.5::DOUBLE END), 6) AS reliability FROM s""",
    "co_mention_links": f"WITH {_links('now_', _TODAY)} SELECT a, b, total AS mentions, sources, last_at, recent, strength FROM now_",
    "link_decay_upsert": f"""WITH {_links('then_', _THEN)}, {_links('now_', _TODAY)}, j AS (SELECT a, b, then_.strength AS s0, now_.strength AS s1 FROM then_ FULL JOIN now_ USING (a, b))
      SELECT a, b, coalesce(s1, 0) AS strength, CASE WHEN coalesce(s1, 0) - coalesce(s0, 0) >= 10 THEN 'heating' WHEN coalesce(s1, 0) - coalesce(s0, 0) <= -10 THEN 'cooling' ELSE 'developing' END AS trajectory, s1 IS NOT NULL AS present FROM j""",
    "pair_heat": f"""WITH g AS (SELECT l_suppkey, l_partkey, count(*) AS total, count(DISTINCT o_orderpriority) AS sources, max(o_orderdate) AS last_at, count(*) FILTER (WHERE {_age('o_orderdate', _TODAY)} <= 3) AS recent FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {_age('o_orderdate', _TODAY)} <= 14 GROUP BY ALL)
      SELECT l_suppkey, l_partkey, round({_recency('last_at', _TODAY, 3.0)}, 6) AS heat FROM g""",
    "typed_links_weighted": f"""WITH e AS (SELECT *, CASE event_type WHEN 'purchase' THEN 1.0::DOUBLE WHEN 'click' THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS w, {_age('ts', "TIMESTAMP '2024-01-31'")} AS age FROM events WHERE event_type <> 'error'),
      g AS (SELECT user_id, event_type, sum(w) AS ws, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) FILTER (WHERE age <= 14) AS recent, count(*) AS total, min(age) AS age, sum(w * value) FILTER (WHERE value <> 0) / nullif(sum(w) FILTER (WHERE value <> 0), 0) AS sentiment FROM e WHERE age <= 90 GROUP BY ALL)
      SELECT user_id, event_type, CAST(greatest(0, least(100, round(100 * exp(-age / 21.0::DOUBLE) * (0.5::DOUBLE * least(1.0::DOUBLE, ws / 4) + 0.3::DOUBLE * least(1.0::DOUBLE, greatest(days, 1) / 3.0::DOUBLE) + 0.2::DOUBLE * recent / greatest(total, 1))))) AS INTEGER) AS strength, round(sentiment, 6) AS sentiment FROM g""",
    "source_performance": f"""WITH m AS (SELECT l_suppkey, l_partkey, o_orderpriority AS source, o_orderdate AS at_, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey), t AS (SELECT l_suppkey, l_partkey, min(at_) AS moved FROM m WHERE o_orderstatus = 'F' GROUP BY ALL), f AS (SELECT source, l_suppkey, l_partkey, min(at_) AS said FROM m GROUP BY ALL),
      j AS (SELECT f.source, moved, CASE WHEN said < moved THEN {_age('said', 'moved')} END AS lead FROM f LEFT JOIN t USING (l_suppkey, l_partkey)) SELECT source, count(*) AS pairs, count(moved) AS confirmed, count(lead) AS early, round(avg(lead), 6) AS avg_lead, round(max(lead), 6) AS max_lead, round(100 * count(moved)::DOUBLE / (count(moved) + 5.0::DOUBLE), 6) AS reliability FROM j GROUP BY source""",
    "transfer_ground_truth": """WITH u AS (SELECT o_custkey AS player, o_orderkey % 25 AS team, o_orderdate AS at_, 'ledger' AS origin, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey % 25, o_orderdate, 'override', o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000)
      SELECT player, team, origin, id FROM u QUALIFY row_number() OVER (PARTITION BY player, team ORDER BY at_, id) = 1""",
    "current_identity": """WITH u AS (SELECT o_custkey, o_orderkey AS k1 FROM orders WHERE o_orderpriority = '1-URGENT' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1), n AS (SELECT o_custkey, o_orderkey AS k2, o_orderstatus AS s2 FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
      SELECT c_custkey, coalesce(k1, k2, c_custkey) AS team, coalesce(s2, 'none') AS status, CASE WHEN k1 IS NOT NULL THEN 'override' WHEN k2 IS NOT NULL THEN 'roster' ELSE 'legacy' END AS origin FROM customer LEFT JOIN u ON u.o_custkey = c_custkey LEFT JOIN n ON n.o_custkey = c_custkey""",
    "team_change_history": "WITH w AS (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) SELECT o_custkey, o_orderkey, before AS from_team, o_orderstatus AS to_team FROM w WHERE before IS NOT NULL AND before <> o_orderstatus",
    "modal_vote_gate": f"""WITH {EVENTS}, v AS (SELECT l_partkey, season, n_regionkey, count(*) AS votes FROM ev GROUP BY ALL), e AS (SELECT l_partkey, season, count(*) AS mentions, count(DISTINCT l_suppkey) AS sources, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS days FROM ev GROUP BY ALL), t AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY l_partkey, season ORDER BY votes DESC, n_regionkey) = 1)
      SELECT l_partkey, season, n_regionkey AS team, votes, mentions FROM t JOIN e USING (l_partkey, season) WHERE sources >= 2 AND mentions >= 3 AND days >= 2 AND votes >= 0.6 * mentions""",
    "established_parts": "SELECT user_id, bool_or(event_type = 'purchase') OR (count(DISTINCT CAST(ts AS DATE)) >= 5 AND count(*) >= 3 AND date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) >= 14) AS established FROM events GROUP BY user_id",
    "identity_ladder": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus <> 'F' THEN 'not_final' WHEN o_totalprice < 50000 THEN 'thin_evidence' WHEN c_acctbal < 0 THEN 'blocked' ELSE 'applied' END AS outcome FROM orders JOIN customer ON o_custkey = c_custkey",
    "nearest_fixture_range_join": f"""WITH j AS (SELECT u.o_orderkey AS k, f.o_orderkey AS fixture, round(abs({_age('u.o_orderdate', 'f.o_orderdate')}), 6) AS gap FROM orders u JOIN orders f ON u.o_custkey = f.o_custkey AND u.o_orderkey <> f.o_orderkey WHERE u.o_orderpriority = '1-URGENT' AND abs({_age('u.o_orderdate', 'f.o_orderdate')}) <= 2)
      SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY k ORDER BY gap, fixture) = 1""",
}
