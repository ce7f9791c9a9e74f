"""Forms of joins and predicates, boards with parameters, gates and ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import relevance
from ..operators import keys
from ..sources.tables import table
from .boards import as_of, hours_old
from .season import SEASONS, seasons


def either_key_join(spark, d):
    """An OR of two equalities as the union of two equi-joins: of each order, the largest small part number that is a line's part or its supplier."""
    known = table(spark, d, "part").where("p_size <= 5").select("p_partkey")
    line = table(spark, d, "lineitem")
    by = lambda key: line.join(known, F.col(key) == F.col("p_partkey")).select("l_orderkey", "p_partkey")
    return by("l_partkey").unionByName(by("l_suppkey")).groupBy("l_orderkey").agg(F.max("p_partkey").alias("part"))


def case_insensitive_join(spark, d):
    """Sources named in another case than they are stored: the six with most texts."""
    docs = table(spark, d, "documents")
    stored = docs.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    named = docs.select(F.upper("source").alias("named")).distinct()
    j = named.join(stored, F.lower("named") == F.lower("source")).withColumn("all", F.lit(1))
    return keys.ranked_first(j, ["all"], [F.desc("n"), F.desc("chars"), F.asc("source")], 6).select("named", "n", "chars")


def member_join(spark, d):
    """Rows that hold a list of ids joined with what the ids name: one row an id, an equi-join, then a list again."""
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("ids"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    j = lists.select("l_orderkey", F.explode("ids").alias("id")).join(s, F.col("id") == F.col("s_suppkey"))
    return j.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_set("s_nationkey")), lambda x: x.cast("string")), ",").alias("nations"))


def shared_stories(spark, d):
    """Three tables in one join: orders in which a nation below 12 and one from 12 on both have a line, with the newest of them."""
    nation = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, d, "lineitem").join(nation, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey").distinct()
    a = part.where("s_nationkey < 12").select("l_orderkey", F.col("s_nationkey").alias("player"))
    b = part.where("s_nationkey >= 12").select("l_orderkey", F.col("s_nationkey").alias("team"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    j = o.join(a, "l_orderkey").join(b, "l_orderkey")
    return j.groupBy("player", "team").agg(F.count("*").alias("shared"), F.max_by("l_orderkey", F.struct("o_orderdate", "l_orderkey")).alias("newest"))


def modal_nation(spark, d):
    """The most frequent nation of a part's lines (the smallest of several), without those of region 0; null if none is left."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("n_regionkey") != 0, F.col("n_nationkey")).alias("vote"))
    j = table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("l_partkey").agg(F.count("*").alias("mentions"), F.count("vote").alias("votes"), F.mode("vote", True).alias("modal"))


def json_members(spark, d):
    """Of raw JSON: numbers only (not "5" in quotes), no keys with a leading underscore, and how often a key is there with a null."""
    e = table(spark, d, "events")
    raw = F.concat(F.lit('{"k": '), (F.col("event_id") % 7).cast("string"), F.lit(', "_seen": 1, "note": "5", "gone": null, "rate": 0.5}'))
    v = e.select("event_type", F.parse_json(raw).alias("v")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    kind = F.schema_of_variant("value")
    kept = v.where(~F.col("key").like("\\_%")).where(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|VOID)"))
    return kept.groupBy("event_type", "key").agg(F.count_if(kind == "VOID").alias("nulls"), F.count_if(kind != "VOID").alias("numbers"), F.sum(F.try_variant_get("value", "$", "double")).alias("total"))


def after_cursor(spark, d):
    """A row-value comparison: rows after (nation, supplier) = (12, 50) in that order, a page of 20."""
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey")
    return s.where((F.col("s_nationkey") > 12) | ((F.col("s_nationkey") == 12) & (F.col("s_suppkey") > 50))).orderBy("s_nationkey", "s_suppkey").limit(20)


def board(spark, d, season_=None, nation=None, region=None, least_games: int = 0, limit: int | None = 50, roster: bool = False):
    """Suppliers of a season with least_games by revenue. What is None isn't asked for; the season is the newest by default.

    roster: everybody, those without a season last and without a rank. limit None: all.
    """
    s = seasons(spark, d)
    wanted = s.agg(F.max("season").alias("season")) if season_ is None else spark.createDataFrame([(season_,)], "season int")
    rated = s.where(F.col("games") >= least_games).join(F.broadcast(wanted), "season").select(F.col("l_suppkey").alias("id"), "season", "revenue")
    place = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    for name, value in (("nation", nation), ("region", region)):
        place = place if value is None else place.where(F.col(name) == value)
    j = place.join(rated, "id", "left" if roster else "inner").withColumn("unrated", F.col("revenue").isNull())
    if limit is not None:  # the best few first, so that one task ranks only them
        j = j.orderBy(F.col("revenue").desc_nulls_last(), "id").limit(limit)
    w = Window.partitionBy("unrated").orderBy(F.desc("revenue"), "id")
    return j.select("id", "nation", F.round("revenue", 2).alias("revenue"), F.when(~F.col("unrated"), F.row_number().over(w)).cast("int").alias("rank"))


def board_default(spark, d):
    return board(spark, d)


def board_filtered(spark, d):
    return board(spark, d, season_=1999, region=2, limit=10)


def board_roster(spark, d):
    """A region's whole roster; not all have games enough to be rated."""
    return board(spark, d, season_=2001, region=2, least_games=50, limit=None, roster=True)


def sigil_board(spark, d):
    """Users' newest readings of this season (day 15 on) or of none: markers (errors) hide what was before; nothing older than 72 hours; the best 50 by score, then the newest."""
    of = F.when(F.col("event_id") % 5 == 0, None).otherwise(F.when(F.dayofmonth("ts") >= 15, 2).otherwise(1))
    e = table(spark, d, "events").withColumn("season", of).where("season is null or season = 2")
    live = keys.latest_per_key(e, ["user_id"], "ts", "event_id").where("event_type <> 'error'").where(hours_old("ts") < 72)
    best = live.orderBy(F.desc("value"), F.desc("ts"), "user_id").limit(50)
    return best.select("user_id", F.round("value", 4).alias("score"), F.row_number().over(Window.orderBy(F.desc("value"), F.desc("ts"), "user_id")).cast("int").alias("rank"))


def _trend(name="event_id"):
    return F.element_at(F.array(F.lit("heating_up"), F.lit("cooling_off"), F.lit("developing_story")), (F.col(name) % 3 + 1).cast("int"))


def narratives_board(spark, d):
    """This week's newest day of each user's stories, the strongest of it; those that cool off leave after three days. Empty rows (errors) aren't stories and hide none."""
    e = table(spark, d, "events").where("event_type <> 'error'").where((hours_old("ts") <= 168) & (hours_old("ts") > 0)).withColumn("day", F.to_date("ts"))
    newest = e.groupBy("user_id").agg(F.max("day").alias("day"))
    live = e.join(newest, ["user_id", "day"]).withColumn("trend", _trend()).where((F.col("trend") != "cooling_off") | (hours_old("ts") < 72))
    return keys.ranked_first(live, ["user_id"], [F.desc("value"), F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "trend", F.round("value", 4).alias("impact"))


def heat_per_team(spark, d):
    """A supplier's six hottest counterparts (parts): the newest verdict of each pair, whatever it says; then only rumours above zero that don't contradict where the part is now."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    tr = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    cooling = F.col("l_linenumber") % 3 == 1
    fresh = tr.where(F.col("o_orderdate") > F.lit("2001-01-01").cast("timestamp")).where(~cooling | (F.col("o_orderdate") > F.lit("2001-06-01").cast("timestamp")))
    newest = keys.ranked_first(fresh, ["l_suppkey", "l_partkey"], [F.desc("o_orderdate"), F.desc("l_orderkey"), F.desc("l_linenumber")])
    here = F.col("l_partkey") % 4 == F.col("l_suppkey") % 4  # the part is with this supplier now
    incoming = F.col("l_returnflag") == "N"
    kept = newest.withColumn("heat", F.col("l_quantity") - 10).where("heat > 0 and l_linestatus = 'O'").where(~((here & incoming) | (~here & (F.col("l_returnflag") == "R"))))
    return keys.ranked_first(kept, ["l_suppkey"], [F.desc("heat"), F.asc("l_partkey")], 6).select("l_suppkey", "l_partkey", "heat")


def candidate_gate(spark, d):
    """A part's candidates (its lines): with the name, of the field, and with a team of ours. One in the end is taken; several, or none with a team, are unclear."""
    named, relevant, team = F.col("l_quantity") > 25, F.col("l_returnflag") != "R", F.col("l_suppkey") % 3 == 0
    g = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.count_if(named).alias("n"), F.count_if(named & relevant).alias("r"), F.count_if(named & relevant & team).alias("t"),
        F.min(F.when(named & relevant & team, F.struct("l_orderkey", "l_linenumber"))).alias("one"),
    )
    verdict = F.when(F.col("n") == 0, "rejected_insufficient_evidence").when(F.col("r") == 0, "rejected_not_sport").when(F.col("t") == 1, "accept").otherwise("ambiguous")
    survivors = F.when(verdict == "accept", 1).when(verdict == "ambiguous", F.when(F.col("t") == 0, F.col("r")).otherwise(F.col("t"))).otherwise(0)
    return g.select("l_partkey", verdict.alias("verdict"), survivors.cast("long").alias("survivors"), F.when(verdict == "accept", F.col("one.l_orderkey")).alias("taken"))


def boxscore_enqueue(spark, d):
    """Finished fixtures with an input version become work where that version is new: pending, no attempts; pending work keeps its place in the queue."""
    line = table(spark, d, "lineitem").where("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("version"))
    new = table(spark, d, "orders").where("o_orderstatus in ('F', 'P')").join(line, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), "version")
    state = F.element_at(F.array(F.lit("pending"), F.lit("done"), F.lit("running")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    old = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), state.alias("was"), (F.col("o_orderkey") % 60).alias("had"), F.col("o_orderdate").alias("due"))
    j = new.join(old, "id", "left").where(~F.col("version").eqNullSafe(F.col("had")))
    return j.select("id", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), "version", F.when(F.col("was") == "pending", F.col("due")).otherwise(as_of()).cast("timestamp_ntz").alias("available_at"))


def reverted_applications(spark, d):
    """A ledger of applied moves (orders of a customer) and later reverts (purchases of the user of that number): a revert takes back the newest move that stands before it, once; without one it finds nothing active."""
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("id"), F.lit("apply").alias("what"), (F.col("o_orderkey") % 1000).alias("at"))
    e = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("id"), F.lit("revert").alias("what"), (F.col("event_id") % 1000).alias("at"))
    w = Window.partitionBy("user_id").orderBy("at", "what", "id")
    both = o.unionByName(e).withColumns({"before": F.lag("what").over(w), "other": F.lag("id").over(w)})
    status = F.when(F.col("before") == "apply", "reverted").otherwise("not_active")
    return both.where("what = 'revert'").select("user_id", F.col("id").alias("revert"), status.alias("status"), F.when(F.col("before") == "apply", F.col("other")).alias("application"))


def page_relevance(spark, d):
    """Documents as pages with one role and one name each, made of their ids; ours are Paris and Lyon."""
    pick = lambda given, of: F.element_at(F.array(*(F.lit(x) for x in given)), (of % len(given) + 1).cast("int"))
    i = F.col("doc_id")
    roles = F.array(F.struct(pick(("paris", "Lyon ", "Oslo"), i).alias("entity"), pick(("subject", "passing_mention", "Absent", "opponent"), i).alias("role")))
    names = F.array(F.struct(pick(("Paris", "Lyon", "Oslo"), F.floor(i / 3)).alias("name"), pick(("the capital city", "club of the city", "a singer"), F.floor(i / 9)).alias("descriptor")))
    ours = F.array(F.lit("Paris (FC)"), F.lit("lyon"))
    kind = F.when(i % 7 == 0, "Roundup").otherwise("article")
    return table(spark, d, "documents").select("doc_id", relevance.relevant(kind, roles, ours, names).alias("relevant"))


QUERIES = {f.__name__: f for f in (
    either_key_join, case_insensitive_join, member_join, shared_stories, modal_nation, json_members, after_cursor, board_default, board_filtered, board_roster, sigil_board, narratives_board, heat_per_team,
    candidate_gate, boxscore_enqueue, reverted_applications, page_relevance,
)}

_AGE = "((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 3600000000.0::DOUBLE)"

ORACLES = {
    "either_key_join": "SELECT l_orderkey, max(p_partkey) AS part FROM (SELECT l_orderkey, p_partkey FROM lineitem JOIN part ON p_size <= 5 AND l_partkey = p_partkey UNION ALL SELECT l_orderkey, p_partkey FROM lineitem JOIN part ON p_size <= 5 AND l_suppkey = p_partkey) GROUP BY l_orderkey",
    "case_insensitive_join": "WITH s AS (SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source) SELECT named, n, chars FROM (SELECT DISTINCT upper(source) AS named FROM documents) JOIN s ON lower(named) = lower(source) ORDER BY n DESC, chars DESC, source LIMIT 6",
    "member_join": "WITH l AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS ids FROM lineitem GROUP BY l_orderkey), j AS (SELECT DISTINCT l_orderkey, s_nationkey FROM (SELECT l_orderkey, unnest(ids) AS id FROM l) JOIN supplier ON s_suppkey = id) SELECT l_orderkey, string_agg(CAST(s_nationkey AS VARCHAR), ',' ORDER BY s_nationkey) AS nations FROM j GROUP BY l_orderkey",
    "shared_stories": "WITH p AS (SELECT DISTINCT l_orderkey, s_nationkey AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) SELECT a.k AS player, b.k AS team, count(*) AS shared, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders JOIN p a ON a.l_orderkey = o_orderkey AND a.k < 12 JOIN p b ON b.l_orderkey = o_orderkey AND b.k >= 12 GROUP BY ALL",
    "modal_nation": """WITH j AS (SELECT l_partkey, CASE WHEN n_regionkey <> 0 THEN n_nationkey END AS vote FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey), g AS (SELECT l_partkey, count(*) AS mentions, count(vote) AS votes FROM j GROUP BY ALL),
      c AS (SELECT l_partkey, vote, count(*) AS c FROM j WHERE vote IS NOT NULL GROUP BY ALL), m AS (SELECT l_partkey, vote FROM c QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY c DESC, vote) = 1) SELECT g.*, vote AS modal FROM g LEFT JOIN m USING (l_partkey)""",
    "json_members": "SELECT event_type, key, count(*) FILTER (WHERE v IS NULL) AS nulls, count(*) FILTER (WHERE v IS NOT NULL) AS numbers, CAST(sum(v) AS DOUBLE) AS total FROM (SELECT event_type, unnest(['k', 'gone', 'rate']) AS key, unnest([(event_id % 7)::DOUBLE, NULL, 0.5]) AS v FROM events) GROUP BY ALL",
    "after_cursor": "SELECT s_nationkey, s_suppkey FROM supplier WHERE (s_nationkey, s_suppkey) > (12, 50) ORDER BY s_nationkey, s_suppkey LIMIT 20",
    "board_default": f"WITH {SEASONS} SELECT l_suppkey AS id, n_nationkey AS nation, round(revenue, 2) AS revenue, CAST(row_number() OVER (ORDER BY revenue DESC, l_suppkey) AS INTEGER) AS rank FROM st WHERE season = (SELECT max(season) FROM st) QUALIFY rank <= 50",
    "board_filtered": f"WITH {SEASONS} SELECT l_suppkey AS id, n_nationkey AS nation, round(revenue, 2) AS revenue, CAST(row_number() OVER (ORDER BY revenue DESC, l_suppkey) AS INTEGER) AS rank FROM st WHERE season = 1999 AND n_regionkey = 2 QUALIFY rank <= 10",
    "board_roster": f"WITH {SEASONS} SELECT s_suppkey AS id, s_nationkey AS nation, round(revenue, 2) AS revenue, CASE WHEN revenue IS NOT NULL THEN CAST(row_number() OVER (ORDER BY revenue DESC NULLS LAST, s_suppkey) AS INTEGER) END AS rank FROM supplier JOIN nation ON s_nationkey = nation.n_nationkey LEFT JOIN st ON l_suppkey = s_suppkey AND season = 2001 AND games >= 50 WHERE nation.n_regionkey = 2",
    "sigil_board": f"WITH e AS (SELECT * FROM events WHERE event_id % 5 = 0 OR day(ts) >= 15 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, round(value, 4) AS score, CAST(row_number() OVER (ORDER BY value DESC, ts DESC, user_id) AS INTEGER) AS rank FROM e WHERE event_type <> 'error' AND {_AGE} < 72 QUALIFY rank <= 50",
    "narratives_board": f"""WITH e AS (SELECT *, {_AGE} AS age, CAST(ts AS DATE) AS day, ['heating_up', 'cooling_off', 'developing_story'][CAST(event_id % 3 AS INTEGER) + 1] AS trend FROM events WHERE event_type <> 'error'), w AS (SELECT *, max(day) OVER (PARTITION BY user_id) AS newest FROM e WHERE age <= 168 AND age > 0)
      SELECT user_id, event_id, trend, round(value, 4) AS impact FROM w WHERE day = newest AND (trend <> 'cooling_off' OR age < 72) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts DESC, event_id DESC) = 1""",
    "heat_per_team": """WITH n AS (SELECT l.*, o_orderdate FROM lineitem l JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate > TIMESTAMP '2001-01-01' AND (l_linenumber % 3 <> 1 OR o_orderdate > TIMESTAMP '2001-06-01') QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC) = 1)
      SELECT l_suppkey, l_partkey, l_quantity - 10 AS heat FROM n WHERE l_quantity > 10 AND l_linestatus = 'O' AND NOT ((l_partkey % 4 = l_suppkey % 4 AND l_returnflag = 'N') OR (l_partkey % 4 <> l_suppkey % 4 AND l_returnflag = 'R')) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY heat DESC, l_partkey) <= 6""",
    "candidate_gate": """WITH i AS (SELECT *, l_quantity > 25 AS a, l_quantity > 25 AND l_returnflag <> 'R' AS b, l_quantity > 25 AND l_returnflag <> 'R' AND l_suppkey % 3 = 0 AS c FROM lineitem), g AS (SELECT l_partkey, count(*) FILTER (WHERE a) AS n, count(*) FILTER (WHERE b) AS r, count(*) FILTER (WHERE c) AS t, min(l_orderkey) FILTER (WHERE c) AS one FROM i GROUP BY l_partkey)
      SELECT l_partkey, CASE WHEN n = 0 THEN 'rejected_insufficient_evidence' WHEN r = 0 THEN 'rejected_not_sport' WHEN t = 1 THEN 'accept' ELSE 'ambiguous' END AS verdict, CASE WHEN n = 0 OR r = 0 THEN 0 WHEN t = 0 THEN r ELSE t END AS survivors, CASE WHEN t = 1 THEN one END AS taken FROM g""",
    "boxscore_enqueue": """WITH v AS (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS version FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey), n AS (SELECT o_orderkey AS id, version, o_orderdate FROM orders JOIN v ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F', 'P'))
      SELECT id, 'pending' AS status, 0 AS attempts, version, CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN o_orderdate ELSE TIMESTAMP '2024-01-31' END AS available_at FROM n WHERE id % 2 <> 0 OR version <> id % 60""",
    "reverted_applications": """WITH b AS (SELECT o_custkey AS user_id, o_orderkey AS id, 'apply' AS what, o_orderkey % 1000 AS at_ FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT user_id, event_id, 'revert', event_id % 1000 FROM events WHERE event_type = 'purchase'), l AS (SELECT *, lag(what) OVER w AS before_, lag(id) OVER w AS other FROM b WINDOW w AS (PARTITION BY user_id ORDER BY at_, what, id))
      SELECT user_id, id AS "revert", CASE WHEN before_ = 'apply' THEN 'reverted' ELSE 'not_active' END AS status, CASE WHEN before_ = 'apply' THEN other END AS application FROM l WHERE what = 'revert'""",
    "page_relevance": """WITH p AS (SELECT doc_id, doc_id % 7 = 0 AS idle, ['paris', 'lyon', 'oslo'][doc_id % 3 + 1] AS entity, ['subject', 'passing_mention', 'absent', 'opponent'][doc_id % 4 + 1] AS role, ['paris', 'lyon', 'oslo'][(doc_id // 3) % 3 + 1] AS name, (doc_id // 9) % 3 = 0 AS place FROM documents)
      SELECT doc_id, CASE WHEN idle THEN false WHEN entity <> 'oslo' THEN role <> 'absent' AND NOT (name = entity AND place) AND (role <> 'passing_mention' OR name = entity) ELSE name <> 'oslo' AND NOT place END AS relevant FROM p""",
}
