"""Queries over an inverted index, reported fixtures and transfer candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nominate, postings, transfers
from ..sources.tables import table


def _words(text):
    return F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+")


def array_containment(spark, d):
    """Benchmark items and the documents that hold all of their words, in any order."""
    index = postings.Index(table(spark, d, "documents"), "doc_id", F.filter(_words("text"), lambda w: w != ""))
    return index.containing(table(spark, d, "benchmark"), "item_id", F.filter(_words("text"), lambda w: w != "")).select("item_id", F.col("id").alias("doc_id"))


def token_holders(spark, d):
    """Documents that hold the two rarest words of the first document."""
    index = postings.Index(table(spark, d, "documents"), "doc_id", F.filter(_words("text"), lambda w: w != ""))
    first = index.sets.orderBy("id").limit(1).select(F.explode("tokens").alias("token"))
    counted = first.join(index.postings, "token").groupBy("token").count().orderBy("count", "token").limit(2)
    return index.holders(*(r.token for r in counted.collect())).select(F.col("id").alias("doc_id"))


def fixture_nominations(spark, d):
    """Orders as fixtures of the nations of their first two lines; every third is reported again, up to three days off, some with sides swapped, other scores, one nation or none."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    rows = table(spark, d, "lineitem").where("l_linenumber <= 2").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    side = lambda n, c: F.max(F.when(F.col("l_linenumber") == n, c))
    goals = (F.col("l_quantity") % 5).cast("int")
    sides = rows.groupBy("l_orderkey").agg(side(1, F.col("s_nationkey")).alias("home"), side(2, F.col("s_nationkey")).alias("away"), side(1, goals).alias("home_score"), side(2, goals).alias("away_score"))
    status = F.when(F.col("o_orderstatus") == "F", "seeded").when(F.col("o_orderstatus") == "P", "completed").otherwise("scheduled")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("fixture"), F.col("o_orderdate").cast("timestamp").alias("at"), status.alias("status"))
    fixtures = o.join(sides, F.col("fixture") == F.col("l_orderkey")).where("home <> away")
    k = F.col("fixture")
    swap = k % 2 == 1
    told = o.join(sides, k == F.col("l_orderkey")).where(k % 3 == 0).select(
        k.alias("article"),
        (F.col("at") + F.make_dt_interval(hours=((k % 7 - 3) * 24).cast("int"))).alias("at"),
        F.when(k % 11 != 0, F.when(swap, F.col("away")).otherwise(F.col("home"))).alias("home"),
        F.when(swap, F.col("home")).otherwise(F.col("away")).alias("away"),
        (F.when(swap, F.col("away_score")).otherwise(F.col("home_score")) + (k % 5 == 0).cast("int")).alias("home_goals"),
        F.when(swap, F.col("home_score")).otherwise(F.col("away_score")).alias("away_goals"),
    )
    other = told.where("article % 13 = 0").withColumns({"article": -F.col("article"), "home_goals": F.col("home_goals") + 2})  # a second report that says otherwise
    return nominate.nominated(told.unionByName(other), fixtures)


TITLES = ("Linked with a move", "A comeback is near", "Rückkehr zu alten Freunden", "Scouts were there")


def transfer_candidates(spark, d):
    """Customers as persons, nations of suppliers as teams, orders as articles, finished ones aside; a customer is with the nation of an order's first line."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("team"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("person"), F.col("o_orderdate").alias("at"), "o_totalprice", "o_orderstatus")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    title = F.element_at(F.array(*(F.lit(t) for t in TITLES)), (F.col("o_orderkey") % len(TITLES) + 1).cast("int"))
    fresh = rows.where((F.col("o_orderstatus") != "P") & (F.col("at") > F.lit("2000-08-01").cast("timestamp")))
    found = transfers.candidates(fresh.select("team", "person", F.col("o_orderkey").alias("article"), "at", F.col("o_totalprice").alias("heat"), title.alias("title")), 2)
    history = transfers.memberships(rows.where("l_linenumber = 1").select("person", "team", "at", F.col("o_orderkey").alias("tie")))
    return transfers.standing(found, history).select("team", "person", "articles", "heat", "returning", "relationship", "direction", "kept")


QUERIES = {f.__name__: f for f in (array_containment, token_holders, fixture_nominations, transfer_candidates)}

_SETS = """d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '')) AS words FROM documents),
b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '')) AS wanted FROM benchmark)"""

ORACLES = {
    "array_containment": f"WITH {_SETS} SELECT item_id, doc_id FROM b JOIN d ON list_has_all(words, wanted)",
    "token_holders": f"""WITH {_SETS},
first AS (SELECT unnest(words) AS token FROM d WHERE doc_id = (SELECT min(doc_id) FROM d)),
each AS (SELECT doc_id, unnest(words) AS token FROM d),
rare AS (SELECT token FROM first JOIN each USING (token) GROUP BY token ORDER BY count(*), token LIMIT 2)
SELECT doc_id FROM each JOIN rare USING (token) GROUP BY doc_id HAVING count(*) = (SELECT count(*) FROM rare)""",
    "fixture_nominations": """
WITH sides AS (
    SELECT l_orderkey, max(s_nationkey) FILTER (WHERE l_linenumber = 1) AS home, max(s_nationkey) FILTER (WHERE l_linenumber = 2) AS away,
        CAST(max(l_quantity % 5) FILTER (WHERE l_linenumber = 1) AS INTEGER) AS home_score, CAST(max(l_quantity % 5) FILTER (WHERE l_linenumber = 2) AS INTEGER) AS away_score
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber <= 2 GROUP BY ALL
),
o AS (
    SELECT o_orderkey AS k, o_orderdate AS at_, CASE o_orderstatus WHEN 'F' THEN 'seeded' WHEN 'P' THEN 'completed' ELSE 'scheduled' END AS status, sides.*
    FROM orders JOIN sides ON o_orderkey = l_orderkey
),
told AS (
    SELECT k AS article, at_ + to_hours(CAST((k % 7 - 3) * 24 AS INTEGER)) AS at_, CASE WHEN k % 11 <> 0 THEN CASE WHEN k % 2 = 1 THEN away ELSE home END END AS home,
        CASE WHEN k % 2 = 1 THEN home ELSE away END AS away,
        CASE WHEN k % 2 = 1 THEN away_score ELSE home_score END + CAST(k % 5 = 0 AS INTEGER) AS hg, CASE WHEN k % 2 = 1 THEN home_score ELSE away_score END AS ag
    FROM o WHERE k % 3 = 0
),
r AS (
    SELECT *, CASE WHEN home IS NULL OR away IS NULL THEN 'team_unresolved' WHEN home = away THEN 'same_team' END AS refused
    FROM (SELECT * FROM told UNION ALL SELECT -article, at_, home, away, hg + 2, ag FROM told WHERE article % 13 = 0)
),
near AS (
    SELECT article, k AS fixture, status, home_score, away_score, o.home <> r.home AS swapped,
        CASE WHEN o.home <> r.home THEN ag ELSE hg END AS wh, CASE WHEN o.home <> r.home THEN hg ELSE ag END AS wa
    FROM r JOIN o ON refused IS NULL AND o.home <> o.away AND abs(epoch_us(o.at_) - epoch_us(r.at_)) <= 2 * 86400000000
        AND ((o.home = r.home AND o.away = r.away) OR (o.home = r.away AND o.away = r.home))
    QUALIFY row_number() OVER (PARTITION BY article ORDER BY abs(epoch_us(o.at_) - epoch_us(r.at_)), k) = 1
),
kinds AS (SELECT fixture, count(DISTINCT (wh, wa)) AS kinds FROM near GROUP BY ALL),
judged AS (
    SELECT n.*, CASE WHEN kinds > 1 THEN 'contradictory' WHEN status IN ('completed', 'seeded') AND home_score IS NOT DISTINCT FROM wh AND away_score IS NOT DISTINCT FROM wa THEN 'already_correct' ELSE 'corrected' END AS verdict
    FROM near n JOIN kinds USING (fixture)
),
named AS (SELECT r.article, r.at_, hg, ag, j.* EXCLUDE (article), coalesce(refused, verdict, 'created') AS outcome FROM r LEFT JOIN judged j ON r.article = j.article)
SELECT article, outcome, fixture, swapped,
    CASE outcome WHEN 'created' THEN hg WHEN 'corrected' THEN wh ELSE home_score END AS home_score,
    CASE outcome WHEN 'created' THEN ag WHEN 'corrected' THEN wa ELSE away_score END AS away_score,
    CASE WHEN outcome = 'created' OR (outcome = 'corrected' AND status <> 'seeded') THEN 'completed' ELSE status END AS status,
    CASE WHEN outcome = 'created' THEN year(at_) - CAST(month(at_) < 7 AS INTEGER) END AS season
FROM named
""",
    "transfer_candidates": """
WITH rows_ AS (
    SELECT s_nationkey AS team, o_custkey AS person, o_orderkey, o_orderdate AS at_, o_totalprice, o_orderstatus, l_linenumber
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
),
pairs AS (
    SELECT team, person, count(DISTINCT o_orderkey) AS articles, max(at_) AS newest, max(o_totalprice) AS heat, bool_or(o_orderkey % 4 IN (1, 2)) AS "returning"
    FROM rows_ WHERE o_orderstatus <> 'P' AND at_ > TIMESTAMP '2000-08-01' GROUP BY ALL
),
found AS (SELECT * FROM pairs WHERE articles >= 2 QUALIFY row_number() OVER (PARTITION BY team ORDER BY heat DESC NULLS LAST, articles DESC, person) <= 40),
moves AS (SELECT person, team, at_, o_orderkey FROM rows_ WHERE l_linenumber = 1 WINDOW w AS (PARTITION BY person ORDER BY at_, o_orderkey, team) QUALIFY lag(team) OVER w IS DISTINCT FROM team),
spans AS (SELECT person, team, at_ AS since, lead(at_) OVER (PARTITION BY person ORDER BY at_, o_orderkey, team) AS until_ FROM moves),
known AS (SELECT f.team, f.person, bool_or(until_ IS NULL OR newest < until_) AS now_ FROM found f JOIN spans s ON f.team = s.team AND f.person = s.person AND since <= newest GROUP BY ALL),
stand AS (SELECT f.*, CASE WHEN now_ THEN 'current' WHEN now_ IS NOT NULL THEN 'former' ELSE 'none' END AS relationship FROM found f LEFT JOIN known USING (team, person))
SELECT team, person, articles, heat, "returning", relationship, CASE relationship WHEN 'current' THEN 'outgoing' ELSE 'incoming' END AS direction, relationship <> 'former' OR "returning" AS kept FROM stand
""",
}
