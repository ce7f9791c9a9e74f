"""Story pages in full, and guards of what they serve. Customers are stories, orders their articles, suppliers the cast."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import guards
from ..operators import keys
from ..sources.tables import table

OPEN_DAYS, MOST, CAST = 14, 50, 6
NOW = "2001-08-01"
PHRASES = ("licensed under", "token =", "!!", "the numbers say")  # stand-ins that the documents do hold, and one of the real ones


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _stories(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderdate") <= _now())
    return o.groupBy(F.col("o_custkey").alias("story")).agg(F.count("*").alias("reports"), F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"))


def _packets(spark, d):
    """The newest packet of a story: its last finished order."""
    done = table(spark, d, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") <= _now()))
    return keys.ranked_first(done, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select(F.col("o_custkey").alias("story"), F.col("o_orderdate").alias("compiled"), F.concat(F.lit("order "), "o_orderkey").alias("headline"))


def _cast(spark, d, stories):
    """Each story's members with their strongest role and first appearance."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("story"), "o_orderdate").where(F.col("o_orderdate") <= _now()).join(stories.select("story"), "story", "left_semi")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("story", F.col("l_suppkey").alias("member")).agg(F.min(F.least(F.col("l_linenumber"), F.lit(3))).alias("role"), F.min("o_orderdate").alias("joined"))


def story_list_ranked(spark, d):
    """Open stories by heat (reports over one plus the days since the last packet), with the six of the cast that count most."""
    s = _stories(spark, d).where(F.col("last_seen") > _now() - F.make_dt_interval(days=F.lit(OPEN_DAYS)))
    age = (F.unix_micros(_now().cast("timestamp")) - F.unix_micros(F.coalesce("compiled", "last_seen").cast("timestamp"))) / 86_400_000_000
    hot = s.join(_packets(spark, d), "story", "left").withColumn("heat", F.round(F.col("reports") / (1 + age), 6))
    top = hot.orderBy(F.desc("heat"), F.desc("last_seen"), F.desc("story")).limit(MOST)  # before the cast is read
    six = keys.ranked_first(_cast(spark, d, top), ["story"], [F.asc("role"), F.asc("joined"), F.asc("member")], CAST)
    named = six.groupBy("story").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("role", "joined", "member"))), lambda m: F.concat(m.member, F.lit(":"), m.role)), ",").alias("cast_list"))
    return top.join(named, "story", "left").select("story", "reports", "headline", "heat", "cast_list")


def story_archive(spark, d):
    """The stories that are over, the newest first: headline, reports, size of the cast, lifespan."""
    old = _stories(spark, d).where(F.col("last_seen") <= _now() - F.make_dt_interval(days=F.lit(OPEN_DAYS)))
    picked = old.orderBy(F.desc("last_seen"), F.desc("story")).limit(MOST)
    sizes = _cast(spark, d, picked).groupBy("story").agg(F.count("*").alias("cast_count"))
    return picked.join(_packets(spark, d), "story", "left").join(sizes, "story", "left").select("story", "headline", "reports", F.coalesce("cast_count", F.lit(0)).alias("cast_count"), "first_seen", "last_seen")


def prose_guards(spark, d):
    """Every turn of a conversation as a hook, and every document as prose."""
    t = F.col("text")
    hooks = table(spark, d, "conversations").select(F.lit("hook").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("part"), guards.hook_violation(t).alias("broken"), guards.has_digit(t).alias("digits"), guards.named_peers(t, ("user", "analyst")).alias("peers"))
    prose = table(spark, d, "documents").select(F.lit("prose").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("part"), guards.first_phrase(t, PHRASES).alias("broken"), guards.has_digit(t).alias("digits"), guards.named_peers(t).alias("peers"))
    return hooks.unionByName(prose)


QUERIES = {f.__name__: f for f in (story_list_ranked, story_archive, prose_guards)}

_STORIES = f"""s AS (SELECT o_custkey AS story, count(*) AS reports, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen FROM orders WHERE o_orderdate <= TIMESTAMP '{NOW}' GROUP BY ALL),
p AS (
    SELECT o_custkey AS story, o_orderdate AS compiled, 'order ' || o_orderkey AS headline FROM orders WHERE o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '{NOW}'
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
),
c AS (
    SELECT o_custkey AS story, l_suppkey AS member, min(least(l_linenumber, 3)) AS role, min(o_orderdate) AS joined
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate <= TIMESTAMP '{NOW}' GROUP BY ALL
)"""

ORACLES = {
    "story_list_ranked": f"""WITH {_STORIES},
hot AS (
    SELECT s.*, headline, round(reports / (1 + (epoch_us(TIMESTAMP '{NOW}') - epoch_us(coalesce(compiled, last_seen))) / 86400000000.0::DOUBLE), 6) AS heat
    FROM s LEFT JOIN p USING (story) WHERE last_seen > TIMESTAMP '{NOW}' - INTERVAL 14 DAYS
),
top AS (SELECT * FROM hot ORDER BY heat DESC, last_seen DESC, story DESC LIMIT 50),
six AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY story ORDER BY role, joined, member) <= 6),
named AS (SELECT story, string_agg(member || ':' || role, ',' ORDER BY role, joined, member) AS cast_list FROM six GROUP BY story)
SELECT story, reports, headline, heat, cast_list FROM top LEFT JOIN named USING (story)""",
    "story_archive": f"""WITH {_STORIES},
picked AS (SELECT * FROM s WHERE last_seen <= TIMESTAMP '{NOW}' - INTERVAL 14 DAYS ORDER BY last_seen DESC, story DESC LIMIT 50),
sizes AS (SELECT story, count(*) AS cast_count FROM c GROUP BY story)
SELECT story, headline, reports, coalesce(cast_count, 0) AS cast_count, first_seen, last_seen FROM picked LEFT JOIN p USING (story) LEFT JOIN sizes USING (story)""",
    "prose_guards": r"""
SELECT 'hook' AS kind, conv_id AS id, CAST(turn AS BIGINT) AS part,
    CASE WHEN len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) > 12 THEN 'hook_max_words' WHEN contains(text, ':') THEN 'hook_colon' WHEN contains(text, '?') THEN 'hook_question_mark' END AS broken,
    coalesce(regexp_matches(text, '[0-9]'), false) AS digits, CAST(contains(lower(coalesce(text, '')), 'the user') AS INTEGER) + CAST(contains(lower(coalesce(text, '')), 'the analyst') AS INTEGER) AS peers
FROM conversations
UNION ALL
SELECT 'prose', doc_id, 0,
    CASE WHEN contains(lower(text), 'licensed under') THEN 'licensed under' WHEN contains(lower(text), 'token =') THEN 'token =' WHEN contains(text, '!!') THEN '!!' WHEN contains(lower(text), 'the numbers say') THEN 'the numbers say' END,
    coalesce(regexp_matches(text, '[0-9]'), false), """ + " + ".join(f"CAST(contains(lower(coalesce(text, '')), 'the {p}') AS INTEGER)" for p in guards.PEERS) + """
FROM documents""",
}
