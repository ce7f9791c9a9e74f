"""Backfills and versioned tables: what is rehearsed, rejected, applied and served."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import story
from ..session import new_path, written
from ..sources.tables import table
from ..sources.versions import Versions

EDGES = f"{story.EDGES}, method string"


def _articles(spark, d):
    """Events as articles of their kind: a person, two teams."""
    e = table(spark, d, "events").where("event_type <> 'error'")
    kind = F.col("event_type")
    teams = F.array((F.col("user_id") % 97).cast("string"), F.concat(F.lit("e"), (F.col("event_id") % 1009).cast("string")))
    return e.select(kind.alias("part"), F.col("event_id").alias("article"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), F.array(F.col("user_id").cast("string")).alias("persons"), teams.alias("teams"))


def story_assembly(spark, d):
    """Events as articles, folded by components."""
    return story.assemble(_articles(spark, d))


def _backfill(articles, versions, reason, method="backfill"):
    """Rehearses a replay into a new version, checks it there, and has readers see it only if nothing is wrong."""
    version = versions.request(reason)
    edges = written(story.replay(articles, method=method), "rehearsal")
    faults = story.replay_faults(articles, edges).first().asDict()
    wrong = ", ".join(f"{name} {n}" for name, n in sorted(faults.items()) if n)
    if wrong:
        versions.fail(version, wrong)
    else:
        versions.complete(version, edges, reason)


def _replayed(spark, d):
    """Two thirds of the articles came live; the others, those without names among them, are replayed: first by a run that stamps them wrongly, then by a right one."""
    all_of = written(_articles(spark, d).withColumn("persons", F.when(F.col("article") % 30 != 0, F.col("persons"))).withColumn("teams", F.when(F.col("article") % 30 != 0, F.col("teams"))), "articles")
    live = written(story.assemble(all_of.where("article % 3 <> 0")).select("article", "story"), "live")
    articles = all_of.join(live, "article", "left")
    versions = Versions(spark, new_path(spark, "stories"))
    _backfill(articles, versions, "stamped as live", "live")
    _backfill(articles, versions, "backfill")
    return versions


def story_replay(spark, d):
    """The edges that readers see after a rejected rehearsal and an applied one."""
    return _replayed(spark, d).read(EDGES)


def story_replay_history(spark, d):
    """Each rehearsal: what became of it and why."""
    return _replayed(spark, d).history()


def directory_versions(spark, d):
    """Refreshes of a directory of names: one that is served, one that fails, one that is overtaken, one that is served in its place."""
    s, c = (table(spark, d, t).select(F.col(f"{t[0]}_name").alias("name"), F.col(f"{t[0]}_nationkey").alias("nation")) for t in ("supplier", "customer"))
    versions = Versions(spark, new_path(spark, "directory"))
    first = versions.request("nightly")
    versions.complete(first, s, "nightly")
    failing = versions.request("import")
    versions.fail(failing, "provider is down")
    versions.complete(failing, c, "after its failure")
    slow, quick = versions.request("slow"), versions.request("quick")
    versions.complete(quick, s.unionByName(c.where("nation < 5")), "quick")
    versions.complete(slow, c, "slow")
    served = versions.read("name string, nation int").groupBy().agg(F.count("*").alias("read"), F.countDistinct("nation").alias("nations"))
    return versions.history().crossJoin(served)


QUERIES = {f.__name__: f for f in (story_assembly, story_replay, story_replay_history, directory_versions)}

ORACLES = {
    "story_replay_history": """
WITH waiting AS (SELECT count(*) AS n FROM events WHERE event_type <> 'error' AND event_id % 3 = 0 AND event_id % 30 <> 0)
SELECT 1 AS version, 'failed' AS status, 'wrong_method ' || n AS reason, NULL::BIGINT AS size, false AS served FROM waiting
UNION ALL SELECT 2, 'ready', 'backfill', n, true FROM waiting
""",
    "directory_versions": """
WITH s AS (SELECT s_nationkey AS nation FROM supplier), c AS (SELECT c_nationkey AS nation FROM customer),
served AS (SELECT nation FROM s UNION ALL SELECT nation FROM c WHERE nation < 5),
seen AS (SELECT count(*) AS "read", count(DISTINCT nation) AS nations FROM served)
SELECT v.*, seen.* FROM seen, (
    SELECT 1 AS version, 'ready' AS status, 'nightly' AS reason, (SELECT count(*) FROM s) AS size, false AS served
    UNION ALL SELECT 2, 'failed', 'provider is down', NULL, false
    UNION ALL SELECT 3, 'late', 'slow', (SELECT count(*) FROM c), false
    UNION ALL SELECT 4, 'ready', 'quick', (SELECT count(*) FROM served), true
) v
""",
}
