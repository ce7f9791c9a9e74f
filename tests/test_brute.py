"""Queries that SQL can't express, against plain loops over the whole table."""

import duckdb
from pyspark.sql import functions as F

from statloom import catalog
from statloom.operators import story
from statloom.session import new_path
from statloom.sources.versions import Versions

SF = "/root/testdata/sf0.001"


def _events(columns, order):
    return duckdb.sql(f"SELECT {columns} FROM read_parquet('{SF}/events.parquet') ORDER BY {order}").fetchall()


def _cast(article, user, nameless=()):
    return (set(), set()) if article in nameless else ({str(user)}, {str(user % 97), f"e{article % 1009}"})


def _assembled(rows, settled=None, nameless=()):
    """A story for each article of rows (article, at, kind, user), kinds apart; settled ones keep theirs."""
    stories, found_in = {}, {}
    for article, at, kind, user in rows:
        persons, teams = _cast(article, user, nameless)
        known = (settled or {}).get(article)
        if settled is not None and known is None and not persons | teams:
            continue
        own = stories.setdefault(kind, {})
        scored = []
        for s in own.values():
            if (at - s["seen"]).days >= 14:
                continue
            shared = 2 * len(s["persons"] & persons) + len(s["teams"] & teams)
            score = shared + 1 + ((at - s["seen"]).total_seconds() <= 48 * 3600)
            if shared and score > 3 and 2 * len(s["seed"] & (persons | teams)) >= len(s["seed"]):
                scored.append((-score, -s["seen"].timestamp(), s["id"], s))
        if known is not None:
            found = own.get(known)
            if found is None or (at - found["seen"]).days >= 14:
                found = None
            number = known
        else:
            found = min(scored, key=lambda x: x[:3])[3] if scored else None
            number = article
        if found is None:
            found = own[number] = {"id": number, "persons": set(), "teams": set(), "seed": persons | teams}
        found["persons"] |= persons
        found["teams"] |= teams
        found["seen"] = at
        found_in[article] = found["id"]
    return found_in


def _articles():
    return [r for r in _events("event_id, ts, event_type, user_id", "ts, event_id") if r[2] != "error"]


def test_story_assembly(spark):
    want = _assembled(_articles())
    got = catalog.queries()["story_assembly"](spark, SF).collect()
    assert {r.article: r.story for r in got} == want and len(got) == len(want)
    assert all(r.opened == (r.story == r.article) for r in got)
    assert len(set(want.values())) < len(want)


def test_story_replay(spark):
    rows = _articles()
    nameless = {r[0] for r in rows if r[0] % 30 == 0}
    live = _assembled([r for r in rows if r[0] % 3], nameless=nameless)
    want = {a: s for a, s in _assembled(rows, live, nameless).items() if a not in live}
    got = catalog.queries()["story_replay"](spark, SF).collect()
    assert {r.article: r.story for r in got} == want and len(got) == len(want) > 0
    assert {r.method for r in got} == {"backfill"} and any(r.story % 3 for r in got)


def test_a_kind_is_folded_by_its_components(spark):
    """One kind alone, a third of which names one person: others don't wait for it."""
    e = "date_add(DATE'2024-01-01', cast(id % 20 AS INT))"
    a = spark.range(300).selectExpr("'k' AS part", "id AS article", f"cast({e} AS TIMESTAMP) AS at", "'k' AS kind", "array(if(id % 3 = 0, 'hot', concat('p', cast(id % 50 AS STRING)))) AS persons", "cast(NULL AS ARRAY<STRING>) AS teams")
    groups = {r.component: r.n for r in story.connected(a).groupBy("component").agg(F.count("*").alias("n")).collect()}
    assert len(groups) == 51 and max(groups.values()) == 100
    rows = [(r.article, r.at, "k", r.persons[0]) for r in a.orderBy("at", "article").collect()]
    plain = {}
    for name in {r[3] for r in rows}:
        fold = story.Fold()
        plain |= {r[0]: fold.add(r[0], r[1], "k", [name], []) for r in rows if r[3] == name}
    assert {r.article: r.story for r in story.assemble(a).collect()} == plain


def test_replay_faults(spark):
    a = spark.createDataFrame([(1, ["x"], None), (2, ["y"], None), (3, ["z"], 3), (4, [], None), (5, None, None)], "article long, persons array<string>, story long").selectExpr("'k' AS part", "*", "timestamp'2024-01-01 00:00:00' AS at", "'k' AS kind", "array() AS teams")
    shape = "part string, article long, story long, opened boolean, method string"
    right = [("k", 1, 1, True, "backfill"), ("k", 2, 2, True, "backfill")]
    faults = lambda rows: story.replay_faults(a, spark.createDataFrame(rows, shape)).first().asDict()
    assert set(faults(right).values()) == {0}
    assert faults(right[:1])["unstamped"] == 1
    assert faults([*right, ("k", 2, 1, False, "backfill")])["twice"] == 1
    assert faults([*right, ("k", 3, 3, False, "backfill")])["settled_again"] == 1
    assert faults([*right, ("k", 4, 4, True, "backfill")])["nameless"] == 1
    assert faults([right[0], ("k", 2, 2, True, None)])["wrong_method"] == 1


def test_versions(spark):
    v = Versions(spark, new_path(spark, "versions"))
    assert v.current() is None and v.read("a int").count() == 0 and v.history().count() == 0
    rows = lambda n: spark.range(n)
    one, two, three = v.request(), v.request(), v.request()
    assert (one, two, three) == (1, 2, 3)
    assert v.complete(two, rows(5)) and v.current() == 2 and v.read("id long").count() == 5
    assert not v.complete(one, rows(9)) and v.current() == 2  # overtaken
    v.fail(three, "no")
    assert not v.complete(three, rows(9)) and v.read("id long").count() == 5
    four = v.request("again")
    assert v.complete(four, rows(0)) and v.read("id long").count() == 0
    assert not v.complete(four, rows(3)) and v.read("id long").count() == 0  # ended
    assert [tuple(r) for r in v.history().orderBy("version").collect()] == [(1, "late", None, 9, False), (2, "ready", None, 5, False), (3, "failed", "no", None, False), (4, "ready", None, 0, True)]


def test_queue_state(spark):
    held, want = {}, []
    waits = {1: 30, 2: 120, 3: 600, 4: 1800}
    for number, user, kind in _events("event_id, user_id, event_type", "event_id"):
        status, version, attempts = held.get(user, ("none", None, 0))
        wait = 0
        if kind in ("signup", "view") and version != str(number % 3):
            status, version, attempts = "pending", str(number % 3), 0
        elif kind == "click" and status == "pending":
            status, attempts = "running", attempts + 1
        elif kind == "purchase" and status == "running":
            status = "done"
        elif kind == "error" and status == "running":
            status, wait = ("parked", 0) if attempts == 5 else ("pending", waits[attempts])
        held[user] = status, version, attempts
        want.append((str(user), number, status, wait, attempts))
    got = catalog.queries()["queue_state"](spark, SF)
    assert sorted(tuple(r) for r in got.select("key", "ord", "status", "wait", "attempts").collect()) == sorted(want)
