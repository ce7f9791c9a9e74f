"""Postings, nominations, transfers and the recompute chain on rows of their own."""

import datetime

from pyspark.sql import functions as F

from statloom.operators import nominate, postings, transfers
from statloom.plans import recompute


def day(n, hours=0):
    return datetime.datetime(2024, 3, 1) + datetime.timedelta(days=n, hours=hours)


def index_of(spark, rows, buckets=8):
    return postings.Index(spark.createDataFrame(rows, "id long, words array<string>, token string, bucket int"), "id", F.col("words"), buckets)


def test_containment(spark):
    sets = [(1, ["a", "b", "c"]), (2, ["a", "c", "c", None]), (3, []), (4, None), (5, ["b"]), (None, ["a"])]
    index = index_of(spark, [(i, w, "x", 1) for i, w in sets])
    asked = {10: ["a"], 11: ["a", "b"], 12: ["c", "a", "a"], 13: ["a", "nowhere"], 14: [], 15: None, 16: ["b", None]}
    got = index.containing(spark.createDataFrame(list(asked.items()), "k long, w array<string>"), "k", F.col("w"))
    held = {i: {x for x in w or [] if x} for i, w in sets if i is not None}
    assert sorted(map(tuple, got.collect())) == sorted((k, i) for k, w in asked.items() for i, s in held.items() if {x for x in w or [] if x} <= s)
    assert sorted(r.id for r in index.holders("a", "c").collect()) == [1, 2] and index.holders("a", "nowhere").count() == 0
    assert sorted(r.id for r in index.holders().collect()) == [1, 2, 3, 4, 5]
    empty = index_of(spark, [])
    assert empty.holders("a").count() == 0 and empty.containing(spark.createDataFrame([(1, ["a"])], "k long, w array<string>"), "k", F.col("w")).count() == 0


def test_a_search_reads_its_buckets_alone(spark):
    index = index_of(spark, [(i, [f"w{i}", "all"], "x", 1) for i in range(200)], 16)
    found = index.holders("w7")
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan, plan
    assert "PushedFilters: [IsNotNull(token), EqualTo(token,w7)]" in plan or "In(token" in plan, plan
    assert [r.id for r in found.collect()] == [7] and index.holders("all").count() == 200


def test_nominations(spark):
    fixtures = [
        (1, day(0), 10, 20, "scheduled", None, None),
        (2, day(0, 2), 30, 40, "seeded", 1, 2),
        (3, day(0), 50, 60, "completed", 0, 0),
        (4, day(4), 50, 60, "completed", 0, 0),
        (5, day(0), 70, 80, "completed", 3, 3),
        (6, None, 90, 91, "scheduled", None, None),
    ]
    reports = [
        (100, day(1), 10, 20, 2, 1),  # as it is stored
        (101, day(1), 40, 30, 2, 1),  # swapped, and right
        (102, day(2), 50, 60, 1, 0),  # as far from 3 as from 4
        (103, day(0), 70, 80, 1, 0),
        (104, day(0), 80, 70, 3, 3),  # says otherwise than 103
        (105, day(2, 1), 10, 20, 5, 5),  # too far from 1
        (106, day(0), None, 20, 1, 1),
        (107, day(0), 20, 20, 1, 1),
        (108, None, 10, 20, 1, 1),
        (109, day(0), 90, 91, 1, 0),
        (110, day(130), 11, 12, 4, 4),
    ]
    got = nominate.nominated(
        spark.createDataFrame(reports, "article long, at timestamp, home int, away int, home_goals int, away_goals int"),
        spark.createDataFrame(fixtures, "fixture long, at timestamp, home int, away int, status string, home_score int, away_score int"),
    )
    assert sorted(map(tuple, got.collect())) == [
        (100, "corrected", 1, False, 2, 1, "completed", None),
        (101, "already_correct", 2, True, 1, 2, "seeded", None),
        (102, "corrected", 3, False, 1, 0, "completed", None),
        (103, "contradictory", 5, False, 3, 3, "completed", None),
        (104, "contradictory", 5, True, 3, 3, "completed", None),
        (105, "created", None, None, 5, 5, "completed", 2023),
        (106, "team_unresolved", None, None, None, None, None, None),
        (107, "same_team", None, None, None, None, None, None),
        (108, "no_time", None, None, None, None, None, None),
        (109, "created", None, None, 1, 0, "completed", 2023),
        (110, "created", None, None, 4, 4, "completed", 2024),
    ]


def test_a_swapped_score_is_put_right(spark):
    f = spark.createDataFrame([(1, day(0), 10, 20, "seeded", 0, 0)], "fixture long, at timestamp, home int, away int, status string, home_score int, away_score int")
    r = spark.createDataFrame([(9, day(0), 20, 10, 3, 1)], "article long, at timestamp, home int, away int, home_goals int, away_goals int")
    assert [tuple(x) for x in nominate.nominated(r, f).collect()] == [(9, "corrected", 1, True, 1, 3, "seeded", None)]
    assert nominate.nominated(r.limit(0), f).count() == 0


def test_transfers(spark):
    seen = spark.createDataFrame([(1, 7, day(0), 1), (1, 7, day(1), 2), (1, 8, day(5), 3), (2, 8, day(0), 4)], "person long, team long, at timestamp, tie long")
    history = transfers.memberships(seen)
    assert sorted((r.person, r.team, r.since, r.until) for r in history.collect()) == [(1, 7, day(0), day(5)), (1, 8, day(5), None), (2, 8, day(0), None)]
    shape = "team long, person long, article long, at timestamp, heat double, title string"
    rows = [(t, p, a, at, h, title) for t, p, at, h, title in [(7, 1, day(9), 5.0, "Set for a SECOND spell"), (8, 1, day(9), 4.0, None), (8, 2, day(9), 4.0, "x"), (7, 2, day(9), 9.0, "x"), (7, 3, day(9), None, "x")] for a in (1, 2)]
    rows += [(7, 5, 1, day(9), 99.0, "x"), (9, 1, 1, day(3), 1.0, "x"), (9, 1, 2, day(3), 1.0, "x"), (7, 4, 1, day(3), 1.0, "x"), (7, 4, 1, day(3), 1.0, "x")]
    found = transfers.candidates(spark.createDataFrame(rows, shape), 2)
    got = {(r.team, r.person): (r.relationship, r.direction, r.returning, r.kept) for r in transfers.standing(found, history).collect()}
    assert got == {
        (7, 1): ("former", "incoming", True, True),
        (8, 1): ("current", "outgoing", False, True),
        (8, 2): ("current", "outgoing", False, True),
        (7, 2): ("none", "incoming", False, True),
        (7, 3): ("none", "incoming", False, True),
        (9, 1): ("none", "incoming", False, True),
    }
    assert [(r.team, r.person) for r in transfers.candidates(spark.createDataFrame(rows, shape), 2, 1).orderBy("team").collect()] == [(7, 2), (8, 1), (9, 1)]
    before = transfers.standing(spark.createDataFrame([(7, 1, day(4), False), (8, 1, day(4), False)], "team long, person long, newest timestamp, returning boolean"), history)
    assert {(r.team, r.relationship) for r in before.collect()} == {(7, "current"), (8, "none")}
    silent = transfers.standing(spark.createDataFrame([(7, 1, day(9), False)], "team long, person long, newest timestamp, returning boolean"), history)
    assert [(r.relationship, r.kept) for r in silent.collect()] == [("former", False)]


def test_the_chain_reads_what_was_written(spark):
    stats = spark.createDataFrame([(i, 2000, i % 2, 30 if i else 3, s, float(i * k)) for i in range(1, 6) for k, s in ((1, "qty"), (2, "returns"))], "l_suppkey long, season int, n_nationkey int, games long, stat string, value double")
    done = recompute.chain(stats)
    assert list(done) == ["stats", "percentiles", "composites", "ratings", "team_ratings", "standings"]
    for name, table in done.items():
        assert table.inputFiles() and "Window" not in table._jdf.queryExecution().optimizedPlan().toString(), name  # what a window gave is read
    assert "Window" in recompute.percentiles(done)._jdf.queryExecution().optimizedPlan().toString()
    assert {r.l_suppkey: r.composite for r in done["composites"].collect()} == dict.fromkeys(range(1, 6), 50.0)  # one stat up, the other down
    assert all(r.rating is None for r in done["ratings"].collect()) and done["standings"].count() == 0  # no deviation
