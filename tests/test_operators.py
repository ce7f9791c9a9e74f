"""Small hand-made frames for the rules that the test tables don't show."""

from datetime import datetime, timedelta
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from statloom.functions import scalar as S
from statloom.functions import text as X
from statloom.operators import bags, cohort, graph, keys, momentum, rating, rollup, story
from statloom.plans import season
from statloom.sources import tables
from statloom.session import new_path, written
from statloom.streaming import streams


def values(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)


def test_single_member_and_constant_cohorts(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("b", 2, 3.0), ("b", 3, 3.0)], "c string, id int, value double")
    assert values(cohort.percentiles(df, ["c"]), "id", "pct") == [(1, 0.0), (2, 0.0), (3, 0.0)]
    z = rating.zscores(df.withColumns({"eligible": F.lit(True), "sign": F.lit(1.0)}), ["c"])
    assert {r.z for r in z.collect()} == {0.0}
    assert spark.range(1).select(S.t_score(F.lit(1.0), F.lit(1.0), F.lit(0.0)).alias("t")).first().t is None


def test_bag_missing_zero_and_merge(spark):
    df = spark.createDataFrame([(1, 0.0, None)], "id int, a double, b double")
    one = df.select(bags.build_bag(a=F.col("a"), b=F.col("b")).alias("bag"))
    assert one.first().bag == {"a": 0.0}
    merged = one.select(bags.merge_bags(F.col("bag"), F.create_map(F.lit("a"), F.lit(7.0))).alias("m")).first().m
    assert merged == {"a": 7.0}
    assert spark.range(1).select(bags.numeric_bag(F.lit('{"x": 1, "y": "no", "z": null}')).alias("b")).first().b == {"x": 1.0}


def test_latest_ties_and_markers(spark):
    df = spark.createDataFrame([(1, 5, 1, "old"), (1, 9, 2, "a"), (1, 9, 3, None), (2, 1, 4, "x")], "k int, at int, id int, v string")
    assert values(keys.latest_per_key(df, ["k"], "at", "id"), "k", "id") == [(1, 3), (2, 4)]
    shown = keys.latest_per_key(df, ["k"], "at", "id").where("v is not null")
    archive = keys.latest_per_key(df.where("v is not null"), ["k"], "at", "id")
    assert values(shown, "k") == [(2,)] and values(archive, "k", "v") == [(1, "a"), (2, "x")]


def test_upsert_keeps_and_replaces(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, None), (3, "c", "z")], "k int, v string, w string")
    assert values(keys.upsert(old, new, ["k"], keep_old=("w",)), "k", "v", "w") == [(1, "a", "x"), (2, None, "y"), (3, "c", "z")]


def test_changed_only_is_null_safe(spark):
    latest = spark.createDataFrame([(1, None), (2, "a")], "k int, v string")
    now = spark.createDataFrame([(1, None), (2, None), (3, "n")], "k int, v string")
    assert values(keys.changed_only(latest, now, ["k"], ["v"]), "k") == [(2,), (3,)]


def test_top_ranked_keeps_ties(spark):
    df = spark.createDataFrame([(1, 9), (2, 8), (3, 8), (4, 1)], "id int, v int")
    assert values(keys.top_ranked(df, "v", 2), "id", "rank") == [(1, 1), (2, 2), (3, 2)]


def test_gate_without_thresholds_is_closed(spark):
    long = spark.createDataFrame([(1, "g", "a", 5.0), (1, "g", "b", 9.0), (2, "g", "a", 5.0), (3, "h", "a", 99.0)], "id int, grp string, stat string, value double")
    least = spark.createDataFrame([("g", "a", 4.0), ("g", "b", 9.0)], "grp string, stat string, least double")
    assert values(rating.eligible(long, least, ["id"], "grp"), "id", "eligible") == [(1, True), (2, False), (3, False)]


def test_rate_siblings_guard_denominators(spark):
    long = spark.createDataFrame([(i, s, v) for i, d in ((1, 4.0), (2, 0.0), (3, -1.0), (4, None)) for s, v in (("n", 8.0), ("d", d)) if v is not None], "id int, stat string, value double")
    reg = spark.createDataFrame([("n", "_rate", "d", "div_mul", 10.0)], "stat string, suffix string, denominator string, formula string, factor double")
    assert values(rollup.rate_siblings(long, ["id"], reg), "id", "stat", "value") == [(1, "n_rate", 20.0)]


def test_cold_start_falls_back(spark):
    df = spark.createDataFrame([(1, 80.0, 1, None, None), (2, 80.0, 1, 20.0, 60.0), (3, 80.0, 9, 20.0, 60.0)], "id int, c double, g int, own double, mean double")
    got = df.select("id", cohort.cold_start(df, "c", "g", F.lit(4.0), "own", "mean").alias("b"))
    assert values(got, "id", "b") == [(1, 57.5), (2, 35.0), (3, 80.0)]


def test_edges_that_vanish_decay(spark):
    before = spark.createDataFrame([(1, 2, 30.0), (1, 3, 10.0)], "a int, b int, strength double")
    now = spark.createDataFrame([(1, 2, 40.0), (2, 3, 5.0)], "a int, b int, strength double")
    assert values(graph.decay_upsert(before, now), "a", "b", "strength", "trajectory", "present") == [(1, 2, 40.0, "heating", True), (1, 3, 0.0, "cooling", False), (2, 3, 5.0, "developing", True)]


def test_momentum_needs_samples_and_takes_one_side(spark):
    a = spark.createDataFrame([(1, 1, 1, 1.0), (1, 2, 2, 4.0), (2, 1, 3, 1.0)], "k int, at int, id int, v double")
    slope = momentum.last_minus_first(a, ["k"], "at", "id", "v", 2, "x")
    other = spark.createDataFrame([(3, 6.0)], "k int, y double")
    assert values(momentum.blend(slope, other, ["k"], "x", "y"), "k", "score") == [(1, 3.0), (3, 6.0)]


def column(spark, values, make, kind="string"):
    """What a column function gives for each value."""
    got = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").select("i", make(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(got)]


def test_result_lines(spark):
    lines = ["Real Madrid 2-1 Arsenal", "A 3-1 B 2-2", "A 2024-25 B", "A 3\u20131 B", "x" * 160 + " 1-0 y", "2-1 Arsenal", "Arsenal 2-1", "A 10:9 B C", "A2-1 B", "A -1 B", "A 151-3 B", "", None, "A season 2024-25 98\u201495 B"]
    got = column(spark, lines, X.result_line)
    want = [("Real Madrid", 2, 1, "Arsenal"), None, None, ("A", 3, 1, "B"), ("x" * 160, 1, 0, "y"), None, None, ("A", 10, 9, "B C"), None, None, None, None, None, ("A season 2024-25", 98, 95, "B")]
    assert [tuple(r) if r else None for r in got] == want


def test_page_text(spark):
    long, longer = " ".join(f"word{i}" for i in range(90)), " ".join(f"word{i}" for i in range(120))
    pages = {
        f"<nav>menu</nav><article>{long}</article><p>rest</p>": long,
        "<article>short</article><p>all &amp; more</p>": "short all & more",
        "<p>kept</p><script>lost <p>lost</p>": "kept",
        f"<article>tiny</article><article>{long}</article>": long,
        f"<article>tiny</article><MAIN class='x'>{long}</MAIN><p>rest</p>": long,  # an article too short gives way to the main part
        f"<article>{longer}": longer,  # no end, no candidate: the whole page
        f"<article>{long}<article>{longer}</article></article>": f"{long} {longer}",
        f"<main>{'a ' * 200}</main><p>b</p>": ("a " * 200 + "b"),  # words of one letter don't count
        "a<textarea>lost</textarea>b<menu>kept</menu>": "ab kept",
        "&amp;lt;b&amp;gt; &lt;i&gt; a > b <p never closed": "<b> <i> a b",
        "<style>p{}</style>one&nbsp;&nbsp;two<script>x</script>": "one  two",
    }
    assert column(spark, list(pages), X.article_text) == list(pages.values())
    assert column(spark, ["a<script>if (1) {}</script><style>b{}</style>c"], X.clean_html) == ["ac"]


def test_walls_scripts_and_words(spark):
    assert column(spark, ["Please SIGN UP", "register to continue", "a subscriber", "your subscription", "signs in"], X.looks_paywalled) == [True, True, True, True, False]
    assert column(spark, ["Milit\u00e3o", "\u0632\u0645", "\u0e01", "\u0915", "\ud55c", "\u03b1", "\u0416"], X.foreign_script) == [False, True, True, True, True, False, True]
    assert column(spark, ["a bc \u00e9 d", ""], X.count_words) == [2, 0]


def test_contested_claims(spark):
    claims = ["Arsenal have reached an agreement in principle", "The Athletic: deal not agreed", "He won\u2019t sign", "They are yet to reach terms", "a 22 million deal", "the and of"]
    assert column(spark, claims, X.denies) == [False, True, True, True, False, False]
    stems = [sorted(x) for x in column(spark, claims, X.stem_set)]
    assert stems == [["agree", "arsen", "princ", "reach"], ["agree", "athle", "deal"], ["sign"], ["reach", "terms", "yet"], ["22", "deal", "milli"], []]


def test_bands_and_trends(spark):
    assert column(spark, [90.0, 89.9, 75.0, 60.0, 50.0, 49.9, 35.0, 34.9], S.band, "double") == ["elite", "strong", "strong", "above average", "average", "below average", "below average", "poor"]
    rows = [("one", 1, 5.0), *(("up", i, 0.3 * i) for i in range(5)), *(("flat", i, 0.25 * i) for i in range(5)), *(("down", i, -i) for i in range(5))]
    got = momentum.trajectory(spark.createDataFrame([(k, i, float(v)) for k, i, v in rows], "k string, at int, v double"), "k", "at", "at", "v").collect()
    assert {r.k: (r.slope, r.trend) for r in got} == {"one": (0.0, "steady"), "up": (0.3, "rising"), "flat": (0.25, "steady"), "down": (-1.0, "falling")}


def test_scores_are_whole_numbers(spark):
    d = spark.createDataFrame([(95.0, 1, 67.0), (0.0, 0, None), (100.0, 9, 99.0)], "top double, high int, comp double")
    assert [r.n for r in d.select(X.notability(F.col("top"), F.col("high"), F.col("comp")).alias("n")).collect()] == [74, 0, 100]
    d = spark.createDataFrame([(5.0, 3, 6.0), (1.0, 9, None)], "n double, s int, age double")
    assert [r.n for r in d.select(X.news_impact(F.col("n"), F.col("s"), F.col("age")).alias("n")).collect()] == [71, 36]
    d = spark.createDataFrame([(4.0, 3, 2, 2, 0.0), (4.0, 3, 0, 4, 365.0), (2.0, 0, 1, 2, 21.0)], "w double, s int, recent int, total int, age double")
    got = d.select(graph.typed_strength(F.col("w"), F.col("s"), F.col("recent"), F.col("total"), F.col("age")).alias("x")).collect()
    assert [r.x for r in got] == [100, 0, 17]  # decay is a factor: an edge of a year has nothing left


def test_names(spark):
    assert spark.range(1).select(S.normal_name(F.lit("  Élan  d'Örtz-9 ")).alias("n")).first().n == "elan d ortz 9"
    names = spark.createDataFrame([("Šešelj Łódź Čović",), ("Ødegård þór Æsir Straße",), ("İlkay Gu\u0308ndog\u0306an",)], "n string")
    assert [r.n for r in names.select(S.normal_name(F.col("n")).alias("n")).collect()] == ["seselj lodz covic", "odegard thor aesir strasse", "ilkay gundogan"]


def test_story_rules():
    at = datetime(2024, 1, 1)
    fold = story.Fold()
    first = fold.add(1, at, "t", ["p1"], ["c1"])
    assert fold.add(2, at + timedelta(hours=1), "u", [], ["c1"]) == 2  # a shared club alone opens a new one
    assert fold.add(3, at + timedelta(hours=2), "t", ["p1"], []) == first  # person, kind and freshness attach
    fold.add(10, at, "m", [f"x{i}" for i in range(11)], [])
    assert fold.add(11, at + timedelta(hours=1), "m", ["x1", "x2"], []) == 11  # a large first cast isn't covered by two
    assert fold.add(12, at + timedelta(days=40), "t", ["p1"], ["c1"]) == 12  # a closed story takes none


def test_a_common_name_opens_no_stories_to_look_at(monkeypatch):
    """A name in all stories alone covers no first cast of three: such stories aren't looked at one by one."""
    seen, chosen = [], story.choose
    monkeypatch.setattr(story, "choose", lambda stories, *rest: seen.append(len(stories)) or chosen(stories, *rest))
    fold, at = story.Fold(), datetime(2024, 1, 1)
    got = [fold.add(i, at + timedelta(minutes=i), "t", [f"p{i % 100}"], ["common", f"e{i}"]) for i in range(300)]
    assert got == [i % 100 for i in range(300)] and max(seen) == 1
    assert fold.add(301, at + timedelta(hours=7), "t", [], []) == 301
    assert fold.add(302, at + timedelta(hours=8), "t", ["p"], ["x"], settled=301) == 301  # gets its names later
    assert fold.add(303, at + timedelta(hours=9), "t", ["p"], ["y", "z"]) == 301


def test_queue_states():
    w = streams.Work()
    assert w.take("enqueue", "1") == ("pending", 0)
    for wait in (30, 120, 600, 1800):
        assert w.take("claim", "1")[0] == "running" and w.take("fail", "1") == ("pending", wait)
    w.take("claim", "1")
    assert w.take("fail", "1") == ("parked", 0)
    assert w.take("enqueue", "1")[0] == "parked" and w.take("enqueue", "2")[0] == "pending"
    w.take("claim", "2")
    assert w.take("enqueue", "2")[0] == "running" and w.take("enqueue", "3") == ("pending", 0) and w.attempts == 0  # a new version reopens running work
    w.take("claim", "3")
    assert w.take("defer", "3") == ("pending", 0) and w.attempts == 0  # and putting off costs no attempt
    w.take("claim", "3")
    assert w.take("complete", "3") == ("done", 0) and w.take("enqueue", "3")[0] == "done"


def test_sinks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, p string")
    path = new_path(spark, "sink")
    tables.rebuild(df, path, "p")
    tables.rebuild(spark.createDataFrame([(9, "b")], "k int, p string"), path, "p")
    assert values(spark.read.parquet(path), "k", "p") == [(1, "a"), (9, "b")]
    csv = new_path(spark, "csv")
    tables.export_csv(df, csv)
    assert spark.read.option("header", True).csv(csv).count() == 2
    assert tables.materialised(df, "view").count() == 2


def test_watermarked_streams(spark):
    rows = [(datetime(2024, 1, d), "k", 1.0) for d in (1, 1, 2, 9)]
    path = new_path(spark, "in")
    df = spark.createDataFrame(rows, "ts timestamp, kind string, value double")
    df.coalesce(1).write.parquet(path)
    got = streams.run_once(streams.daily_counts(streams.file_stream(spark, path, df.schema), "ts", "kind"), "days")
    days = {r.day.day: r.n for r in got.collect()}  # the last day stays open, rows behind the watermark drop out
    assert set(days) <= {1, 2} and all(n >= 1 for n in days.values()) and days


def test_ranks_of_cohorts_of_any_size(spark):
    rows = [(c, (i * 7) % 11 if i % 5 else None, i) for c in ("a", None, "b") for i in range(40)] + [("one", 1, 0)]
    df = spark.createDataFrame(rows, "c string, v int, i int").repartition(5)
    one, many = ({(r.c, r.i): r.rank for r in cohort.percent_ranks(df, ["c"], F.col("v"), "rank", n).collect()} for n in (1000, 0))
    assert one == many and len(one) == len(rows) and one[("one", 0)] == 0


def test_rounding_is_that_of_sql(spark):
    """Of values whose decimal form ends in a 5: as DuckDB rounds the binary value."""
    made = "select cast(a * 90 / m as double) as x from (select explode(sequence(1, 300)) as a) cross join (select explode(array(1600, 2000, 2240, 2560, 3200)) as m)"
    got = [(r.x, r.y) for r in spark.sql(made).select("x", S.rounded("x", 4).alias("y")).collect()]
    want = duckdb.execute("select round(x, 4) from (select unnest(?::double[]) as x)", [[x for x, _ in got]]).fetchall()
    assert [y for _, y in got] == [w[0] for w in want]


def test_compressed_rows_are_not_broadcast(spark):
    """A file of a few kilobytes that holds many rows is no small side of a join."""
    rows = written(spark.range(300_000, numPartitions=1).selectExpr("id % 7 AS v", "array('one stem', 'another stem') AS stems"), "rows")
    held = sum(Path(f.removeprefix("file://")).stat().st_size for f in rows.inputFiles())
    assert held < 1 << 20 and int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= 16 * held


def test_the_season_table_needs_no_session_partitions(spark):
    """Line items are dealt out by their number, so one session partition doesn't make one task hold them all."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        season.forget()
        made = season._seasons(spark, "/root/testdata/sf0.001")
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") >= 3 and "hashpartitioning(l_suppkey" in plan
        assert "hashpartitioning(l_orderkey#" in plan and ", 1), ENSURE_REQUIREMENTS" not in plan.split("SortMergeJoin")[-1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tasks_of_the_season_table_hold_their_share_of_lines(spark, monkeypatch):
    """With more lines there are more tasks, not larger ones; what is added up is the same."""
    d, share = "/root/testdata/sf0.001", 500
    whole = sorted(map(tuple, season._seasons(spark, d).collect()))
    monkeypatch.setattr(season, "LINES_PER_TASK", share)
    lines = tables.table(spark, d, "lineitem").count()
    most = season._fixtures(spark, d).groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    assert most[0] <= 2 * share and most[1] == lines > 8 * share
    assert sorted(map(tuple, season._seasons(spark, d).collect())) == whole
