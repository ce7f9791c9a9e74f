"""Page documents, memory cards and the sinks behind them. A page is one JSON text per entity, its lists in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import keys
from ..session import new_path
from ..sources import tables as sinks
from ..sources.tables import table
from .season import SEASONS, seasons


def ordered(*fields: Column | str) -> Column:
    """A group's structs as a list, sorted by their fields from the first on."""
    return F.array_sort(F.collect_list(F.struct(*fields)))


def entity_page(spark, d):
    """Identity header and season blocks of each supplier."""
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    s = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("s_name").alias("name"), "nation")
    blocks = seasons(spark, d).groupBy("l_suppkey").agg(ordered("season", "games", "lines").alias("seasons"))
    page = F.to_json(F.struct(F.col("s_suppkey").alias("id"), "name", "nation", "seasons"))
    return s.join(blocks, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", page.alias("page"), F.md5(page.cast("binary")).alias("etag"))


def event_series(spark, d):
    """Each customer's last fourteen orders, oldest first."""
    last = keys.ranked_first(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 14)
    g = last.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))).alias("s"))
    return g.select("o_custkey", F.size("s").alias("n"), F.to_json(F.transform("s", lambda x: F.struct(x["o_orderkey"].alias("id"), x["o_orderstatus"].alias("status")))).alias("series"))


def story_page(spark, d):
    """A conversation's turns in order."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(ordered("turn", "role", F.length("text").alias("chars")).alias("turns"))
    return c.select("conv_id", F.to_json(F.struct("conv_id", "turns")).alias("page"))


def meta_directory(spark, d):
    """Regions with their nations by name, and how many suppliers each has."""
    n = table(spark, d, "nation").join(table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers")), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    g = n.groupBy("n_regionkey").agg(ordered(F.col("n_name").alias("nation"), F.coalesce("suppliers", F.lit(0)).alias("suppliers")).alias("nations"))
    return table(spark, d, "region").join(g, F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", F.to_json(F.struct(F.col("r_name").alias("region"), "nations")).alias("page"))


def roster(spark, d):
    """A nation's suppliers of one season by what they took in."""
    s = seasons(spark, d).where("season = 2000")
    w = Window.partitionBy("n_nationkey").orderBy(S.key_of(F.col("revenue")).desc(), "l_suppkey")
    return s.select("n_nationkey", F.row_number().over(w).alias("place"), "l_suppkey", "games", F.round("revenue", 2).alias("revenue"))


def source_card(spark, d):
    """Each market segment's six most reliable priorities as one text line."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    g = o.groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("c"))
    best = keys.ranked_first(g, ["c_mktsegment"], [F.desc(F.round(F.col("c") / (F.col("c") + 5.0), 9)), F.asc("o_orderpriority")], 6).withColumn("k", -F.round(F.col("c") / (F.col("c") + 5.0), 9))
    line = F.transform(F.array_sort(F.collect_list(F.struct("k", "o_orderpriority", "c", "n"))), lambda x: F.concat(x["o_orderpriority"], F.lit(" "), x["c"], F.lit("/"), x["n"]))
    return best.groupBy("c_mktsegment").agg(F.array_join(line, "; ").alias("card"))


def context_memory(spark, d):
    """A bounded memory text for each customer: three newest orders, the two largest, and how many stand how."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    w = Window.partitionBy("o_custkey")
    r = o.withColumns({"new": F.row_number().over(w.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))), "big": F.row_number().over(w.orderBy(S.key_of(F.col("o_totalprice")).desc(), "o_orderkey"))})
    part = lambda place, most: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(place) <= most, F.struct(place, "o_orderkey")))), lambda x: x["o_orderkey"].cast("string")), " ")
    counts = F.concat_ws(" ", *(F.concat(F.lit(f"{s}="), F.count_if(F.col("o_orderstatus") == s)) for s in "FOP"))
    return r.groupBy("o_custkey").agg(F.concat_ws("\n", F.concat(F.lit("newest: "), part("new", 3)), F.concat(F.lit("largest: "), part("big", 2)), F.concat(F.lit("standing: "), counts)).alias("memory"))


def grounded_narratives(spark, d):
    """Orders as narratives that cite parts: citations of parts that can't be seen go, narratives left without any go too; brands by first citation."""
    seen = table(spark, d, "part").where("p_size > 25").select("p_partkey", "p_brand")
    c = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(seen, F.col("l_partkey") == F.col("p_partkey"))
    first = c.groupBy("l_orderkey", "p_brand").agg(F.min("l_linenumber").alias("at"), F.count("*").alias("n"))
    g = first.groupBy("l_orderkey").agg(F.sum("n").alias("cites"), ordered("at", "p_brand").alias("b"))
    return g.select("l_orderkey", "cites", F.array_join(F.transform("b", lambda x: x["p_brand"]), ",").alias("sources"))


def scouting(spark, d):
    """Per supplier-season and stat: band, and whether it is a weakness (under the middle and half a deviation down); zeros say nothing."""
    s = seasons(spark, d)
    long = s.select("l_suppkey", "season", F.expr("stack(3, 'qty', qty, 'revenue', revenue, 'lines', cast(lines as double)) as (stat, value)")).where("value <> 0")
    w = Window.partitionBy("season", "stat")
    pct = F.round(100 * F.percent_rank().over(w.orderBy(S.key_of(F.col("value")))), 1)
    z = (F.col("value") - F.avg("value").over(w)) / F.nullif(F.stddev_pop("value").over(w), F.lit(0.0))
    r = long.withColumns({"pct": pct, "z": F.round(F.coalesce(z, F.lit(0.0)), 6)})
    return r.select("l_suppkey", "season", "stat", S.band(F.col("pct")).alias("band"), ((F.col("pct") < 50) & (F.col("z") <= -0.5)).alias("weakness"))


def rule_scores(spark, d):
    """A rule (long texts are good) against labels, by language: mean absolute error, share right, how many."""
    j = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("n_chars") > 800, 1.0).otherwise(0.25).alias("said")).join(table(spark, d, "labels"), "doc_id")
    return j.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("said") - F.col("quality"))), 6).alias("mae"), F.round(100.0 * F.count_if((F.col("said") >= 0.5).cast("int") == F.col("quality")) / F.count("*"), 4).alias("right_pct"))


KEYWORDS = {"licence": "licensed under|license", "money": r"\$[0-9]|price|payment", "contact": "@|phone|call"}


def keyword_evidence(spark, d):
    """Per source: languages and documents whose text holds each kind of key words."""
    t = F.lower("text")
    g = table(spark, d, "documents").groupBy("source")
    found = [a for k, p in KEYWORDS.items() for a in (F.count_if(t.rlike(p)).alias(f"{k}_docs"), F.countDistinct(F.when(t.rlike(p), F.col("lang"))).alias(f"{k}_langs"))]
    return g.agg(F.count("*").alias("docs"), *found)


def place_descriptors(spark, d):
    """Part types that name a material and no finish: what a name's descriptor must not be."""
    words = F.split(S.normal_name(F.concat_ws(" ", "p_type", "p_name")), " ")
    lists = [F.array(*(F.lit(x) for x in xs)) for xs in (("standard", "small", "medium", "large", "economy", "promo"), ("part", "red", "blue"))]
    return table(spark, d, "part").select("p_partkey", F.arrays_overlap(words, lists[0]).alias("names_place"), (F.arrays_overlap(words, lists[0]) & ~F.arrays_overlap(words, lists[1])).alias("vetoed"))


def pair_board(spark, d):
    """Newest row of each customer and priority; open ones over the customer's mean are shown, but not where the customer has a pending order."""
    o = table(spark, d, "orders")
    last = keys.latest_per_key(o, ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey").where("o_orderstatus = 'O'")
    mean = o.groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))
    shown = last.join(mean, "o_custkey").where("o_totalprice > mean").join(o.where("o_orderstatus = 'P'").select("o_custkey"), "o_custkey", "left_anti")
    return shown.select("o_custkey", "o_orderpriority", "o_orderkey")


def weekly_snapshots(spark, d):
    """A user's daily means of the last seven days as one list, a place for each day (null without events)."""
    day = F.datediff(F.lit("2024-01-31").cast("date"), "ts")
    e = table(spark, d, "events").withColumn("age", day).where("age between 1 and 7").groupBy("user_id", "age").agg(F.round(F.avg("value"), 4).alias("mean"))
    g = e.groupBy("user_id").agg(*(F.max(F.when(F.col("age") == a, F.col("mean"))).alias(f"d{a}") for a in range(1, 8)))
    return g.withColumn("days", sum(F.col(f"d{a}").isNotNull().cast("int") for a in range(1, 8)))


def prevented(spark, d):
    """Returns that a supplier prevents: lines it has times the share returned everywhere, less its own."""
    line = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("faced"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    everywhere = table(spark, d, "lineitem").agg((F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("share"))
    return line.crossJoin(F.broadcast(everywhere)).select("l_suppkey", F.round(F.col("faced") * F.col("share") - F.col("returned"), 6).alias("prevented"))


def cohort_sums(spark, d):
    """Sum and number of each stat in each cohort, so that one entity's peers are a subtraction."""
    s = seasons(spark, d).select("season", "n_regionkey", F.expr("stack(3, 'qty', qty, 'revenue', revenue, 'games', cast(games as double)) as (stat, value)"))
    return s.groupBy("season", "n_regionkey", "stat").agg(F.sum(S.key_of(F.col("value"))).cast("double").alias("total"), F.count("value").alias("n"))


def ordinals(spark, d):
    """Places of customers by balance within their nation, written out."""
    w = Window.partitionBy("c_nationkey").orderBy(S.key_of(F.col("c_acctbal")).desc(), "c_custkey")
    return table(spark, d, "customer").withColumn("place", F.row_number().over(w)).select("c_custkey", S.ordinal(F.col("place")).alias("place"))


def latest_projection(spark, d):
    """Newest row of each user, materialised, then read by kind."""
    last = keys.latest_per_key(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_type", "event_id")
    return sinks.materialised(last, "latest").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("newest"))


def csv_export(spark, d):
    """Nations through a CSV file with a header and back."""
    path = new_path(spark, "csv")
    sinks.export_csv(table(spark, d, "nation"), path)
    return spark.read.option("header", True).schema("n_nationkey int, n_name string, n_regionkey int").csv(path)


def json_export(spark, d):
    """Suppliers through a file of JSON lines and back."""
    path = new_path(spark, "json")
    sinks.export_json(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path)
    return spark.read.schema("s_suppkey long, s_name string, s_nationkey int").json(path)


def partition_rebuild(spark, d):
    """Orders by status; one partition is rebuilt without its small orders, the others stay."""
    o, path = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), new_path(spark, "rebuild")
    sinks.rebuild(o, path, "o_orderstatus")
    sinks.rebuild(o.where("o_orderstatus = 'F' and o_totalprice >= 50000"), path, "o_orderstatus")
    return spark.read.schema(o.schema).parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def appended_snapshots(spark, d):
    """Two snapshots of customers' order counts appended to one table, the later one only where it differs."""
    path = new_path(spark, "snapshots")
    o = table(spark, d, "orders")
    count = lambda rows: rows.groupBy("o_custkey").agg(F.count("*").alias("n"))
    first, now = count(o.where("o_orderdate < timestamp'2001-01-01'")), count(o)
    sinks.append_snapshot(first.withColumn("generation", F.lit(1)), path)
    stored = spark.read.parquet(path)
    sinks.append_snapshot(keys.changed_only(stored, now, ["o_custkey"], ["n"]).withColumn("generation", F.lit(2)), path)
    return keys.latest_per_key(spark.read.schema("o_custkey long, n long, generation int").parquet(path), ["o_custkey"], "generation", "n")


QUERIES = {f.__name__: f for f in (
    entity_page, event_series, story_page, meta_directory, roster, source_card, context_memory, grounded_narratives, scouting, rule_scores, keyword_evidence, place_descriptors, pair_board,
    weekly_snapshots, prevented, cohort_sums, ordinals, latest_projection, csv_export, json_export, partition_rebuild, appended_snapshots,
)}

_DAYS = ", ".join(f"max(mean) FILTER (WHERE age = {a}) AS d{a}" for a in range(1, 8))
_FOUND = ", ".join(f"count(*) FILTER (WHERE regexp_matches(lower(text), '{p}')) AS {k}_docs, count(DISTINCT lang) FILTER (WHERE regexp_matches(lower(text), '{p}')) AS {k}_langs" for k, p in KEYWORDS.items())
_LONG = f"WITH {SEASONS}, lg AS (SELECT l_suppkey, season, n_regionkey, unnest(['qty', 'revenue', 'lines', 'games']) AS stat, unnest([qty, revenue, CAST(lines AS DOUBLE), CAST(games AS DOUBLE)]) AS value FROM st)"

ORACLES = {
    "entity_page": f"""WITH {SEASONS}, b AS (SELECT l_suppkey, list({{'season': season, 'games': games, 'lines': lines}} ORDER BY season, games, lines) AS seasons FROM st GROUP BY l_suppkey),
      p AS (SELECT s_suppkey, CAST(to_json({{'id': s_suppkey, 'name': s_name, 'nation': n_name, 'seasons': seasons}}) AS VARCHAR) AS page FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN b ON l_suppkey = s_suppkey) SELECT *, md5(page) AS etag FROM p""",
    "event_series": """WITH o AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 14)
      SELECT o_custkey, CAST(count(*) AS INTEGER) AS n, CAST(to_json(list({'id': o_orderkey, 'status': o_orderstatus} ORDER BY o_orderdate, o_orderkey)) AS VARCHAR) AS series FROM o GROUP BY o_custkey""",
    "story_page": "SELECT conv_id, CAST(to_json({'conv_id': conv_id, 'turns': list({'turn': turn, 'role': role, 'chars': len(text)} ORDER BY turn, role, len(text))}) AS VARCHAR) AS page FROM conversations GROUP BY conv_id",
    "meta_directory": """WITH s AS (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY ALL) SELECT r_regionkey, CAST(to_json({'region': r_name, 'nations': list({'nation': n_name, 'suppliers': coalesce(suppliers, 0)} ORDER BY n_name)}) AS VARCHAR) AS page
      FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN s ON s_nationkey = n_nationkey GROUP BY r_regionkey, r_name""",
    "roster": f"WITH {SEASONS} SELECT n_nationkey, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY CAST(revenue AS DECIMAL(18,6)) DESC, l_suppkey) AS INTEGER) AS place, l_suppkey, games, round(revenue, 2) AS revenue FROM st WHERE season = 2000",
    "source_card": """WITH g AS (SELECT c_mktsegment, o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY round(c / (c + 5.0::DOUBLE), 9) DESC, o_orderpriority) AS p FROM g)
      SELECT c_mktsegment, string_agg(o_orderpriority || ' ' || c || '/' || n, '; ' ORDER BY p) AS card FROM b WHERE p <= 6 GROUP BY c_mktsegment""",
    "context_memory": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_totalprice AS DECIMAL(18,6)) DESC, o_orderkey) AS b FROM orders)
      SELECT o_custkey, 'newest: ' || string_agg(CAST(o_orderkey AS VARCHAR), ' ' ORDER BY a) FILTER (WHERE a <= 3) || chr(10) || 'largest: ' || string_agg(CAST(o_orderkey AS VARCHAR), ' ' ORDER BY b) FILTER (WHERE b <= 2) || chr(10) || 'standing: F=' || count(*) FILTER (WHERE o_orderstatus = 'F')
      || ' O=' || count(*) FILTER (WHERE o_orderstatus = 'O') || ' P=' || count(*) FILTER (WHERE o_orderstatus = 'P') AS memory FROM r GROUP BY o_custkey""",
    "grounded_narratives": """WITH f AS (SELECT l_orderkey, p_brand, min(l_linenumber) AS at_, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25 GROUP BY ALL)
      SELECT l_orderkey, CAST(sum(n) AS BIGINT) AS cites, string_agg(p_brand, ',' ORDER BY at_, p_brand) AS sources FROM f GROUP BY l_orderkey""",
    "scouting": f"""{_LONG}, r AS (SELECT l_suppkey, season, stat, round(100 * percent_rank() OVER (PARTITION BY season, stat ORDER BY CAST(value AS DECIMAL(18,6))), 1) AS pct, round(coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0), 6) AS z FROM lg WHERE value <> 0 AND stat <> 'games' WINDOW w AS (PARTITION BY season, stat))
      SELECT l_suppkey, season, stat, CASE WHEN pct >= 90 THEN 'elite' WHEN pct >= 75 THEN 'strong' WHEN pct >= 60 THEN 'above average' WHEN pct >= 50 THEN 'average' WHEN pct >= 35 THEN 'below average' ELSE 'poor' END AS band, pct < 50 AND z <= -0.5 AS weakness FROM r""",
    "rule_scores": """WITH j AS (SELECT lang, CASE WHEN n_chars > 800 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS said, quality FROM documents JOIN labels USING (doc_id))
      SELECT lang, count(*) AS n, round(avg(abs(said - quality)), 6) AS mae, round(100.0::DOUBLE * count(*) FILTER (WHERE CAST(said >= 0.5 AS INTEGER) = quality) / count(*), 4) AS right_pct FROM j GROUP BY lang""",
    "keyword_evidence": f"SELECT source, count(*) AS docs, {_FOUND} FROM documents GROUP BY source",
    "place_descriptors": """WITH w AS (SELECT p_partkey, string_split(trim(regexp_replace(lower(p_type || ' ' || p_name), '[^a-z0-9]+', ' ', 'g')), ' ') AS t FROM part), v AS (SELECT p_partkey, list_has_any(t, ['standard', 'small', 'medium', 'large', 'economy', 'promo']) AS a, list_has_any(t, ['part', 'red', 'blue']) AS b FROM w)
      SELECT p_partkey, a AS names_place, a AND NOT b AS vetoed FROM v""",
    "pair_board": """WITH l AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1), m AS (SELECT o_custkey, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ALL)
      SELECT o_custkey, o_orderpriority, o_orderkey FROM l JOIN m USING (o_custkey) WHERE o_orderstatus = 'O' AND o_totalprice > mean AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = l.o_custkey AND p.o_orderstatus = 'P')""",
    "weekly_snapshots": f"""WITH e AS (SELECT user_id, date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS age, value FROM events), g AS (SELECT user_id, age, round(avg(value), 4) AS mean FROM e WHERE age BETWEEN 1 AND 7 GROUP BY ALL)
      SELECT user_id, {_DAYS}, CAST(count(*) AS INTEGER) AS days FROM g GROUP BY user_id""",
    "prevented": "SELECT l_suppkey, round(count(*) * (SELECT count(*) FILTER (WHERE l_returnflag = 'R') / count(*)::DOUBLE FROM lineitem) - count(*) FILTER (WHERE l_returnflag = 'R'), 6) AS prevented FROM lineitem GROUP BY l_suppkey",
    "cohort_sums": f"{_LONG} SELECT season, n_regionkey, stat, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total, count(value) AS n FROM lg WHERE stat <> 'lines' GROUP BY ALL",
    "ordinals": """WITH p AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(c_acctbal AS DECIMAL(18,6)) DESC, c_custkey) AS p FROM customer)
      SELECT c_custkey, p || CASE WHEN p % 100 IN (11, 12, 13) THEN 'th' WHEN p % 10 = 1 THEN 'st' WHEN p % 10 = 2 THEN 'nd' WHEN p % 10 = 3 THEN 'rd' ELSE 'th' END AS place FROM p""",
    "latest_projection": "WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT event_type, count(*) AS n, max(event_id) AS newest FROM l GROUP BY event_type",
    "csv_export": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "json_export": "SELECT s_suppkey, s_name, s_nationkey FROM supplier",
    "partition_rebuild": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice >= 50000 GROUP BY o_orderstatus",
    "appended_snapshots": """WITH a AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '2001-01-01') AS before_, count(*) AS n FROM orders GROUP BY o_custkey)
      SELECT o_custkey, n, CASE WHEN n = before_ THEN 1 ELSE 2 END AS generation FROM a""",
}
