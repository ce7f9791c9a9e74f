"""Text queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import text as X
from ..operators import keys
from ..session import written
from ..sources.tables import table


def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_title(F.col("html")).alias("title"), X.domain_of(F.col("url")).alias("domain"))


def html_extract(spark, d):
    return table(spark, d, "pages").withColumn("text", X.article_text(F.col("html"))).select("page_id", F.length("text").alias("n_chars"), S.content_hash(F.col("text")).alias("hash"))


def html_clean(spark, d):
    """Tags dropped, entities decoded, single spaces: the whole page, without the choice of a part."""
    return table(spark, d, "pages").select("page_id", F.md5(X.clean_html(F.col("html"))).alias("hash"))


def text_guards(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.foreign_script(t).alias("foreign_script"), X.sentences(t).alias("sentences"), t.rlike("[0-9]").alias("has_digits"), X.looks_paywalled(t).alias("paywalled"), F.lower(t).rlike("licensed under|all rights reserved").alias("banned"))


def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", S.content_hash(F.col("text")).alias("hash"))


def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.count_words(F.col("text")).alias("words"))


def truncated(spark, d):
    """Texts cut to 120 characters, marks of emphasis taken off."""
    return table(spark, d, "documents").select("doc_id", F.substring(X.strip_emphasis(F.col("text")), 1, 120).alias("head"))


def quote_slice(spark, d):
    return table(spark, d, "documents").select("doc_id", X.quote_slice(F.col("text"), "license").alias("quote")).where("quote is not null")


def _lines(spark, d):
    """Result lines made of orders: good ones with four kinds of dash, and seasons, two scores, a missing side and a score within a word."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    k, home, away = F.col("o_orderkey"), F.col("c_name"), F.initcap("c_mktsegment")
    score = lambda dash: F.concat((k % 5).cast("string"), F.lit(dash), (k % 7).cast("string"))
    kinds = [F.concat_ws(" ", home, score(x), away) for x in ("-", "\u2013", "\u2014", ":")]
    kinds += [F.concat_ws(" ", home, F.lit("2024-25"), away), F.concat_ws(" ", home, score("-"), away, score("-")), F.concat_ws(" ", score("-"), away), F.concat(home, score("-"), F.lit(" "), away), F.concat_ws(" ", home, F.lit("of 2024-25"), score("-"), away)]
    line = F.lit(None)
    for i, x in enumerate(kinds):
        line = F.when(k % len(kinds) == i, x).otherwise(line)
    return o.select("o_orderkey", line.alias("t"))


def result_lines(spark, d):
    """Names and points of lines that hold exactly one score between two names."""
    return _lines(spark, d).select("o_orderkey", X.result_line(F.col("t")).alias("r")).where("r is not null").select("o_orderkey", "r.*")


def _titles(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", "source", "n_chars", S.normal_name(F.substring_index("text", "\n", 1)).alias("title"))


def dedupe_cross_source_titles(spark, d):
    """Equal normal titles (a first line of 30 characters or more stands for one) of different sources: each points at the canonical one; rows of its own source don't.

    Canonical is what is visible, then already read, then oldest, then best in its feed (unranked last), then the smallest id.
    Lengths stand in for those four.
    """
    t = _titles(spark, d).where(F.length("title") >= 30)
    n = F.col("n_chars")
    w = Window.partitionBy("title").orderBy((n % 2 == 0).desc(), (n % 3 == 0).desc(), (n % 7).asc(), F.nullif(n % 5, F.lit(0)).asc_nulls_last(), F.asc("doc_id"))
    c = t.select("doc_id", "source", F.first("doc_id").over(w).alias("duplicate_of"), F.first("source").over(w).alias("kept"))
    return c.where("doc_id <> duplicate_of and source <> kept").select("doc_id", "duplicate_of")


def _surfaces(spark, d):
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    named = p.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("surface"), F.lit("name").alias("origin"))
    alias = p.select(F.lit("part"), "p_partkey", F.concat_ws(" ", "p_brand", "p_type"), F.lit("alias"))
    other = s.select(F.lit("supplier"), "s_suppkey", "s_name", F.lit("name"))
    every = named.union(alias).union(other).withColumn("norm", S.normal_name(F.col("surface"))).where("norm <> ''")
    return keys.ranked_first(every, ["kind", "id", "norm"], [F.desc("origin"), F.asc("surface")])


def nrm_surfaces(spark, d):
    return _surfaces(spark, d).select("kind", "id", "norm", "origin")


def resolve_names_verdict(spark, d):
    """Each distinct brand-and-kind name: no entity unresolved, one linked, several refused."""
    asked = table(spark, d, "part").select(S.normal_name(F.concat_ws(" ", "p_brand", "p_type")).alias("norm")).union(table(spark, d, "nation").select(S.normal_name(F.col("n_name")))).distinct()
    hits = _surfaces(spark, d).groupBy("norm").agg(F.countDistinct("kind", "id").alias("n"), F.min("id").alias("id"))
    j = asked.join(hits, "norm", "left")
    return j.select("norm", F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "linked").otherwise("refused").alias("verdict"), F.when(F.col("n") == 1, F.col("id")).alias("id"))


def directory_tokens(spark, d):
    """Suppliers and nations with their distinct, sorted name tokens."""
    e = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name")).unionByName(table(spark, d, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")))
    return e.select("kind", "id", F.array_join(F.array_sort(F.array_distinct(F.split(S.normal_name(F.col("name")), " "))), " ").alias("tokens"))


def _claims(spark, d):
    """Claims about orders, a customer's being one packet: agreed, not agreed, or yet to be."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    state = F.when(F.col("o_orderstatus") == "F", "has been agreed").when(F.col("o_orderstatus") == "O", "isn\u2019t agreed").otherwise("is yet to be agreed")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("packet"), F.concat_ws(" ", F.lit("The"), "o_orderpriority", "c_mktsegment", F.lit("deal of"), F.round("o_totalprice").cast("long"), state).alias("t"))


def contested_pairs(spark, d):
    """Claims of one packet whose stems overlap by half of the smaller set, one of them denying.

    A pair of overlap 0.5 shares one of the rarer half of the smaller set's stems: those alone meet, on Spark, and only ids travel.
    """
    rows = written(_claims(spark, d).select("id", "packet", X.stem_set(F.col("t")).alias("stems"), X.denies(F.col("t")).alias("denies")).where(F.size("stems") > 0), "claims")
    seen = rows.select("id", "packet", "denies", F.size("stems").alias("n"), F.explode("stems").alias("stem"))
    often = seen.groupBy("packet", "stem").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("packet", "id").orderBy("often", "stem"))
    short = seen.join(often, ["packet", "stem"]).withColumn("place", place).where(F.col("place") <= F.floor(F.col("n") / 2) + 1)  # all but ceil(n / 2) - 1 of them
    met = short.alias("a").join(seen.alias("b"), ["packet", "stem"]).where("a.denies <> b.denies and (a.n < b.n or a.n = b.n and a.denies)")
    x, y = (F.when(F.col("a.denies") == one, F.col("a.id")).otherwise(F.col("b.id")) for one in (True, False))
    pairs, sets = met.select(x.alias("x"), y.alias("y")).distinct(), rows.select("id", "stems")
    both = pairs.join(sets.select(F.col("id").alias("x"), F.col("stems").alias("s")), "x").join(sets.select(F.col("id").alias("y"), F.col("stems").alias("t")), "y")
    return both.withColumn("overlap", F.round(X.overlap(F.col("s"), F.col("t")), 6)).where("overlap >= 0.5").select("x", "y", "overlap")


def routing_tags(spark, d):
    """Topic to routing tag and bucket, by kind of event."""
    e = table(spark, d, "events")
    tag = F.when(F.col("event_type") == "purchase", "transfer").when(F.col("event_type").isin("click", "view"), "form").when(F.col("event_type") == "signup", "profile")
    return e.select("event_id", F.concat_ws(",", tag, F.when(F.abs("value") > 100, "charged")).alias("tags"), F.when(tag == "transfer", "transfer").when(tag.isNotNull(), "other").alias("bucket"))


def news_impact(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct(F.lower("event_type")).alias("s"), F.max("ts").alias("at"))
    age = (F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp_ltz"))) / 3_600_000_000.0
    return e.select("user_id", X.news_impact(F.col("n").cast("double"), F.col("s"), age).alias("impact"))


def unresolved_rollup(spark, d):
    """Sources by how many documents they have in each language, and the first head line: the ten most frequent."""
    t = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min_by(F.substring("text", 1, 40), "doc_id").alias("first"))
    return t.orderBy(F.desc("n"), "source", "lang").limit(10)


def funnel_report(spark, d):
    """By source: labelled documents, how many are bad or toxic, share rejected; at least ten labelled."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return j.where("n >= 10").select("source", "n", "bad", "toxic", F.round(100.0 * F.col("bad") / F.col("n"), 4).alias("reject_pct"))


def calibration_brier(spark, d):
    """Length as a forecast of quality: mean squared error and hit rate by decile."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select((F.least(F.col("n_chars"), F.lit(4000)) / 4000.0).alias("p"), F.col("quality").alias("y"))
    g = j.withColumn("decile", F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int")).groupBy("decile")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("forecast"), F.round(F.avg("y"), 6).alias("rate"), F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 6).alias("brier"))


QUERIES = {f.__name__: f for f in (
    html_title, html_extract, html_clean, text_guards, content_hash, word_counts, truncated, quote_slice, result_lines, dedupe_cross_source_titles, nrm_surfaces, resolve_names_verdict,
    directory_tokens, contested_pairs, routing_tags, news_impact, unresolved_rollup, funnel_report, calibration_brier,
)}


def _norm(x: str) -> str:
    for double, plain in S.LIGATURES.items():
        x = f"replace({x}, '{double}', '{plain}')"
    return f"trim(regexp_replace(lower(translate({x}, '{S.ACCENTED}', '{S.PLAIN}')), '[^a-z0-9]+', ' ', 'g'))"


_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


def _blocks(x: str, *tags: str) -> str:
    for tag in tags:
        x = f"regexp_replace({x}, '(?is)<{tag}.*?(</{tag}>|\\z)', '', 'g')"
    return x


def _clean(x: str) -> str:
    x = f"trim(regexp_replace(regexp_replace({_blocks(x, 'script', 'style')}, '<[^>]*(>|\\z)|>', ' ', 'g'), '\\s+', ' ', 'g'))"
    for a, b in X.ENTITIES:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: strlen(w) > 1)"


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _part(tag: str) -> str:
    """The first of the longest blocks."""
    return f"list_sort(list_transform(regexp_extract_all(bare, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1), lambda b, i: {{'n': -strlen(b), 'i': i, 'b': b}}))[1].b"


_FOREIGN = "[" + "".join(f"\\x{{{a:04x}}}-\\x{{{b:04x}}}" for a, b in X.FOREIGN) + "]"
_CLAIM = r"list_filter(regexp_split_to_array(regexp_replace(lower(t), '[''’]', '', 'g'), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_TOKENS = "list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')"
_SCORE = "'^(\\d{1,9})[-–—:]+(\\d{1,9})$'"
_LINE = """CASE o_orderkey % 9 """ + " ".join(f"WHEN {i} THEN c_name || ' ' || o_orderkey % 5 || '{x}' || o_orderkey % 7 || ' ' || away" for i, x in enumerate(("-", "–", "—", ":"))) + """ WHEN 4 THEN c_name || ' 2024-25 ' || away
  WHEN 5 THEN c_name || ' ' || o_orderkey % 5 || '-' || o_orderkey % 7 || ' ' || away || ' ' || o_orderkey % 5 || '-' || o_orderkey % 7 WHEN 6 THEN o_orderkey % 5 || '-' || o_orderkey % 7 || ' ' || away
  WHEN 7 THEN c_name || o_orderkey % 5 || '-' || o_orderkey % 7 || ' ' || away ELSE c_name || ' of 2024-25 ' || o_orderkey % 5 || '-' || o_orderkey % 7 || ' ' || away END"""

_SURFACE = f"""su AS (SELECT * FROM (SELECT *, {_norm('surface')} AS norm FROM (SELECT 'part' AS kind, p_partkey AS id, p_name AS surface, 'name' AS origin FROM part UNION ALL SELECT 'part', p_partkey, p_brand || ' ' || p_type, 'alias' FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name, 'name' FROM supplier)) WHERE norm <> ''
  QUALIFY row_number() OVER (PARTITION BY kind, id, norm ORDER BY origin DESC, surface) = 1)"""

ORACLES = {
    "html_title": f"SELECT page_id, left({_clean(_TITLE)}, 500) AS title, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') AS domain FROM pages",
    "html_clean": f"SELECT page_id, md5({_clean('html')}) AS hash FROM pages",
    "html_extract": f"""WITH b AS (SELECT page_id, {_blocks('html', *X.CHROME)} AS bare FROM pages), p AS (SELECT page_id, {_clean(_part('article'))} AS a, {_clean(_part('main'))} AS m, {_clean('bare')} AS w FROM b),
      t AS (SELECT page_id, CASE WHEN len({_words('a')}) >= 80 THEN a WHEN len({_words('m')}) >= 80 THEN m ELSE w END AS t FROM p)
      SELECT page_id, CAST(len(t) AS INTEGER) AS n_chars, left(sha256(trim(regexp_replace(t, '\\s+', ' ', 'g'))), 32) AS hash FROM t""",
    "text_guards": rf"""SELECT doc_id, regexp_matches(text, '{_FOREIGN}') AS foreign_script, CAST(len(regexp_extract_all(text, '[.!?]+(\s|$)')) AS INTEGER) AS sentences, regexp_matches(text, '[0-9]') AS has_digits,
      regexp_matches(lower(text), '{"|".join(X.PAYWALL)}') AS paywalled, regexp_matches(lower(text), 'licensed under|all rights reserved') AS banned FROM documents""",
    "content_hash": r"SELECT doc_id, left(sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))), 32) AS hash FROM documents",
    "word_counts": r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: strlen(w) > 1)) AS INTEGER) AS words FROM documents",
    "truncated": r"SELECT doc_id, left(regexp_replace(text, '[*_]{1,3}([^*_\n]+)[*_]{1,3}', '\1', 'g'), 120) AS head FROM documents",
    "quote_slice": "SELECT doc_id, substr(text, greatest(p - 160, 1), least(p, 161) + 159 + 7) AS quote FROM (SELECT doc_id, text, instr(lower(text), 'license') AS p FROM documents) WHERE p > 0",
    "result_lines": f"""WITH l AS (SELECT o_orderkey, {_LINE} AS t FROM (SELECT *, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS away FROM orders JOIN customer ON o_custkey = c_custkey)), w AS (SELECT o_orderkey, {_TOKENS} AS w FROM l),
      s AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: coalesce(TRY_CAST(regexp_extract(w[i], {_SCORE}, 1) AS INTEGER) <= 150 AND TRY_CAST(regexp_extract(w[i], {_SCORE}, 2) AS INTEGER) <= 150, false)) AS i FROM w)
      SELECT o_orderkey, array_to_string(w[:i[1] - 1], ' ') AS home, CAST(regexp_extract(w[i[1]], {_SCORE}, 1) AS INTEGER) AS home_score, CAST(regexp_extract(w[i[1]], {_SCORE}, 2) AS INTEGER) AS away_score, array_to_string(w[i[1] + 1:], ' ') AS away FROM s WHERE len(i) = 1 AND i[1] > 1 AND i[1] < len(w)""",
    "dedupe_cross_source_titles": f"""WITH t AS (SELECT doc_id, source, n_chars, {_norm("string_split(text, chr(10))[1]")} AS title FROM documents), c AS (SELECT *, first_value(doc_id) OVER w AS duplicate_of, first_value(source) OVER w AS kept FROM t WHERE len(title) >= 30 WINDOW w AS (PARTITION BY title ORDER BY n_chars % 2 = 0 DESC, n_chars % 3 = 0 DESC, n_chars % 7, nullif(n_chars % 5, 0) NULLS LAST, doc_id))
      SELECT doc_id, duplicate_of FROM c WHERE doc_id <> duplicate_of AND source <> kept""",
    "nrm_surfaces": f"WITH {_SURFACE} SELECT kind, id, norm, origin FROM su",
    "resolve_names_verdict": f"""WITH {_SURFACE}, a AS (SELECT DISTINCT {_norm("p_brand || ' ' || p_type")} AS norm FROM part UNION SELECT {_norm('n_name')} FROM nation), h AS (SELECT norm, count(DISTINCT (kind, id)) AS n, min(id) AS id FROM su GROUP BY norm)
      SELECT norm, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'linked' ELSE 'refused' END AS verdict, CASE WHEN n = 1 THEN id END AS id FROM a LEFT JOIN h USING (norm)""",
    "directory_tokens": f"WITH e AS (SELECT 'supplier' AS kind, CAST(s_suppkey AS BIGINT) AS id, s_name AS name FROM supplier UNION ALL SELECT 'nation', CAST(n_nationkey AS BIGINT), n_name FROM nation) SELECT kind, id, array_to_string(list_sort(list_distinct(string_split({_norm('name')}, ' '))), ' ') AS tokens FROM e",
    "contested_pairs": f"""WITH f AS (SELECT o_orderkey AS id, o_custkey AS packet, concat_ws(' ', 'The', o_orderpriority, c_mktsegment, 'deal of', CAST(round(o_totalprice) AS BIGINT), CASE o_orderstatus WHEN 'F' THEN 'has been agreed' WHEN 'O' THEN 'isn’t agreed' ELSE 'is yet to be agreed' END) AS t FROM orders JOIN customer ON o_custkey = c_custkey), w AS (SELECT *, {_CLAIM} AS words FROM f),
      m AS (SELECT id, packet, list_distinct(list_filter(list_transform(list_filter(words, lambda w: NOT list_contains({_list(X.STOPWORDS + X.NEGATIONS)}, w)), lambda w: left(w, 5)), lambda w: strlen(w) > 1)) AS stems, regexp_matches(lower(t), '{"|".join(X.NEGATION_PHRASES)}') OR list_has_any(words, {_list(X.NEGATIONS)}) AS denies FROM w)
      SELECT * FROM (SELECT a.id AS x, b.id AS y, round(len(list_intersect(a.stems, b.stems)) / least(len(a.stems), len(b.stems))::DOUBLE, 6) AS overlap FROM m a JOIN m b ON a.packet = b.packet AND a.denies AND NOT b.denies WHERE len(a.stems) > 0 AND len(b.stems) > 0) WHERE overlap >= 0.5""",
    "routing_tags": "SELECT event_id, concat_ws(',', tag, CASE WHEN abs(value) > 100 THEN 'charged' END) AS tags, CASE WHEN tag = 'transfer' THEN 'transfer' WHEN tag IS NOT NULL THEN 'other' END AS bucket FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN 'transfer' WHEN event_type IN ('click', 'view') THEN 'form' WHEN event_type = 'signup' THEN 'profile' END AS tag FROM events)",
    "news_impact": """WITH e AS (SELECT user_id, count(*) AS n, count(DISTINCT lower(event_type)) AS s, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 3600000000.0::DOUBLE AS age FROM events GROUP BY user_id)
      SELECT user_id, CAST(round(60 * (1 - exp(-n / 5.0::DOUBLE)) + least(25, 6 * s) + CASE WHEN age <= 12 THEN 15 WHEN age <= 24 THEN 10 WHEN age <= 48 THEN 5 ELSE 0 END) AS INTEGER) AS impact FROM e""",
    "unresolved_rollup": "SELECT source, lang, count(*) AS n, arg_min(left(text, 40), doc_id) AS first FROM documents GROUP BY ALL ORDER BY n DESC, source, lang LIMIT 10",
    "funnel_report": "SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 0) AS bad, count(*) FILTER (WHERE toxic = 1) AS toxic, round(100.0::DOUBLE * count(*) FILTER (WHERE quality = 0) / count(*), 4) AS reject_pct FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING count(*) >= 10",
    "calibration_brier": "WITH j AS (SELECT least(n_chars, 4000) / 4000.0::DOUBLE AS p, quality AS y FROM documents JOIN labels USING (doc_id)) SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS decile, count(*) AS n, round(avg(p), 6) AS forecast, round(avg(y), 6) AS rate, round(avg(pow(p - y, 2)), 6) AS brier FROM j GROUP BY 1",
}
