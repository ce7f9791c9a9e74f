"""Packets of stories. Documents are articles; those of one source are a story, their lines its facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import packet
from ..sources.tables import table

TYPES = ("transfer", " Injury", "suspension", "form", "", "general")
REGISTERS = ("neutral", "joy", "Anger", "", "joy", "grief")
# Participants of every story: (entity_type, entity, role, name); names are looked for in the texts.
CAST = [("word", 3, "passing_mention", "The"), ("word", 1, "Subject ", "license"), ("word", 2, "opponent", "email"), ("word", 4, None, "a"), ("word", 5, "subject", " ")]


def _of(names, key):
    return F.element_at(F.array(*(F.lit(n) for n in names)), (key % len(names) + 1).cast("int"))


def _articles(spark, d):
    docs = table(spark, d, "documents")
    n = F.coalesce("n_chars", F.lit(0))
    lines = F.split(F.col("text"), "\n")
    return docs.select(
        F.coalesce("source", F.lit("-")).alias("packet"),
        F.col("doc_id").alias("article"),
        F.col("lang").alias("source"),
        lines[0].alias("title"),
        F.when(F.col("doc_id") % 3 != 0, n % 50).alias("feed_rank"),
        F.when(F.col("doc_id") % 13 != 0, F.col("doc_id") * 37 % 1000).alias("published"),
        F.col("text").alias("body"),
        _of(TYPES, n).alias("story_type"),
        _of(REGISTERS, n + F.col("doc_id")).alias("register"),
        F.when(n % 2 == 0, F.concat(F.lit("said at "), n)).alias("phrase"),
        lines.alias("facts"),
        F.when(n % 5 == 0, F.concat(F.lit("One "), n % 4, F.lit("-"), n % 3, F.lit(" Two"))).alias("result_line"),
    )


def packet_full(spark, d):
    """Every source's packet from its newest articles, its lists as text."""
    a = _articles(spark, d)
    cast = a.select("packet").distinct().crossJoin(F.broadcast(spark.createDataFrame(CAST, "entity_type string, entity int, role string, name string")))
    words = a.select("packet", "article", F.posexplode(F.slice(F.split(F.col("title"), " "), 1, 3)).alias("i", "name"), F.col("source").alias("kind"), F.col("source"))
    mentions = words.select("packet", "article", "i", "name", "kind", F.when(F.col("i") > 0, F.col("source")).alias("descriptor"))
    p = packet.compiled(a, cast, mentions)
    row = lambda *c: F.concat_ws("|", *(F.coalesce(x.cast("string"), F.lit("")) for x in c))
    text = lambda c, one: F.coalesce(F.array_join(F.transform(c, one), ";"), F.lit(""))
    return p.select(
        "packet", "members", "headline", "result_line", "register", "phrase",
        F.array_join("story_types", ",").alias("story_types"), F.array_join("tags", ",").alias("tags"), F.size("claims").alias("claims"), text("dropped", lambda x: x.cast("string")).alias("dropped"),
        text("quotes", lambda q: row(q.article, q.source, q.entity, q.quote)).alias("quotes"),
        text("unresolved", lambda u: row(u["name"], u.kind, u.descriptor, u.mentions)).alias("unresolved"),
        *(F.col("fingerprints")[s].alias(f"{s}_slice") for s in ("narratives", "vibe", "transfers")),
    )


QUERIES = {"packet_full": packet_full}


def _sql() -> str:
    pick = lambda names, key: "[" + ", ".join(f"'{n}'" for n in names) + f"][CAST(({key}) % {len(names)} AS INTEGER) + 1]"
    strip = lambda c: f"regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"
    cast = ", ".join(f"({packet.ROLES.index(r.strip().lower()) if r else 3}, {e}, '{n.lower()}')" for _, e, r, n in CAST if n.strip())
    one = "concat_ws(chr(31), CAST(article AS VARCHAR), coalesce(source, ''), fact, coalesce(CAST(published AS VARCHAR), ''), story_type)"
    tags = ", ".join(f"('{t}', '{g}')" for t, gs in packet.TAGS.items() for g in gs)
    mark = lambda *parts: "substr(sha256(" + " || chr(30) || ".join(f"coalesce({p}, '')" for p in parts) + "), 1, 32)"
    return f"""
WITH articles AS (
    SELECT coalesce(source, '-') AS packet, doc_id AS article, lang AS source, string_split(text, chr(10)) AS facts, text AS body, coalesce(n_chars, 0) AS n,
        CASE WHEN doc_id % 3 <> 0 THEN coalesce(n_chars, 0) % 50 END AS feed_rank, CASE WHEN doc_id % 13 <> 0 THEN doc_id * 37 % 1000 END AS published
    FROM documents
),
m AS (
    SELECT *, facts[1] AS title, lower({strip(pick(TYPES, 'n'))}) AS story_type, lower({strip(pick(REGISTERS, 'n + article'))}) AS register,
        CASE WHEN n % 2 = 0 THEN 'said at ' || n END AS phrase, CASE WHEN n % 5 = 0 THEN 'One ' || n % 4 || '-' || n % 3 || ' Two' END AS result_line
    FROM (SELECT *, row_number() OVER (PARTITION BY packet ORDER BY published DESC NULLS LAST, article DESC) - 1 AS pos FROM articles) WHERE pos < 200
),
said AS (SELECT packet, pos, article, source, published, story_type, unnest(facts) AS raw, unnest(range(len(facts))) AS i FROM m),
clean AS (SELECT * EXCLUDE (raw), {strip('raw')} AS fact FROM said),
firsts AS (SELECT * FROM clean WHERE fact <> '' QUALIFY row_number() OVER (PARTITION BY packet, fact ORDER BY pos DESC, i) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY packet ORDER BY pos, i DESC) AS place FROM firsts),
claims AS (
    SELECT packet, count(*) FILTER (WHERE place <= 200) AS claims, coalesce(string_agg(CAST(article AS VARCHAR), ';' ORDER BY place) FILTER (WHERE place > 200), '') AS dropped,
        string_agg({one}, chr(30) ORDER BY place) FILTER (WHERE place <= 200) AS told, string_agg({one}, chr(30) ORDER BY place) FILTER (WHERE place <= 200 AND story_type = 'transfer') AS moved
    FROM placed GROUP BY packet
),
heads AS (
    SELECT packet, count(*) AS members, arg_min(title, (coalesce(feed_rank, 2147483647), -coalesce(published, 0), article)) FILTER (WHERE {strip('title')} <> '') AS headline,
        arg_min(result_line, pos) FILTER (WHERE result_line IS NOT NULL) AS result_line
    FROM m GROUP BY packet
),
types AS (SELECT packet, string_agg(story_type, ',' ORDER BY k DESC, story_type) AS story_types FROM (SELECT packet, story_type, count(*) AS k FROM m WHERE story_type <> '' GROUP BY ALL) GROUP BY packet),
moods AS (SELECT packet, register FROM (SELECT packet, register, count(*) AS k, min(pos) AS p FROM m WHERE register NOT IN ('', 'neutral') GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY packet ORDER BY k DESC, p) = 1),
phrases AS (SELECT packet, arg_min(phrase, pos) AS phrase FROM m JOIN moods USING (packet, register) WHERE phrase IS NOT NULL GROUP BY packet),
known(story_type, tag) AS (VALUES {tags}),
tagged AS (SELECT packet, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT packet, tag FROM m JOIN known USING (story_type) UNION SELECT packet, 'charged' FROM moods) GROUP BY packet),
actors(role, entity, name) AS (VALUES {cast}),
named AS (SELECT packet, pos, article, source, body, entity, name, position(name IN lower(body)) AS spot FROM m, actors WHERE contains(lower(body), name) QUALIFY row_number() OVER (PARTITION BY packet, pos ORDER BY role, entity) = 1),
cut AS (SELECT *, row_number() OVER (PARTITION BY packet ORDER BY pos) AS k, substr(body, greatest(spot - 160, 1), least(spot, 161) + 159 + length(name)) AS quote FROM named),
quotes AS (SELECT packet, string_agg(article || '|' || coalesce(source, '') || '|' || entity || '|' || quote, ';' ORDER BY pos) AS quotes FROM cut WHERE k <= 6 GROUP BY packet),
words AS (SELECT packet, pos, source, unnest(string_split(title, ' ')[1:3]) AS name, unnest(range(least(len(string_split(title, ' ')), 3))) AS i FROM m),
counted AS (
    SELECT packet, lower({strip('name')}) AS key, count(*) AS mentions, arg_min((name, source), (pos, i)) AS n, coalesce(arg_min(source, (pos, i)) FILTER (WHERE i > 0 AND {strip('source')} <> ''), '') AS descriptor
    FROM words WHERE {strip('name')} <> '' GROUP BY ALL
),
unresolved AS (
    SELECT packet, string_agg(n[1] || '|' || coalesce(n[2], '') || '|' || descriptor || '|' || mentions, ';' ORDER BY mentions DESC, n[1]) AS unresolved
    FROM (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY packet ORDER BY mentions DESC, n[1]) <= 50) GROUP BY packet
)
SELECT packet, members, headline, result_line, register, phrase, coalesce(story_types, '') AS story_types, coalesce(tags, '') AS tags, claims, coalesce(dropped, '') AS dropped,
    coalesce(quotes, '') AS quotes, coalesce(unresolved, '') AS unresolved,
    {mark('headline', 'told')} AS narratives_slice, {mark('register', 'phrase', 'told')} AS vibe_slice, {mark('moved')} AS transfers_slice
FROM heads LEFT JOIN claims USING (packet) LEFT JOIN types USING (packet) LEFT JOIN moods USING (packet) LEFT JOIN phrases USING (packet)
    LEFT JOIN tagged USING (packet) LEFT JOIN quotes USING (packet) LEFT JOIN unresolved USING (packet)
"""


ORACLES = {"packet_full": _sql()}
