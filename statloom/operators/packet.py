"""Packets: what a story's articles say, as one row. Headline, topics, register, claims, facts, quotes, tags, fingerprints, unresolved names.

Only a story's newest MOST_MEMBERS articles count (an article is in a story once), chosen before anything is gathered (the
rank is pruned on both sides of the shuffle), so a packet's row is bounded however large its story is. Claims are deduplicated and ranked by shuffles of their
own; quotes are cut on the articles' rows, so texts are never gathered.

Defined results: the newest is the latest published, then the largest article; unknown times are the oldest. Claims are the
same only byte for byte, and belong to who said them first; the newest MOST_CLAIMS stay, and each other one's article is named.
A headline has the lowest feed rank (none is last), then the newest, then the smallest article; a register is what most
articles have, then the newest's, neutral ones aside; blank titles, facts, registers and names are nothing. A story without
articles has no packet; one without participants no quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote_slice
from ..session import written
from .keys import ranked_first

# How much a packet holds.
MOST_MEMBERS, MOST_CLAIMS, MOST_QUOTES, MOST_UNRESOLVED = 200, 200, 6, 50
# The tags of a topic, and participants' roles in their order.
TAGS = {t: [t] for t in ("transfer", "injury", "roster", "contract", "performance", "fixture", "general")} | {"suspension": ["injury", "suspension"]}
ROLES = ("subject", "opponent", "passing_mention")


def stripped(c: Column) -> Column:
    """Without white space around; empty for null."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def fingerprint(*parts: Column) -> Column:
    """128 bits of the parts, nulls as empty."""
    return F.substring(F.sha2(F.concat_ws("\x1e", *(F.coalesce(p, F.lit("")) for p in parts)).cast("binary"), 256), 1, 32)


def members_of(articles: DataFrame) -> DataFrame:
    """Each packet's newest articles with pos, 0 for the newest; topics and registers in lower case. Only keys are ranked; texts come from the rows that the chosen keys find."""
    keys = articles.select("packet", "article", "published")
    chosen = written(ranked_first(keys, ["packet"], [F.desc_nulls_last("published"), F.desc("article")], MOST_MEMBERS, "_place").drop("published"), "chosen")
    w = articles.join(chosen, ["packet", "article"])
    own = {c: F.lower(stripped(F.col(c))) for c in ("story_type", "register")}
    return w.withColumns({**own, "pos": F.col("_place") - 1}).drop("_place")


def claims_of(members: DataFrame) -> DataFrame:
    """packet, claims (newest first, MOST_CLAIMS at most) and dropped (the articles of the others)."""
    said = members.select("packet", "pos", "article", "source", "published", "story_type", F.posexplode("facts").alias("i", "fact")).withColumn("fact", stripped(F.col("fact"))).where("fact <> ''")
    first = F.max_by(F.struct("pos", "i", "article", "source", "published", "story_type"), F.struct("pos", -F.col("i")))
    one = said.groupBy("packet", "fact").agg(first.alias("f")).select("packet", "fact", "f.*")
    placed = ranked_first(one, ["packet"], [F.asc("pos"), F.desc("i")], None, "place")
    kept = F.col("place") <= MOST_CLAIMS
    of = lambda *c: F.struct("place", *c)
    got = placed.groupBy("packet").agg(F.array_sort(F.collect_list(F.when(kept, of("article", "source", "fact", "published", "story_type")))).alias("claims"), F.array_sort(F.collect_list(F.when(~kept, of("article")))).alias("_d"))
    return got.select("packet", "claims", F.transform("_d", lambda d: d.article).alias("dropped"))


def quotes_of(members: DataFrame, participants: DataFrame) -> DataFrame:
    """packet and quotes: from each of the newest articles, around the first participant that it names."""
    role = F.lower(stripped(F.col("role")))
    order = F.coalesce(*(F.when(role == r, i) for i, r in enumerate(ROLES)), F.lit(len(ROLES)))
    cast = participants.where(stripped(F.col("name")) != "").groupBy("packet").agg(F.array_sort(F.collect_list(F.struct(order.alias("order"), "entity_type", "entity", "name"))).alias("cast"))
    named = members.join(cast, "packet").select("packet", "pos", "article", "source", "body", F.get(F.filter("cast", lambda e: F.contains(F.lower("body"), F.lower(e["name"]))), F.lit(0)).alias("e"))
    cut = named.where("e is not null").select("packet", "pos", "article", "source", "e.entity_type", "e.entity", quote_slice(F.col("body"), F.lower("e.name")).alias("quote"))
    return ranked_first(cut, ["packet"], [F.asc("pos")], MOST_QUOTES).groupBy("packet").agg(F.array_sort(F.collect_list(F.struct("pos", "article", "source", "entity_type", "entity", "quote"))).alias("quotes"))


def unresolved_of(members: DataFrame, mentions: DataFrame) -> DataFrame:
    """packet and unresolved: names by how often they are mentioned, in their first form, with the first descriptor there is."""
    at = F.struct("pos", "i")
    m = mentions.join(members.select("packet", "article", "pos"), ["packet", "article"]).withColumn("key", F.lower(stripped(F.col("name")))).where("key <> ''")
    described = F.when(stripped(F.col("descriptor")) != "", F.struct("pos", "i", "descriptor"))
    n = m.groupBy("packet", "key").agg(F.count("*").alias("mentions"), F.min_by(F.struct("name", "kind"), at).alias("n"), F.min(described)["descriptor"].alias("descriptor"))
    top = ranked_first(n.select("packet", "mentions", "n.*", "descriptor"), ["packet"], [F.desc("mentions"), F.asc("name")], MOST_UNRESOLVED)
    return top.groupBy("packet").agg(F.array_sort(F.collect_list(F.struct((-F.col("mentions")).alias("_m"), "name", "kind", F.coalesce("descriptor", F.lit("")).alias("descriptor"), "mentions"))).alias("unresolved"))


def compiled(articles: DataFrame, participants: DataFrame, mentions: DataFrame) -> DataFrame:
    """One packet for each story.

    articles: packet, article, source, title, feed_rank, published, body, story_type, register, phrase, facts (list), result_line;
    participants: packet, entity_type, entity, role, name; mentions: packet, article, i (place in the article), name, kind, descriptor.
    """
    m = written(members_of(articles), "members")
    late = F.lit((1 << 31) - 1)
    titled = F.when(stripped(F.col("title")) != "", F.struct(F.coalesce("feed_rank", late).alias("r"), (-F.coalesce("published", F.lit(0))).alias("p"), "article", "title"))
    line = F.when(stripped(F.col("result_line")) != "", F.struct("pos", "result_line"))
    moved = (F.col("register") != "") & (F.col("register") != "neutral")
    head = m.groupBy("packet").agg(
        F.count("*").alias("members"),
        F.min(titled)["title"].alias("headline"),
        F.min(line)["result_line"].alias("result_line"),
        F.collect_list(F.when(F.col("story_type") != "", F.col("story_type"))).alias("_types"),
        F.array_sort(F.collect_list(F.when(moved, F.struct("pos", "register", stripped(F.col("phrase")).alias("phrase"))))).alias("_moods"),
    )
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    types = F.transform(F.array_sort(F.transform(F.array_distinct("_types"), lambda t: F.struct((-times(F.col("_types"), t)).alias("n"), t.alias("t")))), lambda s: s.t)
    moods = F.transform("_moods", lambda x: x.register)
    register = F.array_min(F.transform("_moods", lambda x: F.struct((-times(moods, x.register)).alias("n"), x.pos.alias("pos"), x.register.alias("register"))))["register"]
    head = head.withColumns({"story_types": types, "register": register})
    phrase = F.get(F.filter("_moods", lambda x: (x.register == F.col("register")) & (x.phrase != "")), F.lit(0))["phrase"]
    known = F.create_map(*(x for t, tags in TAGS.items() for x in (F.lit(t), F.array(*(F.lit(g) for g in tags)))))
    none = F.array().cast("array<string>")
    tags = F.flatten(F.transform("story_types", lambda t: F.coalesce(F.try_element_at(known, t), none)))
    head = head.withColumns({"phrase": phrase, "tags": F.array_sort(F.array_distinct(F.concat(tags, F.when(F.col("register").isNotNull(), F.array(F.lit("charged"))).otherwise(none))))}).drop("_types", "_moods")

    whole = head.join(claims_of(m), "packet", "left").join(quotes_of(m, participants), "packet", "left").join(unresolved_of(m, mentions), "packet", "left")
    one = lambda c: F.concat_ws("\x1f", c.article.cast("string"), F.coalesce(c.source, F.lit("")), c.fact, F.coalesce(c.published.cast("string"), F.lit("")), c.story_type)
    text = lambda cs: F.array_join(F.transform(cs, one), "\x1e")
    moves = F.filter("claims", lambda c: c.story_type == "transfer")
    slices = {"narratives": fingerprint(F.col("headline"), text(F.col("claims"))), "vibe": fingerprint(F.col("register"), F.col("phrase"), text(F.col("claims"))), "transfers": fingerprint(text(moves))}
    return whole.withColumn("fingerprints", F.create_map(*(x for n, c in slices.items() for x in (F.lit(n), c))))
