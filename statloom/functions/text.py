"""Text functions: page text, guards, small scores. Column expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that are page furniture, dropped with all they hold, in this order.
CHROME = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript", "svg", "iframe", "button", "select", "textarea", "template", "figure")
# Entities that are decoded, in this order (so that "&amp;lt;" becomes "<").
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"))
# Phrases of pages behind a wall.
PAYWALL = ("subscribe", "subscription", "sign in", "sign up", "register to continue")
# Scripts that English prose doesn't use (Cyrillic, Hebrew, Arabic, Devanagari, Thai, kana, Han, Hangul).
FOREIGN = ((0x0400, 0x04FF), (0x0590, 0x05FF), (0x0600, 0x06FF), (0x0900, 0x097F), (0x0E00, 0x0E7F), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF))
# Words and phrases that deny a claim.
NEGATIONS = (
    "not", "no", "never", "nor", "denied", "denies", "deny", "rejected", "rejects", "reject", "refused", "refuses", "without", "wont", "isnt", "arent", "hasnt", "havent",
    "doesnt", "dont", "didnt", "cannot", "cant", "false", "unfounded", "dismissed", "off", "collapsed", "failed", "fails", "ruled",
)
NEGATION_PHRASES = ("yet to", "far from", "no agreement", "not agreed")
# Words that say nothing of what a claim is about.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "at", "for", "with", "from", "by", "as", "is", "are", "was", "were", "be", "been", "being", "has", "have", "had",
    "will", "would", "could", "should", "may", "might", "that", "this", "it", "its", "his", "her", "their", "he", "she", "they", "we", "you", "i", "said", "says", "say", "after",
    "before", "over", "into", "about", "who", "which", "than", "then", "there", "here", "up", "out", "if", "so",
)
LEAST_ARTICLE_WORDS = 80


def normal_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def decode_entities(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def without_blocks(c: Column, *tags: str) -> Column:
    """Elements removed with all they hold, tag by tag; one that is never closed takes the rest."""
    for tag in tags:
        c = F.regexp_replace(c, rf"(?is)<{tag}.*?(</{tag}>|\z)", "")
    return c


def clean_html(c: Column) -> Column:
    """The text of a page: no scripts and styles, no tags (one that is never closed takes the rest), single spaces, entities decoded at last."""
    bare = F.regexp_replace(without_blocks(c, "script", "style"), r"<[^>]*(>|\z)|>", " ")
    return decode_entities(normal_space(bare))


def largest_block(c: Column, tag: str) -> Column:
    """The longest text between a tag and the next end of one, null if there is none.

    A tag within such a stretch ends at the same place, so its own is shorter.
    """
    blocks = F.regexp_extract_all(c, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.try_element_at(F.array_sort(blocks, lambda a, b: F.octet_length(b) - F.octet_length(a)), F.lit(1))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being worked out once however often use has it."""
    return F.transform(F.array(value), use)[0]


def article_text(c: Column, least_words: int = LEAST_ARTICLE_WORDS) -> Column:
    """The article's text if it is long enough, else the main part's, else that of the whole page, each without furniture."""
    long_enough = lambda x: F.when(count_words(x) >= least_words, x)
    part = lambda bare, tag: _once(clean_html(largest_block(bare, tag)), long_enough)
    return _once(without_blocks(c, *CHROME), lambda bare: F.coalesce(part(bare, "article"), part(bare, "main"), clean_html(bare)))


def html_title(c: Column) -> Column:
    return F.substring(clean_html(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)), 1, 500)


def domain_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^www\.", "")


def count_words(c: Column) -> Column:
    """Words of two bytes or more."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: F.octet_length(w) > 1))


def looks_paywalled(c: Column) -> Column:
    return F.lower(c).rlike("|".join(PAYWALL))


def sentences(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[.!?]+(\s|$)"))


def foreign_script(c: Column) -> Column:
    return c.rlike("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in FOREIGN) + "]")


def strip_emphasis(c: Column) -> Column:
    return F.regexp_replace(c, r"[*_]{1,3}([^*_\n]+)[*_]{1,3}", "$1")


def claim_words(c: Column) -> Column:
    """Lower-case words of letters and digits; apostrophes join ("won't" is "wont")."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), "['\u2019]", ""), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def denies(c: Column) -> Column:
    said = F.lower(c)
    phrase = F.lit(False)
    for x in NEGATION_PHRASES:
        phrase = phrase | said.contains(x)
    return phrase | F.exists(claim_words(c), lambda w: w.isin(*NEGATIONS))


def stem_set(c: Column) -> Column:
    """Distinct beginnings, five characters long, of the words that carry a claim; denials aside."""
    words = F.filter(claim_words(c), lambda w: ~w.isin(*STOPWORDS, *NEGATIONS))
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.substring(w, 1, 5)), lambda w: F.octet_length(w) > 1))


def overlap(a: Column, b: Column) -> Column:
    """Shared share of the smaller set."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)).cast("double"), F.lit(0.0))


SCORE = r"^(\d{1,9})[-\u2013\u2014:]+(\d{1,9})$"
MOST_POINTS = 150  # more is a year, not a score


def result_line(c: Column) -> Column:
    """home, home_score, away_score, away of a line that holds exactly one score, as a word of its own between two names; else null."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    points = lambda w, k: F.regexp_extract(w, SCORE, k).try_cast("int")
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.coalesce((points(F.get(words, i), 1) <= MOST_POINTS) & (points(F.get(words, i), 2) <= MOST_POINTS), F.lit(False)))
    one = F.get(at, F.lit(0))
    name = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    found = F.struct(name(F.lit(1), one).alias("home"), points(F.get(words, one), 1).alias("home_score"), points(F.get(words, one), 2).alias("away_score"), name(one + 2, F.size(words)).alias("away"))
    return F.when((F.size(at) == 1) & (one > 0) & (one < F.size(words) - 1), found)


def news_impact(reports: Column, sources: Column, age_hours: Column) -> Column:
    """0 to 100, a whole number. sources: distinct ones, in lower case."""
    fresh = F.when(age_hours <= 12, 15).when(age_hours <= 24, 10).when(age_hours <= 48, 5).otherwise(0)
    return F.round(60 * (1 - F.exp(-reports / 5.0)) + F.least(F.lit(25), 6 * sources) + fresh).cast("int")


def notability(top: Column, high: Column, composite: Column) -> Column:
    """0 to 100, a whole number. top: highest percentile of any rate; high: how many reach 85; composite: 50 where unknown."""
    score = 0.6 * top + F.least(F.lit(30.0), 10.0 * high) + F.least(F.greatest(0.4 * (F.coalesce(composite, F.lit(50.0)) - 50), F.lit(-10.0)), F.lit(10.0))
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0))).cast("int")


def quote_slice(c: Column, needle: str | Column, around: int = 160) -> Column:
    """So many characters either side of the first place of needle (lower case); null without one."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    at = F.position(needle, F.lower(c))
    return F.when(at > 0, F.substring(c, F.greatest(at - around, F.lit(1)), F.least(at, F.lit(around + 1)) + around - 1 + F.length(needle)))
