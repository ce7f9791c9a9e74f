"""What served prose may not hold: phrases, marks, digits, names of others, hooks that break their rules. Column expressions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import ACCENTED, PLAIN

# Phrases that a text on momentum may not hold.
MOMENTUM = ("isn't a surge", "isn't a collapse", "the tape calls this", "the engine sees this as", "the momentum engine", "the numbers say", "steady band")
# Words, and marks, that a reading may not hold.
READING = ("notability", "convergence", "sentiment", "z-score", "percentile", "composite", "momentum score", "the omen is", "(", "**")
# Those whom a reading may name, one at most.
PEERS = ("analyst", "insider", "scout", "influencer", "journalist")
HOOK_WORDS = 12


def folded(c: Column) -> Column:
    """Lower case, without accents, with plain quotes."""
    return F.translate(F.lower(F.translate(c, ACCENTED, PLAIN)), "‘’‚‛ʼ“”„", "'''''\"\"\"")


def first_phrase(c: Column, phrases: Iterable[str]) -> Column:
    """The first of the phrases, in their order, that the text holds whatever its case, accents and quotes; null if none."""
    text = folded(c)
    return F.coalesce(*(F.when(text.contains(folded(F.lit(p))), F.lit(p)) for p in phrases), F.lit(None).cast("string"))


def first_exact(c: Column, names: Iterable[str]) -> Column:
    """The first of the names that the text holds as they are written."""
    return F.coalesce(*(F.when(c.contains(n), F.lit(n)) for n in names), F.lit(None).cast("string"))


def named_peers(c: Column, peers: Iterable[str] = PEERS) -> Column:
    """How many different peers are named, each with its article."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return sum((low.contains(f"the {p}").cast("int") for p in peers), F.lit(0))


def hook_violation(c: Column, most: int = HOOK_WORDS) -> Column:
    """The first rule that a title breaks: too many words, a colon, a question mark; null if none."""
    words = F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.when(words > most, "hook_max_words").when(c.contains(":"), "hook_colon").when(c.contains("?"), "hook_question_mark")


def has_digit(c: Column) -> Column:
    return F.coalesce(c.rlike("[0-9]"), F.lit(False))
