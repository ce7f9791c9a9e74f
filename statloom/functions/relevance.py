"""Whether a page reports on one of ours, from what a reader noted of it: its kind, the entities' roles, the names with their descriptors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of page that report nothing; words of places; words of clubs and players.
NOT_REPORTING = ("score_table", "listing_or_schedule", "roundup")
PLACE_WORDS = ("city", "capital", "town", "village", "municipality")
CLUB_WORDS = ("club", "team", "side", "fc", "squad", "rivals", "rival", "derby", "manager", "coach", "player", "striker", "keeper", "goalkeeper", "midfielder", "defender", "forward", "winger", "captain")


def _same(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def names_place(descriptor: Column) -> Column:
    """A descriptor with a place's word and none of a club's; null has none."""
    words = F.split(F.lower(descriptor), r"[^\p{L}\p{N}]+")
    listed = lambda given: F.arrays_overlap(words, F.array(*(F.lit(w) for w in given)))
    return F.coalesce(listed(PLACE_WORDS) & ~listed(CLUB_WORDS), F.lit(False))


def is_ours(ours: Column, name: Column) -> Column:
    """Whether a name is one of ours, with or without what stands there in brackets."""
    n = F.trim(name)
    return (n != "") & F.exists(ours, lambda o: _same(F.trim(F.substring_index(o, " (", 1)), n) | _same(F.trim(o), n))


def relevant(kind: Column, roles: Column, ours: Column, names: Column) -> Column:
    """roles: array of (entity, role); ours: array of strings; names: array of (name, descriptor).

    Without roles or ours there is no ground to reject. A role of ours counts unless it is absent, is described as a place, or is a
    mention in passing that the names don't hold. Where no role is ours, a name of ours that isn't a place counts.
    """
    listed = lambda entity: F.exists(names, lambda n: _same(n["name"], F.trim(entity)))
    placed = lambda entity: F.exists(names, lambda n: _same(n["name"], F.trim(entity)) & names_place(n["descriptor"]))
    own = F.filter(roles, lambda r: is_ours(ours, r["entity"]))
    by_role = F.exists(own, lambda r: (F.lower(r["role"]) != "absent") & ~placed(r["entity"]) & ((F.lower(r["role"]) != "passing_mention") | listed(r["entity"])))
    by_name = F.exists(names, lambda n: is_ours(ours, n["name"]) & ~names_place(n["descriptor"]))
    bare = (F.size(roles) <= 0) | (F.size(ours) <= 0)
    return F.when(F.lower(kind).isin(*NOT_REPORTING), False).when(bare, True).when(F.size(own) > 0, by_role).otherwise(by_name)
