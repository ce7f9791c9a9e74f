"""Story assembly: articles in time order either join the best open story or open one.

Order matters only among articles that could meet in one story. An article joins a story if it names half of the cast
of the story's first article; so it shares two names with that one, or one name if that one has two at most.
Articles that share such a key are linked, and each connected component is folded by itself, in time order: as many
folds as there are components, however large a part (a sport, a language) is. A component that holds much of the table
is one order by definition. Rows stream through a task, whose state is the open stories of the last fortnight.

Defined results: articles without id or time are left out; equal times go by article; names that repeat count once, null ones never; an
article without names opens a story of its own; a backfill leaves it without one.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import chain, combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .components import components

PERSON, TEAM, SAME_TYPE, FRESH = 2, 1, 1, 1  # what a shared person, team, kind and recent touch count
ATTACH_OVER, FRESH_HOURS, WINDOW_DAYS = 3, 48, 14
EDGES = "part string, article long, story long, opened boolean"


def covers(seed: frozenset, cast: frozenset) -> bool:
    """Whether an article names half of a story's first cast."""
    return 2 * len(seed & cast) >= len(seed)


def choose(stories: list[dict], persons: frozenset, teams: frozenset, kind: str, at: int) -> dict | None:
    """The story with the best score over ATTACH_OVER; ties to the freshest, then the lowest id. Times are microseconds."""
    best = None
    for s in stories:
        score = PERSON * len(s["persons"] & persons) + TEAM * len(s["teams"] & teams) + SAME_TYPE * (kind == s["kind"]) + FRESH * (at - s["seen"] <= FRESH_HOURS * HOUR)
        if score > ATTACH_OVER and covers(s["seed"], persons | teams):
            key = (-score, -s["seen"], s["id"])
            if best is None or key < best[0]:
                best = key, s
    return None if best is None else best[1]


HOUR = 3_600_000_000
_EPOCH = datetime(1970, 1, 1)


def _seed_keys(seed: frozenset) -> list:
    """Of a first cast: an article that names half of it shares one of these, as ``_cast_keys`` lists them."""
    return sorted(seed) if len(seed) <= 2 else list(combinations(sorted(seed), 2))


def _cast_keys(cast: frozenset) -> chain:
    return chain(cast, combinations(sorted(cast), 2))


class Fold:
    """The open stories of one component.

    A story is looked up by two names of its first cast (one, where that has two at most), which an article that may join
    it shares; so a name that all stories hold makes no article look at all of them. Stories that were opened without
    names, of which no half is asked, are looked up by any name.
    """

    def __init__(self) -> None:
        self.stories: dict[int, dict] = {}
        self.by_seed: dict[object, set[int]] = defaultdict(set)
        self.naming: dict[tuple, set[int]] = defaultdict(set)  # of stories opened without names
        self.touched: deque = deque()  # (when, story), oldest first

    def _close_before(self, at: int) -> None:
        while self.touched and at - self.touched[0][0] >= WINDOW_DAYS * 24 * HOUR:
            when, number = self.touched.popleft()
            s = self.stories.get(number)
            if s and s["seen"] == when:
                del self.stories[number]
                for index, keys in ((self.by_seed, _seed_keys(s["seed"])), (self.naming, () if s["seed"] else self._named(s["persons"], s["teams"]))):
                    for e in keys:
                        index[e].discard(number)
                        if not index[e]:
                            del index[e]

    @staticmethod
    def _named(persons: frozenset, teams: frozenset) -> list[tuple]:
        return [*(("p", x) for x in persons), *(("t", x) for x in teams)]

    def add(self, article: int, at: datetime | int, kind: str, persons, teams, settled: int | None = None) -> int:
        """The article's story: the settled one, else the one chosen. A story's id is its first article's. at: microseconds, or a time."""
        at = at if isinstance(at, int) else (at - _EPOCH) // timedelta(microseconds=1)
        self._close_before(at)
        persons, teams = frozenset(persons), frozenset(teams)
        if settled is None:
            near = set().union(*(self.by_seed[k] for k in _cast_keys(persons | teams) if k in self.by_seed), *(self.naming[e] for e in self._named(persons, teams) if e in self.naming))
            s = choose([self.stories[n] for n in near], persons, teams, kind, at)
        else:
            s = self.stories.get(settled)
        if s is None:
            number = article if settled is None else settled
            s = self.stories[number] = {"id": number, "seed": persons | teams, "persons": persons, "teams": teams, "kind": kind}
            for k in _seed_keys(s["seed"]):
                self.by_seed[k].add(number)
        s["persons"], s["teams"], s["seen"] = s["persons"] | persons, s["teams"] | teams, at
        if not s["seed"]:
            for e in self._named(persons, teams):
                self.naming[e].add(s["id"])
        self.touched.append((at, s["id"]))
        return s["id"]


def _compact(column: str) -> Column:
    return F.coalesce(F.array_compact(F.col(column).cast("array<string>")), F.array().cast("array<string>"))


def _names() -> Column:
    tagged = lambda column, tag: F.transform(_compact(column), lambda x: F.concat(F.lit(tag), x))
    return F.array_sort(F.array_distinct(F.concat(tagged("persons", "p"), tagged("teams", "t"))))


def connected(articles: DataFrame, settled: str | None = None) -> DataFrame:
    """articles with component: the smallest article of those that could, one through the other, meet in one story.

    settled: an expression of the story that an article is in already; such articles are linked to it.
    """
    named = articles.withColumn("names", _names())
    pairs = F.flatten(F.transform("names", lambda x, i: F.transform(F.slice("names", i + 2, F.size("names")), lambda y: F.concat(x, F.lit("\x01"), y))))
    keyed = named.select("part", "article", F.explode(pairs).alias("key"))
    small = named.where(F.size("names") <= 2).select("part", F.explode("names").alias("key")).distinct()
    single = named.select("part", "article", F.explode("names").alias("key")).join(small, ["part", "key"], "left_semi")
    links = keyed.unionByName(single.select("part", "article", "key"))
    first = links.groupBy("part", "key").agg(F.min("article").alias("first"))  # combined before the shuffle
    edges = links.join(first, ["part", "key"]).select(F.col("article").alias("a"), F.col("first").alias("b")).where("a <> b").distinct()
    if settled:
        edges = edges.unionByName(articles.select(F.col("article").alias("a"), F.expr(settled).alias("b")).where("a <> b"))
    roots = components(edges).select(F.col("v").alias("article"), "root")
    return articles.join(roots, "article", "left").withColumn("component", F.coalesce("root", "article")).drop("root")


def _folded(articles: DataFrame, settled: str | None) -> DataFrame:
    """part, article, story, opened of the articles that aren't settled, each component folded in the order of its clock."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, fold = None, Fold()
        for rows in batches:
            out = []
            columns = (rows[c].tolist() for c in ("part", "component", "article", "at", "kind", "persons", "teams", "known", "settled"))
            for part, component, article, when, kind, persons, teams, known, number in zip(*columns, strict=True):
                if (part, component) != at:
                    at, fold = (part, component), Fold()
                got = fold.add(article, when, kind, persons, teams, number if known else None)
                if not known:
                    out.append((part, article, got, got == article))
            yield pd.DataFrame(out, columns=["part", "article", "story", "opened"])

    number = F.lit(None).cast("long") if settled is None else F.col(settled).cast("long")
    own = articles.where("article is not null and at is not null").select(
        "part", "article", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "kind", _compact("persons").alias("persons"), _compact("teams").alias("teams"),
        number.isNotNull().alias("known"), F.coalesce(number, F.lit(0)).alias("settled"),
    )
    grouped = connected(written(own, "articles"), None if settled is None else "if(known, settled, null)")
    return grouped.repartition("part", "component").sortWithinPartitions("part", "component", "at", "article").mapInPandas(run, EDGES)


def assemble(articles: DataFrame) -> DataFrame:
    """articles: part, article (unique), at, kind, persons, teams -> part, article, story, opened."""
    return _folded(articles, None)


def replay(articles: DataFrame, settled: str = "story", method: str = "backfill") -> DataFrame:
    """Stories for the articles without one, as they would have been chosen at the articles' own time: part, article, story, opened, method.

    Articles that are in a story stay there, and take part with their names; those without names stay without a story.
    """
    joining = articles.where(F.col(settled).isNotNull() | (F.size(_names()) > 0))
    return _folded(joining, settled).withColumn("method", F.lit(method))


def replay_faults(articles: DataFrame, edges: DataFrame, settled: str = "story", method: str = "backfill") -> DataFrame:
    """One row of what must be zero in a replay's edges: articles left without a story, in two, or settled already; stories without names; edges of another method."""
    waiting = articles.where(F.col(settled).isNull() & (F.size(_names()) > 0) & F.col("article").isNotNull() & F.col("at").isNotNull())
    cast = articles.select("article", _names().alias("names"))
    left = waiting.join(edges, "article", "left_anti").agg(F.count("*").alias("unstamped"))
    twice = edges.groupBy("article").count().where("count > 1").agg(F.count("*").alias("twice"))
    again = edges.join(articles.where(F.col(settled).isNotNull()), "article", "left_semi").agg(F.count("*").alias("settled_again"))
    empty = edges.join(cast, "article").groupBy("story").agg(F.max(F.size("names")).alias("n")).where("n = 0").agg(F.count("*").alias("nameless"))
    other = edges.where(~F.col("method").eqNullSafe(F.lit(method))).agg(F.count("*").alias("wrong_method"))
    return left.crossJoin(twice).crossJoin(again).crossJoin(empty).crossJoin(other)
