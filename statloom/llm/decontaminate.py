"""Benchmark decontamination: pigeonhole edit matching.

Texts and test items are reduced to lower-case letters and digits with single spaces between them. An item of m
characters may differ by BUDGET * m edits anywhere. Cut into one piece more than that, one piece at least stands in the
document unchanged, and one of those is followed by a piece with one edit at most (the pieces form a ring, so the last
one, which the first would follow, always counts). Documents are streamed once through an automaton of all pieces;
where one is hit and the next agrees so far, Myers' bit-parallel algorithm measures the distance between the item and
the best stretch around.

Documents are scanned where they lie, without a shuffle; items are sent in blocks of ITEM_BYTES at most, one scan a
block, so a benchmark of any size fits the workers.

Defined results: null and empty texts hold nothing; null ids are kept as null; items so short that the
budget allows no edit must stand word for word, and items without letters or digits match nothing; however long a text
is and however often it repeats itself, each stretch of it is measured once an item; repeated documents and items each get their
rows; of an item's places in a document the nearest counts, the first of equals; empty tables give an empty result;
input columns beside id and text are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import held, text_blocks, utf8_bytes

BUDGET = 0.1
ITEM_BYTES = 4 << 20

_KEEP = np.full(256, 32, np.uint8)
_KEEP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
_KEEP[65:91] = range(97, 123)


def plain(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Each text reduced; a character of the result is a byte."""
    got = _KEEP[data]
    space = got == 32
    drop = space.copy()
    drop[1:] &= space[:-1]
    drop[:1] = space[:1]
    starts = offsets[:-1][offsets[:-1] < len(got)]
    drop[starts] = space[starts]
    kept = np.flatnonzero(~drop)
    borders = np.searchsorted(kept, offsets)
    whole = got[kept].tobytes().decode("latin-1")
    return [whole[a:b].rstrip(" ") for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]


def best_match(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Smallest edit distance between a pattern of m characters and a stretch of text, and the first end of such a stretch."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        d0 = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(d0 | up)), up & d0
        score += 1 if plus & top else -1 if minus & top else 0
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(d0 | plus)), plus & d0
        if score < best:
            best, end = score, at + 1
    return best, end


def begins_nearly(text: str, at: int, piece: str) -> bool:
    """Whether some stretch of text from at on is the piece but for one edit."""
    if text.startswith(piece, at):
        return True
    i = 0
    while at + i < len(text) and text[at + i] == piece[i]:
        i += 1
    return text.startswith(piece[i + 1 :], at + i + 1) or text.startswith(piece[i + 1 :], at + i) or text.startswith(piece[i:], at + i + 1)


def merged(windows: list[list[int]]) -> list[list[int]]:
    """The same places as stretches that don't overlap, so that each is looked at once however often it was hit."""
    out: list[list[int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


class Finder:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[int, str]], budget: float):
        import ahocorasick

        self.items, pieces = [], {}
        for item_id, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            own = plain(raw, np.array([0, len(raw)]))[0]
            if not own:
                continue
            k = int(budget * len(own))
            masks: dict[str, int] = {}
            for i, c in enumerate(own):
                masks[c] = masks.get(c, 0) | 1 << i
            cuts = [len(own) * i // (k + 1) for i in range(k + 2)]
            for a, b, c in zip(cuts[:-1], cuts[1:], [*cuts[2:], None], strict=True):
                pieces.setdefault(own[a:b], []).append((len(self.items), a, own[b:c] if c else ""))
            self.items.append((item_id, own, k, masks))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[dict]:
        """The items in a reduced text."""
        if not text or not self.items:
            return []
        found: dict[int, tuple[int, int]] = {}
        windows: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for i, at, following in where:
                if following and not begins_nearly(text, last + 1, following):
                    continue
                _, own, k, _ = self.items[i]
                begin = last - size + 1 - at
                a, b = max(0, begin - k), min(len(text), begin + len(own) + k)
                if not k:  # word for word, by itself
                    if (a == 0 or text[a - 1] == " ") and (b == len(text) or text[b : b + 1] == " "):
                        found.setdefault(i, (0, b))
                    continue
                mine = windows.setdefault(i, [])
                if mine and a <= mine[-1][1] and b >= mine[-1][0]:  # hits come nearly in order, so most overlap the last one
                    mine[-1] = [min(a, mine[-1][0]), max(b, mine[-1][1])]
                else:
                    mine.append([a, b])
        for i, mine in windows.items():
            _, own, k, masks = self.items[i]
            for a, b in merged(mine):
                distance, end = best_match(masks, len(own), text[a:b])
                if distance <= k and (i not in found or (distance, a + end) < found[i]):
                    found[i] = distance, a + end
        return [{"item_id": self.items[i][0], "distance": d, "budget": self.items[i][2], "end_at": end} for i, (d, end) in sorted(found.items())]


FOUND = "array<struct<item_id:long,distance:int,budget:int,end_at:long>>"
_FOUND = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("budget", pa.int32()), ("end_at", pa.int64())]))


def found_in(items: list[tuple[int, str]], spark, budget: float = BUDGET):
    """A column function: the items that each text holds."""
    name, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(items)

    @arrow_udf(FOUND)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held(name, lambda: Finder(sent.value, budget))
        for texts in batches:
            for data, offsets in text_blocks(texts):
                yield pa.array([own.find(t) for t in plain(data, offsets)], _FOUND)

    return search


def _blocks(benchmark: DataFrame, item: str, item_text: str) -> Iterator[list[tuple[int, str]]]:
    """The items, about ITEM_BYTES at a time."""
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).cast("long").alias("id"), F.col(item_text).alias("text"))
    blocks = max(1, -(-(items.agg(F.sum(utf8_bytes("text"))).first()[0] or 0) // ITEM_BYTES))
    for i in range(blocks):
        yield [(r.id, r.text) for r in items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", budget: float = BUDGET) -> DataFrame:
    """key, item_id, distance, budget and end_at (place in the reduced text) of every item in every document."""
    out = None
    for block in _blocks(benchmark, item, item_text):
        found = docs.select(key, found_in(block, docs.sparkSession, budget)(F.coalesce(F.col(text), F.lit(""))).alias("f")).select(key, F.inline_outer("f")).where("distance is not null")  # a plain inline adds a filter that searches again
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", budget: float = BUDGET) -> DataFrame:
    """docs without those that hold an item."""
    for block in _blocks(benchmark, item, item_text):
        docs = docs.where(F.size(found_in(block, docs.sparkSession, budget)(F.coalesce(F.col(text), F.lit("")))) == 0)
    return docs
