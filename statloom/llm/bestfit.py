"""Best-fit packing by linear grouping, planned on the histogram of lengths.

Documents longer than a sequence are cut into full pieces behind a first one that may be shorter. Lengths are whole
numbers up to the capacity, so whatever the table's size its lengths are one histogram of ``capacity`` counts. The plan
is made on that alone:

1. Large lengths, in equal-cardinality groups, are rounded up to the largest of their group: few sizes.
2. Configurations (which sizes fill a sequence together) are optimised by column generation: a linear program over the
   groups, whose new columns come from a knapsack.
3. Actual lengths take the places of rounded ones, the largest that fits each place and leaves room for the rest.
4. What is left, small lengths last, goes best-fit into the tightest room.

Sequences of equal contents stay together as one run, so the plan has a number of rows that is bounded by capacity and
groups, not by the table (some thousands for 1,024). Each piece finds its place by its length and its number among the
pieces of that length. Those numbers are counted by the tasks that encode, and shifted by what earlier tasks hold: no
sort, no group in one task.

Defined results: a null text is an empty document, one piece holding the end id alone; repeated rows are packed each
for itself; a very long text is encoded and cut whole; an empty table gives an empty result; input columns beside id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..session import written
from .encoding import encoder, with_end

LENGTH = 1024
END_ID = 2
GROUPS = 160  # of large lengths
SMALL = 16  # lengths up to capacity // SMALL aren't part of configurations
_EPS = 1e-9
_RANK_BITS = 44


@dataclass
class Run:
    """``bins`` sequences of equal contents: (length, copies) in order, and the room left."""

    bins: int
    contents: list[tuple[int, int]]
    room: int


@dataclass
class Lengths:
    """Counts by length, of which the largest one up to some length is asked for."""

    left: np.ndarray
    lower: list[int] = field(init=False)

    def __post_init__(self) -> None:
        self.lower = list(range(-1, len(self.left) - 1))  # where to look on from a length that is used up

    def largest(self, most: int, taken: dict[int, int]) -> int:
        """The largest length up to most of which any is left beside those taken; 0 if there is none."""
        at = most
        while at > 0:
            root = at
            while root > 0 and not self.left[root]:
                root = self.lower[root]
            while at > root:  # the way is shorter next time
                self.lower[at], at = root, self.lower[at]
            if not root or self.left[root] > taken.get(root, 0):
                return root
            at = root - 1
        return 0


def linear_groups(counts: np.ndarray, groups: int, smallest: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths from smallest on in equal-cardinality groups from the largest down: rounded lengths, descending, and how many of each."""
    total = int(counts[smallest:].sum())
    each = max(1, -(-total // groups))
    rounded: dict[int, int] = {}
    top, room = 0, 0  # the group's largest length, and how many more it takes
    for length in range(len(counts) - 1, smallest - 1, -1):
        n = int(counts[length])
        while n:
            if not room:
                top, room = length, each
            took = min(n, room)
            rounded[top] = rounded.get(top, 0) + took
            n, room = n - took, room - took
    return np.array(list(rounded), np.int64), np.array(list(rounded.values()), np.float64)


def _best_column(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable multiset of sizes within capacity, as copies of each."""
    best = np.zeros(capacity + 1)
    for size, value in zip(sizes.tolist(), values.tolist(), strict=True):
        for _ in range(capacity // size if value > _EPS else 0):
            np.maximum(best[size:], best[:-size] + value, out=best[size:])
    copies, room = np.zeros(len(sizes)), capacity
    worth = np.flatnonzero(values > _EPS)
    while len(worth := worth[sizes[worth] <= room]) and best[room] > _EPS:
        chosen = worth[int(np.argmax(best[room - sizes[worth]] + values[worth]))]
        copies[chosen] += 1
        room -= int(sizes[chosen])
    return copies


def configurations(sizes: np.ndarray, wanted: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Fewest sequences for the wanted numbers of each size, as (copies of each size, sequences), rounded down."""
    k = len(sizes)
    if not k:
        return []
    columns = np.diag((capacity // sizes).astype(float))
    cost, inverse = np.ones(k), np.diag(1.0 / np.diag(columns))
    spread = np.random.default_rng(k).random(k)  # equal groups would make many pivots that lead nowhere
    used = inverse @ (wanted * (1 - 1e-4 * spread))
    for _ in range(40 * k):
        dual = cost @ inverse
        worst = int(np.argmin(dual))
        if dual[worst] < -_EPS:  # more of a size than wanted does no harm
            column, price = np.zeros(k), 0.0
            column[worst] = -1.0
        else:
            column, price = _best_column(dual, sizes, capacity), 1.0
            if dual @ column <= 1 + 1e-7:
                break
        step = inverse @ column
        ahead = np.flatnonzero(step > _EPS)
        if not len(ahead):
            break
        ratios = used[ahead] / step[ahead]
        leaves = int(ahead[np.argmin(ratios)])
        pivot = inverse[leaves] / step[leaves]
        amount = used[leaves] / step[leaves]
        inverse -= np.outer(step, pivot)
        inverse[leaves] = pivot
        used = np.maximum(used - step * amount, 0)
        used[leaves] = amount
        columns[:, leaves], cost[leaves] = column, price
    return [(columns[:, i].astype(int), int(np.floor(used[i] + 1e-6))) for i in range(k) if cost[i] and used[i] >= 1 - 1e-6]


def _substituted(chosen: list[tuple[np.ndarray, int]], sizes: np.ndarray, lengths: Lengths, capacity: int) -> Iterator[Run]:
    """Runs of actual lengths in the configurations: each place takes the largest that leaves the places after it their rounded sizes."""
    for copies, bins in sorted(chosen, key=lambda c: -int(sizes[np.flatnonzero(c[0])[0]])):
        places = np.repeat(sizes, copies).tolist()
        after = np.append(np.cumsum(places[::-1])[::-1][1:], 0).tolist()
        while bins:
            taken: dict[int, int] = {}
            room = capacity
            for rest in after:
                if size := lengths.largest(room - rest, taken):
                    taken[size] = taken.get(size, 0) + 1
                    room -= size
            if not taken:
                break
            n = min(bins, *(int(lengths.left[s]) // c for s, c in taken.items()))
            for s, c in taken.items():
                lengths.left[s] -= c * n
            bins -= n
            yield Run(n, list(taken.items()), room)


def _best_fit(runs: list[Run], left: np.ndarray, capacity: int) -> list[Run]:
    """What is left, longest first, each into the tightest room; new sequences where there is none."""
    rooms: list[list[Run]] = [[] for _ in range(capacity + 1)]
    for run in runs:
        rooms[run.room].append(run)
    for size in np.flatnonzero(left)[::-1].tolist():
        n, room = int(left[size]), size
        while n:
            while room < capacity and not rooms[room]:
                room += 1
            copies = room // size  # in one sequence, as the one just used stays the tightest
            run = rooms[room].pop() if rooms[room] else Run(n // copies + 1, [], capacity)
            full = min(run.bins, n // copies)
            if full:
                into = room - copies * size
                rooms[into].append(Run(full, [*run.contents, (size, copies)], into))
                n -= full * copies
            elif n:
                into = room - n * size
                rooms[into].append(Run(1, [*run.contents, (size, n)], into))
                full, n = 1, 0
            if run.contents and run.bins > full:
                rooms[room].append(Run(run.bins - full, run.contents, room))
    return [run for some in rooms for run in some]


def plan(counts: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Where the pieces of each length go; counts[n] pieces have length n, up to the capacity.

    Rows (length, first number, first sequence, copies in a sequence, offset), sorted: of a length's pieces, those from
    the first number on go to the sequences from the first one on, so many into each, side by side from the offset.
    """
    capacity = len(counts) - 1
    left = counts.astype(np.int64).copy()
    runs = [Run(int(left[capacity]), [(capacity, 1)], 0)] if left[capacity] else []
    left[capacity] = 0
    smallest = capacity // SMALL + 1
    sizes, wanted = linear_groups(left, groups, smallest)
    large = np.where(np.arange(capacity + 1) >= smallest, left, 0)
    placed = Lengths(large.copy())
    runs += _substituted(configurations(sizes, wanted, capacity), sizes, placed, capacity)
    left += placed.left - large
    runs = _best_fit(runs, left, capacity)
    rows, given, first = [], np.zeros(capacity + 1, np.int64), 0
    for run in runs:
        offset = 0
        for size, copies in run.contents:
            rows.append((size, int(given[size]), first, copies, offset))
            given[size] += run.bins * copies
            offset += size * copies
        first += run.bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _numbered(counters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each piece's number among this task's pieces of its length so far."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, len(ordered)))
    out = np.empty(len(lengths), np.int64)
    out[order] = counters[ordered] + np.arange(len(ordered)) - np.repeat(begins, sizes)
    counters[ordered[begins]] += sizes
    return out


def _pieces(docs: DataFrame, path: str, key: str, text: str, length: int, end_id: int | None) -> DataFrame:
    """All pieces: k, piece, start, length, ids, ids_crc32, part (the task), nth (its number among the task's pieces of that length)."""
    kind = dict(docs.dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counters, part = encoder(path, False), np.zeros(length + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            at = 0
            for counts, ids in own.texts(batch.column(1)):
                counts, ids = with_end(counts, ids, end_id)
                pieces = -(-counts // length)
                before = np.cumsum(pieces) - pieces
                number = np.arange(int(pieces.sum())) - np.repeat(before, pieces)
                first = np.repeat(counts - (pieces - 1) * length, pieces)  # the first piece's length
                start = np.where(number == 0, 0, first + (number - 1) * length)
                sizes = np.where(number == 0, first, length)
                places = 4 * (start + np.repeat(np.cumsum(counts) - counts, pieces))
                borders = np.append(places, 4 * len(ids)).astype(np.int32)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]
                owners = pa.array(np.repeat(np.arange(at, at + len(counts)), pieces))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(owners),
                        pa.array(number, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(borders), pa.py_buffer(raw)]),
                        pa.array(crcs, pa.int64()),
                        pa.array(np.full(len(sizes), part), pa.int32()),
                        pa.array(_numbered(counters, sizes), pa.int64()),
                    ],
                    names=["k", "piece", "start", "length", "ids", "ids_crc32", "part", "nth"],
                )
                at += len(counts)

    return docs.select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(cut, f"k {kind}, piece int, start long, length long, ids binary, ids_crc32 long, part int, nth long")


def _place(table: np.ndarray):
    """A column function: sequence and offset of the piece of a length that has a number."""
    begins = (table[:, 0] << _RANK_BITS) + table[:, 1]

    @arrow_udf("sequence_id long, offset long")
    def place(lengths: pa.Array, numbers: pa.Array) -> pa.Array:
        length, number = lengths.to_numpy(), numbers.to_numpy()
        at = np.searchsorted(begins, (length << _RANK_BITS) + number, "right") - 1
        _, first, sequence, copies, offset = table[at].T
        number = number - first
        return pa.StructArray.from_arrays([pa.array(sequence + number // copies), pa.array(offset + number % copies * length)], ["sequence_id", "offset"])

    return place


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int | None = END_ID, groups: int = GROUPS) -> DataFrame:
    """Pieces with key, piece, start, length, ids (binary, little-endian unsigned 32-bit), ids_crc32, sequence_id, offset."""
    pieces = written(_pieces(docs, path, key, text, length, end_id), "bestfit-pieces")
    counted = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = np.zeros(length + 1, np.int64)
    for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row a length
        counts[r.length] = r.n
    numbered = pieces.join(starts, ["part", "length"])
    placed = numbered.withColumn("at", _place(plan(counts, groups))("length", F.col("before") + F.col("nth")))
    return placed.select(F.col("k").alias(key), "piece", "start", "length", "ids", "ids_crc32", "at.sequence_id", "at.offset")
