"""Periodic runs of words by internal pattern matching, and texts with their repeats taken out.

A run is a stretch of words with smallest period q (words q apart are equal), long enough (``least`` words and ``times``
periods), that can't be made longer. A run of four periods holds an aligned block of b words, b the power of two with
b / 2 < q <= b, and a period's room on one of its sides; there the block occurs again, q words off and no nearer. So, for
every dyadic block, its next and its last occurrence in the neighbouring windows of b words (with itself an arithmetic
progression) give the only candidate periods. Occurrences of a block are an interval of the suffix array, found by prefix
doubling, which passes through just those block lengths; a wavelet matrix over the suffix array answers the range
successor queries, all at once. Candidates are extended to both ends and kept if long enough. Blocks of one word have
windows of one word, which are compared.

Texts are worked on some megabytes at a time; nothing is shuffled, so a hot source or group of copies costs nothing
extra. Memory grows with the block, or with a longer text: about 50 times its bytes where words have two letters.

Defined results: null and empty texts have no runs and become the empty text; repeated rows each keep their row; a very
long text is searched whole; ties don't occur, as all runs are returned, by start and then period; an empty table gives
an empty result; columns of the input that clash with an added name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import text_blocks, without

LEAST, TIMES = 6, 4
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True
_QUERIES = 1 << 18  # answered together
_WORDS = 1 << 16  # written out together


class RangeSuccessor:
    """A wavelet matrix over integers: of those in a range of places, how many are below x, and which is the k-th smallest."""

    def __init__(self, values: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        words = len(values) // 64 + 1
        for bit in range(int(values.max(initial=1)).bit_length() - 1, -1, -1):
            ones = (values >> bit) & 1 == 1
            packed = np.zeros(8 * words, np.uint8)
            some = np.packbits(ones, bitorder="little")
            packed[: len(some)] = some
            packed = packed.view("<u8")
            upto = np.zeros(words + 1, np.int32)
            np.cumsum(np.bitwise_count(packed), out=upto[1:])
            self.levels.append((bit, packed, upto, len(values) - int(upto[-1])))
            values = np.concatenate([values[~ones], values[ones]])

    @staticmethod
    def _ones(packed: np.ndarray, upto: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return upto[word] + np.bitwise_count(packed[word] & mask)

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        found = np.zeros(len(lo), np.int64)
        for bit, packed, upto, zeros in self.levels:
            a, b = self._ones(packed, upto, lo), self._ones(packed, upto, hi)
            up = (x >> bit) & 1 == 1
            found += np.where(up, hi - lo - b + a, 0)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
        return found

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """k counts from 0 and is below hi - lo."""
        found = np.zeros(len(lo), np.int64)
        for bit, packed, upto, zeros in self.levels:
            a, b = self._ones(packed, upto, lo), self._ones(packed, upto, hi)
            less = hi - lo - b + a
            up = k >= less
            found += up.astype(np.int64) << bit
            k = np.where(up, k - less, k)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
        return found


def _occurring_blocks(seq: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffix array, and by dyadic length the aligned blocks that occur more than once: (length, starts, first and last place in the array)."""
    n = len(seq)
    array = np.argsort(seq, kind="stable").astype(np.int32)
    begins = np.flatnonzero(np.append(True, np.diff(seq[array]) != 0))
    sizes = np.diff(np.append(begins, n))
    rank, many = np.empty(n, np.int32), np.zeros(n, np.int32)  # a class is named by its first place
    rank[array] = np.repeat(begins, sizes)
    many[begins] = sizes
    levels, b = [], 1
    while True:
        if b > 1:
            starts = np.arange(0, n - b + 1, b, dtype=np.int32)
            lo = rank[starts]
            again = many[lo] > 1
            levels.append((b, starts[again], lo[again], (lo + many[lo])[again]))
        if b >= longest:
            break
        places = np.flatnonzero(many[rank[array]] > 1)  # only classes of several are parted further
        if not len(places):
            break
        some = array[places]
        key = rank[some].astype(np.int64) * n + rank[some + b]  # a stretch that occurs twice holds no border, so another word follows
        order = np.argsort(key, kind="stable")
        some, key = some[order], key[order]
        array[places] = some
        begins = np.flatnonzero(np.append(True, np.diff(key) != 0))
        sizes = np.diff(np.append(begins, len(key)))
        rank[some] = np.repeat(places[begins], sizes)
        many[places[begins]] = sizes
        b *= 2
    return array, levels


def _certain(seq: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches that have a period for certain, from blocks and their neighbouring occurrences: (begin, end, period)."""
    same = np.flatnonzero(seq[1:] == seq[:-1]).astype(np.int32)
    begins, ends, periods = [same], [same + 2], [np.ones(len(same), np.int32)]
    array, levels = _occurring_blocks(seq, longest)
    if sum(len(s) for _, s, _, _ in levels):
        tree = RangeSuccessor(array)
        for b, all_starts, all_lo, all_hi in levels:
            for i in range(0, len(all_starts), _QUERIES):
                start, lo, hi = (x[i : i + _QUERIES].astype(np.int64) for x in (all_starts, all_lo, all_hi))
                before = tree.below(lo, hi, start)
                for k, exists in ((before + 1, before + 1 < hi - lo), (before - 1, before > 0)):
                    which = np.flatnonzero(exists)
                    other = tree.smallest(lo[which], hi[which], k[which])
                    period = np.abs(other - start[which])
                    near = (2 * period > b) & (period <= b)
                    first = np.minimum(other, start[which])[near]
                    begins.append(first.astype(np.int32))
                    ends.append((first + period[near] + b).astype(np.int32))
                    periods.append(period[near].astype(np.int32))
    return tuple(np.concatenate(x) for x in (begins, ends, periods))


def _matches(seq: np.ndarray, at: int, period: int, step: int) -> int:
    """How many words from at on, in the direction of step, equal those a period further in the other one."""
    found, width = 0, 16
    while True:
        if step > 0:
            high = min(len(seq), at + width)
            differ = seq[at:high] != seq[at - period : high - period]
        else:
            low = max(0, at + 1 - width)
            differ = (seq[low : at + 1] != seq[low + period : at + 1 + period])[::-1]
        k = int(differ.argmax()) if differ.any() else len(differ)
        found += k
        if k < len(differ) or not len(differ):
            return found
        at += step * k
        width *= 2


def runs_of(seq: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period), sorted. seq ends in a word that occurs nowhere else, and so does each text in it."""
    begin, end, period = _certain(seq, longest)
    order = np.lexsort((begin, period))
    begin, end, period = begin[order], end[order], period[order]
    # Of one period all stretches are equally long; those that share a period's words are parts of one.
    apart = np.flatnonzero(np.append(True, (period[1:] != period[:-1]) | (begin[1:] > end[:-1] - period[1:])))[: len(begin)]
    last = np.append(apart[1:], len(begin)) - 1
    found = set()
    for b, e, q in zip(begin[apart].tolist(), end[last].tolist(), period[apart].tolist(), strict=True):
        e += _matches(seq, e, q, 1)
        b -= _matches(seq, b - 1, q, -1) if b else 0
        if e - b >= max(least, times * q):
            found.add((b, e - b, q))
    return np.array(sorted(found), np.int64).reshape(-1, 3)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block of texts: where each begins, its bytes, and how many words lie before each text."""
    solid = ~_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    final = solid.copy()
    final[:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]  # a text's end ends a word
    begin[edges] = solid[edges]
    final[edges - 1] = solid[edges - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(final) + 1 - starts, np.searchsorted(starts, offsets)


def _names(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each distinct word."""
    border = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=border[1:])
    solid = data[~_SPACE[data]]
    coded = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(border), pa.py_buffer(solid)]).dictionary_encode()
    return coded.indices.to_numpy()


def _repeated_tail(n: int, g: int) -> np.ndarray:
    """Word numbers where all from a certain one on repeat its first few, by the number g."""
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def _joined(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, upto: np.ndarray) -> pa.Array:
    """The words, one space between those of a text; upto are the texts' borders among the words."""
    out = np.empty(int(sizes.sum()) + len(sizes), np.uint8)
    ends = np.cumsum(sizes + 1)
    data = np.append(data, np.uint8(32))
    for i in range(0, len(starts), _WORDS):
        size = sizes[i : i + _WORDS] + 1
        stop = ends[i : i + _WORDS]
        low = int(stop[0] - size[0])
        at = np.repeat(starts[i : i + _WORDS] - (stop - size - low), size) + np.arange(int(stop[-1]) - low)
        out[low : int(stop[-1])] = data[at]
    out[ends - 1] = 32
    borders = np.append(0, ends)[upto]
    some = upto[1:] > upto[:-1]
    keep = np.ones(len(out), bool)
    keep[borders[1:][some] - 1] = False
    borders = borders - np.append(0, np.cumsum(some))
    return pa.Array.from_buffers(pa.string(), len(upto) - 1, [None, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(out[keep])])


def searched(data: np.ndarray, offsets: np.ndarray, tails: list[int | None], least: int = LEAST, times: int = TIMES) -> tuple[pa.Array, pa.Array]:
    """Of a block of texts: each one's runs, and the text without what repeats."""
    starts, sizes, upto = _words(data, offsets)
    counts = np.diff(upto)
    which = np.arange(len(starts))
    for i, g in enumerate(tails):
        if g is not None and counts[i]:
            which[upto[i] : upto[i + 1]] = upto[i] + _repeated_tail(int(counts[i]), g)
    names = _names(data, sizes)[which]
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(names)) + text  # a border after each text
    seq = np.full(len(names) + len(counts), -1, np.int32)
    seq[place] = names
    seq[upto[1:] + np.arange(len(counts))] = len(names) + np.arange(len(counts))
    found = runs_of(seq, int(counts.max(initial=0)) // times, least, times)
    first = upto[:-1] + np.arange(len(counts))
    owner = np.searchsorted(first, found[:, 0], "right") - 1
    again = np.zeros(len(seq) + 1, np.int64)
    np.add.at(again, found[:, 0] + found[:, 2], 1)
    np.add.at(again, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(again[:-1])[place] == 0
    words = which[kept]
    left = _joined(data, starts[words], sizes[words], np.append(0, np.cumsum(kept))[upto])
    runs = pa.StructArray.from_arrays([pa.array(found[:, 0] - first[owner]), pa.array(found[:, 1]), pa.array(found[:, 2])], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(counts) + 1)), pa.int32()), runs), left


def find_runs(docs: DataFrame, text: str = "text", tail: Column | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with runs (array of start, length, period) and collapsed (words joined by one space, those after any run's first period left out).

    Where tail, a number, isn't null, the text's end is first overwritten by repeats of its own words: a planted run.
    """

    @arrow_udf("runs array<struct<start:long,length:long,period:long>>, collapsed string")
    def search(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, tails in batches:
            numbers, got, at = tails.to_pylist(), [], 0
            for data, offsets in text_blocks(texts):
                got.append(searched(data, offsets, numbers[at : at + len(offsets) - 1], least, times))
                at += len(offsets) - 1
            runs, left = ([x[i] for x in got] for i in (0, 1))
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            whole = [pa.concat_arrays(runs), pa.concat_arrays(left)] if got else [pa.array([], kind), pa.array([], pa.string())]
            yield pa.StructArray.from_arrays(whole, ["runs", "collapsed"])

    docs = without(docs, "runs", "collapsed")
    found = search(F.col(f"`{text}`"), F.lit(None).cast("long") if tail is None else tail.cast("long"))
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns), found.alias("_found")).select(*(F.col(f"`{c}`") for c in docs.columns), "_found.runs", "_found.collapsed")


def digested(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of figures a text: its number of runs, the run of the most periods, and hashes of all runs and of what is left."""

    def more_periods(a: Column, b: Column) -> Column:
        ahead = a.length * b.period - b.length * a.period
        return F.when(ahead != 0, F.when(ahead > 0, -1).otherwise(1)).when(a.start != b.start, F.when(a.start < b.start, -1).otherwise(1)).when(a.period < b.period, -1).when(a.period > b.period, 1).otherwise(0)

    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))), "")
    best = F.when(F.size("runs") > 0, F.array_sort("runs", more_periods)[0])
    return found.select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(key, "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
