"""Token-id output: shards of ids in key order, each compressed by a Re-Pair grammar of its own.

A shard's grammar is built in rounds. A round counts every adjacent pair of the whole shard, takes the most frequent
ones and replaces them, left to right, by new nonterminals: PAIRS_PER_ROUND at first, then as many as there are rules
already. A rule costs three symbols (its two sides and its expansion length), so only pairs that stand LEAST_USES times
pay. Numbers are stored in as many bits as the largest of them needs. Rounds end where rules, lengths and symbols no
longer shrink; where that is due to one bit more for every number, the next rounds may win it back, so rounds go on, and
the smallest grammar of all is kept. That is one law for every vocabulary. Pairs that hold the end id are never replaced. Rules come with their expansion lengths, so any range of ids
is decoded from the symbols that cover it and the rules below those, without the rest of the shard.

Files: one Parquet row per shard, with the place of its first id within its part of the key order, the keys and lengths
of its documents and its grammars (rules, expansion lengths, symbols). A shard ends between documents, before it has
more than SHARD_IDS ids; a longer document is a shard of its own, of one grammar for every SHARD_IDS ids. Parts are
written as a stream, a shard at a time, so how large a part is doesn't matter to memory: there is one for each
PART_BYTES of text, MAX_PARTS at most, and beyond that they grow. The starts of the parts are the driver's share: one
number each.

Defined results: a null text is an empty document, one end id; null keys come first; rows with equal keys are in
the order of their positions (pass a table scan or a checkpoint, which is read the same way twice); an empty table gives
an empty result; input columns beside key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_path
from .common import utf8_bytes
from .encoding import encoder, resolved, with_end

PART_BYTES = 8 << 20
MAX_PARTS = 20_000
SHARD_IDS = 4 << 20
END_ID = 1
PAIRS_PER_ROUND = 16_384
LEAST_USES = 4
SLOT_BITS = 21  # of the table in which a round's pairs are looked up
SLICE = 1 << 16  # symbols looked up together


def _frequent(seq: np.ndarray, end_id: int, room: int) -> np.ndarray:
    """The round's pairs, as left << 32 | right, sorted."""
    shift, kind = (16, np.uint32) if int(seq.max(initial=0)) < 1 << 16 else (32, np.uint64)
    pairs = seq[:-1].astype(kind) << kind(shift)
    pairs |= seq[1:]
    inner = seq != end_id
    pairs = pairs[inner[:-1] & inner[1:]]
    pairs.sort()
    many = pairs[LEAST_USES - 1 :] == pairs[: len(pairs) - LEAST_USES + 1] if len(pairs) >= LEAST_USES else np.zeros(0, bool)
    many[1:] &= pairs[1 : len(many)] != pairs[: len(many) - 1] if len(many) else True
    at = np.flatnonzero(many)  # where a pair that stands so often begins
    best = pairs[at]
    if len(at) > room:
        uses = np.searchsorted(pairs, best, "right") - at
        best = best[np.sort(np.argsort(-uses, kind="stable")[:room])]
    best = best.astype(np.uint64)
    return best if shift == 32 else (best >> np.uint64(16)) << np.uint64(32) | best & np.uint64(0xFFFF)


def _slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left * np.uint32(2654435761) ^ right * np.uint32(2246822519)) >> np.uint32(32 - SLOT_BITS)


def _places(seq: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pairs stand, without overlaps (left to right), and which. Of pairs that share a slot only the first: the others wait."""
    left, right = (pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32)
    table = np.full(1 << SLOT_BITS, -1, np.int32)
    table[_slot(left, right)[::-1]] = np.arange(len(pairs) - 1, -1, -1)
    found = [(np.zeros(0, np.int32), np.zeros(0, np.int32))]
    for a in range(0, len(seq) - 1, SLICE):  # slices stay in the processor's caches
        one, two = seq[a : a + SLICE], seq[a + 1 : a + SLICE + 1]
        which = table.take(_slot(one[: len(two)], two))
        at = np.flatnonzero(which >= 0)
        which = which[at]
        ok = (left.take(which) == one.take(at)) & (right.take(which) == two.take(at))
        found.append(((at[ok] + a).astype(np.int32), which[ok]))
    at, which = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(at):
        return at, which
    runs = np.concatenate([[0], np.flatnonzero(at[1:] - at[:-1] != 1) + 1])
    even = (at - np.repeat(at[runs], np.diff(runs, append=len(at)))) & 1 == 0
    return at[even], which[even]


def compress(ids: np.ndarray, base: int, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (left, right), their expansion lengths, and the symbols; rule k is the symbol base + k."""
    seq, rules, lengths = ids.astype(np.uint32), np.zeros((0, 2), np.uint32), np.zeros(0, np.uint32)
    best, size = (rules, lengths, seq), _bits(base, rules, lengths, seq)
    while len(seq) > 1:
        pairs = _frequent(seq, end_id, max(PAIRS_PER_ROUND, len(rules)))
        at, which = _places(seq, pairs) if len(pairs) else (np.zeros(0, np.int64),) * 2
        used = np.bincount(which, minlength=len(pairs)) >= LEAST_USES
        at, which = at[used[which]], which[used[which]]
        if not len(at):
            break
        number = (np.cumsum(used) - 1 + base + len(rules)).astype(np.uint32)
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq.copy()
        seq[at] = number[which]
        seq = seq[stay]
        new = np.stack([pairs[used] >> np.uint64(32), pairs[used] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        lengths = np.concatenate([lengths, _sizes(lengths, base)[new].sum(1).astype(np.uint32)])  # a round's rules use earlier symbols only
        longer = _width(base, rules) < _width(base, np.concatenate([rules, new]))
        rules = np.concatenate([rules, new])
        now = _bits(base, rules, lengths, seq)
        if now < size:
            best, size = (rules, lengths, seq), now
        elif not longer:
            break
    return best


def _width(base: int, rules: np.ndarray) -> int:
    """Bits of the largest symbol."""
    return (base + len(rules) - 1).bit_length()


def _sizes(lengths: np.ndarray, base: int) -> np.ndarray:
    """How many ids each symbol stands for."""
    return np.concatenate([np.ones(base, np.uint32), lengths])


def _bits(base: int, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray) -> int:
    """The size of a grammar as it is stored."""
    return _width(base, rules) * (2 * len(rules) + len(symbols)) + len(rules) * int(lengths.max(initial=0)).bit_length()


def expand(rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, base: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids from start to stop: only symbols that cover them are expanded, level by level."""
    sizes = _sizes(lengths, base)
    ends = np.cumsum(sizes.take(symbols), dtype=np.int64)
    whole = int(ends[-1]) if len(ends) else 0
    stop = whole if stop is None else min(stop, whole)
    if start >= stop:
        return np.zeros(0, np.uint32)
    a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    left = symbols[a:b].astype(np.uint32)
    before = int(ends[a - 1]) if a else 0
    at = np.concatenate([[0], ends[a : b - 1] - before])
    out = np.empty(int(ends[b - 1]) - before, np.uint32)
    first, second = np.ascontiguousarray(rules.T)
    while len(left):
        out[at] = left  # a rule's place is written again by its left side
        more = np.flatnonzero(left >= base)
        at, more = at.take(more), left.take(more) - np.uint32(base)
        left = first.take(more)
        at = np.concatenate([at, at + sizes.take(left)])
        left = np.concatenate([left, second.take(more)])
    return out[start - before : stop - before]


def packed(x: np.ndarray, width: int) -> bytes:
    """Numbers below 2 ** width: their low bytes, the next ones and so on, then the remaining bits, each as a plane of its own."""
    planes = [(x >> np.uint32(8 * k) & np.uint32(255)).astype(np.uint8).tobytes() for k in range(width // 8)]
    return b"".join(planes + [np.packbits(x >> np.uint32(k) & np.uint32(1) > 0).tobytes() for k in range(width // 8 * 8, width)])


def unpacked(data: bytes, width: int, n: int) -> np.ndarray:
    out, raw, at = np.zeros(n, np.uint32), np.frombuffer(data, np.uint8), 0
    for k in range(width // 8):
        out |= raw[at : at + n].astype(np.uint32) << np.uint32(8 * k)
        at += n
    for k in range(width // 8 * 8, width):
        out |= np.unpackbits(raw[at : at + -(-n // 8)], count=n).astype(np.uint32) << np.uint32(k)
        at += -(-n // 8)
    return out


GRAMMAR = "struct<n_ids:bigint,base:int,n_rules:bigint,n_symbols:bigint,length_bits:int,rules:binary,lengths:binary,symbols:binary>"
_GRAMMAR = pa.struct([("n_ids", pa.int64()), ("base", pa.int32()), ("n_rules", pa.int64()), ("n_symbols", pa.int64()), ("length_bits", pa.int32()), ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary())])


def stored(ids: np.ndarray, base: int, end_id: int = END_ID) -> dict:
    """A grammar as it is written."""
    rules, lengths, symbols = compress(ids, base, end_id)
    width, length_bits = _width(base, rules), int(lengths.max(initial=0)).bit_length()
    return {"n_ids": len(ids), "base": base, "n_rules": len(rules), "n_symbols": len(symbols), "length_bits": length_bits, "rules": packed(rules.ravel(), width), "lengths": packed(lengths, length_bits), "symbols": packed(symbols, width)}


def ids_of(grammar: dict, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids of one stored grammar, whole or a range of it."""
    n, base = grammar["n_rules"], grammar["base"]
    width = (base + n - 1).bit_length()
    return expand(unpacked(grammar["rules"], width, 2 * n).reshape(-1, 2), unpacked(grammar["lengths"], grammar["length_bits"], n), unpacked(grammar["symbols"], width, grammar["n_symbols"]), base, start, stop)


class _Shards:
    """Shards of one part, as its documents come."""

    def __init__(self, part: int, base: int, end_id: int, shard_ids: int):
        self.part, self.base, self.end_id, self.shard_ids = part, base, end_id, shard_ids
        self.first = self.n = 0
        self.keys, self.sizes, self.ids = [], [], []

    def take(self, keys: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, ends = 0, np.cumsum(sizes)
        while at < len(sizes):
            before = int(ends[at - 1]) if at else 0
            upto = int(np.searchsorted(ends, before + self.shard_ids - self.n, "right"))
            if upto == at and self.n:  # the next document doesn't fit
                yield self.row()
                continue
            upto = max(upto, at + 1)
            self.keys.append(keys.slice(at, upto - at))
            self.sizes.append(sizes[at:upto])
            self.ids.append(ids[before : int(ends[upto - 1])])
            self.n, at = self.n + int(ends[upto - 1]) - before, upto

    def row(self) -> pa.RecordBatch:
        ids, keys = np.concatenate(self.ids), pa.concat_arrays(self.keys)
        grammars = [stored(ids[i : i + self.shard_ids], self.base, self.end_id) for i in range(0, len(ids), self.shard_ids)]
        columns = {"part": pa.array([self.part], pa.int32()), "first": pa.array([self.first], pa.int64()), "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), "sizes": pa.array([np.concatenate(self.sizes)], pa.list_(pa.int64())), "grammars": pa.array([grammars], pa.list_(_GRAMMAR))}
        self.first, self.n = self.first + len(ids), 0
        self.keys, self.sizes, self.ids = [], [], []
        return pa.RecordBatch.from_pydict(columns)


def write_ids(docs: DataFrame, path: str, out: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, part_bytes: int = PART_BYTES, shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of all texts, in ascending key order, by the vocabulary file at path, as grammar files under out."""
    from tokenizers import Tokenizer

    base = Tokenizer.from_file(resolved(path)).get_vocab_size()
    read = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    total = read.agg(F.sum(utf8_bytes("text") + 16)).first()[0] or 0
    parts = int(min(MAX_PARTS, max(1, -(-total // part_bytes))))
    order = [F.col("k").asc_nulls_first(), F.col("place")]  # the place splits rows of one key
    ordered = read.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("k", "text")
    kind = dict(docs.dtypes)[key]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, shards = encoder(path, False), _Shards(TaskContext.get().partitionId(), base, end_id, shard_ids)
        for batch in batches:
            at = 0
            for counts, ids in own.texts(batch.column("text")):
                counts, ids = with_end(counts, ids, end_id)
                yield from shards.take(batch.column("k").slice(at, len(counts)), counts, ids)
                at += len(counts)
        if shards.n:
            yield shards.row()

    ordered.mapInArrow(rows, f"part int, first long, keys array<{kind}>, sizes array<bigint>, grammars array<{GRAMMAR}>").write.option("compression", "zstd").parquet(out)


def read_ids(spark, out: str, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: key, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    shards = spark.read.parquet(out)
    kind = dict(shards.dtypes)["keys"].removeprefix("array<")[:-1]
    ends = shards.select("part", (F.col("first") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("end"))
    totals = sorted((r.part, r.n) for r in ends.groupBy("part").agg(F.max("end").alias("n")).collect())  # MAX_PARTS at most
    starts = dict(zip((part for part, _ in totals), np.cumsum([0, *(n for _, n in totals)]).tolist(), strict=False))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = batch.column("sizes")[i].values.to_numpy()
                ids = np.concatenate([ids_of(g.as_py()) for g in batch.column("grammars")[i].values])
                first = starts[batch.column("part")[i].as_py()] + batch.column("first")[i].as_py()
                keys, ends = batch.column("keys")[i].values, np.cumsum(sizes)
                for a in range(0, len(sizes), 512):
                    own = slice(a, min(a + 512, len(sizes)))
                    before = int(ends[a] - sizes[a])
                    borders = (4 * np.concatenate([[0], ends[own] - before])).astype(np.int32)
                    binary = pa.Array.from_buffers(pa.binary(), len(borders) - 1, [None, pa.py_buffer(borders), pa.py_buffer(ids[before : ends[own][-1]])])
                    yield pa.RecordBatch.from_arrays([keys[own], pa.array(first + ends[own] - sizes[own]), pa.array(sizes[own]), binary], names=["k", "start", "n_tokens", "ids"])

    return shards.mapInArrow(documents, f"k {kind}, start long, n_tokens long, ids binary").withColumnRenamed("k", key)


def grammar_ids(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, out: str | None = None) -> DataFrame:
    """Writes the files (under out, else in the shared folder) and reads them back."""
    out = out or new_path(docs.sparkSession, "ids")
    write_ids(docs, path, out, key, text, end_id)
    return read_ids(docs.sparkSession, out, key)
