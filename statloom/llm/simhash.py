"""SimHash near-duplicates with pigeonring filtering.

Sketches lie on a ring of segments. If two differ by at most a budget in all, then from some segment on every chain of
consecutive segments stays within its share of the budget (chain length times budget over segments). So a pair need
only meet where its chain begins: on the segments that the shares force to be equal or nearly so. There, longer chains
are checked, and then the whole distance.

Two rings use this:

* ``fingerprints`` and ``link``: 64 bits in four segments of 16, a budget of three. Shares 0.75, 1.5, 2.25 and 3: the
  first segment is equal, the first two differ by one bit at most, three by two. Keys: the first segment and the second
  without one of its bits.
* ``near_duplicates``: texts whose sets of five-word shingles have a similarity of 0.8. Their 64-bit fingerprints
  differ by up to 15 bits, for which no segment is selective (see the README), so this SimHash is wide: 16 segments of
  64 bits, and the bits of a segment are set by the majority of one sample of the set, its three smallest hashes under
  a permutation of the segment's own. A bit differs as often as one of a plain SimHash does (about 13 % at 0.8), but
  those that differ lie together, so half of the segments are equal. The budget is 19 bits a segment, 304 in all. Pairs
  meet where a segment is equal, and go on if each chain from there, up to the whole ring, keeps its share. The full
  check deals each text's shingle hashes into 1024 bins and compares four bits of the smallest of every bin. Estimates
  from 0.72 to 0.85 stay open: what the sure edges don't connect meets again, with its whole set of shingle hashes, in
  the buckets where it stayed open, and is counted exactly there. So rows grow with texts, not with pairs.

Equal sketches are one vertex. Within a bucket of equal keys only the edges of a spanning forest come out, found by
visiting: each sketch is compared with those not reached yet. Buckets of more than BUCKET sketches are dealt out as
pairs of chunks, so none is too large for a task and no pair is left out. Their sizes stay a table.

Defined results: null text is an empty one; empty texts have fingerprint zero and link to each other; null ids link
like others, and a component of null ids alone has a null id; repeated rows get the same answer; an empty table gives
an empty result; columns of the input that clash with an added name are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..session import written
from .common import by_bytes, free_name, without
from .components import components


WORDS, SEED, DISTANCE = 3, 42, 3
BUCKET = 4096
ROWS_PER_TASK = 1 << 18  # of keys with fingerprints
SKETCHES_PER_TASK = 1 << 15  # of keys with sketches, half a kilobyte each
SETS_PER_TASK = 1 << 12  # of keys with whole sets

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of so many words, repeats included; of all words, where they are fewer; of none, if there are none."""
    own = (text or "").encode().translate(_LOWER).split()
    if not own:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(own) <= words:
        return np.array([h(b" ".join(own), seed)], np.uint64)
    return np.fromiter((h(s, seed) for s in map(b" ".join, zip(*(own[k:] for k in range(words)), strict=False))), np.uint64, len(own) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_of(words: int = WORDS, seed: int = SEED):
    """A column function: the 64-bit fingerprint of each text, as a signed long."""

    @arrow_udf("long")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in by_bytes(texts):
                yield pa.array(np.array([fingerprint(shingle_hashes(t, words, seed)) for t in part], np.uint64).view(np.int64))

    return found


def visit(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest. near(i, others): which of the others are near i."""
    left, edges = np.arange(n), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            ok = near(i, left)
            if ok.any():
                got = left[ok].tolist()
                edges += [(i, j) for j in got]
                queue += got
                left = left[~ok]
    return edges


def _scanned(keyed: DataFrame, look: Callable[[int, pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]], bucket: int, tasks: int) -> DataFrame:
    """What look(key, rows) finds in each bucket of rows with one key: (a long, b long, open boolean). keyed: key long, v long and what look needs."""
    hot = written(keyed.groupBy("key").count().where(F.col("count") > bucket).select("key", F.ceil(2 * F.col("count") / bucket).cast("long").alias("chunks")), "hot")
    own = keyed.columns
    if hot.isEmpty():
        dealt = keyed.withColumn("part", F.lit(0).cast("long"))
    else:  # each row of a hot key goes to every pair of chunks that holds its own
        chunk = F.pmod(F.xxhash64(F.lit(5), "v"), F.col("chunks")).cast("long")
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: F.least(F.col("chunk"), j) * F.col("chunks") + F.greatest(F.col("chunk"), j) + 1)
        joined = keyed.join(hot, "key", "left").withColumn("chunk", chunk)
        dealt = joined.select(*own, F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("part"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def found(rows: pa.Table) -> pa.RecordBatch:
            key, part = rows.column("key").to_numpy(), rows.column("part").to_numpy()
            change = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(key)]])
            got = [look(int(key[s]), rows.slice(s, e - s)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if e - s > 1]
            a, b, opened = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.int64, np.int64, bool), zip(*got, strict=True) if got else ((), (), ()), strict=True))
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "open": pa.array(opened, pa.bool_())})

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            key, part = held.column("key").to_numpy(), held.column("part").to_numpy()
            if len(key) and (key[0] != key[-1] or part[0] != part[-1]):
                upto = int(np.flatnonzero((key != key[-1]) | (part != part[-1]))[-1]) + 1
                yield found(held.slice(0, upto))
                held = held.slice(upto)
        if held is not None and len(held):
            yield found(held)

    return dealt.repartition(tasks, "key", "part").sortWithinPartitions("key", "part").mapInArrow(scan, "a long, b long, open boolean").distinct()


_SEGMENT = np.array([0xFFFF << (16 * k) for k in range(4)], np.uint64)


def _near_bits(distance: int):
    def look(key: int, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = rows.column("v").to_numpy()
        x = v.view(np.uint64)
        i = key & 3
        chain = _SEGMENT[i] | _SEGMENT[(i + 1) % 4] | _SEGMENT[(i + 2) % 4]

        def near(k: int, others: np.ndarray) -> np.ndarray:
            z = x[others] ^ x[k]
            ok = np.bitwise_count(z & chain) <= 3 * distance // 4
            ok[ok] = np.bitwise_count(z[ok]) <= distance
            return ok

        edges = np.array(visit(len(v), near), np.int64).reshape(-1, 2)
        return v[edges[:, 0]], v[edges[:, 1]], np.zeros(len(edges), bool)

    return look


def link(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(a, b): edges that connect all of the distinct fingerprints (column fp, long) that differ by at most distance <= 3 bits."""
    if not 0 <= distance <= 3:
        raise ValueError("four segments of 16 bits serve distances from 0 to 3")
    keys = []
    for i in range(4):
        segment = lambda k: F.shiftrightunsigned("fp", 16 * (k % 4)).bitwiseAND(0xFFFF)
        for bit in range(16):
            keys.append(F.shiftleft(segment(i), 22) + F.shiftleft(segment(i + 1).bitwiseAND(0xFFFF ^ (1 << bit)), 6) + (bit * 4 + i))
    tasks = -(-fps.count() * len(keys) // ROWS_PER_TASK) or 1
    spread = fps.repartition(tasks, "fp")  # few rows before the explode, very many after it
    keyed = spread.select(F.col("fp").alias("v"), F.explode(F.array(*keys)).alias("key"))
    return _scanned(keyed, _near_bits(distance), bucket, tasks).select("a", "b")


def linked(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """docs without text, with fingerprint (hex) and component_id: the smallest key that can be reached by links, its own included."""
    kept = without(docs, "fingerprint", "component_id")
    own = free_name(kept, "fp")
    prints = written(kept.withColumn(own, fingerprint_of(words)(F.coalesce(F.col(text), F.lit("")))).drop(text), "prints")
    distinct = written(prints.groupBy(F.col(own).alias("fp")).agg(F.min(key).alias("least")), "distinct")
    roots = components(link(distinct.select("fp"), distance, bucket))
    grouped = distinct.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = grouped.join(least, "root").select(F.col("fp").alias(own), "component_id")
    return prints.join(answer, own).withColumn("fingerprint", F.lower(F.lpad(F.hex(own), 16, "0"))).drop(own)


NEAR_WORDS, SIMILARITY = 5, 0.8
BELOW, ABOVE = 0.08, 0.05  # estimates so far from the similarity are taken as they are; what lies between is counted
SEGMENTS, SAMPLE, SHARE, BINS = 16, 3, 19, 1024  # SHARE: bits of a segment that may differ, on an average of each chain


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(15))
    return x * np.uint32(0x9E3779B1)


def _scattered(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, (SEGMENTS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def ring_of(hashes: np.ndarray) -> np.ndarray:
    """The segments of a set's wide SimHash: bits set in over half of the segment's sample (of all, where a set is smaller)."""
    own, least = np.unique(hashes), np.zeros((SEGMENTS, 0), np.uint64)
    for i in range(0, len(own), 4096):
        least = np.concatenate([least, _scattered(own[i : i + 4096] * _FACTORS)], axis=1)
        if least.shape[1] > SAMPLE:
            least = np.partition(least, SAMPLE - 1, axis=1)[:, :SAMPLE]
    bits = _scattered(least).T  # anew, as the smallest begin with zeros
    if len(bits) == 0:
        return np.zeros(SEGMENTS, np.uint64)
    return bits[0] & bits[1] | bits[0] & bits[2] | bits[1] & bits[2] if len(bits) == SAMPLE else np.bitwise_and.reduce(bits)


def bins_of(hashes: np.ndarray) -> np.ndarray:
    """For each bin 0 if it is empty, else 1 to 15 by the smallest hash in it; two bins a byte."""
    least = np.full(BINS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    np.minimum.at(least, (hashes % np.uint64(BINS)).astype(np.int64), hashes >> np.uint64(1))
    code = (1 + _mixed((least >> np.uint64(8)).astype(np.uint32)) % np.uint32(15)).astype(np.uint8)
    code[least == 0xFFFFFFFFFFFFFFFF] = 0
    return code[::2] | code[1::2] << np.uint8(4)


def similarities(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of a set to others, from unpacked bins; two empty sets are alike."""
    there = others > 0
    both = ((one > 0) & there).sum(1)
    either = (one > 0).sum() + there.sum(1) - both
    same = ((one == others) & there).sum(1)
    return np.where(either > 0, (same - both / 15) * 15 / 14 / np.maximum(either, 1), 1.0)  # one in 15 unequal codes agrees


def sketch_of(words: int = NEAR_WORDS):
    """A column function: a 128-bit hash of the text, its sketch (the bins, then the ring), and the ring's keys: its segments, each of which ends in its place."""

    @arrow_udf("struct<h:binary,sketch:binary,keys:array<long>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in by_bytes(texts):
                h, sketch, keys = [], [], []
                for t in part:
                    own = shingle_hashes(t, words)
                    m = ring_of(own)
                    h.append(xxhash.xxh3_128_digest((t or "").encode()))
                    sketch.append(bins_of(own).tobytes() + m.tobytes())
                    keys.append((m & ~np.uint64(15) | np.arange(SEGMENTS, dtype=np.uint64)).view(np.int64).tolist())
                yield pa.StructArray.from_arrays([pa.array(h, pa.binary()), pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["h", "sketch", "keys"])

    return found


def sets_of(words: int = NEAR_WORDS):
    """A column function: the distinct shingle hashes of each text, sorted."""

    @arrow_udf("binary")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in by_bytes(texts):
                yield pa.array([np.unique(shingle_hashes(t, words)).tobytes() for t in part], pa.binary())

    return found


class _Bucket:
    """The sketches of a bucket. A pair is looked at in the first bucket from which all of its chains hold, and nowhere else."""

    def __init__(self, key: int, rows: pa.Table):
        x = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(rows), -1)
        self.bins, self.ring, self.place = x[:, : BINS // 2], np.ascontiguousarray(x[:, BINS // 2 :]).view(np.uint64), key & 15

    def estimates(self, k: int, others: np.ndarray) -> np.ndarray:
        """Estimated similarities, -1 for pairs whose chains don't hold from here, or do from an earlier place."""
        apart = np.bitwise_count(self.ring[others] ^ self.ring[k]).astype(np.int16)
        over = np.zeros((len(apart), 2 * SEGMENTS + 1), np.int16)  # bits beyond their share, added up twice around the ring
        np.cumsum(np.concatenate([apart, apart], axis=1) - SHARE, axis=1, dtype=np.int16, out=over[:, 1:])
        most = np.lib.stride_tricks.sliding_window_view(over[:, 1:-1], SEGMENTS, axis=1).max(-1)  # of the chains from each place
        begin = (apart == 0) & (most <= over[:, :SEGMENTS])
        own = begin[:, self.place] & ~begin[:, : self.place].any(1)
        out = np.full(len(others), -1.0)
        unpacked = lambda rows: np.concatenate([rows & 15, rows >> 4], axis=-1)
        if own.any():
            out[own] = similarities(unpacked(self.bins[k]), unpacked(self.bins[others[own]]))
        return out


def _sure_sets(similarity: float):
    """Edges of pairs that are near beyond doubt; and, as (vertex, key), what may be near something that those leave apart."""

    def look(key: int, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, v, opened = _Bucket(key, rows), rows.column("v").to_numpy(), []

        def near(k: int, others: np.ndarray) -> np.ndarray:
            said = own.estimates(k, others)
            ok = said >= similarity + ABOVE
            maybe = ~ok & (said >= similarity - BELOW)
            if maybe.any():
                opened.append((k, others[maybe]))
            return ok

        edges = np.array(visit(len(v), near), np.int64).reshape(-1, 2)
        group, unsure = np.arange(len(v)), np.zeros(len(v), bool)
        for i, j in edges.tolist():  # in the order of visiting: i has its group
            group[j] = group[i]
        for i, others in opened:
            apart = others[group[others] != group[i]]
            unsure[apart] = True
            unsure[i] |= len(apart) > 0
        a = np.concatenate([v[edges[:, 0]], v[unsure]])
        return a, np.concatenate([v[edges[:, 1]], np.full(int(unsure.sum()), key)]), np.arange(len(a)) >= len(edges)

    return look


def _exact_sets(similarity: float):
    """Edges that connect what is near by the sets themselves; rows of one root are connected already."""

    def look(key: int, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, v, root, edges = _Bucket(key, rows), rows.column("v").to_numpy(), rows.column("root").to_numpy().copy(), []
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("own").to_pylist()]
        size = np.array([len(x) for x in sets])
        for k in range(len(v)):
            others = k + 1 + np.flatnonzero((root[k + 1 :] != root[k]) & (np.minimum(size[k + 1 :], size[k]) >= similarity * np.maximum(size[k + 1 :], size[k])))
            said = own.estimates(k, others)
            for j in others[np.argsort(-said, kind="stable")[: int((said >= similarity - BELOW).sum())]].tolist():
                if root[j] != root[k]:
                    both = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
                    if both >= similarity * (size[k] + size[j] - both):
                        edges.append((v[k], v[j]))
                        root[root == root[j]] = root[k]
        found = np.array(edges, np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1], np.zeros(len(found), bool)

    return look


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = NEAR_WORDS, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """docs without all but one row of each group of equal or near texts: the smallest key's (nulls last) stays.

    docs must be read the same way twice (a table scan or checkpoint): its rows are numbered by position.
    """
    row = free_name(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    own = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col(row).alias("row"))
    sketched = written(numbered.select(own.alias("own"), sketch_of(words)(F.coalesce(F.col(text), F.lit(""))).alias("s")).select("own", "s.*"), "sketches")
    texts = written(sketched.groupBy("h").agg(F.min("own").alias("own"), F.min("sketch").alias("sketch"), F.min("keys").alias("keys")).withColumn("v", F.col("own.row")), "texts")
    keyed = texts.select("v", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").count().where("count > 1").select("key")  # sketches travel only where something meets
    meeting = written(keyed.join(shared, "key", "left_semi"), "meeting")
    tasks = -(-meeting.count() // SKETCHES_PER_TASK) or 1
    found = written(_scanned(meeting.join(texts.select("v", "sketch"), "v"), _sure_sets(similarity), bucket, tasks), "pairs")
    sure = found.where("not open").select("a", "b")
    edges = sure
    unsure = found.where("open").select(F.col("a").alias("v"), F.col("b").alias("key"))
    if not unsure.isEmpty():
        rooted = unsure.join(components(sure), "v", "left").withColumn("root", F.coalesce("root", "v"))
        apart = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
        left = written(rooted.join(apart, "key", "left_semi"), "open")
        whole = numbered.select(F.col(row).alias("v"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(left.select("v").distinct(), "v", "left_semi").select("v", sets_of(words)("text").alias("own"))
        counted = left.join(written(whole, "sets"), "v").join(texts.select("v", "sketch"), "v")
        edges = sure.unionByName(_scanned(counted, _exact_sets(similarity), bucket // 4 or 1, -(-left.count() // SETS_PER_TASK) or 1).select("a", "b"))
    grouped = texts.select("v", "own").join(components(edges), "v", "left")
    stays = grouped.groupBy(F.coalesce("root", "v").alias("g")).agg(F.min("own").alias("own")).select(F.col("own.row").alias(row))
    return numbered.join(stays, row, "left_semi").drop(row)
