"""Packing: first-fit decreasing with a tournament tree of bin capacities, run apart in randomised groups.

Documents become pieces of at most ``length`` ids: full ones, and one rest. Pieces are dealt at random (a seeded hash
of the row's position and the piece's number) into groups of about GROUP_PIECES, each packed alone in one task, so the
work per task stays the same however long the table or a document is, and no key can be hot. Row positions are stable
only if the input is read the same way twice: pass a table scan or a checkpoint.

Defined results: a null text is an empty document, one piece holding the end id alone; repeated rows are packed each
for itself; an empty table gives an empty result; input columns beside id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import runs, utf8_bytes
from .encoding import encoder, with_end

LENGTH = 2048
END_ID = 1
GROUP_PIECES = 3072
MAX_TASKS = 20_000  # beyond it tasks pack several groups, one after the other


def token_ids(path: str, end_id: int | None, length: int):
    """A column function: each text's ids and end_id (if any) as pieces of at most length ids, each little-endian unsigned 32-bit."""

    @arrow_udf("array<binary>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path, False)
        for texts in batches:
            for counts, all_ids in own.texts(texts):  # small batches go out as they are ready
                counts, all_ids = with_end(counts, all_ids, end_id)
                pieces = -(-counts // length)
                before = np.cumsum(pieces) - pieces
                starts = np.repeat(np.cumsum(counts) - counts - length * before, pieces) + length * np.arange(int(pieces.sum()))
                borders = (4 * np.append(starts, len(all_ids))).astype(np.int32)
                values = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(borders), pa.py_buffer(all_ids)])
                yield pa.ListArray.from_arrays(pa.array(np.append(before, len(starts)), pa.int32()), values)

    return ids


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece its bin and its offset there. Ties in length keep their order."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int(np.searchsorted(-lengths[order], -capacity, "right"))
    bins[order[:full]] = np.arange(full)  # a full piece is a bin
    leaves = 1
    while leaves < n - full:
        leaves *= 2
    room = [capacity] * (2 * leaves)  # room[k]: the most room in a bin under node k
    for i, size in zip(order[full:].tolist(), lengths[order[full:]].tolist(), strict=True):
        k = 1
        while k < leaves:
            k *= 2
            if room[k] < size:
                k += 1
        bins[i], offsets[i] = full + k - leaves, capacity - room[k]
        room[k] -= size
        while k > 1:
            k //= 2
            a, b = room[2 * k], room[2 * k + 1]
            room[k] = a if a >= b else b
    return bins, offsets


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, seed: int = 77, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces with key, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    size = docs.agg(F.count("*").alias("n"), F.sum(utf8_bytes(text)).alias("bytes")).first()
    groups = max(1, -(-(size.n + (size.bytes or 0) // (4 * length)) // group_pieces))  # an id is about four bytes of text
    read = docs.select(F.col(key).alias("k"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    coded = read.select("k", "row", token_ids(path, end_id, length)("text").alias("pieces"))
    total = ((F.size("pieces") - 1).cast("long") * length + F.octet_length(F.element_at("pieces", -1)) / 4).cast("long")
    pieces = coded.select("k", "row", total.alias("doc_tokens"), F.posexplode_outer("pieces").alias("no", "ids")).select(
        "k",
        "doc_tokens",
        (F.col("no").cast("long") * length).alias("start"),
        "ids",
        F.pmod(F.xxhash64(F.lit(seed), "row", "no"), F.lit(groups)).cast("int").alias("g"),
        F.xxhash64("row", "no").alias("o"),
    )
    kind = dict(docs.dtypes)[key]

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by([("o", "ascending")])  # arrival order varies
        sizes = pc.divide(pc.binary_length(group.column("ids")), 4).to_numpy().astype(np.int64)
        bins, offsets = first_fit_decreasing(sizes, length)
        first = group.column("g")[0].as_py() << 32
        return group.select(["k", "start", "ids", "doc_tokens"]).append_column("length", pa.array(sizes)).append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets)).select(["k", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "g"):
            yield from packed(group).to_batches()

    tasks = min(groups, MAX_TASKS)
    grouped = pieces.repartitionById(tasks, F.col("g") % tasks).sortWithinPartitions("g")  # by hash, some tasks would get several groups and others none
    out = grouped.mapInArrow(groups_of, f"k {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("k", key)
