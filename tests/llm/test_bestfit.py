"""Linear grouping against what packing must hold, and against lower bounds."""

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from statloom.llm import bestfit, queries
from statloom.llm.encoding import resolved

PATH = resolved("byte_bpe_50k.json")
NAMES = "doc_id long, text string, ids string, part string, length string, sequence_id string"


def fits(counts):
    """Number of sequences of the plan, once it is shown that each piece has a place of its own and nothing overlaps."""
    rows = bestfit.plan(counts)
    starts = {}
    spans = defaultdict(list)
    for i, (size, first, sequence, copies, offset) in enumerate(rows.tolist()):
        end = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == size else counts[size]
        assert starts.get(size, 0) == first
        starts[size] = end
        for k in range(end - first):
            spans[sequence + k // copies].append((offset + k % copies * size, size))
    assert starts == {s: int(n) for s, n in enumerate(counts) if n}
    for s in spans.values():
        at = 0
        for offset, size in sorted(s):
            assert offset == at
            at += size
        assert at < len(counts)
    assert sorted(spans) == list(range(len(spans)))
    return len(spans)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_all(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(1025, np.int64)
    n = [0, 1, 7, 300, 3000, 20000][seed]
    sizes = rng.integers(1, 1025, n) if seed % 2 else np.minimum(1024, 1 + rng.exponential(250, n).astype(int))
    np.add.at(counts, sizes, 1)
    least = max(-(-int((counts * np.arange(1025)).sum()) // 1024), int(counts[513:].sum()))
    assert fits(counts) <= max(least + 3, least * 1.01 + 1)


def test_plan_pairs_what_fits_exactly():
    counts = np.zeros(1025, np.int64)
    counts[[600, 424, 512, 1024, 342, 341]] = [500, 500, 101, 7, 100, 200]
    assert fits(counts) == 500 + 51 + 7 + 100


def best_fit_decreasing(counts):
    rooms, used = [], 0
    for size in range(len(counts) - 1, 0, -1):
        for _ in range(counts[size]):
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                used += 1
            bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else len(counts) - 1) - size)
    return used


@pytest.mark.parametrize("low,high", [(250, 500), (200, 400)])
def test_fewer_sequences_than_best_fit_decreasing(low, high):
    counts = np.zeros(1025, np.int64)
    np.add.at(counts, np.random.default_rng(1).integers(low, high, 3000), 1)
    assert fits(counts) < 0.97 * best_fit_decreasing(counts)


def test_groups_are_equal_and_round_up():
    counts = np.array([0, 5, 0, 10, 7, 0, 8, 0, 0])
    sizes, wanted = bestfit.linear_groups(counts, 3, 2)
    assert sizes.tolist() == [6, 4, 3] and wanted.tolist() == [9, 9, 7]


def test_plan_grows_with_lengths_alone():
    counts = np.random.default_rng(3).integers(0, 2, 1025)
    counts[0] = 0
    small, large = len(bestfit.plan(counts)), len(bestfit.plan(counts * 10**7))
    assert large < max(20_000, 20 * small)


def check(rows, texts, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert sorted(by_doc, key=repr) == sorted(texts, key=repr)
    for i, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(-(-len(ids) // capacity)))
        assert all(p.length == capacity for p in pieces[1:])
        at = 0
        for p in pieces:
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for s in by_sequence.values():
        at = 0
        for offset, size in sorted(s):
            assert offset == at
            at += size
        assert at <= capacity
    return len(by_sequence)


def test_query(spark):
    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = queries.op12_best_fit(spark, d).collect()
        texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
        used = check(rows, texts, 1024)
        assert used <= 1.01 * -(-sum(r.length for r in rows) // 1024) + 2


def test_odd_inputs(spark):
    texts = [None, "", "a", "   \n", "é日本語 <|endoftext|>", "lorem ipsum " * 30_000, "word " * 63, "x" * 5000]
    docs = spark.createDataFrame([(i if i != 2 else None, t, "a", "b", "c", "d") for i, t in enumerate(texts)], NAMES).repartition(3)
    rows = bestfit.pack(docs, PATH, length=64).collect()
    check(rows, {i if i != 2 else None: t for i, t in enumerate(texts)}, 64)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    twice = bestfit.pack(docs.union(docs), PATH, length=64).collect()
    assert len(twice) == 2 * len(rows) and len({(r.sequence_id, r.offset) for r in twice}) == len(twice)
    assert bestfit.pack(docs.limit(0), PATH).collect() == []
