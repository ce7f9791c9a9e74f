"""Periodic runs against a search of all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from statloom.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_of(words, least=6, times=4):
    found = {}
    n = len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and (i, j + q - i) not in found:  # a stretch's smallest period comes first
                if not any(s <= i and i + q + (j - i) <= s + m and q % p == 0 for (s, m), p in found.items()):
                    found[i, j + q - i] = q
            i = j + 1
    return sorted((s, m, q) for (s, m), q in found.items())


def planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def collapsed(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text):
    words = planted(WORD.findall(text or ""), doc_id)
    runs = runs_of(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(collapsed(words, runs)))


def strings(seed):
    """Texts rich in repeats of all kinds."""
    r = random.Random(seed)
    for _ in range(60):
        out = []
        while len(out) < r.choice([0, 3, 20, 90, 200]):
            part = [r.choice("ab" if r.random() < 0.5 else "abcdefgh") for _ in range(r.randint(1, 12))]
            out += part * r.choice([1, 1, 2, 3, 4, 5, 9]) + part[: r.randint(0, len(part))]
        yield out
    a, b = ["a"], ["a", "b"]
    for _ in range(8):
        a, b = b, b + a
    yield b
    yield ["a"] * 100
    yield (["x"] * 7 + ["y"]) * 12


@pytest.mark.parametrize("seed", range(4))
def test_against_all_periods(seed):
    texts = list(strings(seed))
    raw = [" ".join(t).encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    runs, left = periodic.searched(np.frombuffer(b"".join(raw), np.uint8), offsets, [None] * len(texts))
    for words, got, rest in zip(texts, runs.to_pylist(), left.to_pylist(), strict=True):
        want = runs_of(words)
        assert [(r["start"], r["length"], r["period"]) for r in got] == want
        assert rest == collapsed(words, want)


def test_range_successor():
    rng = np.random.default_rng(5)
    for n in (1, 2, 63, 64, 65, 500):
        values = rng.permutation(n)
        tree = periodic.RangeSuccessor(values)
        lo = rng.integers(0, n, 50)
        hi = lo + 1 + (rng.random(50) * (n - lo)).astype(int)
        hi = np.minimum(hi, n)
        x = rng.integers(0, n, 50)
        assert tree.below(lo, hi, x).tolist() == [int((values[a:b] < c).sum()) for a, b, c in zip(lo, hi, x)]
        k = (rng.random(50) * (hi - lo)).astype(int)
        assert tree.smallest(lo, hi, k).tolist() == [int(np.sort(values[a:b])[c]) for a, b, c in zip(lo, hi, k)]


def test_odd_inputs(spark):
    texts = [None, "", " \n\t\x0b ", "a", "a a a a a a", "é é\x0cé é\né é x", "a\x00b a\x00b a\x00b a\x00b a\x00b a\x00b", "one two " * 9, " ".join(map(str, range(3000))) * 5, "ab cd " * 50_000]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "r", "c") for i, t in enumerate(texts)], "doc_id long, text string, Runs string, collapsed string").repartition(2)
    found = periodic.find_runs(docs.union(docs))
    assert found.columns == ["doc_id", "text", "runs", "collapsed"]
    rows = found.collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        words = WORD.findall(r.text or "")
        known = {100_000: [(0, 100_000, 2)], 14_996: [(1, 14_994, 2_999)]}  # the numbers' copies join as "29990": from the second word on, a run
        want = known.get(len(words)) or runs_of(words)
        assert [tuple(x) for x in r.runs] == want and r.collapsed == collapsed(words, want)
    assert periodic.digested(periodic.find_runs(docs.limit(0))).collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = queries.op13_periodic_runs(spark, d)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(plain(r["doc_id"], r["text"]) for r in rows)
