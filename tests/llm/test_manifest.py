"""The Merkle manifest against a plain tree built in Python."""

import hashlib
import zlib
from collections import defaultdict

import oracle
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from statloom.llm import manifest, queries

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
NAMES = "doc_id long, source string, lang string, n_chars long, text string, path string, root string, leaf string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return H(*("-" if r[f] is None else f"{len(str(r[f]).encode())}:{r[f]}" for f in FIELDS))


def tree(nodes):
    """The root, and for each leaf its flanks (left, right) by level."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_owners = [], []
        for i in range(0, len(nodes), 3):
            run = nodes[i : i + 3]
            for j in range(len(run)):
                for o in owners[i + j]:
                    paths[o].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(H(*run))
            up_owners.append([o for own in owners[i : i + 3] for o in own])
        nodes, owners = up, up_owners
    return nodes[0], paths


def plain(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by[s]])
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for r, path in zip(by[s], trees[s][1]):
            path = path + top
            now = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            node = leaf(r | {"text": r["text"] and r["text"].replace("\n", "")}) if now else leaf(r)
            for a, b in path:
                node = H(a, node, b)
            out.append((r["doc_id"], leaf(r), trees[s][0], root, H(*(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


def built(docs, levels):
    altered = [*FIELDS[:-1], F.replace("text", F.lit("\n"), F.lit(""))]
    found = manifest.verified(docs, FIELDS, altered, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, levels=levels)
    return sorted((tuple(r) for r in found.drop("source").collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_odd_rows_and_several_rounds(spark, levels):
    texts = [None, "", "a\nb", "\n", "é日\n" * 30, "word " * 50_000, "same", "same"]
    rows = [(i if i % 11 else None, None if i % 7 == 0 else ["a", "B", "", "ä", "hot"][min(4, i % 9)], None if i % 5 == 0 else "en", i if i % 3 else None, texts[i % 8], "p", "q", "r") for i in range(200)]
    rows += rows[40:43] * 3  # repeated rows
    docs = spark.createDataFrame(rows, NAMES).repartition(3)
    assert built(docs, levels) == plain([r.asDict() for r in docs.collect()])


def test_rows_of_one_key_are_dealt_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(manifest, "ROWS_EACH", 10)
    docs = spark.range(90).select(F.when(F.col("id") < 60, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("s").alias("source"), F.lit("l").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t\n").alias("text"))
    assert built(docs, 1) == plain([r.asDict() for r in docs.collect()])


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, None, None, None, None, "p", "q", "r")], NAMES)
    got = built(one, 6)
    assert got == plain([r.asDict() for r in one.collect()]) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == H("")
    assert built(one.limit(0), 6) == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = queries.op11_manifest(spark, d)
    rows = pq.read_table(f"{d}/documents.parquet").to_pylist()
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)
    assert any(not r.verified for r in got.collect())
    assert oracle.compare(oracle.connect(d), got, manifest.ORACLE) == ""
