"""Every registered query of this subpackage, and the pipeline, over whole small tables against brute force."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from statloom.llm import decontaminate, queries
from statloom.llm.encoding import resolved as vocabulary

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}


def result(spark, name, d=SMALL):
    return queries.queries()[name](spark, d).collect()


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.fixture(scope="module")
def ids(docs):
    t = library("word_bpe_49k.json")
    return {i: np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for i, r in docs.items()}


def test_op1(spark, docs):
    got = result(spark, "op1_sharding")
    assert sorted(r.doc_id for r in got) == sorted(docs)
    slots = defaultdict(list)
    for r in got:
        raw = (docs[r.doc_id]["text"] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op2(spark, docs):
    t = library("byte_bpe_50k.json")
    want = {i: (len((r["text"] or "").encode()), len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for i, r in docs.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in result(spark, "op2_token_counts")} == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in result(spark, "op2_token_counts"))


def check_packed(rows, ids):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
    assert set(pieces) == set(ids)
    for i, parts in pieces.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids[i])
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(map(len, ids.values()))
    assert len(sequences) <= 1.02 * total / 2048 + 1


def test_op3(spark, ids):
    check_packed(result(spark, "op3_packing"), ids)


def edits(texts, items):
    """Smallest distance between each item and any stretch of each text: the plain table, a column for each character."""
    most = max(map(len, items.values()))
    codes = np.full((len(items), most), 1 << 20)
    for k, item in enumerate(items.values()):
        codes[k, : len(item)] = list(map(ord, item))
    last, place = np.array([len(x) for x in items.values()]), np.arange(most + 1)
    for name, text in texts.items():
        column = np.tile(place, (len(items), 1))
        best = last.copy()
        for c in map(ord, text):
            step = np.minimum(column[:, :-1] + (codes != c), column[:, 1:] + 1)
            column = np.minimum.accumulate(np.concatenate([np.zeros((len(items), 1), int), step], 1) - place, axis=1) + place
            best = np.minimum(best, column[np.arange(len(items)), last])
        for k, item in enumerate(items):
            yield name, item, int(best[k])


def plain(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return decontaminate.plain(raw, np.array([0, len(raw)]))[0]


@pytest.fixture(scope="module")
def leaks(docs):
    """Items in texts of moderate size, by the plain table."""
    items = {r["item_id"]: plain(r["text"]) for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()}
    texts = {i: p for i, r in docs.items() if len(p := plain(r["text"])) <= 4000}
    return set(texts), {(i, k) for i, k, d in edits(texts, items) if items[k] and d <= int(0.1 * len(items[k]))}


def test_op4(spark, docs, leaks):
    looked, want = leaks
    got = {(r.doc_id, r.item_id) for r in result(spark, "op4_decontaminate")}
    assert {x for x in got if x[0] in looked} == want
    assert want


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    runs = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op5(spark, docs):
    prints = {i: fingerprint(r["text"]) for i, r in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(docs)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in result(spark, "op5_simhash")} == {i: (f"{prints[i]:016x}", find(i)) for i in docs}


def test_op6(spark):
    rows = pq.read_table(f"{LARGER}/embeddings.parquet").to_pylist()
    x = np.array([r["embedding"] for r in rows], np.float64)
    v = np.array([r["vec_id"] for r in rows])
    size, hits, n = np.sqrt((x * x).sum(1)), 0, 0
    got = defaultdict(list)
    for r in result(spark, "op6_neighbours", LARGER):
        got[r.query_id].append(r)
    assert set(got) == {i for i in v.tolist() if i % 50 == 0}
    for q, found in got.items():
        k = int(np.flatnonzero(v == q)[0])
        said = x @ x[k] / (size * size[k])
        order = [i for i in np.lexsort((v, -said)).tolist() if v[i] != q][:5]
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - said[v == r.vec_id][0]) < 1e-12 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & set(v[order].tolist()))
        n += 5
    assert hits / n >= 0.9


def test_op7(spark, ids):
    at, want = 0, {}
    for i in sorted(ids):
        want[i] = (at, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        at += len(ids[i])
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in result(spark, "op7_grammar_ids")} == want


def test_op8(spark):
    known = {r["doc_id"]: r for r in pq.read_table(f"{LARGER}/documents.parquet").to_pylist()}
    got = result(spark, "op8_language", LARGER)
    assert sorted(r.doc_id for r in got) == sorted(known)
    right = []
    for r in got:
        assert r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1
        letters = any(c.isalpha() for c in known[r.doc_id]["text"] or "")
        assert (r.lang_pred == "und") == (not letters)
        if r.held_out and letters:
            right.append(r.lang_pred == known[r.doc_id]["lang"])
    assert np.mean(right) >= 0.95


def test_op9(spark):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{LARGER}/labels.parquet").to_pylist()}
    got = result(spark, "op9_quality", LARGER)
    assert len(got) == pq.read_metadata(f"{LARGER}/documents.parquet").num_rows
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == labels[r.doc_id] for r in got if r.held_out and r.doc_id in labels]) >= 0.9


def test_op10(spark, docs):
    phrases = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))
    for r in result(spark, "op10_licenses"):
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (docs[r.doc_id]["text"] or "").encode())
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, label) for p, label in phrases for i in range(len(words)) if words[i : i + p.count(b" ") + 1] == p.split()]
        places = [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_pipeline(spark, docs, ids, leaks):
    """Each stage on its own input: what it must keep and what must go."""
    import corpus_pipeline

    table, kept = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    before = set(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, SMALL).cache()
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        own = [r.doc_id for r in table.collect()]
        assert len(own) == len(set(own)) and set(own) <= before
        kept[name] = before, set(own)
        before = set(own)
    was, stays = kept["language_id"]
    assert stays <= {i for i in was if any(c.isalpha() for c in docs[i]["text"] or "")}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SMALL}/labels.parquet").to_pylist()}
    assert stays >= {i for i in was if labels.get(i) == 1}
    was, stays = kept["quality"]
    assert np.mean([(i in stays) == (labels[i] == 1) for i in was if i in labels]) >= 0.9
    was, stays = kept["near_dedup"]
    sets, alike = {i: shingles(docs[i]["text"]) for i in was}, defaultdict(set)
    order = sorted(was)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            j = len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
            assert not (j >= 0.8 and a in stays and b in stays)
            if j >= 0.7:
                alike[a].add(b)
                alike[b].add(a)
    assert all(i in stays for i in was if not alike[i])
    assert all(i in stays or any(b < i for b in alike[i]) for i in was)
    was, stays = kept["decontaminate"]
    looked, found = leaks
    assert {i for i in was if i in looked} - stays == {i for i, _ in found} & was
    check_packed(corpus_pipeline.run(spark, SMALL).collect(), {i: ids[i] for i in stays})
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_odd_inputs(spark):
    """Nulls anywhere, empty and repeated rows, an empty table, extra columns with clashing names."""
    import corpus_pipeline

    good = " ".join(f"word{i} and other words of a plain sentence." for i in range(40))
    rows = [(1, good, "en", "s", 5, 0.5), (1, good, "en", "s", 5, 0.5), (None, good + " more", None, None, None, None), (3, None, "en", "s", 0, None), (4, "", None, "s", 0, 1.0)]
    rows = [(*r, "x", "y", "z") for r in rows]
    shape = "doc_id long, text string, lang string, source string, n_chars long, score double, _own_score string, Lang_Pred string, bits string"
    for given in (spark.createDataFrame(rows, shape), spark.createDataFrame([], shape)):
        table = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, SMALL)
            assert table.columns == given.columns
            assert table.count() <= given.count()
        corpus_pipeline.STAGES[-1][1](spark, table, SMALL).collect()
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, shape), SMALL)
    assert sorted((r.doc_id for r in kept.where(F.length("text") > 0).collect()), key=str) == [1]
