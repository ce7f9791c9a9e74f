"""Odd inputs for every operator, and brute-force versions of the results."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from statloom.llm import components, decontaminate, encoding, grammar_ids, langid, licenses, neighbours, packing, quality, sharding, simhash, token_counts
from statloom.llm.encoding import resolved as vocabulary
from statloom.session import new_path

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
EXTRA = "doc_id long, text string, lang string, source string, shard string, slot string, score string, fingerprint string, n_tokens string, labels string"
LONG = " ".join(random.Random(1).choice(["lorem", "ipsum", "dolor", "sit", "amet,", "x9"]) for _ in range(60_000))
TEXTS = ["The quick brown fox jumps over the lazy dog.", None, "", "   \n\t ", "The quick brown fox jumps over the lazy dog.", "été à la plage <|endoftext|> 日本語", LONG, "a", "Released under the MIT License."]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, None if i % 4 == 0 else "en", None, "s", "t", "u", "v", "w", "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0]], EXTRA)  # a null id, a repeated row


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EXTRA)


def ids_of(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_sharding(spark, odd, none):
    got = sharding.shuffle_into_shards(odd, 4)
    rows = got.collect()
    assert got.columns == ["doc_id", "text", "lang", "source", "score", "fingerprint", "n_tokens", "labels", "shard", "slot"]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in rows))) == sorted(map(repr, ((r.doc_id, r.text) for r in odd.collect())))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(map(len, slots.values())) == [2, 2, 3, 3] and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert [tuple(r) for r in rows] and sorted(map(str, rows)) == sorted(map(str, sharding.shuffle_into_shards(odd, 4).collect()))
    assert sharding.shuffle_into_shards(none, 4).count() == 0


@pytest.mark.parametrize("max_tasks", [20_000, 3])
def test_sharding_splits_a_repeated_id(spark, max_tasks):
    """Many small buckets, one or several a task; three quarters of the rows have one id."""
    docs = spark.range(400).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id")).alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"))
    got = sharding.shuffle_into_shards(docs, 7, bucket_bytes=2000, max_tasks=max_tasks)
    by_shard = got.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d")).collect()
    assert {r.n for r in by_shard} == {57, 58} and all(r.n == r.d == r.m + 1 for r in by_shard)
    assert got.where("doc_id = 7").count() == 300 and got.select("doc_id").distinct().count() == 101
    assert sorted(got.collect()) == sorted(sharding.shuffle_into_shards(docs, 7, bucket_bytes=2000, max_tasks=max_tasks).collect())


def test_sharding_order_is_shuffled(spark):
    got = sharding.shuffle_into_shards(spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), 2).orderBy("shard", "slot").collect()
    order = np.array([r.doc_id for r in got])
    assert abs(np.corrcoef(order, np.arange(2000))[0, 1]) < 0.1


def own_ids(path, texts):
    """What the encoder gives, a list a text."""
    out = []
    for counts, ids in encoding.Encoder(path, False).texts(pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("piece", [None, 40])
def test_encoding_equals_the_library(path, piece, monkeypatch):
    from tokenizers import Tokenizer

    if piece:  # long texts are cut safely
        monkeypatch.setattr(encoding, "PIECE_BYTES", piece)
        monkeypatch.setattr(encoding, "WINDOW", 16)
        monkeypatch.setattr(encoding, "BATCH_BYTES", 1)
    rng = random.Random(4)
    letters = [*" \n\t\r  abcAB01'.,;!éÉ×÷ßç日本Σσ\x1c\xa0\x85\u3000\u0300İŉ😀", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'ll", " the", " don't", "\r\n", "é"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    texts += ["Plain words, and 12 more. " * 50, " a", "b ", " ", "", None, LONG[:3000] + "  \n\n double  spaces " + "é" * 200 + " end"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert own_ids(path, texts) == want
    counts = np.concatenate([c for c, _ in encoding.Encoder(path, True).texts(pa.array(texts, pa.string()))])
    assert counts.tolist() == list(map(len, want))


def test_a_full_memo_begins_anew(monkeypatch):
    monkeypatch.setattr(encoding, "MEMO_ENTRIES", 5)
    monkeypatch.setattr(encoding, "BATCH_BYTES", 30)
    texts = [f"word{i % 7} and number {i}" for i in range(60)]
    assert own_ids(WORD, texts) == [ids_of(WORD, t) for t in texts]


def test_sentencepiece_counts():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    texts = ["Hello  world", "", "x" * 30]
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    assert [c.tolist() for c, _ in encoding.Encoder(path, True).texts(pa.array(texts))] == [want]


def test_token_counts(odd, none):
    rows = token_counts.count_tokens(odd, BYTE).collect()
    assert len(rows) == 10 and all(r.n_tokens == len(ids_of(BYTE, r.text)) and r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 512) for r in rows)
    assert token_counts.count_tokens(none, BYTE).count() == 0


def brute_first_fit(lengths, capacity):
    room, bins = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if k == len(room):
            room.append(capacity)
        room[k] -= lengths[i]
        bins[i] = k
    return [bins[i] for i in range(len(lengths))]


@pytest.mark.parametrize("n", [0, 1, 2, 9, 500])
def test_first_fit_decreasing(n):
    lengths = np.random.default_rng(n).integers(1, 33, n)
    assert packing.first_fit_decreasing(lengths, 32)[0].tolist() == brute_first_fit(lengths.tolist(), 32)


def check_pieces(rows, docs, length):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.length == len(r.ids) // 4 <= length
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s)])[:-1].tolist() and sum(r.length for r in s) <= length
    want = defaultdict(list)
    for d, t in docs:
        want[d].append([*ids_of(WORD, t), 1])
    for d, texts in want.items():
        assert sum(r.length for r in by_doc[d]) == sum(map(len, texts))
        if len(texts) == 1:
            got = sorted(by_doc[d], key=lambda r: r.start)
            assert [x for r in got for x in np.frombuffer(r.ids, "<u4").tolist()] == texts[0] and {r.doc_tokens for r in got} == {len(texts[0])}
    return len(by_sequence)


def test_packing(odd, none):
    rows = packing.pack(odd, WORD, group_pieces=20).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in odd.collect()], 2048)
    assert packing.pack(none, WORD).count() == 0


@pytest.mark.parametrize("base", [49408, 70_000])
@pytest.mark.parametrize("seed", range(3))
def test_grammar_round_trip(seed, base):
    r = np.random.default_rng(seed)
    ids = np.concatenate([r.integers(0, 6, 3000), np.tile([5, 6, 7], 800), [1], r.integers(0, base, 500), np.full(777, 9)]).astype(np.uint32)
    rules, lengths, symbols = grammar_ids.compress(ids, base)
    assert len(symbols) < len(ids) and (grammar_ids.expand(rules, lengths, symbols, base) == ids).all()
    kept = grammar_ids.stored(ids, base)
    assert (grammar_ids.ids_of(kept) == ids).all() and kept["n_symbols"] == len(symbols)
    assert 8 * sum(len(kept[x]) for x in ("rules", "lengths", "symbols")) - grammar_ids._bits(base, rules, lengths, symbols) < 8 * 100
    for a in r.integers(0, len(ids), 20):
        assert (grammar_ids.ids_of(kept, int(a), int(a) + 90) == ids[a : a + 90]).all()
    for short in (ids[:0], ids[:1], ids[:2]):
        assert (grammar_ids.ids_of(grammar_ids.stored(short, base)) == short).all()


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("texts", [[" "], ["   \n\t "], [None, "  "], ["\n", ""], [], ["", "x", " "]])
def test_blocks_without_chunks(path, texts):
    got = [c for counts, _ in encoding.Encoder(path, False).texts(pa.array(texts, pa.string())) for c in counts.tolist()]
    assert got == [len(ids_of(path, t)) for t in texts]


@pytest.mark.parametrize("piece", [1, 2, 3, 64, 1 << 16])
def test_grammar_places_whatever_the_slices(monkeypatch, piece):
    """Pairs looked up slice by slice against a plain walk; runs of one symbol cross the slices."""
    monkeypatch.setattr(grammar_ids, "SLICE", piece)
    r = np.random.default_rng(piece)
    for _ in range(20):
        seq = np.repeat(r.integers(0, 4, 60), r.integers(1, 6, 60)).astype(np.uint32)
        pairs = np.unique(seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:])
        want, i = [], 0
        wanted = set(pairs[::2].tolist())
        hits = [(int(a) << 32 | int(b)) in wanted for a, b in zip(seq[:-1], seq[1:], strict=True)]
        while i < len(hits):
            if hits[i]:
                want.append((i, int(np.searchsorted(pairs[::2], int(seq[i]) << 32 | int(seq[i + 1])))))
            i += 2 if hits[i] else 1
        at, which = grammar_ids._places(seq, pairs[::2])
        assert list(zip(at.tolist(), which.tolist(), strict=True)) == want
        ids = np.concatenate([seq, [1], seq[::-1]]).astype(np.uint32)
        assert (grammar_ids.ids_of(grammar_ids.stored(ids, 49408)) == ids).all()


def test_grammar_ends_where_no_pair_pays():
    ids = np.tile(np.arange(2, 300), 3).astype(np.uint32)  # every pair stands three times
    assert len(grammar_ids.compress(ids, 49408)[0]) == 0
    ids = np.tile(np.arange(2, 300), 4).astype(np.uint32)
    rules, _, symbols = grammar_ids.compress(ids, 49408)
    assert len(rules) and 3 * len(rules) + len(symbols) < len(ids)


@pytest.mark.parametrize("width", [0, 1, 8, 9, 16, 17, 31])
def test_packed_numbers(width):
    x = np.random.default_rng(width).integers(0, 1 << width, 1001).astype(np.uint32)
    assert (grammar_ids.unpacked(grammar_ids.packed(x, width), width, len(x)) == x).all()


@pytest.mark.parametrize("limits", [{}, {"part_bytes": 3000, "shard_ids": 64}, {"part_bytes": 1 << 30, "shard_ids": 1000}])
def test_grammar_ids(spark, odd, none, limits):
    out = new_path(spark, "ids")
    grammar_ids.write_ids(odd.repartition(3), WORD, out, **limits)
    rows = sorted(grammar_ids.read_ids(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 0, 0, 1, 2, 4, 5, 6, 7, 8]
    at = 0
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        want = np.array([*ids_of(WORD, texts[r.doc_id]), 1], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids) == (at, len(want) // 4, want)
        at += r.n_tokens
    if limits:
        assert max(g.n_ids for r in spark.read.parquet(out).collect() for g in r.grammars) <= limits["shard_ids"]
    assert grammar_ids.grammar_ids(none, WORD).count() == 0


def test_a_repeated_row_spreads_over_parts(spark):
    out = new_path(spark, "ids")
    docs = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one and the same text").alias("text")).repartition(8)
    grammar_ids.write_ids(docs, WORD, out, part_bytes=20_000)
    assert spark.read.parquet(out).select("part").distinct().count() > 3
    rows = sorted(grammar_ids.read_ids(spark, out).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [r.n_tokens * i for i, r in enumerate(rows)] and len(rows) == 4000


def test_myers_equals_the_table():
    def table(p, t):
        col, best = list(range(len(p) + 1)), (len(p), 0)
        for j, ch in enumerate(t):
            before, col[0] = col[:], 0
            for i in range(1, len(p) + 1):
                col[i] = min(before[i] + 1, col[i - 1] + 1, before[i - 1] + (p[i - 1] != ch))
            best = min(best, (col[-1], j + 1), key=lambda x: x[0])
        return best

    rng = random.Random(3)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, 70))) for _ in range(2))
        t = t[:9] + p[:30] + "z" + p[31:] + t
        masks = defaultdict(int)
        for i, c in enumerate(p):
            masks[c] |= 1 << i
        assert decontaminate.best_match(masks, len(p), t) == table(p, t)


def test_decontamination(spark, odd, none):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(30)).capitalize() + ".") for i in range(20)] + [(90, None), (91, ""), (92, "?!"), (93, "short one"), (0, "again an item of an id that is there already, word for word")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    filler = lambda n: " ".join(word() for _ in range(n))
    docs, want = [], set()
    for i, t in items[:20]:
        edited = list(t)
        for _ in range(int(0.08 * len(t))):
            edited[rng.randrange(len(edited))] = rng.choice(["", "q"])
        docs += [(3 * i, filler(50) + " " + t.upper() + "\n" + filler(20)), (3 * i + 1, filler(9) + "".join(edited) + filler(50)), (3 * i + 2, filler(80) + t[: len(t) // 2])]
        want |= {(3 * i, i), (3 * i + 1, i)}
    docs += [(999, "a short one here"), (998, "shortoned"), (997, None)]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want | {(999, 93)}
    kept = decontaminate.clean(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want} - {999}
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0 and decontaminate.clean(odd, bench).columns == odd.columns


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 50)] + [(7, 7)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            top[y] = x
    got = {r.v: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in top}


def brute_fingerprint(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [4096, 3])
def test_links_equal_all_pairs(spark, bucket):
    rng = random.Random(bucket)
    centres = [rng.getrandbits(64) for _ in range(30)]
    x = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for c in centres for _ in range(25)} | {0, 1, 2**64 - 1})
    signed = [v - (1 << 64) if v >> 63 else v for v in x]
    edges = simhash.link(spark.createDataFrame([(v,) for v in signed], "fp long"), bucket=bucket)
    roots = {r.v: r.root for r in components.components(edges).collect()}
    top = list(range(len(x)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(x)):
        for j in range(i):
            if bin(x[i] ^ x[j]).count("1") <= 3:
                top[find(i)] = find(j)
    want, got = defaultdict(set), defaultdict(set)
    for i, v in enumerate(signed):
        want[find(i)].add(v)
        got[roots.get(v, v)].add(v)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_simhash_of_documents(odd, none):
    rows = simhash.linked(odd).collect()
    assert len(rows) == 10 and "text" not in rows[0].asDict() and rows[0].score == "u"
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert all(r.fingerprint == f"{brute_fingerprint(texts[r.doc_id]):016x}" for r in rows)
    got = {r.doc_id: r.component_id for r in rows}
    assert got[0] == got[4] == 0 and got[1] == got[2] == got[None] == 1 and got[6] == 6
    assert simhash.linked(none).count() == 0


def test_near_duplicates(spark, odd, none):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 7)))
    docs, groups = [], {}
    for g in range(40):
        base = [word() for _ in range(rng.randint(150, 400))]
        for k in range(4):
            t = base[:]
            for _ in range(k % 3):
                t[rng.randrange(len(t))] = word()
            groups[10 * g + k] = g
            docs.append((10 * g + k, " ".join(t)))
    rng.shuffle(docs)
    kept = {r.doc_id for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert kept == {10 * g for g in range(40)}
    tight = {r.doc_id for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), bucket=2).collect()}
    assert tight == kept
    left = simhash.near_duplicates(odd)
    assert left.columns == odd.columns and sorted((r.doc_id for r in left.collect()), key=repr) == [0, 1, 5, 6, 7, 8]
    assert simhash.near_duplicates(none).count() == 0


def similar_texts(rng, n, replaced):
    """Two texts of n words, the second with so many single words replaced, and the exact similarity of their five-word shingles."""
    a = [f"{rng.getrandbits(40):x}" for _ in range(n)]
    b = a[:]
    for i in range(replaced):
        b[4 + i * ((n - 9) // replaced)] = f"{rng.getrandbits(40):x}"
    x, y = (set(simhash.shingle_hashes(" ".join(t), 5).tolist()) for t in (a, b))
    return " ".join(a), " ".join(b), len(x & y) / len(x | y)


def test_near_duplicates_with_few_equal_segments(spark):
    rng, docs = random.Random(11), []
    while len(docs) < 20:
        a, b, same = similar_texts(rng, 150, 3)
        assert same >= 0.81
        equal = simhash.ring_of(simhash.shingle_hashes(a, 5)) == simhash.ring_of(simhash.shingle_hashes(b, 5))
        if equal.sum() <= 6 and (equal & np.roll(equal, 1)).any():
            docs += [(len(docs), a), (len(docs) + 1, b)]
    kept = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 20, 2))


def wide_pair(rng, both, each):
    """Two sets of hashes with so many in both and so many in each alone."""
    h = np.array([rng.getrandbits(64) for _ in range(both + 2 * each)], np.uint64)
    return h[: both + each], np.concatenate([h[:both], h[both + each :]])


def test_the_ring_is_a_simhash():
    """Segments are majorities over samples, and differ in as many bits as the angle between the sets says."""
    rng = random.Random(13)
    for both, each in ((4, 0), (40, 5), (300, 150)):
        pairs = [wide_pair(rng, both, each) for _ in range(150)]
        bits = np.mean([np.bitwise_count(simhash.ring_of(a) ^ simhash.ring_of(b)).sum() / 1024 for a, b in pairs])
        assert abs(bits - math.acos(both / (both + each)) / math.pi) < 0.03
    a, _ = wide_pair(rng, 3, 0)
    assert all(simhash.ring_of(np.array([x, x], np.uint64)).tolist() == simhash.ring_of(np.array([x], np.uint64)).tolist() for x in a)
    of = [simhash.ring_of(a[k : k + 1]).tolist() for k in range(3)]  # of a set of three each sample is the whole set
    assert simhash.ring_of(a).tolist() == [sum(1 << k for k in range(64) if (x >> k & 1) + (y >> k & 1) + (z >> k & 1) > 1) for x, y, z in zip(*of)]
    assert simhash.ring_of(a[:2]).tolist() == [x & y for x, y in zip(*of[:2])] and simhash.ring_of(a[:0]).tolist() == [0] * 16


def test_chains_decide_where_a_pair_is_looked_at():
    """In the first place from which every chain keeps its share of 19 bits a segment, by a plain loop; in none, if there is no such place."""
    rng, seen = random.Random(14), Counter()
    for _ in range(300):
        one = [rng.getrandbits(64) for _ in range(16)]
        mask = [rng.choice((0, 1, 1)) * sum(1 << k for k in rng.sample(range(64), rng.randint(1, 64))) for _ in range(16)]
        two = [x ^ m for x, m in zip(one, mask)]
        apart = [m.bit_count() for m in mask]
        want = [i for i in range(16) if apart[i] == 0 and all(sum(apart[(i + j) % 16] for j in range(n)) <= 19 * n for n in range(1, 17))][:1]
        rows = pa.table({"sketch": [bytes([17]) * 512 + np.array(r, np.uint64).tobytes() for r in (one, two)]})
        got = [i for i in range(16) if simhash._Bucket(i - 16 * rng.randint(0, 9), rows).estimates(0, np.array([1]))[0] >= 0]
        assert got == want
        seen[len(got)] += 1
    assert seen[0] > 30 and seen[1] > 30


def test_near_duplicates_at_the_limit(spark):
    rng, docs, want, near = random.Random(12), [], set(), 0
    for n, pairs in ((300, 30), (1000, 30), (4000, 20), (12_000, 12)):
        for p in range(pairs):
            a, b, same = similar_texts(rng, n, int(n * (0.0205 if p % 2 else 0.0235)))
            assert 0.78 <= same <= 0.84
            want |= {len(docs)} if same >= 0.8 else {len(docs), len(docs) + 1}
            near += same >= 0.8
            docs += [(len(docs), a), (len(docs) + 1, b)]
    assert near == 46
    kept = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == want


def brute_nearest(rows, queries, k):
    out = {}
    for q, x in queries:
        s = [(-float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))), i) for i, y in rows if i != q]
        out[q] = [i for _, i in sorted((round(a, 12), b) for a, b in s)[:k]]
    return out


def test_neighbours(spark):
    r = np.random.default_rng(0)
    centres = r.standard_normal((12, 16)) * 2
    x = (centres[r.integers(0, 12, 1500)] + r.standard_normal((1500, 16))).astype(np.float32)
    x[200:260] = x[200]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] * 16), (None, [1.0] * 16), (5200, [1.0] * 3), (5250, [float("inf")] * 16)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>").repartition(6)
    got = defaultdict(list)
    for g in neighbours.nearest(df, F.col("vec_id") % 50 == 0, block=300).orderBy("query_id", "rank").collect():
        got[g.query_id].append(g.vec_id)
    both = [(i, v.astype(float)) for i, v in enumerate(x)]
    want = brute_nearest(both, both[::50], 5)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(w)) / 5 for q, w in want.items()]) >= 0.95
    assert got[200] == [201, 202, 203, 204, 205]


@pytest.mark.parametrize("share", [3, 1.25])
def test_neighbours_behind_a_block_of_copies(spark, share):
    r = np.random.default_rng(3)
    x = r.standard_normal((3000, 16))
    copies = int(len(x) / share)
    x[:copies] = np.repeat(x[: copies // 50 + 1], 50, axis=0)[:copies] + r.standard_normal((copies, 16)) * 1e-3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    made = neighbours.Index(x, 40)
    probes, own = np.broadcast_to(made.probes(x, 5, 0.98), 40), made.lists_of(x)
    said = x @ x.T
    np.fill_diagonal(said, -2)
    near = np.argsort(-said, axis=1)[:, :5]
    rank = np.argsort(-(x @ made.centres.T - (made.centres**2).sum(1) / 2), axis=1).argsort(1)
    met = np.take_along_axis(rank, own[near], 1) < probes[own][:, None]
    assert met[:copies].mean() >= 0.97 and met[copies:].mean() >= 0.97
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    got = defaultdict(set)
    for g in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got[g.query_id].add(g.vec_id)
    assert np.mean([len(got[q] & set(near[q].tolist())) / 5 for q in range(-(-copies // 20) * 20, len(x), 20)]) >= 0.95


@pytest.mark.parametrize("shift", [0, 0.05])
def test_neighbours_of_repeated_ids(spark, shift):
    r = np.random.default_rng(4)
    x = r.standard_normal((600, 12))
    both = [(i, v + shift * r.standard_normal(12)) for i, v in enumerate(x) for _ in range(6)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in both], "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for g in neighbours.nearest(df, F.col("vec_id") % 20 == 0, block=200, recall=1.0).orderBy("query_id", "rank").collect():
        got[g.query_id].append(g.vec_id)
    u = np.stack([v / np.linalg.norm(v) for _, v in both])
    ids = np.array([i for i, _ in both])
    want = {}
    for q in range(0, 600, 20):
        best = (u[ids == q] @ u.T).max(0).reshape(600, 6).max(1)
        best[q] = -2
        want[q] = np.argsort(-best)[:5].tolist()
    assert {len(v) for v in got.values()} == {5} and got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(w)) / 5 for q, w in want.items()]) >= 0.97


def test_lists_of_few_ids(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((7, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x) for _ in range(40)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.lit(True)).collect()
    assert len(got) == 35 and all(len({g.vec_id for g in got if g.query_id == q} - {q}) == 5 for q in range(7))


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, round(r.score, 6)) for r in got] == [(1, 1, 0.707107), (2, 2, -1.0)]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("piece", [1 << 18, 1, 2, 5])
@pytest.mark.parametrize("cached", [1 << 22, 4])
def test_ppm_code_lengths(monkeypatch, piece, cached):
    """The trees against a plain PPM coder with exclusion, whatever the slices and the cache."""
    monkeypatch.setattr(langid, "_SLICE", piece)
    monkeypatch.setattr(langid, "CACHED", cached)
    train = {"x": "abracadabra abra\n", "y": "the cat sat on the mat"}
    trees = langid.Trees(sorted(train), [langid.grams(pa.array([train[n]])) for n in sorted(train)])

    def plain(text, known):
        counts = defaultdict(lambda: defaultdict(int))
        padded = b"\n\n\n" + known.encode()
        for i in range(3, len(padded)):
            for k in range(4):
                counts[padded[i - k : i]][padded[i]] += 1
        bits, t = 0.0, b"\n\n\n" + text.encode()
        for i in range(3, len(t)):
            out: set[int] = set()
            for k in (3, 2, 1, 0):
                c = {s: n for s, n in counts.get(t[i - k : i], {}).items() if s not in out}
                n, q = sum(c.values()), len(c)
                if t[i] in c:
                    bits += np.log2((n + q) / c[t[i]])
                    break
                bits += np.log2((n + q) / q) if q else 0
                out |= set(c)
            else:
                bits += np.log2(256 - len(out))
        return bits

    texts = ["abra", "the mat abra", "", "zebra é", "cadab", "a", "", "abracadabra the cat sat, abra"]
    for data, offsets in licenses.text_blocks(pa.array(texts)):
        got = [trees.lengths(data, offsets) for _ in range(2)][1]
    for row, t in zip(got, texts, strict=True):
        assert row == pytest.approx([plain(t, train[n]) for n in sorted(train)], abs=1e-3)


def test_language(spark, odd, none):
    docs = spark.createDataFrame([(i, "the cat and the dog are here with us" if i % 2 else "le chat et le chien sont ici avec nous", "en" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string")
    model = langid.learn(docs, F.col("doc_id") < 30)
    assert all(r.lang_pred == r.lang for r in langid.identify(docs, model).collect())
    got = {(r.doc_id, r.text): r for r in langid.identify(odd, model).collect()}
    assert got[(1, None)].lang_pred == got[(2, "")].lang_pred == got[(None, "   \n\t ")].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(none, model).count() == 0
    nothing = langid.learn(none, F.lit(True))
    assert {(r.lang_pred, r.score) for r in langid.identify(odd, nothing).collect()} == {("und", 0.0)}


def test_every_language_is_learnt(spark):
    """Eighty languages of their own letters each, one of them in one document alone."""
    rng = random.Random(8)
    rows = []
    for k in range(80):
        letters = [chr(0x4E00 + 5 * k + j) for j in range(5)]
        rows += [(len(rows) + i, " ".join("".join(rng.choices(letters, k=5)) for _ in range(20)), f"l{k:02}") for i in range(1 if k == 7 else 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, F.lit(True), train_total=160, train_bytes=1 << 20)
    assert model.sent.value[0] == [f"l{k:02}" for k in range(80)]
    assert sum(int(n.sum()) for _, n in model.sent.value[1]) < 160 * 3 * 250
    assert all(r.lang_pred == r.lang for r in langid.identify(docs, langid.learn(docs, F.lit(True))).collect())


def test_texts_of_no_learnt_language_are_strange(spark):
    words = {"en": "the cat and dog are here with us in a house of stone", "fr": "le chat et le chien sont ici avec nous dans une maison"}
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(60)), lang) for i in range(200) for lang in [("en", "fr")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, F.lit(True))
    assert set(model.usual) == {"en", "fr"}
    other = ["\u0434\u043e\u043c \u0438 \u043a\u043e\u0442 " * 30, "zqx jjwv kqxz wwyzq " * 30, "cat", "xyz 9"]
    tried = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(other)], "doc_id long, text string, Strange string, bits string")
    assert [r.strange for r in langid.identify(tried, model).orderBy("doc_id").collect()] == [True, True, False, False]
    assert not any(r.strange for r in langid.identify(docs, model).collect())


def test_long_texts_are_judged_by_slices():
    rng = np.random.default_rng(2)
    w, t = rng.normal(size=3 * quality.OWN + 3), rng.normal(size=(2, 2))
    for text in (b"", b"\n", b"a\n\nb", b"one line", b"\n".join(rng.choice([b"ab cd", b"ab cd", b"A!!!", b"", b"some longer line, 12 words"], 400).tolist())):
        data = np.frombuffer(text, np.uint8)
        x, weight, first = quality.lines(data, np.array([0, len(data)]))
        want = quality.document_means(quality.marginals(x, first, w, t)[0], weight, first)[0]
        for size in (1, 7, 64, 1000):
            assert abs(quality.long_mean(data, w, t, size) - want) < 1e-9


def test_quality_of_a_long_text_of_short_lines(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ("Good words stand here.\n" if i % 2 else "!!!! 55 ||\n") * (40 if i < 30 else 4000)) for i in range(32)], "doc_id long, text string")
    labels = spark.range(30).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    model = quality.learn(docs, labels, F.lit(True))
    monkeypatch.setattr(quality, "BLOCK_BYTES", 1 << 30)
    whole = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all((whole[i] >= 0.5) == (i % 2 == 1) for i in range(32))
    long = np.frombuffer(("Good words stand here.\n" * 4000).encode(), np.uint8)
    mean = quality.long_mean(long, *model[:2], slice_lines=100)
    assert abs(1 / (1 + np.exp(-(model[2] * (mean - 0.5) + model[3]))) - whole[31]) < 1e-9


def test_marginals_equal_all_paths():
    from itertools import product

    r = np.random.default_rng(1)
    x, w, t = r.standard_normal((9, 3)), r.standard_normal(3), r.standard_normal((2, 2))
    first = np.array([0, 4, 5, 9])
    p, joint = quality.marginals(x, first, w, t)
    for a, b in zip(first[:-1], first[1:], strict=True):
        total, ones, pair = 0.0, np.zeros(b - a), np.zeros((b - a, 4))
        for y in product((0, 1), repeat=b - a):
            s = np.exp(sum(x[a + i] @ w * y[i] for i in range(b - a)) + sum(t[y[i - 1], y[i]] for i in range(1, b - a)))
            total, ones = total + s, ones + s * np.array(y)
            for i in range(1, b - a):
                pair[i, 2 * y[i - 1] + y[i]] += s
        assert p[a:b] == pytest.approx(ones / total) and joint[a:b] == pytest.approx(pair / total)


def test_line_features_split_like_python():
    texts = ["a b\n\nc c c!", "", "\n", "x" * 50, "é é\nok."]
    for data, offsets in licenses.text_blocks(pa.array(texts)):
        x, weight, first = quality.lines(data, offsets)
    assert np.diff(first).tolist() == [len(t.split("\n")) for t in texts]
    assert weight.tolist() == [len(line.encode()) + 1 for t in texts for line in t.split("\n")]


def test_quality(spark, odd, none):
    rng = random.Random(6)
    good = lambda: "\n".join("The " + " ".join(rng.choice(["river", "hill", "walks", "slowly", "home"]) for _ in range(9)) + "." for _ in range(5))
    bad = lambda: "\n".join("BUY!! NOW!! | $$$ | ### 99 99 99" for _ in range(5))
    docs = spark.createDataFrame([(i, good() if i % 2 else bad()) for i in range(120)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(None).cast("string").alias("text"))
    model = quality.learn(docs, labels, F.col("doc_id") < 80)
    assert all(r.predicted == r.doc_id % 2 for r in quality.score(docs, model).collect())
    rows = quality.score(odd, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert quality.score(none, model).count() == 0 and quality.learn(docs, labels.limit(0), F.lit(True)) is None
    assert {r.score for r in quality.score(odd, None).collect()} == {0.5}


def test_matching_statistics():
    own = licenses.Scanner()
    runs = {tuple(own.number[w.encode()] for w in t[i:j]) for t in own.templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    rng = random.Random(7)
    words = [w for t in own.templates for w in t]
    for _ in range(60):
        stream = []
        while len(stream) < 40:
            t = rng.choice(own.templates)
            i = rng.randrange(len(t))
            stream += [own.number[w.encode()] for w in t[i : i + rng.randint(1, 9)]] if rng.random() < 0.7 else [own.number[rng.choice(words).encode()]]
        lengths = []
        for i in range(len(stream)):
            n = 0
            while n <= i and tuple(stream[i - n : i + 1]) in runs:
                n += 1
            lengths.append(n)
        want = [(i, n) for i, n in enumerate(lengths) if n >= 3 and (i + 1 == len(stream) or lengths[i + 1] <= n)]
        assert [(a, n) for a, n, _ in own.automaton.anchors(stream, 3)] == want


def test_licenses(spark, odd, none):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rng = random.Random(9)
    bits = ["MIT license", "mit-license", "Apache  License", "general\npublic license", "été", "日本", "the", "0", ".", *(t for _, t in licenses.TEMPLATES)]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text))
        places = [(i, label) for p, label in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    edited = licenses.TEMPLATES[2][1].replace("any person", "any other person").replace("this software", "such software")
    (one,) = licenses.scan_licenses(spark.createDataFrame([(1, "x " * 50 + edited + " y" * 50)], "doc_id long, text string")).collect()
    assert one.labels == "mit" and one.spans[0].first_word == 50 and 0.75 <= one.score < 1
    whole = [t for _, t in licenses.TEMPLATES if len(t) > 600]
    mixed = " noise ".join(whole).upper()  # whole licences, one after the other
    (one,) = licenses.scan_licenses(spark.createDataFrame([(1, mixed)], "doc_id long, text string")).collect()
    assert len(whole) >= 4 and {s.template for s in one.spans if s.coverage == 1} >= {k for k, (_, t) in enumerate(licenses.TEMPLATES) if t in whole} and one.score == 1
    got = licenses.scan_licenses(odd).collect()
    assert [r.labels for r in got] == [""] * 8 + ["mit", ""] and got[1].n_words == 0 and got[0].n_words == 9
    assert licenses.scan_licenses(none).count() == 0


def test_crc_of_binary_is_unsigned(spark):
    assert spark.range(1).select(F.crc32(F.lit(b"\xff\x00")).alias("c")).first().c == zlib.crc32(b"\xff\x00")


def test_names_of_helper_columns_stay(spark):
    """Whatever an input column is called, it comes out as it was."""
    names = ["scan", "_scan", "best", "_best", "fp", "_fp", "row", "_row", "bucket", "place", "g", "k"]
    docs = spark.createDataFrame([(i, f"text of document {i} under the MIT License", *map(str, range(len(names)))) for i in range(4)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    model = langid.learn(docs.withColumn("lang", F.lit("en")), F.lit(True))
    for got in (licenses.scan_licenses(docs), langid.identify(docs, model), simhash.linked(docs), simhash.near_duplicates(docs), sharding.shuffle_into_shards(docs, 2), quality.score(docs, None), token_counts.count_tokens(docs, BYTE)):
        assert [[r[n] for n in names] for r in got.collect()] == [list(map(str, range(len(names))))] * got.count()


def test_lines_that_begin_alike_are_no_twins():
    data = np.frombuffer(b"the same beginning, one end\nthe same beginning, two end\nthe same beginning, two end\nbeginning! beginning? beginning?", np.uint8)
    x, _, _ = quality.lines(data, np.array([0, len(data)]))
    twin, repeats = len(quality.CLASSES) + 3, len(quality.CLASSES) + 2
    assert x[:, twin].tolist() == [0, 0, 1, 0] and x[:, repeats].tolist() == pytest.approx([0, 0, 0, 1 / 3])


def test_neighbours_of_extreme_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [1e-200, 1e-200]), (3, [5e-324, 0.0]), (4, [-1.0, 1.0]), (5, [1e308, -1e308])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [2, 1, 3, 4, 5] and [round(r.score, 6) for r in got] == [1.0, 0.707107, 0.707107, 0.0, 0.0]


def test_items_in_very_long_and_repetitive_texts(spark):
    item = " ".join(f"w{i}x{i * 7}" for i in range(40))
    again = "abc " * 40
    bench = spark.createDataFrame([(1, item), (2, again)], "item_id long, text string")
    docs = spark.createDataFrame([(1, LONG + " " + item.replace("w3", "v3") + " " + LONG), (2, "abc " * 20_000), (3, "abd " * 20_000), (4, LONG)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(docs, bench).collect()}
    assert got.keys() == {(1, 1), (2, 2)} and 0 < got[(1, 1)] <= 12 and got[(2, 2)] == 0


def test_each_text_is_searched_once(spark, odd):
    bench = spark.createDataFrame([(1, "some item of a benchmark")], "item_id long, text string")
    plan = decontaminate.contaminated(odd, bench)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def brute_chains(anchors, gap):
    """The most words that any chain of anchors covers, by trying all."""

    def best(i):
        d, t, n = anchors[i]
        return n + max((best(j) - max(0, d + n - anchors[j][0], t + n - anchors[j][1]) for j in range(len(anchors)) if anchors[j][0] > d and anchors[j][1] > t and max(0, d + n - anchors[j][0], t + n - anchors[j][1]) < anchors[j][2] and anchors[j][0] - d - n <= gap and anchors[j][1] - t - n <= gap), default=0)

    return max(map(best, range(len(anchors))), default=0)


def test_chains_equal_brute_force():
    rng = random.Random(13)
    for _ in range(300):
        anchors = [(rng.randrange(20), rng.randrange(12), rng.randint(3, 5)) for _ in range(rng.randint(0, 7))]
        got = licenses.chains(anchors, 30, 4)
        assert max((c for _, _, c in got), default=0) == brute_chains(sorted(set(anchors)), 4)
        spans = [(a, b) for a, b, _ in got]
        assert all(a <= b for a, b in spans) and len(spans) <= len(anchors)


def test_spans_equal_a_plain_scan(spark):
    """Labels, spans and scores against anchors found by trying every run of words in every template."""
    rng, own = random.Random(17), licenses.Scanner()
    texts = []
    for _ in range(60):
        words = []
        while len(words) < 60:
            t = rng.choice(own.templates)
            i = rng.randrange(len(t))
            words += t[i : i + rng.randint(1, 40)] if rng.random() < 0.8 else ["noise"]
        texts.append(" ".join(words))
    for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        words, labels, score = r.text.split(" "), set(filter(None, r.base_labels.split(","))), 0.0
        runs = []  # the longest run of any template that ends at each word
        for at in range(len(words)):
            n = next(k for k in range(min(at + 1, 200), -1, -1) if not k or any(words[at - k + 1 : at + 1] == t[j : j + k] for t in own.templates for j in range(len(t) - k + 1)))
            runs.append(n)
        ends = [(at, n) for at, n in enumerate(runs) if n >= licenses.MIN_MATCH and (at + 1 == len(words) or runs[at + 1] <= n)]
        for k, t in enumerate(own.templates):
            anchors = [(at - n + 1, j, n) for at, n in ends for j in range(len(t) - n + 1) if t[j : j + n] == words[at - n + 1 : at + 1]]
            for _, _, covered in licenses.chains(anchors, len(t), licenses.MAX_GAP):
                score = max(score, min(1.0, covered / len(t)))
                labels |= {licenses.TEMPLATES[k][0]} if min(1.0, covered / len(t)) >= licenses.COVERED else set()
        assert (r.labels, r.score) == (",".join(sorted(labels)), score)
