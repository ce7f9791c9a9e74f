"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of orders 0 to 3 with frozen counts. A byte costs its exact code length: the
longest known context codes it or escapes (method C: the escape counts as often as symbols have been seen) to the next
shorter one, which leaves out the symbols already ruled out; bytes seen nowhere cost an even share of the rest. A text
gets the language of the smallest code length. As the statistics are frozen, a cost depends on four bytes alone: each
worker works out the cost of a run of four bytes when it first meets it, and looks it up from then on.

Trees are kept as sorted arrays of the contexts seen, all of them, so they grow with what was learnt and with the
number of languages, not with the alphabet. They are learnt from a bounded sample of labelled rows, by a hash of the
id: of every language about ``train_docs`` documents (all, if there are fewer), less where that would come to more than
``train_total`` documents or ``train_bytes`` bytes of text for all languages together, but one at least.
All three are parameters of learn. The contexts that the driver gathers are fewer than the bytes learnt.

What a byte of a language usually costs is measured on documents of the sample that its tree hasn't learnt. A text that
costs STRANGE times as much, FREE_BITS aside, is in none of the learnt languages: it is marked as strange.

Defined results: ``und`` with score 0 for null texts, texts without a letter and where nothing could be learnt; ties
go to the smaller language name; repeated rows each get the same answer; an empty table gives an empty result;
columns of the input that clash with an added name are replaced; texts of any length, in any number of lines, are scored
whole, a slice at a time. score is the winner's chance by Bayes' rule, all languages being equally likely beforehand.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import free_name, held, text_blocks, without

TRAIN_DOCS, TRAIN_TOTAL, TRAIN_BYTES = 2000, 20_000, 256 << 20
TRIED, TRIED_FROM = 5, 20  # one in five documents is kept to try the trees on, where a language has so many
STRANGE, FREE_BITS = 2.5, 256  # a text is strange from so many times the usual bits a byte on, and so many more
CACHED = 1 << 22  # costs that a worker keeps
UNKNOWN = "und"
_START = 10  # a text is preceded by line ends
_COSTS = 1 << 22  # bytes times languages looked at together
_SLICE = 1 << 18  # and bytes at most, however few the languages


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Runs of four bytes (the first three may precede the text) and how often each is seen."""
    parts = [_grams(data, offsets) for data, offsets in text_blocks(texts) if len(data)]
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte after the three before it; a first border of -3 says that the first text began earlier."""
    out = data.astype(np.uint32)
    starts, ends = offsets[:-1], offsets[1:]
    for k in (1, 2, 3):
        p = np.full(len(data), _START, np.uint32)
        p[k:] = data[:-k] if len(data) > k else data[:0]
        for j in range(k):
            at = starts + j
            p[at[(at < ends) & (at >= 0)]] = _START
        out |= p << np.uint32(8 * k)
    return out


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where wanted keys stand among sorted ones, and whether they do."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


class Tree:
    """One language's contexts and what follows them, order by order."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.seen, self.n, contexts = [], [], []
        for order in range(4):
            keys, at = np.unique(grams & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
            n = np.bincount(at, counts, len(keys))
            self.seen.append(keys)
            self.n.append(n)
            names, first = np.unique(keys >> np.uint32(8), return_index=True)
            contexts.append((names, np.add.reduceat(n, first) if len(n) else n, np.diff(np.append(first, len(keys)))))
        # of each context: its name, how often and how many symbols were seen, and how often those stand in the next shorter one
        self.contexts = []
        for order, (names, total, kinds) in enumerate(contexts):
            shorter = np.zeros(len(names))
            if order:
                below = self.n[order - 1][_at(self.seen[order - 1], self.seen[order] & np.uint32((1 << 8 * order) - 1))[0]]
                shorter = np.bincount(np.searchsorted(names, self.seen[order] >> np.uint32(8)), below, len(names))
            self.contexts.append((names, total, kinds, shorter))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """The code length of each gram's last byte after the three before it."""
        bits, escaped = np.zeros(len(grams)), np.zeros(len(grams))
        left = np.ones(len(grams), bool)  # not coded yet
        out_n, out_q = np.zeros(len(grams)), np.zeros(len(grams))  # of the symbols ruled out already
        for order in (3, 2, 1, 0):
            gram = grams & np.uint32((1 << 8 * (order + 1)) - 1)
            names, total, kinds, shorter = self.contexts[order]
            at, known = _at(names, gram >> np.uint32(8))
            n, q = (np.where(known, x[at] if len(x) else 0, 0) for x in (total, kinds))
            free_n, free_q = n - out_n, q - out_q
            if len(names):
                out_n, out_q = np.where(known, shorter[at], 0), q
            place, here = _at(self.seen[order], gram)
            here &= left
            bits[here] = (escaped + np.log2(np.maximum(free_n + free_q, 1)))[here] - np.log2(self.n[order][place[here]])
            left &= ~here
            escaped += np.where(free_q > 0, np.log2(np.maximum(free_n + free_q, 1)) - np.log2(np.maximum(free_q, 1)), 0)
        bits[left] = escaped[left] + np.log2(max(1, 256 - len(self.seen[0])))
        return bits


class Trees:
    """The context trees of all languages, and the costs met so far."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.languages = languages
        self.trees = [Tree(g, n) for g, n in counts]
        self.shift = np.uint32(32 - (CACHED // max(1, len(languages))).bit_length() + 1)
        self.keys = np.zeros(1 << int(32 - self.shift), np.uint32)
        self.keys[0] = 1  # no slot holds its own key yet
        self.costs = np.zeros((len(self.keys), len(languages)), np.float32)

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint32(2654435761)) >> self.shift

    def _bits(self, grams: np.ndarray) -> np.ndarray:
        slot = self._slot(grams)
        out = self.costs[slot]
        new = np.flatnonzero(self.keys[slot] != grams)
        if len(new):
            met, which = np.unique(grams[new], return_inverse=True)
            got = np.stack([t.bits(met) for t in self.trees], 1).astype(np.float32)
            out[new] = got[which]
            slot, first = np.unique(self._slot(met), return_index=True)
            free = self.keys[slot] == (slot == 0)  # others are worked out again each time
            self.keys[slot[free]], self.costs[slot[free]] = met[first[free]], got[first[free]]
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        width = min(_SLICE, max(1 << 10, _COSTS // len(self.languages)))
        for lo in range(0, len(data), width):
            hi = min(lo + width, len(data))
            first = int(np.searchsorted(offsets, lo, "right")) - 1
            last = int(np.searchsorted(offsets, hi, "left"))
            back = max(0, lo - 3)
            starts = offsets[int(np.searchsorted(offsets, back)) : last] - back
            earlier = [] if len(starts) and starts[0] == 0 else [-3]
            bits = self._bits(_grams(data[back:hi], np.concatenate([earlier, starts, [hi - back]]).astype(np.int64))[lo - back :])
            docs = np.arange(first, last)
            cuts = np.maximum(offsets[first:last], lo) - lo
            full = np.minimum(offsets[first + 1 : last + 1], hi) - lo > cuts
            out[docs[full]] += np.add.reduceat(bits, cuts[full], axis=0, dtype=np.float64)
        return out


class Model(NamedTuple):
    """A learnt model: its name, the broadcast contexts of all languages, and the usual bits a byte of each."""

    name: str
    sent: Broadcast
    usual: dict[str, float]


def learn(docs: DataFrame, learn_from: Column, text: str = "text", language: str = "lang", key: str = "doc_id", train_docs: int = TRAIN_DOCS, train_total: int = TRAIN_TOTAL, train_bytes: int = TRAIN_BYTES) -> Model:
    """A broadcast model of the languages of the rows where learn_from holds and language and text aren't null."""
    spark = docs.sparkSession
    rows = docs.where(learn_from & F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(language).cast("string").alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(key), F.lit(8)), F.lit(1 << 20)).alias("h"))
    known = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min("h").alias("least")).collect()
    model = None
    if known:
        each, each_bytes = min(train_docs, max(1, train_total // len(known))), train_bytes // len(known)

        def upto(n: int, size: int, least: int) -> int:
            """A language's rows with smaller hashes are learnt: of 2 ** 20 parts so many, but its first row at least."""
            return max(int(min(each / n, each_bytes / max(size, 1)) * (1 << 20)), least + 1)

        of_language = lambda column: F.element_at(F.create_map(*(F.lit(x) for r in known for x in (r.lang, column(r)))), F.col("lang"))
        many = [r.lang for r in known if r.n >= TRIED_FROM]
        picked = rows.where(F.col("h") < of_language(lambda r: upto(r.n, r.bytes, r.least)))
        picked = picked.withColumn("tried", (F.col("h") % TRIED == 0) & F.col("lang").isin(many) & (F.col("h") != of_language(lambda r: r.least)))
        sample = picked.where("not tried").select("lang", "text")

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name in batch.column("lang").unique():
                    g, n = grams(batch.column("text").filter(pc.equal(batch.column("lang"), name)))
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([name.as_py()] * len(g), pa.string()), "gram": g.astype(np.int64), "n": n.astype(np.int64)})

        found = sample.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
        if len(found):
            groups = {name: part for name, part in found.groupby("lang")}
            names = sorted(groups)
            model = names, [(np.asarray(groups[x].gram, np.uint32), np.asarray(groups[x].n, np.int64)) for x in names]
    learnt = Model(uuid.uuid4().hex, spark.sparkContext.broadcast(model), {})
    if model and many:
        cost = identify(picked.where("tried").select("lang", "text"), learnt).where("lang_pred = lang").groupBy("lang").agg((F.sum("bits") / F.sum(F.octet_length("text"))).alias("each"))
        learnt.usual.update((r.lang, r.each) for r in cost.collect() if r.each)
    return learnt


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score, bits (the text's code length in that language) and strange (whether that is much for its bytes)."""
    kept = without(docs, "lang_pred", "score", "bits", "strange")
    if model.sent.value is None:
        return kept.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "bits": F.lit(0.0), "strange": F.lit(False)})
    name, sent = model.name, model.sent

    @arrow_udf("struct<lang_pred:string,score:double,bits:double>")
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees = held(name, lambda: Trees(*sent.value))
        for texts in batches:
            won, score, least = [], [], []
            for data, offsets in text_blocks(texts):
                bits = trees.lengths(data, offsets)
                won.append(bits.argmin(1))
                least.append(bits.min(1))
                score.append(1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1))
            names = pa.array(trees.languages, pa.string())
            at, score, least = (np.concatenate([np.zeros(0, kind), *x]) for kind, x in ((np.int64, won), (float, score), (float, least)))
            yield pa.StructArray.from_arrays([names.take(pa.array(at)), pa.array(score), pa.array(least)], ["lang_pred", "score", "bits"])

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    own = free_name(kept, "best")
    found = kept.withColumn(own, best(F.coalesce(F.col(text), F.lit(""))))
    usual = F.element_at(F.create_map(*(F.lit(x) for pair in model.usual.items() for x in pair)), F.col(f"{own}.lang_pred")) if model.usual else F.lit(None)
    much = F.col(f"{own}.bits") > STRANGE * usual * F.octet_length(text) + FREE_BITS
    return found.select(
        *(F.col(f"`{c}`") for c in kept.columns),
        F.when(letters, F.col(f"{own}.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(letters, F.col(f"{own}.score")).otherwise(0.0).alias("score"),
        F.when(letters, F.col(f"{own}.bits")).otherwise(0.0).alias("bits"),
        (letters & F.coalesce(much, F.lit(False))).alias("strange"),
    )
