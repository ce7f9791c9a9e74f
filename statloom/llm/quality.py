"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line is good or bad. What speaks for either are byte-level features of the line and of its neighbours; what links
lines are transition weights. Forward-backward gives each line's marginal, and a document's quality is their mean,
weighted by line length, put through a one-dimensional logistic calibration.

Labels are known for documents only, so in learning each line has its document's label. Learning is bounded: about
``train_docs`` labelled documents by a hash of the id, of each a stretch of at most ``train_lines`` lines that begins at
a hashed place (both are parameters of learn); their features are gathered on the driver. Statistics of lines cover
whole texts. Scoring is a scan: no shuffle, whole texts.

Texts longer than BLOCK_BYTES are judged a slice of lines at a time: forward with the chances that the slice before
leaves, then backward, two numbers a line being kept. So memory grows by a third of a text's bytes per number even where
lines are short.

Defined results: null and empty texts are one empty line and get its score; very long texts are judged whole; texts without labels to learn from score
0.5; ties (score 0.5) count as good; repeated rows each get the same score; an empty table gives an empty result;
columns of the input that clash with an added name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import text_blocks, without

TRAIN_DOCS = 3000
TRAIN_LINES = 120
ROUNDS = 200  # of gradient descent
BLOCK_BYTES = 1 << 20  # of texts judged together; longer ones are judged by slices
SLICE_LINES = 1 << 16

# Classes of bytes whose shares of a line are features.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"|", b"!?", b"#$%&*+<=>@[]\\^_`{}~/", b".,;:'\"()-", b" \t\r")
_CLASS = np.zeros(256, np.uint8)
for _i, _c in enumerate(CLASSES):
    _CLASS[list(_c)] = _i + 1
_CLASS[128:] = len(CLASSES) + 1
_KINDS = len(CLASSES) + 2
OWN = len(CLASSES) + 6  # features of a line by itself


_VALUE = np.random.default_rng(9).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(factor: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.append(np.uint64(1), np.full(n, factor, np.uint64)))


def _hashes(data: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """A hash of all bytes of each stretch (start, size): a polynomial, from sums over everything before."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * _powers(_FACTOR, len(data))[:-1], dtype=np.uint64)])
    back = _powers(_INVERSE, len(data))
    return [(sums[starts + sizes] - sums[starts]) * back[starts] for starts, sizes in spans]


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line (with those of the lines before and after), its weight, and each text's first line."""
    ends_at = np.flatnonzero(data == 10)
    n_docs = len(offsets) - 1
    per_doc = np.searchsorted(ends_at, offsets[1:]) - np.searchsorted(ends_at, offsets[:-1]) + 1
    first = np.concatenate([[0], np.cumsum(per_doc)])
    n = int(first[-1])
    starts, stops = np.empty(n, np.int64), np.empty(n, np.int64)
    is_first = np.zeros(n, bool)
    is_first[first[:-1]] = True
    is_last = np.zeros(n, bool)
    is_last[first[1:] - 1] = True
    starts[is_first], stops[is_last] = offsets[:-1], offsets[1:]
    starts[~is_first], stops[~is_last] = ends_at + 1, ends_at
    size = stops - starts
    line_of = np.repeat(np.arange(n, dtype=np.int32), size + ~is_last)
    counts = np.bincount(line_of * _KINDS + _CLASS[data], minlength=n * _KINDS).reshape(n, _KINDS).astype(np.float64)
    counts[~is_last, 0] -= 1  # the line end
    share = counts[:, 1:] / np.maximum(size, 1)[:, None]
    gap = (data == 32) | (data == 10) | (data == 9)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    word = ~gap
    word_at = np.flatnonzero(word & (np.concatenate([[True], gap[:-1]]) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    word_end = np.flatnonzero(word & (np.concatenate([gap[1:], [True]]) | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    word_size = word_end - word_at
    key, line_key = _hashes(data, [(word_at, word_size), (starts, size)])
    word_line = line_of[word_at] if len(word_at) else np.zeros(0, np.int64)
    same = np.zeros(len(word_at), bool)
    if len(word_at) > 1:
        same[1:] = (key[1:] == key[:-1]) & (word_size[1:] == word_size[:-1]) & (word_line[1:] == word_line[:-1])
    words = np.bincount(word_line, minlength=n)
    repeats = np.bincount(word_line, same, n) / np.maximum(words, 1)
    twin = np.zeros(n, bool)
    if n > 1:
        twin[1:] = (line_key[1:] == line_key[:-1]) & (size[1:] == size[:-1]) & ~is_first[1:]
    last_byte = np.where(size > 0, data[np.maximum(stops - 1, 0)] if len(data) else 0, 0)
    own = np.column_stack([share, np.log1p(size) / 8, repeats, twin, np.isin(last_byte, [33, 46, 63]), np.minimum(size / np.maximum(words, 1), 40) / 10])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][~is_first[1:]] = own[:-1][~is_first[1:]]
    after[:-1][~is_last[:-1]] = own[1:][~is_last[:-1]]
    return np.column_stack([own, before, after, is_first, is_last, np.ones(n)]), size + 1.0, first


def _products(m: np.ndarray, longest: int, forward: bool) -> np.ndarray:
    """Products of each matrix with those before it (or after it); m: four columns, row by row. Scaled to a largest entry of 1."""
    p, d = m.copy(), 1
    while d < longest:
        a, b = p[:-d], p[d:]
        got = np.stack([a[:, 0] * b[:, 0] + a[:, 1] * b[:, 2], a[:, 0] * b[:, 1] + a[:, 1] * b[:, 3], a[:, 2] * b[:, 0] + a[:, 3] * b[:, 2], a[:, 2] * b[:, 1] + a[:, 3] * b[:, 3]], 1)
        got /= got.max(1, keepdims=True)
        p = np.concatenate([p[:d], got]) if forward else np.concatenate([got, p[-d:]])
        d *= 2
    return p


def _steps(u: np.ndarray, t: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What each line, good by u, does to the chances of the line before it: matrices as four columns. At starts their equal rows forget what came before."""
    top = np.maximum(u, 0)
    bad, good = np.exp(-top), np.exp(u - top)
    e = np.exp(t - t.max())
    m = np.column_stack([e[0, 0] * bad, e[0, 1] * good, e[1, 0] * bad, e[1, 1] * good])
    m[starts] = np.column_stack([bad, good, bad, good])[starts]
    m /= m.max(1, keepdims=True)
    return m


def marginals(x: np.ndarray, first: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's chance to be good, and of each pair (line before, line) the four joint chances."""
    n = len(x)
    starts = first[:-1]
    m = _steps(x @ w, t, starts)
    longest = int(np.diff(first).max(initial=1))
    alpha = _products(m, longest, True)[:, :2]
    suffix = _products(m, longest, False)
    beta = np.ones((n, 2))
    beta[:-1] = np.column_stack([suffix[1:, 0] + suffix[1:, 1], suffix[1:, 2] + suffix[1:, 3]])
    beta[first[1:] - 1] = 1
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    joint = np.zeros((n, 4))
    if n > 1:
        j = np.repeat(alpha[:-1], 2, axis=1) * m[1:] * np.tile(beta[1:], 2)
        joint[1:] = j / np.maximum(j.sum(1, keepdims=True), 1e-300)
    joint[starts] = 0
    return p[:, 1], joint


def _borders(data: np.ndarray) -> np.ndarray:
    """Where each line of one text begins, and one past where the next would."""
    return np.concatenate([[0], np.flatnonzero(data == 10) + 1, [len(data) + 1]])


def _stretch(data: np.ndarray, borders: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights of lines a to b - 1 of one text, from those lines, two before and one after alone."""
    lo, hi = max(a - 2, 0), min(b + 1, len(borders) - 1)
    part = data[borders[lo] : borders[hi] - 1]
    x, weight, _ = lines(part, np.array([0, len(part)]))
    return x[a - lo : b - lo], weight[a - lo : b - lo]


def long_mean(data: np.ndarray, w: np.ndarray, t: np.ndarray, slice_lines: int = SLICE_LINES) -> float:
    """document_means of one text of any length: its lines a slice at a time, forward with what the slice before leaves, then backward; a line keeps two numbers."""
    borders = _borders(data)
    n = len(borders) - 1
    cuts = [*range(0, n, slice_lines), n]
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    u, alpha = np.empty(n), np.empty(n)  # alpha: the chance to be good by the lines so far
    carry = np.ones(2)
    for a, b in spans:
        step = max(1, slice_lines // 8)
        for i in range(a, b, step):
            u[i : min(b, i + step)] = _stretch(data, borders, i, min(b, i + step))[0] @ w
        m = _products(_steps(u[a:b], t, np.arange(a == 0)), b - a, True)
        so_far = np.column_stack([carry[0] * m[:, 0] + carry[1] * m[:, 2], carry[0] * m[:, 1] + carry[1] * m[:, 3]])
        so_far /= so_far.sum(1, keepdims=True)
        alpha[a:b], carry = so_far[:, 1], so_far[-1]
    total, carry = 0.0, np.ones(2)
    for a, b in reversed(spans):
        m = _products(_steps(u[a:b], t, np.arange(a == 0)), b - a, False)
        after = np.column_stack([m[:, 0] * carry[0] + m[:, 1] * carry[1], m[:, 2] * carry[0] + m[:, 3] * carry[1]])
        beta = np.concatenate([after[1:], carry[None]])
        good = alpha[a:b] * beta[:, 1]
        p = good / (good + (1 - alpha[a:b]) * beta[:, 0])
        total += float(p @ np.diff(borders[a : b + 1]))
        carry = after[0] / after[0].sum()
    return total / float(borders[-1])


def document_means(p: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.add.reduceat(p * weight, first[:-1]) if len(first) > 1 else np.zeros(0)
    return sums / (np.add.reduceat(weight, first[:-1]) if len(first) > 1 else np.ones(0))


def fit(x: np.ndarray, weight: np.ndarray, first: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Weights, transitions and the calibration (slope, intercept) by regularised maximum likelihood."""
    y = np.repeat(label, np.diff(first)).astype(float)
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    seen = np.zeros((len(y), 4))
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    seen[at, (2 * y[at - 1] + y[at]).astype(int)] = 1
    m1, m2, size = np.zeros(len(w) + 4), np.zeros(len(w) + 4), max(1.0, len(y))
    for k in range(1, ROUNDS + 1):
        p, joint = marginals(x, first, w, t)
        g = np.concatenate([x.T @ ((y - p) * balance) / size - 1e-4 * w, ((seen - joint) * balance[:, None]).sum(0) / size - 1e-2 * t.ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = 0.15 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
        w, t = w + step[:-4], t + step[-4:].reshape(2, 2)
    s = document_means(marginals(x, first, w, t)[0], weight, first)
    z = np.column_stack([s - 0.5, np.ones(len(s))])
    c = np.array([4.0, 0.0])
    for _ in range(30):  # Newton's method, with a weak pull towards the start
        p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.eye(2) * 0.05
        c = c + np.linalg.solve(h, z.T @ (label - p) - 0.05 * (c - [4.0, 0.0]))
    return w, t, float(c[0]), float(c[1])


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, text: str = "text", key: str = "doc_id", label: str = "quality", train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES):
    """A model from labelled rows where learn_from holds; None if both labels don't occur."""
    known = labels.where(learn_from & F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("label"))
    n = known.count()
    if not n:
        return None
    picked = known.where(F.pmod(F.xxhash64(F.col(key), F.lit(9)), F.lit(1 << 20)) < max(1, (train_docs << 20) // n))
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(picked), key).select("text", "label")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for data, offsets in text_blocks(batch.column("text")):
                mine = batch.column("label").slice(at, len(offsets) - 1).to_pylist()
                at += len(offsets) - 1
                got = []
                for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    borders = _borders(data[a:b])
                    more = len(borders) - 1 - train_lines
                    skip = (b - a) * 2654435761 % more if more > 0 else 0
                    x, weight = _stretch(data[a:b], borders, skip, min(len(borders) - 1, skip + train_lines))
                    got.append((np.column_stack([x, weight]).astype("<f4").tobytes(), mine[d]))
                yield pa.RecordBatch.from_pydict({"x": pa.array([g[0] for g in got], pa.binary()), "label": pa.array([g[1] for g in got], pa.int32())})

    found = rows.mapInArrow(features, "x binary, label int").toPandas().sort_values(["label", "x"])
    if found.label.nunique() < 2:
        return None
    width = 3 * OWN + 3
    parts = [np.frombuffer(b, "<f4").reshape(-1, width + 1) for b in found.x]
    whole = np.concatenate(parts).astype(np.float64)
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return fit(whole[:, :-1], whole[:, -1], first, found.label.to_numpy())


def score(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher is better) and predicted (1 or 0)."""
    kept = without(docs, "score", "predicted")
    if model is None:
        return kept.withColumns({"score": F.lit(0.5), "predicted": F.lit(1)})

    @arrow_udf("double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, t, slope, base = model
        for texts in batches:
            for data, offsets in text_blocks(texts, BLOCK_BYTES):
                if len(data) > BLOCK_BYTES:  # one text
                    mean = np.array([long_mean(data, w, t)])
                else:
                    x, weight, first = lines(data, offsets)
                    mean = document_means(marginals(x, first, w, t)[0], weight, first)
                yield pa.array(1 / (1 + np.exp(-np.clip(slope * (mean - 0.5) + base, -30, 30))))

    return kept.withColumn("score", judge(F.coalesce(F.col(text), F.lit("")))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
