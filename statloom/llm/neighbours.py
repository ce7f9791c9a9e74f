"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors of length one go to the nearest of a few hundred or thousand centres. What a vector differs from its centre by is
turned by a random rotation and kept as one sign bit a dimension, with three correction scalars: its length, its inner
product with the centre, and how well the signs stand for it. From the packed bits, a query's inner product with each
vector of a list follows up to a known error; vectors whose upper bound reaches the k-th largest lower bound are
compared exactly, in double precision.

The index is fitted on a bounded sample (SAMPLE vectors, by a hash of the id) and holds every vector. A query looks at
as many of its nearest lists as meet RECALL of the neighbours within the sample, both of those outside the own list and of
those of queries of the same list (more, until one of them holds k + 1 ids); vectors without clusters thus
need most lists, clustered ones few. Lists and the queries for one are dealt out
in blocks of at most BLOCK rows, so a hot list is many tasks; each block gives at most k ids a query.

Defined results: vectors that are null, zero or of another dimension than most of the sample, or hold null or
non-finite components, take no part, nor do null ids; rows that share the query's id are its own; an id with several
vectors counts with the best; very large and very small components count like others; ties go to the smaller id; with nothing to search the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

SAMPLE = 20_000
MAX_LISTS = 4096
RECALL = 0.98  # aimed at, within the sample
ASKED = 4096  # of the sample, to find out how many lists that takes
BLOCK = 4096
BOUND = 3.0  # of the estimate's standard error


class Index:
    """Centres and the rotation."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 6):
        r = np.random.default_rng(seed)
        self.dimension = sample.shape[1]
        self.rotation = np.linalg.qr(r.standard_normal((self.dimension, self.dimension)))[0].astype(np.float32)
        x = sample.astype(np.float32)
        c = x[r.permutation(len(x))[:lists]]
        for _ in range(8):
            own = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
            size = np.bincount(own, minlength=len(c))
            sums = np.stack([np.bincount(own, x[:, d], len(c)) for d in range(self.dimension)], 1)
            c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c).astype(np.float32)
        self.centres = c

    def probes(self, sample: np.ndarray, k: int, recall: float, seed: int = 6) -> np.ndarray:
        """For queries of each list, lists to look at so that such a share of the sample's own neighbours is met.

        Asked are vectors drawn from the whole sample. The share must be met among the neighbours outside the query's own
        list, so that copies, which are all in it, don't outvote the others; and for the queries of each list by itself.
        """
        x = sample.astype(np.float32)
        asked = np.random.default_rng(seed).permutation(len(x))[:ASKED]
        ranks, own = [], self.lists_of(x)
        for i in range(0, len(asked), 128):
            rows = asked[i : i + 128]
            said = x[rows] @ x.T
            said[np.arange(len(rows)), rows] = -2
            near = np.argpartition(-said, min(k, len(x) - 1), axis=1)[:, :k]
            order = np.argsort(-(x[rows] @ self.centres.T - (self.centres**2).sum(1) / 2), axis=1)
            ranks.append(np.take_along_axis(order.argsort(1), own[near], 1))
        ranks = np.concatenate(ranks)
        far = ranks[ranks > 0]
        out = np.full(len(self.centres), int(np.ceil(np.quantile(far, recall))) + 1 if len(far) else 1)
        for c in np.unique(own[asked]):
            out[c] = max(out[c], int(np.ceil(np.quantile(ranks[own[asked] == c], recall))) + 1)
        return out

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        """Each unit vector's nearest centre."""
        return np.concatenate([(x[i : i + 4096] @ self.centres.T - (self.centres**2).sum(1) / 2).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed sign bits; and length, product with the centre and fit of each difference from the centre."""
        c = self.centres[lists]
        rest = x - c
        size = np.linalg.norm(rest, axis=1)
        turned = rest / np.maximum(size, 1e-12)[:, None] @ self.rotation.T
        fit = np.abs(turned).sum(1) / np.sqrt(self.dimension)
        return np.packbits(turned > 0, axis=1), np.column_stack([size, (rest * c).sum(1), np.maximum(fit, 1e-6)]).astype(np.float32)

    def bounds(self, q: np.ndarray, centre: int, bits: np.ndarray, scalars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of unit queries with a list's vectors, and how far off they may be."""
        c, d = self.centres[centre], self.dimension
        rest = q - c
        far = np.linalg.norm(rest, axis=1)[:, None]
        signs = (np.unpackbits(bits, axis=1)[:, :d].astype(np.float32) * 2 - 1) / np.sqrt(d)
        size, inner, fit = scalars.T
        said = rest @ self.rotation.T @ signs.T / fit
        off = BOUND * np.sqrt(np.maximum(0, 1 - fit**2)) / fit / np.sqrt(max(d - 1, 1))
        return (q @ c)[:, None] + inner + size * said, far * (size * off)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    values = column.flatten() if hasattr(column, "flatten") else column.values
    return values.to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each vector by a power of two, so that its largest component is near one: exact, and squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest other vectors by cosine."""
    spark = vectors.sparkSession
    shape = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    v = F.col("v")
    sound = v.isNotNull() & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & sound)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], shape)
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < max(1, int((1 << 20) * min(1.0, sample / n)))).groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v")).toPandas()  # one row an id
    held = [np.asarray(x) for x in picked.v] or [np.asarray(rows.select("v").first().v)]
    sizes, seen = np.unique([len(x) for x in held], return_counts=True)
    dimension = int(sizes[seen.argmax()])
    x = _unit(np.stack([x for x in held if len(x) == dimension]))
    made = Index(x, int(min(MAX_LISTS, len(x), max(1, np.sqrt(n) / 2))))
    probes, sent = made.probes(x, k, recall), spark.sparkContext.broadcast(made)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            x = _unit(_matrix(batch.column("v"), dimension))
            lists = index.lists_of(x)
            bits, scalars = index.codes(x, lists)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), batch.column("q"), pa.array(lists, pa.int32()), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array([s.tobytes() for s in scalars], pa.binary())], names=["id", "v", "q", "list", "bits", "scalars"])

    stored = written(rows.where(F.size("v") == dimension).mapInArrow(coded, "id long, v array<double>, q boolean, list int, bits binary, scalars binary"), "codes")
    held = stored.groupBy("list").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")).collect()  # one row a list
    filled, distinct = {r.list: r.n for r in held}, {r.list: r.ids for r in held}

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        ids_in = np.array([distinct.get(c, 0) for c in range(len(index.centres))])
        for batch in batches:
            q = _unit(_matrix(batch.column("v"), dimension))
            near = q @ index.centres.T - (index.centres**2).sum(1) / 2
            order = np.argsort(-near, axis=1, kind="stable")
            most = np.maximum.accumulate(ids_in[order], axis=1)  # lists may share ids, so that a sum would count some twice
            few = np.column_stack([np.zeros(len(q), most.dtype), most[:, :-1]]) < k + 1
            wanted = (np.cumsum(ids_in[order] > 0, axis=1) <= probes[order[:, :1]]) | few
            wanted &= ids_in[order] > 0
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array([o[w] for o, w in zip(order, wanted, strict=True)], pa.list_(pa.int32()))], names=["id", "v", "lists"])

    asked = stored.where("q").select("id", "v").mapInArrow(probed, "id long, v array<double>, lists array<int>").select("id", "v", F.explode("lists").alias("list"))
    asked = written(asked, "asked")
    asks = {r.list: r["count"] for r in asked.groupBy("list").count().collect()}
    if not asks:
        return spark.createDataFrame([], shape)
    blocks = spark.createDataFrame([(c, -(-filled.get(c, 0) // block), -(-asks[c] // block)) for c in sorted(asks)], "list int, parts int, askers int")
    deal = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(parts)).cast("int")
    steps = lambda to: F.explode(F.sequence(F.lit(0), F.col(to) - 1))
    members = stored.join(F.broadcast(blocks), "list").withColumn("part", deal(1, "parts")).withColumn("asker", steps("askers")).select("list", "part", "asker", "id", "v", "bits", "scalars")
    askers = asked.join(F.broadcast(blocks), "list").withColumn("asker", deal(2, "askers")).withColumn("part", steps("parts")).select("list", "part", "asker", "id", "v")

    def best(group: pa.Table, queries: pa.Table) -> pa.Table:
        index, out = sent.value, {"query_id": [], "vec_id": [], "score": []}
        if len(group) and len(queries):
            ids = group.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            x = _scaled(_matrix(group.column("v").combine_chunks(), dimension))[order]
            bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            scalars = np.frombuffer(b"".join(group.column("scalars").to_pylist()), np.float32).reshape(-1, 3)[order]
            size = np.sqrt((x * x).sum(1))
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            asking, q = queries.column("id").to_numpy(), _scaled(_matrix(queries.column("v").combine_chunks(), dimension))
            for i in range(0, len(asking), 256):
                said, off = index.bounds(_unit(q[i : i + 256]), group.column("list")[0].as_py(), bits, scalars)
                for j, own in enumerate(asking[i : i + 256].tolist()):
                    others = ids != own
                    low = np.maximum.reduceat(np.where(others, said[j] - off[j], -np.inf), first)
                    least = np.partition(low, -k)[-k] if len(low) > k else -np.inf
                    at = np.flatnonzero(others & (said[j] + off[j] >= least - 1e-5))
                    z = q[i + j]
                    exact = (x[at] * z).sum(1) / (size[at] * np.sqrt((z * z).sum()))
                    by_score = np.lexsort((ids[at], -exact))
                    top = by_score[np.sort(np.unique(ids[at[by_score]], return_index=True)[1])[:k]]  # the best row of each id
                    out["query_id"] += [own] * len(top)
                    out["vec_id"] += ids[at[top]].tolist()
                    out["score"] += exact[top].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    keys = ["list", "part", "asker"]
    found = members.groupBy(*keys).cogroup(askers.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
