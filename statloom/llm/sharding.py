"""Sharding: a two-pass external shuffle.

Pass one scatters whole records by a seeded hash of key and position into buckets that fit a task's memory, so that no
repeated id makes a bucket heavy. Pass two puts each bucket into a seeded Fisher-Yates order and writes it. Bucket
after bucket, that is one uniform permutation of the table; shard k takes the k-th run of it, so row counts differ by
one at most.

There are as many buckets as the table needs. A task takes a run of them, in order and one at a time: one bucket while
there are MAX_TASKS at most, several beyond. So the driver sees one count for each task, and tasks find the places of
their buckets as they go. Row positions and recomputed tasks agree only if the input is read the same way twice: pass a
table scan or a checkpoint.

Defined results: null ids and null texts are ordinary values; repeated rows are all kept, each in a slot of its own;
fewer rows than shards leave the last shards empty; an empty table gives an empty result; input columns named shard or
slot are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_path
from .common import free_name, runs, utf8_bytes, without

BUCKET_BYTES = 16 << 20  # of text; a task holds about three times that
MAX_TASKS = 20_000


def shuffle_into_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", seed: int = 20_011, bucket_bytes: int = BUCKET_BYTES, path: str | None = None, max_tasks: int = MAX_TASKS) -> DataFrame:
    """Writes docs, shuffled, under path (one folder per shard, rows by slot) and returns what was written: the columns of docs, shard int and slot long."""
    spark = docs.sparkSession
    docs = without(docs, "shard", "slot")
    path = path or new_path(spark, "shards")
    names = free_name(docs, "bucket"), free_name(docs, "place")
    total = docs.agg(F.sum(utf8_bytes(text) + 16)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    each = -(-buckets // max_tasks)  # buckets of a task
    tasks = -(-buckets // each)
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.monotonically_increasing_id()), F.lit(buckets))
    numbered = docs.withColumn(names[0], bucket)
    task = F.floor(F.col(names[0]) / each).cast("int")
    rows = dict.fromkeys(range(tasks), 0) | {r.t: r.n for r in numbered.groupBy(task.alias("t")).agg(F.count("*").alias("n")).collect()}
    n, starts = sum(rows.values()), np.cumsum([0, *(rows[t] for t in range(tasks))]).tolist()
    dealt = numbered.repartitionById(tasks, task)
    dealt = dealt.sortWithinPartitions(names[0]) if each > 1 else dealt
    schema = T.StructType([*docs.schema.fields, T.StructField(names[1], T.LongType())])

    def shuffled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for whole in runs(batches, names[0]) if each > 1 else one(batches):
            at = whole.column(names[0])[0].as_py()
            first = starts[at // each] if first is None else first
            whole = whole.drop_columns([names[0]])
            keys = pa.table({"k": whole.column(key).cast(pa.string()), "t": whole.column(text)})
            order = pc.sort_indices(keys, sort_keys=[("k", "ascending"), ("t", "ascending")]).to_numpy().copy()  # arrival order varies
            np.random.default_rng([seed, at]).shuffle(order)  # Fisher-Yates
            step = max(1, len(order) // max(1, whole.nbytes >> 22))
            for i in range(0, len(order), step):
                part = whole.take(pa.array(order[i : i + step])).append_column(names[1], pa.array(np.arange(i, min(i + step, len(order))) + first, pa.int64()))
                yield from part.combine_chunks().to_batches()
            first += len(order)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        got = [b for b in batches if b.num_rows]
        if got:
            yield pa.Table.from_batches(got)

    base, extra = divmod(n, shards)
    place, long_end = F.col(names[1]), extra * (base + 1)
    shard = F.when(place < long_end, F.floor(place / (base + 1))).otherwise(extra + F.floor((place - long_end) / max(base, 1)))
    first = F.when(F.col("shard") <= extra, F.col("shard") * (base + 1)).otherwise(long_end + (F.col("shard") - extra) * base)
    out = dealt.mapInArrow(shuffled, schema).withColumn("shard", shard.cast("int")).withColumn("slot", (place - first).cast("long")).drop(names[1])
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path).select(*(F.col(f"`{c}`") for c in out.columns))
