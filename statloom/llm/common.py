"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns whose names an operator is about to add."""
    low = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in low))


def utf8_bytes(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_crc32(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def fold(doc_id: str | Column, folds: int = 3) -> Column:
    """crc32 of the id as text, modulo folds: the split into learning and held-out documents."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


_held: dict[object, Any] = {}


def held(key: object, make: Callable[[], Any]) -> Any:
    """What make() gives, kept in this Python worker until another key is asked for: one large model at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


SCAN_BYTES = 2 << 20  # of texts looked at together


def text_blocks(texts: pa.Array, limit: int = SCAN_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts' UTF-8 bytes, without copies, and their borders, some megabytes at a time; null is empty."""
    large = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32, len(texts) + 1, texts.offset * (8 if large else 4)).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    buffer = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]
        at = upto


def by_bytes(texts: pa.Array, limit: int = SCAN_BYTES) -> Iterator[list[str | None]]:
    """The array's texts as lists of about as many bytes each; a longer text is a list of its own."""
    at = 0
    for _, offsets in text_blocks(texts, limit):
        yield texts.slice(at, len(offsets) - 1).to_pylist()
        at += len(offsets) - 1


def runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Sorted batches as one table for each value of an integer column."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        value = batch.column(by).to_numpy()
        cuts = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1).tolist(), len(value)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a and waiting and waiting[0].column(by)[0].as_py() != value[a]:
                yield pa.Table.from_batches(waiting)
                waiting = []
            if b > a:
                waiting.append(batch.slice(a, b - a))
    if waiting:
        yield pa.Table.from_batches(waiting)
