"""Token counts: Arrow functions that return lengths only.

Batches are balanced by bytes, not rows, and long texts are split at places where the vocabulary's pre-tokenizer
always splits. No shuffle: the scan's partitions are the unit of work, so a hot source or group of copies costs
nothing extra.

Defined results: a null text counts 0 bytes and 0 tokens, like an empty one; repeated rows each keep their row; an
empty table gives an empty result; columns of the input that clash with an added name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import utf8_bytes, without
from .encoding import encoder

LIMIT = 512


def token_count(path: str):
    """A column function: tokens of each text by the vocabulary at path, without added special tokens."""

    @arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path, True)
        for texts in batches:
            got = [counts for counts, _ in own.texts(texts)]
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *got]))

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    docs = without(docs, "n_bytes", "n_tokens", "over_limit")
    return docs.withColumns({"n_bytes": utf8_bytes(text), "n_tokens": token_count(path)(F.col(text))}).withColumn("over_limit", F.col("n_tokens") > limit)
