"""A corpus pipeline: five operators in a row over ``documents``, each stage written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import decontaminate, langid, packing, quality, simhash
from statloom.llm.common import fold, free_name, table
from statloom.llm.queries import WORDS
from statloom.session import new_path, ship

LEAST_LANGUAGE_SCORE = 0.5  # one language more likely than all others together


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, those of which no language is more likely than the others together, and those that cost much more bits than a text of their language does."""
    ship(spark)
    model = langid.learn(docs, fold("doc_id") != 1)
    own, names = _aside(docs, "lang_pred", "score", "bits", "strange")
    found = langid.identify(own, model)
    return _back(found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE) & ~F.col("strange")), docs, names)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are predicted to be bad."""
    ship(spark)
    model = quality.learn(docs, table(spark, sf_dir, "labels"), fold("doc_id") != 1)
    own, names = _aside(docs, "score", "predicted")
    return _back(quality.score(own, model).where("predicted = 1"), docs, names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of equal or near texts (five-word shingles, similarity 0.8)."""
    ship(spark)
    return simhash.near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold an item of ``benchmark``, give or take a tenth of its characters."""
    ship(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids, packed: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship(spark)
    return packing.pack(docs, WORDS).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _aside(docs: DataFrame, *added: str) -> tuple[DataFrame, dict[str, str]]:
    """docs, its own columns of the names that an operator adds put aside under free names, and those names."""
    names: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in added:
            docs = docs.withColumnRenamed(c, names.setdefault(c, free_name(docs, f"_own_{c}")))
    return docs, names


def _back(kept: DataFrame, docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """kept with the columns of docs."""
    return kept.select(*(F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns))


STAGES = [
    ("language_id", identify_language),
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("packing", pack_sequences),
]

#: Trained models, sketches and bin packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
