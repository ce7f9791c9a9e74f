"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, decontaminate, grammar_ids, langid, licenses, manifest, neighbours, packing, periodic, quality, sharding, simhash, token_counts
from .common import fold, table, text_crc32, utf8_bytes


BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"  # public vocabularies: each task finds its own copy


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.shuffle_into_shards(docs, shards=40).select(
        "doc_id",
        (utf8_bytes("text") + 16).alias("size"),
        text_crc32("text").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, BYTES).drop("text")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, WORDS).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.linked(docs).select("doc_id", "fingerprint", "component_id")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_grammar_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grammar_ids.grammar_ids(docs, WORDS).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs, fold("doc_id") != 1)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id") == 1).alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels"), fold("doc_id") != 1)
    return quality.score(docs, model).select("doc_id", (fold("doc_id") == 1).alias("held_out"), "score", "predicted")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    altered = [*LEAF_FIELDS[:-1], F.replace("text", F.lit("\n"), F.lit(""))]
    return manifest.verified(docs, LEAF_FIELDS, altered, tampered).drop("source")


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(table(spark, sf_dir, "documents"), BYTES).drop("ids")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("tail"))
    return periodic.digested(periodic.find_runs(docs, tail=F.col("tail")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_sharding, op2_token_counts, op3_packing, op4_decontaminate, op5_simhash, op6_neighbours, op7_grammar_ids, op8_language, op9_quality, op10_licenses, op11_manifest, op12_best_fit, op13_periodic_runs]
    return {q.__name__: q for q in named}


def oracle_sql() -> dict[str, str]:
    return {"op11_manifest": manifest.ORACLE}
