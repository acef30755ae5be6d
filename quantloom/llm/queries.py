"""The queries of the thirteen operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, fingerprints, licenses, manifest, mixing, neighbours, passages, pieces, private, quality, substrings, toxicity
from .common import documents
from .minhash import near_duplicates


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(documents(spark, sf_dir))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_substrings(documents(spark, sf_dir))


def op3_near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir)).select("doc_id", "canonical_sha256", "license_id")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "topic", "n_tokens", "probability", "kept")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic").alias("insult"))
    return toxicity.toxicity(documents(spark, sf_dir), labels, ["low_quality", "insult"]).select("doc_id", "p_low_quality", "p_insult", "toxic")


def op8_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.find_private(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op11_random_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(neighbours.vectors(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(documents(spark, sf_dir))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_near_passages": op3_near_passages,
    "op4_license_scan": op4_license_scan,
    "op5_source_mixing": op5_source_mixing,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_toxicity": op7_toxicity,
    "op8_private_data": op8_private_data,
    "op9_quality_rules": op9_quality_rules,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_random_projection_forest": op11_random_projection_forest,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op4_license_scan": licenses.SQL,
    "op5_source_mixing": mixing.SQL,
    "op9_quality_rules": quality.SQL,
    "op12_merkle_manifest": manifest.SQL,
    "op13_phrase_collocations": collocations.SQL,
}
