"""Queries of this subpackage for the driver contract: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import langid, matroska, merkle, mixing, ngram_jaccard, packing, quality, secrets, seen_digests, spotsigs, suffix_dedup, token_links, warc
from tracewell.llm.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op1_spotsigs_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.near_groups(table(spark, sf_dir, "documents"))


def op2_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.round_trip(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.link_counts(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links.aligned(table(spark, sf_dir, "documents"))


def op12_perfect_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen_digests.dedup(table(spark, sf_dir, "documents")).drop("in_history")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_jaccard_join": ngram_jaccard.ORACLE, "op5_ngram_jaccard_links": ngram_jaccard.LINKS_ORACLE, "op7_warc": warc.ORACLE, "op12_perfect_hash_dedup": seen_digests.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
