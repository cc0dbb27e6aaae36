"""The registered queries of this subpackage, thin over its operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, license_scan, media_chunks, mixing, near_dup, packing, quality_classifier, quality_rules, substring_dedup, token_counts

#: The operators take these paths as a parameter.
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.media_features(table(spark, sf_dir, "documents"))


def op2_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), WORD_BPE)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op3_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_best_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mixing.labelled_domains(docs, table(spark, sf_dir, "labels")))
    return mixed.rows.drop("text_low", "text_high")


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, quality_classifier.ratings(table(spark, sf_dir, "labels")))
    return quality_classifier.classify(docs, model)


def op9_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("matches")


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents")).drop("text_low", "text_high")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_media_chunks, op2_best_two_fit, op3_weighted_minhash, op4_adaptive_rules, op5_best_region, op6_token_counts,
        op7_soft_mixing, op8_ordinal_quality, op9_license_join, op10_paragraph_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {"op4_adaptive_rules": quality_rules.sql()}
