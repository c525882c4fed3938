"""The queries op1 to op13, each over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bloom_dedup,
    conversation_repair,
    jaccard_join,
    language_id,
    merkle_manifest,
    piece_matching,
    poisson_mix,
    quality_classifier,
    quality_rules,
    simhash_join,
    substring_dedup,
    token_records,
    toxicity,
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir), texts=False)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_counts(documents(spark, sf_dir))


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    mixed = poisson_mix.poisson_mix(docs, poisson_mix.tempered_rates(docs, 0.5))
    return mixed.select("doc_id", "source", "copy", "shuffle_key", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op5_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bloom_dedup.exact_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir)).drop("tie")


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.record_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_piece_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_matching.round_trips(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_simhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_join.simhash_components(documents(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.merkle_manifest(documents(spark, sf_dir), altered=merkle_manifest.tampered_leaf()).drop("source", "path")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op4_poisson_mix": op4_poisson_mix,
    "op5_bloom_dedup": op5_bloom_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_token_records": op8_token_records,
    "op9_piece_matching": op9_piece_matching,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_simhash_join": op12_simhash_join,
    "op13_merkle_manifest": op13_merkle_manifest,
}
