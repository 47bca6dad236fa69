"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import bpe, decontamination, language_id, license_scan, ngram_join, quality_classifier, quality_rules, substring_dedup, suffix_dedup, token_counts
from parlance.llm.common import in_shards, shared_dir, table
from parlance.llm.oracles import ORACLES  # noqa: F401


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"), texts=True)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels").where(in_shards()))
    out = quality_classifier.score(docs, model)
    return out.select("doc_id", (~in_shards()).alias("held_out"), "score", "predicted")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")  # digests are cheap, and the misses are dealt out by content
    counts = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), shared_dir(spark, "token-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = language_id.train(docs.where(in_shards()))
    out = language_id.identify(docs, model)
    return out.select("doc_id", (~in_shards()).alias("held_out"), "lang_pred", "score", "rejected")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("places")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"), texts=True)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_byte_bpe, op3_substring_dedup, op4_quality_classifier, op5_token_counts, op6_decontamination, op7_language_id, op8_license_scan, op9_ngram_join, op10_suffix_dedup)}
