"""A corpus pipeline over `documents`: five stages, each written as Parquet and read again as the next one's docs.

Every stage takes nulls in any column, empty and very long texts, equal rows, an empty
table, and further columns of any names; all but the last return the columns they got.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import bpe, decontamination, ngram_join, quality_classifier, substring_dedup
from parlance.llm.common import in_shards, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Each row is judged by its own text. Null and empty texts have no features: all get the score of the model's bias,
    and stay or go with it. Equal rows stay or go together. Without labelled rows among docs everything scores 0.5 and stays.
    """
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels").where(in_shards()))
    return quality_classifier.reject(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles, the smallest doc_id stays.

    One row of each group: equal rows are one, null ids come last, and a tie of ids is settled by a digest
    of the row. Rows without words are groups of their own.
    """
    return ngram_join.one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside 20-word windows that stand earlier go; n_chars follows the text.

    All rows stay, also those of which no word is left; a null text becomes empty. Rows that share a
    doc_id count as one document, a null doc_id as the smallest.
    """
    out = substring_dedup.deduplicate(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, each row by its own text; null and empty texts stay."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids, with digests of the ids and of what they decode to; a null text has no ids."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [("quality_classifier", quality), ("ngram_join", near_duplicates), ("substring_dedup", substrings), ("decontamination", benchmark), ("byte_bpe", tokens)]
#: The classifier and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
