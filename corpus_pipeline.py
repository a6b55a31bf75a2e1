"""From raw documents to packed training sequences, stage by stage.

Defined cases of all stages: null, empty and very long texts, null ids, repeated rows, empty tables
and columns with clashing names are taken as the stage's operator states; all columns of the
documents stay as they are but for those a stage is there to change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import language, packing, secrets, simhash, winnowing
from strandline.llm.common import stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null, empty and letterless texts, and those with unsure windows, go.

    Without any label to learn from every document stays.
    """
    return language.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id.

    Equal rows count as one; null and empty texts are copies of one another; null ids stay.
    """
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate; an empty benchmark contaminates none."""
    return winnowing.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def scrub_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark; null texts stay null."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, packed in sequences: a row per piece; an empty text is one end id."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("scrub_secrets", scrub_secrets), ("pack", pack)]

# a network, a 64-bit hash and a tokenizer are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
