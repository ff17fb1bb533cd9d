"""The corpus pipeline: toxicity, quality, near duplicates, repeated passages, packing. Every stage works on all that its predecessor kept."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lamella.llm import op1_toxicity, op3_substring_dedup, op4_packing, op7_quality_votes, op8_odd_sketch, storage
from lamella.llm.text import small_batches


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    small_batches(spark)
    return op1_toxicity.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose posterior of good quality is below a half go."""
    small_batches(spark)
    return op7_quality_votes.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 on five-word shingles the smallest stays."""
    small_batches(spark)
    return op8_odd_sketch.keep(docs, width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 50 words that a smaller document has go; texts and n_chars follow."""
    small_batches(spark)
    return op3_substring_dedup.kept_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all that is left, in sequences of at most 1024. Executors are full when this stage comes: few pieces are remembered."""
    small_batches(spark)
    return op4_packing.digests(docs, public_tokenizers.path("byte_bpe_50k.json"), held=50_000)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]
#: Classifier scores and posteriors have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written as Parquet in the shared folder and read again. The tables that a stage has
    stored on its way go once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = storage.shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        before = storage.mark()
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        storage.release(spark, before)
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
