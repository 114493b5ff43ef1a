"""Corpus preparation: language, near-duplicates, benchmark passages, personal data, mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatehouse.llm import decontaminate, language_id, mixing, near_dups, pii
from gatehouse.session import scratch_path

#: Bytes of rows that a Python worker is handed at a time; without it, 10,000 whole texts or index segments, in the memory
#: of the JVM and of the worker.
BATCH_BYTES = "4m"


def bound_batches(spark: SparkSession) -> None:
    """Bound what is handed to Python workers by bytes, for the stage's plans and those of the caller."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, without a text, or hardly in any of the learned languages, go."""
    bound_batches(spark)
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one of the smallest doc_id."""
    bound_batches(spark)
    return near_dups.deduplicate(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    bound_batches(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in its text gives way to the name of its kind."""
    bound_batches(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, with the words it takes of each."""
    bound_batches(spark)
    return mixing.mixture(docs)


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]

#: The first two stages and the redaction are not expressible in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of each are written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
