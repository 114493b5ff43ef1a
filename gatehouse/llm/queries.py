"""Registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gatehouse.llm import (
    collocations, decontaminate, fingerprints, importance, language_id, license_scan, lm_scoring, mixing, near_dups, pii, ranked_search,
    secrets_scan, simhash,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    """Register ``function(spark, sf_dir) -> DataFrame`` with the DuckDB SQL of its rows, where SQL can express it."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


@register("op1_pii")
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; checked by the base patterns in tests."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


@register("op2_order_minhash")
def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document; checked against all pairs in tests."""
    return near_dups.near_dup_classes(table(spark, sf_dir, "documents"))


@register("op3_importance")
def op3_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight and draw of every document; checked by counting n-grams directly in tests."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op4_secrets")
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; base spans are checked by the base patterns in tests, the network by held-out recall."""
    return secrets_scan.secrets(table(spark, sf_dir, "documents"))


@register("op5_mixing", mixing.CHECKING_SQL)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@register("op6_fingerprints")
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text; checked by direct comparison of texts in tests."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@register("op7_lm_scoring")
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of every document; base scores are checked by direct counting in tests, the model by its sums."""
    return lm_scoring.score(table(spark, sf_dir, "documents"))


@register("op8_licenses", license_scan.CHECKING_SQL)
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document."""
    return license_scan.licenses(table(spark, sf_dir, "documents"))


@register("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; checked by held-out accuracy in tests."""
    return language_id.identify(table(spark, sf_dir, "documents")).drop("text_key")


@register("op10_decontaminate")
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark windows that they hold; checked by brute force in tests."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


@register("op11_simhash")
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and component of every document; checked against all pairs in tests."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op12_ranked_search", ranked_search.CHECKING_SQL)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest-scoring documents of every benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "item_id", "rank", "doc_id", "score")


@register("op13_collocations", collocations.CHECKING_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))
