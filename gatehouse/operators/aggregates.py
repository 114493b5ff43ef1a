"""Aggregation shapes of the reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def duplicates(df: DataFrame, keys: Sequence[str], name: str = "duplicate_count") -> DataFrame:
    """Key combinations that occur more than once (null keys group together)."""
    return df.groupBy(*keys).agg(F.count("*").alias(name)).filter(F.col(name) > 1)


def conditional_counts(df: DataFrame, keys: Sequence[str], total: str, cases: Mapping[str, Column]) -> DataFrame:
    """Per group: all rows and the rows meeting each condition."""
    return df.groupBy(*keys).agg(
        F.count("*").alias(total), *(F.count_if(condition).alias(name) for name, condition in cases.items())
    )


def one_row_summary(parts: Sequence[tuple[DataFrame, Mapping[str, Column]]]) -> DataFrame:
    """Many scalar counts in one row: a single conditional aggregate per table."""
    return side_by_side([
        df.agg(*(F.count_if(condition).alias(name) for name, condition in counts.items())) for df, counts in parts
    ])


def side_by_side(rows: Sequence[DataFrame]) -> DataFrame:
    """One-row frames with different columns as one row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*(F.any_value(name, True).alias(name) for name in stacked.columns))


#: Different values that one text may join.
MOST_JOINED = 100_000


def joined_text(
    df: DataFrame, keys: Sequence[str], value: str, name: str, separator: str = ", ", most: int = MOST_JOINED
) -> DataFrame:
    """Sorted distinct values as one text, at most ``most`` of them: more end the query with an error.

    Values are made distinct before they meet, and counted before they are collected, so that no task gathers more.
    """
    different = df.select(*keys, F.col(value).alias("_value")).distinct()
    # What is beyond the bound is counted, not collected.
    sizes = different.groupBy(*keys).agg(F.count("_value").alias("_n")).select(*(F.col(k).alias(f"_of_{k}") for k in keys), "_n")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys), F.lit(True))
    counted = different.join(sizes, same)
    text = F.array_join(F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.col("_value")))), separator)
    joined = counted.groupBy(*keys).agg(F.max("_n").alias("_n"), text.alias(name))
    refused = F.raise_error(F.lit(f"More than {most} values to join.")).cast("string")
    return joined.select(*keys, F.when(F.col("_n") > most, refused).otherwise(F.col(name)).alias(name))


def next_version(df: DataFrame, keys: Sequence[str], version: str, name: str = "next_version") -> DataFrame:
    return df.groupBy(*keys).agg((F.coalesce(F.max(version), F.lit(0)) + 1).cast("bigint").alias(name))


def latest_valid(
    parents: DataFrame, history: DataFrame, key: str, version: str, status: str, allowed: Sequence[str], default: str
) -> DataFrame:
    """Each parent's status from its newest history row with an allowed status, else the default."""
    newest = (
        history.filter(F.col(status).isin(list(allowed)))
        .groupBy(key)
        .agg(F.max_by(status, version).alias("_latest"))
    )
    return parents.join(newest, key, "left").withColumn(status, F.coalesce("_latest", F.lit(default))).drop("_latest")


def tagged_union(branches: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), branches)
