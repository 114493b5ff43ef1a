"""Ordered per-key computations that survive a hot key.

A plain window sends all rows of a key to one task. Here the table is first cut into range partitions by (key,
order), which splits a hot key over as many partitions as its size needs; windows run inside (key, chunk), and one
small row per (key, chunk) carries state across chunk borders. The chunk number is checkpointed, because range
boundaries come from sampling and both readers of it must agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gatehouse.session import materialize

CHUNK = "_chunk"


def chunk(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with the number of the range partition that holds them; ``order`` should be unique within a key."""
    return materialize(df.repartitionByRange(*keys, *order).withColumn(CHUNK, F.spark_partition_id()))


def _attach(chunked: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join carried state on (keys, chunk), null-safe.

    Only keys that span chunks have a carry row, so its size is bounded by twice the number of chunks.
    """
    side = F.broadcast(carry).alias("carry")
    condition = F.col(f"rows.{CHUNK}") == F.col(f"carry.{CHUNK}")
    for key in keys:
        condition &= F.col(f"rows.{key}").eqNullSafe(F.col(f"carry.{key}"))
    extra = [F.col(f"carry.{name}") for name in carry.columns if name not in (*keys, CHUNK)]
    return chunked.alias("rows").join(side, condition, "left").select("rows.*", *extra)


def running_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", chunked: bool = False
) -> DataFrame:
    """Dense 1-based position of each row within its key (within the whole table when ``keys`` is empty)."""
    parts = df if chunked else chunk(df, keys, order)
    counts = parts.groupBy(*keys, CHUNK).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.withColumn("_offset", F.sum("_n").over(earlier)).filter("_offset IS NOT NULL").drop("_n")
    )
    local = F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(*order))
    numbered = _attach(parts, offsets, keys).withColumn(
        name, (local + F.coalesce("_offset", F.lit(0))).cast("bigint")
    )
    return numbered.drop("_offset", *(() if chunked else (CHUNK,)))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str = "before", chunked: bool = False
) -> DataFrame:
    """Sum of ``value`` over the key's rows before each row, 0 for the first."""
    parts = (df if chunked else chunk(df, keys, order)).withColumn("_value", value.cast("bigint"))
    sums = parts.groupBy(*keys, CHUNK).agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.sum("_sum").over(earlier)).filter("_offset IS NOT NULL").drop("_sum")
    local = F.sum("_value").over(Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    summed = _attach(parts, offsets, keys).withColumn(name, F.coalesce(local, F.lit(0)) + F.coalesce("_offset", F.lit(0)))
    return summed.drop("_value", "_offset", *(() if chunked else (CHUNK,)))


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    inclusive: bool = False,
    chunked: bool = False,
) -> DataFrame:
    """Latest non-null ``value`` of the key before each row (or up to it when ``inclusive``)."""
    parts = (df if chunked else chunk(df, keys, order)).withColumn("_value", value)
    moment = F.when(F.col("_value").isNotNull(), F.struct(*order))
    tails = parts.groupBy(*keys, CHUNK).agg(F.max_by("_value", moment).alias("_tail"))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        tails.withColumn("_carry", F.last("_tail", True).over(earlier)).filter("_carry IS NOT NULL").drop("_tail")
    )
    frame = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    local = F.last("_value", True).over(frame)
    filled = _attach(parts, carry, keys).withColumn(name, F.coalesce(local, F.col("_carry")))
    return filled.drop("_value", "_carry", *(() if chunked else (CHUNK,)))
