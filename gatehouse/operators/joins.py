"""Join shapes of the catalogue, written so that a hot foreign key does not land on one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gatehouse.session import estimated_bytes

BROADCAST_LIMIT = 16 * 1024 * 1024


def lookup_join(
    facts: DataFrame, lookup: DataFrame, on: dict[str, str], how: str = "left", limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """Join facts to a table that is unique by its key: ``on`` maps fact columns to lookup columns.

    The facts are read once. A lookup whose estimated size is at most ``limit`` is broadcast. With a larger one the join
    shuffles both sides, and adaptive execution, with the settings of ``build_session``, splits the partition of a
    frequent key over tasks, each with that key's one lookup row.
    """
    condition = _all(facts[f] == lookup[k] for f, k in on.items())
    small = estimated_bytes(lookup) <= limit
    return facts.join(F.broadcast(lookup) if small else lookup, condition, how)


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def bridge_join(
    bridge: DataFrame, left: DataFrame, left_on: dict[str, str], right: DataFrame, right_on: dict[str, str]
) -> DataFrame:
    """Many-to-many: the bridge rows with both of their ends."""
    return lookup_join(lookup_join(bridge, left, left_on, "inner"), right, right_on, "inner")


def exists_filter(left: DataFrame, right: DataFrame, on: dict[str, str], negate: bool = False) -> DataFrame:
    """Rows of ``left`` with (or, negated, without) a match; the right side is reduced to distinct keys first."""
    keys = right.select(*on.values()).distinct()
    return lookup_join(left, keys, on, "left_anti" if negate else "left_semi")


def missing_links(
    facts: DataFrame, links: Sequence[tuple[DataFrame, dict[str, str], str, str]], keep: Sequence[str]
) -> DataFrame:
    """Rows with a missing parent; each link is ``(parent, on, issue column, issue text)``."""
    joined, flags = facts, []
    for parent, on, name, text in links:
        key = next(iter(on.values()))
        marked = parent.select(*on.values())
        joined = lookup_join(joined, marked, on, "left")
        joined = joined.withColumn(name, F.when(F.col(key).isNull(), text)).drop(*on.values())
        flags.append(name)
    return joined.filter(F.coalesce(*flags).isNotNull()).select(*keep, *flags)


def mismatched(facts: DataFrame, lookup: DataFrame, on: dict[str, str], differs: Column) -> DataFrame:
    """Equi-join plus an inequality between the two sides (null compares as not different)."""
    return lookup_join(facts, lookup, on, "inner").filter(differs)


def inherit(children: DataFrame, parents: DataFrame, on: dict[str, str], child: str, parent: str) -> DataFrame:
    """Fill a child's blank column from its parent."""
    source = parents.select(*on.values(), F.col(parent).alias("_inherited"))
    filled = F.coalesce(F.nullif(F.trim(child), F.lit("")), F.col("_inherited"))
    joined = lookup_join(children, source, on, "left")
    value = F.when(F.nullif(F.trim(child), F.lit("")).isNull(), filled).otherwise(F.col(child))
    return joined.withColumn(child, value).select(*children.columns)


def count_children(parents: DataFrame, children: DataFrame, on: dict[str, str], name: str) -> DataFrame:
    """Parents with their number of children, zero kept; children are counted before they meet the parents."""
    keys = list(on.values())
    counts = children.groupBy(*keys).agg(F.count("*").alias(name))
    condition = _all(parents[p] == counts[k] for p, k in on.items())
    return parents.join(counts, condition, "left").drop(*(counts[k] for k in keys)).fillna(0, [name])


def completeness(expected: DataFrame, actual: DataFrame, on: Sequence[str], status: str = "status") -> DataFrame:
    """Expected rows labelled Available or Missing."""
    found = actual.select(*on).distinct().withColumn("_found", F.lit(True))
    return expected.join(found, list(on), "left").select(
        *expected.columns, F.when(F.col("_found"), "Available").otherwise("Missing").alias(status)
    )
