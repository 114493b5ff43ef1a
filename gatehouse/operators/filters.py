"""Filters: optional parameters, search, tenancy, labelled issues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gatehouse.functions.text import contains_ci, normalize
from gatehouse.operators.joins import exists_filter, lookup_join

# Lifecycle states and the shape of a dataset code.
DRAFT, ACTIVE, ARCHIVED = "Draft", "Active", "Archived"
DATASET_STATUSES = (DRAFT, ACTIVE, ARCHIVED)
CODE_PATTERN = r"^DS-[0-9]{6}$"


def optional_filters(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Equality per column, skipped where the requested value is None."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def date_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Inclusive range; a start after the end is refused."""
    if start is not None and end is not None and start > end:
        raise ValueError("The start of a date range cannot be later than its end.")
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(column) <= F.lit(end))
    return df


def keyword_match(
    df: DataFrame,
    keyword: str,
    fields: Sequence[str],
    key: str,
    bridge: DataFrame | None = None,
    tags: DataFrame | None = None,
    bridge_key: str = "dataset_id",
    bridge_tag: str = "tag_id",
    tag_key: str = "tag_id",
    tag_name: str = "tag_name",
) -> DataFrame:
    """Rows where any field, or the name of any linked tag, contains the keyword in any case."""
    hit = reduce(lambda a, b: a | b, (F.coalesce(contains_ci(F.col(f), keyword), F.lit(False)) for f in fields))
    if bridge is None or tags is None:
        return df.filter(hit)
    matching = tags.filter(contains_ci(F.col(tag_name), keyword)).select(F.col(tag_key).alias("_tag"))
    linked = (
        exists_filter(bridge, matching, {bridge_tag: "_tag"}).select(F.col(bridge_key).alias("_linked")).distinct()
    )
    return (
        lookup_join(df, linked, {key: "_linked"}, "left")
        .filter(hit | F.col("_linked").isNotNull())
        .drop("_linked")
    )


def with_tag(
    df: DataFrame, tag: str, key: str, bridge: DataFrame, tags: DataFrame, bridge_key: str = "dataset_id",
    bridge_tag: str = "tag_id", tag_key: str = "tag_id", normalized: str = "normalized_name",
) -> DataFrame:
    """Rows linked to exactly this tag, compared in normalized form."""
    wanted = tags.filter(F.col(normalized) == normalize(F.lit(tag))).select(F.col(tag_key).alias("_tag"))
    linked = exists_filter(bridge, wanted, {bridge_tag: "_tag"}).select(F.col(bridge_key).alias("_linked"))
    return exists_filter(df, linked, {key: "_linked"})


def visible(df: DataFrame, sees_all_statuses: bool = False) -> DataFrame:
    """Not soft-deleted, and only Active rows unless the reader may see all."""
    live = df.filter(~F.col("is_deleted"))
    return live if sees_all_statuses else live.filter(F.col("status") == ACTIVE)


def for_workspace(df: DataFrame, workspace_id, is_admin: bool = False, column: str = "workspace_id") -> DataFrame:
    """Tenant isolation: a platform administrator sees all rows, no workspace sees none."""
    if is_admin:
        return df
    return df.filter(F.lit(False)) if workspace_id is None else df.filter(F.col(column) == F.lit(workspace_id))


def stamp_workspace(
    writes: DataFrame, stored: DataFrame, key: str, workspace_id, is_admin: bool = False
) -> tuple[DataFrame, DataFrame]:
    """A batch of writes as one tenant: ``(accepted, refused)``.

    New rows get the tenant's id; changing a row that is, or would become, another tenant's is refused. An
    administrator writes any tenant but must name one.
    """
    if is_admin:
        named = F.col("workspace_id").isNotNull()
        return writes.filter(named), writes.filter(~named).withColumn(
            "reason", F.lit("A WorkspaceId must be provided for platform-level operations.")
        )
    prior = stored.select(F.col(key).alias("_key"), F.col("workspace_id").alias("_prior"))
    joined = writes.join(prior, writes[key] == prior["_key"], "left")
    moved = F.col("_key").isNotNull() & (
        ~F.col("_prior").eqNullSafe(F.lit(workspace_id)) | ~F.col("workspace_id").eqNullSafe(F.lit(workspace_id))
    )
    accepted = joined.filter(~moved).withColumn("workspace_id", F.lit(workspace_id)).select(*writes.columns)
    refused = joined.filter(moved).select(
        *writes.columns, F.lit("A record cannot be moved to another workspace.").alias("reason")
    )
    return accepted, refused


def first_issue(df: DataFrame, rules: Sequence[tuple[Column, str]], name: str = "validation_issue") -> DataFrame:
    """Rows breaking at least one ordered rule, labelled with the first one broken."""
    label = F.lit(None).cast("string")
    for broken, text in reversed(list(rules)):
        label = F.when(broken, text).otherwise(label)
    return df.withColumn(name, label).filter(F.col(name).isNotNull())
