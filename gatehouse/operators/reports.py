"""Catalogue, access and ingest reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gatehouse.functions.text import contains_ci
from gatehouse.operators.aggregates import conditional_counts, one_row_summary
from gatehouse.operators.filters import ACTIVE, ARCHIVED, DRAFT, optional_filters
from gatehouse.operators.joins import bridge_join, count_children, lookup_join
from gatehouse.operators.paging import MAX_ERROR_PAGE_SIZE, latest, page_rows, rank_by_list
from gatehouse.operators.quality import ACTIVE_RUNS

# Roles in order of rank, and the audit actions of imports.
ROLE_RANK = ("Platform Administrator", "Workspace Administrator", "Data Analyst", "Business User", "Viewer")
IMPORT_ACTIONS = (
    "File Upload", "Import Configuration", "Import Initiation",
    "Import Completion", "Import Failure", "Import Cancellation",
)


def catalogue_report(datasets: DataFrame, workspaces: DataFrame, categories: DataFrame, users: DataFrame) -> DataFrame:
    """Datasets with workspace, category and owner names."""
    w = workspaces.select(F.col("workspace_id").alias("_w"), "workspace_name")
    c = categories.select(F.col("category_id").alias("_c"), "category_name")
    u = users.select(F.col("user_id").alias("_u"), F.col("full_name").alias("owner_name"))
    joined = lookup_join(datasets, w, {"workspace_id": "_w"}, "inner")
    joined = lookup_join(joined, c, {"category_id": "_c"}, "inner")
    return lookup_join(joined, u, {"owner_id": "_u"}, "inner").drop("_w", "_c", "_u")


def dataset_tags(bridge: DataFrame, datasets: DataFrame, tags: DataFrame) -> DataFrame:
    d = datasets.select(F.col("dataset_id").alias("_d"), F.col("code"), F.col("name").alias("dataset_name"))
    t = tags.select(F.col("tag_id").alias("_t"), "tag_name")
    joined = bridge_join(bridge, d, {"dataset_id": "_d"}, t, {"tag_id": "_t"})
    return joined.select("code", "dataset_name", "tag_id", "tag_name")


def tenant_summary(datasets: DataFrame) -> DataFrame:
    live = ~F.col("is_deleted")
    return conditional_counts(
        datasets, ["workspace_id"], "dataset_count",
        {
            "active_count": (F.col("status") == ACTIVE) & live,
            "archived_count": (F.col("status") == ARCHIVED) & live,
            "soft_deleted_count": F.col("is_deleted"),
        },
    )


def catalogue_summary(
    categories: DataFrame, datasets: DataFrame, versions: DataFrame, tags: DataFrame, bridge: DataFrame
) -> DataFrame:
    every, live = F.lit(True), ~F.col("is_deleted")
    return one_row_summary([
        (categories, {"active_category_count": F.col("is_active")}),
        (datasets, {
            "total_dataset_count": every,
            "available_dataset_count": live,
            "draft_dataset_count": (F.col("status") == DRAFT) & live,
            "active_dataset_count": (F.col("status") == ACTIVE) & live,
            "archived_dataset_count": (F.col("status") == ARCHIVED) & live,
            "soft_deleted_dataset_count": F.col("is_deleted"),
        }),
        (versions, {"dataset_version_count": every}),
        (tags, {"tag_count": every}),
        (bridge, {"dataset_tag_mapping_count": every}),
    ])


def ingest_summary(
    files: DataFrame, columns: DataFrame, runs: DataFrame, staging: DataFrame, records: DataFrame,
    errors: DataFrame, configs: DataFrame,
) -> DataFrame:
    every, status = F.lit(True), F.col("status")
    return one_row_summary([
        (files, {"uploaded_file_count": every}),
        (columns, {"dataset_column_count": every}),
        (runs, {
            "import_count": every,
            "active_import_count": status.isin(list(ACTIVE_RUNS)),
            "completed_import_count": status == "Completed",
            "completed_with_errors_count": status == "Completed With Errors",
            "failed_import_count": status == "Failed",
            "cancelled_import_count": status == "Cancelled",
            "pinned_import_count": F.col("config_id").isNotNull(),
        }),
        (staging, {"staging_row_count": every}),
        (records, {"dataset_record_count": every}),
        (errors, {"import_error_count": every}),
        (configs, {"configuration_count": every, "active_configuration_count": F.col("is_active")}),
    ])


def platform_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of the named tables, side by side."""
    return one_row_summary([(df, {f"{name}_count": F.lit(True)}) for name, df in tables.items()])


def runs_by_outcome(runs: DataFrame) -> DataFrame:
    sums = {"total": "total_records", "success": "success_records", "rejected": "rejected_records", "errors": "error_count"}
    return runs.groupBy("status", "import_mode", "duplicate_behavior").agg(
        F.count("*").alias("import_count"), *(F.sum(c).alias(name) for c, name in sums.items())
    )


def run_history(
    runs: DataFrame, files: DataFrame, dataset_id=None, status: str | None = None, number: int = 1, size: int = 20
) -> DataFrame:
    """A page of runs, newest first, with file names."""
    wanted = optional_filters(runs, {"dataset_id": dataset_id, "status": status})
    names = files.select(F.col("file_id").alias("_f"), F.col("original_name"))
    named = lookup_join(wanted, names, {"file_id": "_f"}, "inner").drop("_f")
    return page_rows(named, [("created_at", False), ("import_id", True)], number, size)


def error_page(errors: DataFrame, import_id=None, number: int = 1, size: int = 50) -> DataFrame:
    wanted = optional_filters(errors, {"import_id": import_id})
    order = [("row_number", True), ("happened_at", True), ("error_id", True)]
    return page_rows(wanted, order, number, size, MAX_ERROR_PAGE_SIZE)


def latest_errors(errors: DataFrame, n: int = 200) -> DataFrame:
    return latest(errors, [F.col("happened_at").desc(), F.col("row_number").asc(), F.col("error_id").asc()], n)


def roles_by_rank(roles: DataFrame, name: str = "role_name", ranked: Sequence[str] = ROLE_RANK) -> DataFrame:
    return roles.withColumn("role_rank", rank_by_list(F.col(name), ranked)).orderBy("role_rank", name)


def permission_matrix(
    grants: DataFrame, roles: DataFrame, permissions: DataFrame, prefix: str | None = None
) -> DataFrame:
    """Role and permission names of every grant, optionally of one permission family."""
    r = roles.select(F.col("role_id").alias("_r"), "role_name")
    p = permissions.select(F.col("permission_id").alias("_p"), "permission_name")
    if prefix is not None:
        p = p.filter(F.col("permission_name").startswith(prefix))
    return bridge_join(grants, r, {"role_id": "_r"}, p, {"permission_id": "_p"}).select("role_name", "permission_name")


def permissions_per_role(roles: DataFrame, grants: DataFrame) -> DataFrame:
    counts = grants.select(F.col("role_id").alias("_r"))
    return count_children(roles, counts, {"role_id": "_r"}, "permission_count")


def workspaces_with_users(workspaces: DataFrame, users: DataFrame) -> DataFrame:
    members = users.select(F.col("workspace_id").alias("_w"))
    return count_children(workspaces, members, {"workspace_id": "_w"}, "user_count")


def users_with_roles(users: DataFrame, workspaces: DataFrame, user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """Every user with workspace and role names, null where there is none; a user has one row per role."""
    w = workspaces.select(F.col("workspace_id").alias("_w"), "workspace_name")
    r = roles.select(F.col("role_id").alias("_r"), "role_name")
    ur = user_roles.select(F.col("user_id").alias("_u"), F.col("role_id").alias("_role"))
    joined = lookup_join(users, w, {"workspace_id": "_w"}, "left")
    joined = joined.join(ur, joined["user_id"] == ur["_u"], "left")
    return lookup_join(joined, r, {"_role": "_r"}, "left").drop("_w", "_u", "_role", "_r")


def audit_trail(
    audit: DataFrame, entity_type: str, action_prefix: str | None = None, actions: Sequence[str] = (),
    workspace_id=None, n: int = 100,
) -> DataFrame:
    """Latest audit events of an entity type or of related actions, optionally of one tenant."""
    wanted = F.col("entity_type") == entity_type
    if action_prefix is not None:
        wanted |= F.col("action").startswith(action_prefix)
    if actions:
        wanted |= F.col("action").isin(list(actions))
    rows = optional_filters(audit.filter(wanted), {"workspace_id": workspace_id})
    return latest(rows, [F.col("happened_at").desc(), F.col("audit_id").asc()], n)


def session_log(tokens: DataFrame, users: DataFrame, as_of: str, n: int = 50) -> DataFrame:
    """Latest sessions labelled Active or Inactive at a given time."""
    u = users.select(F.col("user_id").alias("_u"), "email")
    alive = F.col("revoked_at").isNull() & (F.col("expires_at") > F.lit(as_of).cast("timestamp_ntz"))
    sessions = lookup_join(tokens, u, {"user_id": "_u"}, "inner").drop("_u")
    rows = latest(sessions, [F.col("created_at").desc(), F.col("token_id").asc()], n)
    return rows.withColumn("token_status", F.when(alive, "Active").otherwise("Inactive"))


def user_list(
    users: DataFrame, search: str | None = None, is_active: bool | None = None, number: int = 1, size: int = 20
) -> DataFrame:
    """A page of users by name, filtered by name or e-mail text and activity."""
    wanted = optional_filters(users, {"is_active": is_active})
    if search and search.strip():
        wanted = wanted.filter(contains_ci(F.col("full_name"), search) | contains_ci(F.col("email"), search))
    return page_rows(wanted, [("full_name", True), ("user_id", True)], number, size)


def category_list(categories: DataFrame, active_only: bool = True) -> DataFrame:
    rows = categories.filter("is_active") if active_only else categories
    return rows.orderBy("category_name")
