"""Integrity checks. Each takes DataFrames and returns the violating rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gatehouse.operators.aggregates import duplicates, tagged_union
from gatehouse.functions.text import normalize
from gatehouse.operators.catalogue import MUST_RESTORE, NOT_FOUND
from gatehouse.operators.filters import ARCHIVED, CODE_PATTERN, DATASET_STATUSES, first_issue
from gatehouse.operators.joins import exists_filter, lookup_join, mismatched, missing_links
from gatehouse.functions.typed import COLUMN_TYPES
from gatehouse.operators.typed_values import VALUE_FIELDS

# States and options of an import run, and the file limits.
RUN_STATUSES = ("Created", "Queued", "Processing", "Completed", "Completed With Errors", "Failed", "Cancelled")
ACTIVE_RUNS = ("Queued", "Processing")
FINISHED_RUNS = ("Completed", "Completed With Errors", "Failed", "Cancelled")
IMPORT_MODES = ("Full", "Append")
DUPLICATE_BEHAVIOURS = ("Skip", "Reject", "Update")
FILE_EXTENSIONS = (".csv", ".xlsx")
MAX_FILE_BYTES = 25 * 1024 * 1024


def _missing(name: str) -> Column:
    return F.nullif(F.trim(name), F.lit("")).isNull()


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return duplicates(df, keys)


def missing_codes(datasets: DataFrame) -> DataFrame:
    return datasets.filter(_missing("code"))


def malformed_codes(datasets: DataFrame) -> DataFrame:
    return datasets.filter(~F.col("code").rlike(CODE_PATTERN))


def unknown_status(datasets: DataFrame, allowed: Sequence[str] = DATASET_STATUSES) -> DataFrame:
    return datasets.filter(~F.col("status").isin(list(allowed)))


def soft_delete_inconsistent(datasets: DataFrame) -> DataFrame:
    return datasets.filter(F.col("is_deleted") != F.col("deleted_at").isNotNull())


def deleted_datasets(datasets: DataFrame) -> DataFrame:
    return datasets.filter("is_deleted")


def missing_relationships(datasets: DataFrame, workspaces: DataFrame, categories: DataFrame, users: DataFrame):
    """Datasets whose workspace, category or owner does not exist."""
    links = [
        (workspaces.select(F.col("workspace_id").alias("_w")), {"workspace_id": "_w"}, "workspace_issue", "Missing Workspace"),
        (categories.select(F.col("category_id").alias("_c")), {"category_id": "_c"}, "category_issue", "Missing Category"),
        (users.select(F.col("user_id").alias("_u")), {"owner_id": "_u"}, "owner_issue", "Missing Owner"),
    ]
    return missing_links(datasets, links, ["dataset_id", "code"])


def owner_inconsistent(datasets: DataFrame, users: DataFrame) -> DataFrame:
    """Owners that are inactive, without a workspace, or in another one."""
    owners = users.select(
        F.col("user_id").alias("_u"), F.col("workspace_id").alias("owner_workspace_id"),
        F.col("is_active").alias("owner_is_active"),
    )
    bad = (
        ~F.col("owner_is_active")
        | F.col("owner_workspace_id").isNull()
        | (F.col("owner_workspace_id") != F.col("workspace_id"))
    )
    return mismatched(datasets, owners, {"owner_id": "_u"}, bad).select(
        "dataset_id", "workspace_id", "owner_id", "owner_workspace_id", "owner_is_active"
    )


def tag_workspace_differs(datasets: DataFrame, bridge: DataFrame, tags: DataFrame) -> DataFrame:
    d = datasets.select(F.col("dataset_id").alias("_d"), F.col("workspace_id").alias("dataset_workspace_id"))
    t = tags.select(F.col("tag_id").alias("_t"), F.col("workspace_id").alias("tag_workspace_id"), "tag_name")
    linked = lookup_join(lookup_join(bridge, d, {"dataset_id": "_d"}, "inner"), t, {"tag_id": "_t"}, "inner")
    return linked.filter(F.col("dataset_workspace_id") != F.col("tag_workspace_id")).select(
        "dataset_id", "dataset_workspace_id", "tag_id", "tag_name", "tag_workspace_id"
    )


def without_first_version(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    first = versions.filter(F.col("version_number") == 1).select(F.col("dataset_id").alias("_v"))
    return exists_filter(datasets, first, {"dataset_id": "_v"}, negate=True)


def file_issues(files: DataFrame, datasets: DataFrame, users: DataFrame) -> DataFrame:
    """First problem of each uploaded file's metadata."""
    d = datasets.select(F.col("dataset_id").alias("_d"), F.col("workspace_id").alias("_dw"))
    u = users.select(F.col("user_id").alias("_u"))
    joined = lookup_join(lookup_join(files, d, {"dataset_id": "_d"}, "inner"), u, {"uploaded_by": "_u"}, "left")
    rules = [
        (~F.lower("extension").isin(list(FILE_EXTENSIONS)), "Unsupported file extension"),
        (F.col("size") <= 0, "File is empty"),
        (F.col("size") > MAX_FILE_BYTES, "File exceeds 25 MB"),
        (_missing("original_name"), "Original file name is missing"),
        (_missing("stored_name"), "Stored file name is missing"),
        (_missing("path"), "File path is missing"),
        (F.col("workspace_id") != F.col("_dw"), "File and dataset workspaces differ"),
        (F.col("_u").isNull(), "Uploading user does not exist"),
    ]
    return first_issue(joined, rules).select("file_id", "dataset_id", "workspace_id", "extension", "size", "validation_issue")


def schema_issues(columns: DataFrame, datasets: DataFrame) -> DataFrame:
    """First problem of each registered column."""
    d = datasets.select(F.col("dataset_id").alias("_d"), F.col("workspace_id").alias("_dw"))
    rules = [
        (_missing("name"), "Column name is missing"),
        (_missing("normalized_name"), "Normalized column name is missing"),
        (~F.col("data_type").isin(list(COLUMN_TYPES)), "Unsupported inferred data type"),
        (F.col("ordinal") < 0, "Column ordinal cannot be negative"),
        (F.col("workspace_id") != F.col("_dw"), "Column and dataset workspaces differ"),
    ]
    joined = lookup_join(columns, d, {"dataset_id": "_d"}, "inner")
    return first_issue(joined, rules).select("column_id", "dataset_id", "name", "data_type", "ordinal", "validation_issue")


def run_issues(runs: DataFrame, files: DataFrame, datasets: DataFrame) -> DataFrame:
    """First problem of each run's configuration and lifecycle."""
    f = files.select(
        F.col("file_id").alias("_f"), F.col("dataset_id").alias("_fd"), F.col("workspace_id").alias("_fw"),
        F.col("extension").alias("_fx"),
    )
    d = datasets.select(F.col("dataset_id").alias("_d"), F.col("workspace_id").alias("_dw"))
    joined = lookup_join(lookup_join(runs, f, {"file_id": "_f"}, "inner"), d, {"dataset_id": "_d"}, "inner")
    counters = ("total", "success", "rejected", "errors")
    status, ended = F.col("status"), F.col("completed_at")
    rules = [
        (~status.isin(list(RUN_STATUSES)), "Unsupported import status"),
        (~F.col("import_mode").isin(list(IMPORT_MODES)), "Unsupported import mode"),
        (~F.col("duplicate_behavior").isin(list(DUPLICATE_BEHAVIOURS)), "Unsupported duplicate behavior"),
        (F.col("invalid_behavior") != "Skip", "Unsupported invalid-record behavior"),
        (F.length("delimiter") != 1, "CSV delimiter must contain one character"),
        (F.col("key_columns_json").isNotNull() & F.try_parse_json("key_columns_json").isNull(),
         "KeyColumnsJson is not valid JSON"),
        (F.col("dataset_id") != F.col("_fd"), "Import file belongs to another dataset"),
        ((F.col("workspace_id") != F.col("_fw")) | (F.col("workspace_id") != F.col("_dw")),
         "Import workspace is inconsistent"),
        ((F.lower("_fx") == ".xlsx") & _missing("worksheet"), "Worksheet is required for XLSX"),
        (reduce(lambda a, b: a | b, (F.col(c) < 0 for c in counters)), "Import counters cannot be negative"),
        (status.isin(list(ACTIVE_RUNS)) & F.col("queued_at").isNull(), "Active import has no queue timestamp"),
        ((status == "Processing") & F.col("started_at").isNull(), "Processing import has no start timestamp"),
        (status.isin(list(FINISHED_RUNS)) & ended.isNull(), "Terminal import has no completion timestamp"),
        (ended < F.col("created_at"), "Completion precedes creation"),
    ]
    return first_issue(joined, rules).select(
        "import_id", "dataset_id", "status", "import_mode", "duplicate_behavior", "validation_issue"
    )


def concurrent_runs(runs: DataFrame) -> DataFrame:
    """Datasets with more than one active run."""
    return duplicates(
        runs.filter(F.col("status").isin(list(ACTIVE_RUNS))), ["workspace_id", "dataset_id"], "active_import_count"
    )


def tenant_graph_issues(
    datasets: DataFrame, files: DataFrame, columns: DataFrame, runs: DataFrame, staging: DataFrame,
    records: DataFrame, values: DataFrame, errors: DataFrame,
) -> DataFrame:
    """Tenant consistency over the ingest graph: tagged violations of seven entity types."""
    d = datasets.select(F.col("dataset_id").alias("_d"), F.col("workspace_id").alias("_dw"))
    f = files.select(F.col("file_id").alias("_f"), F.col("dataset_id").alias("_fd"), F.col("workspace_id").alias("_fw"))
    r = runs.select(F.col("import_id").alias("_r"), F.col("dataset_id").alias("_rd"), F.col("workspace_id").alias("_rw"))
    rec = records.select(
        F.col("record_id").alias("_e"), F.col("dataset_id").alias("_ed"), F.col("workspace_id").alias("_ew")
    )
    col = columns.select(
        F.col("column_id").alias("_c"), F.col("dataset_id").alias("_cd"), F.col("workspace_id").alias("_cw")
    )
    ws = F.col("workspace_id")

    def branch(df: DataFrame, entity: str, key: str, issue: str) -> DataFrame:
        return df.select(
            F.lit(entity).alias("entity_type"), F.col(key).cast("string").alias("entity_id"),
            F.lit(issue).alias("validation_issue"),
        )

    run_graph = lookup_join(lookup_join(runs, f, {"file_id": "_f"}, "inner"), d, {"dataset_id": "_d"}, "inner")
    record_graph = lookup_join(
        lookup_join(records, d, {"dataset_id": "_d"}, "inner"), r, {"source_import_id": "_r"}, "left"
    )
    value_graph = lookup_join(lookup_join(values, rec, {"record_id": "_e"}, "inner"), col, {"column_id": "_c"}, "inner")
    return tagged_union([
        branch(mismatched(files, d, {"dataset_id": "_d"}, ws != F.col("_dw")), "UploadedDataFile", "file_id",
               "Uploaded file workspace differs from dataset workspace"),
        branch(mismatched(columns, d, {"dataset_id": "_d"}, ws != F.col("_dw")), "DatasetColumn", "column_id",
               "Dataset column workspace differs from dataset workspace"),
        branch(run_graph.filter(
            (F.col("dataset_id") != F.col("_fd")) | (ws != F.col("_fw")) | (ws != F.col("_dw"))),
            "DataImport", "import_id", "Import, file and dataset do not share the same workspace and dataset"),
        branch(mismatched(staging, r, {"import_id": "_r"}, ws != F.col("_rw")), "ImportStagingRow", "staging_id",
               "Staging row workspace differs from import workspace"),
        branch(record_graph.filter(
            (ws != F.col("_dw")) | F.col("_r").isNull() | (F.col("_rd") != F.col("dataset_id"))
            | (F.col("_rw") != ws)),
            "DatasetRecord", "record_id", "Dataset record is inconsistent with its dataset or source import"),
        branch(value_graph.filter((F.col("_ed") != F.col("_cd")) | (F.col("_ew") != F.col("_cw"))),
               "DatasetRecordValue", "value_id", "Record value references a column from another dataset or workspace"),
        branch(mismatched(errors, r, {"import_id": "_r"}, ws != F.col("_rw")), "ImportError", "error_id",
               "Import error workspace differs from import workspace"),
    ])


def typed_value_issues(values: DataFrame) -> DataFrame:
    """Non-blank values where other than exactly the declared type's field is filled."""
    wrong = F.lit(None).cast("boolean")
    for kind, own in VALUE_FIELDS.items():
        others = [F.col(name).isNotNull() for name in VALUE_FIELDS.values() if name != own]
        bad = reduce(lambda a, b: a | b, others, F.col(own).isNull())
        wrong = F.when(F.col("data_type") == kind, bad).otherwise(wrong)
    return values.filter(F.col("raw_value").isNotNull() & (F.trim("raw_value") != "") & wrong)


def cancellation_issues(runs: DataFrame) -> DataFrame:
    cancelled = F.col("status") == "Cancelled"
    return runs.filter(
        (cancelled & (~F.col("cancellation_requested") | F.col("completed_at").isNull()))
        | (F.col("cancellation_requested") & ~F.col("status").isin([*ACTIVE_RUNS, "Cancelled"]))
    )


def forbidden_rows(df: DataFrame, denied: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows that a deny list says must not exist."""
    return exists_filter(df, denied, on)


def metadata_issues(requests: DataFrame, datasets: DataFrame, categories: DataFrame, users: DataFrame) -> DataFrame:
    """First reason to refuse each registration or update of a dataset's metadata.

    ``requests(dataset_id, workspace_id, name, category_id, owner_id)``, the id being null for a registration. A name is
    unique among the live datasets of its workspace; requests of one batch are not compared with each other.
    """
    stored = datasets.select(
        F.col("dataset_id").alias("_d"), F.col("is_deleted").alias("_gone"), (F.col("status") == ARCHIVED).alias("_archived"))
    names = datasets.filter("NOT is_deleted").groupBy(
        F.col("workspace_id").alias("_nw"), normalize(F.col("name")).alias("_name")).agg(
        F.min("dataset_id").alias("_least"), F.max("dataset_id").alias("_most"))
    active = categories.filter("is_active").select(F.col("category_id").alias("_c"))
    owners = users.filter("is_active").select(F.col("user_id").alias("_u"), F.col("workspace_id").alias("_uw"))
    asked = requests.withColumn("_folded", normalize(F.col("name")))
    joined = lookup_join(asked, stored, {"dataset_id": "_d"})
    joined = lookup_join(joined, names, {"workspace_id": "_nw", "_folded": "_name"})
    joined = lookup_join(lookup_join(joined, active, {"category_id": "_c"}), owners, {"owner_id": "_u"})
    update, own = F.col("dataset_id").isNotNull(), F.col("dataset_id")
    another = F.col("_least").isNotNull() & ~(own.eqNullSafe(F.col("_least")) & own.eqNullSafe(F.col("_most")))
    rules = [
        (update & (F.col("_d").isNull() | F.col("_gone")), NOT_FOUND),
        (update & F.col("_archived"), MUST_RESTORE),
        (_missing("name"), "Dataset name is required."),
        (another, "Dataset name must be unique within the workspace."),
        (F.col("_c").isNull(), "An active dataset category is required."),
        (~F.coalesce(F.col("_uw") == F.col("workspace_id"), F.lit(False)), "Dataset owner must be an active user in the same workspace."),
    ]
    return first_issue(joined, rules, "reason").select(*requests.columns, "reason")
