"""Headers, inferred types and the schema registry."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gatehouse.functions.booleans import to_boolean
from gatehouse.functions.dates import to_datetime
from gatehouse.functions.numbers import to_decimal, to_integer
from gatehouse.functions.text import clean_header, clean_name, is_blank, normalize
from gatehouse.functions.typed import BOOLEAN, DATETIME, DECIMAL_TYPE, INTEGER, STRING, fits, typed_value
from gatehouse.functions.working import carried, data_columns

from gatehouse.session import spread


@dataclass(frozen=True)
class ColumnSpec:
    """One column of a dataset's fixed schema."""

    name: str
    data_type: str
    ordinal: int
    is_key: bool = False
    is_required: bool = True


def _ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def header_audit(headers: DataFrame) -> DataFrame:
    """Files whose header list is unusable: input ``(file, headers array)``, one row per issue.

    The test stays inside each header array, so no file's headers are shuffled.
    """
    written = F.transform("headers", lambda h: clean_header(F.coalesce(h, F.lit(""))))
    names = F.transform(written, lambda h: F.upper(h))
    repeated = F.filter(written, lambda h: F.size(F.filter(names, lambda m: m == F.upper(h))) > 1)
    issue = (
        F.when(F.size("headers") == 0, "File contains no headers.")
        .when(F.exists(names, lambda n: n == ""), "File contains missing or blank headers.")
        .when(
            F.size(repeated) > 0,
            F.concat(F.lit("Duplicate column name '"), repeated[0], F.lit("' was found.")),
        )
    )
    return headers.select("file", issue.alias("issue")).filter("issue IS NOT NULL")


# One bit per type, in the order types are tried.
_TYPE_BITS = {INTEGER: 1, DECIMAL_TYPE: 2, BOOLEAN: 4, DATETIME: 8}


def _fitting_types(value: Column) -> Column:
    """Bits of the types one cell fits, null for a blank cell.

    Every integer is a decimal, '0' and '1' are also booleans, and no other types overlap, so the first match
    settles the cell.
    """
    return (
        F.when(is_blank(value), None)
        .when(to_integer(value).isNotNull(), F.when(value.isin("0", "1"), 7).otherwise(3))
        .when(to_decimal(value).isNotNull(), 2)
        .when(to_boolean(value).isNotNull(), 4)
        .when(to_datetime(value).isNotNull(), 8)
        .otherwise(0)
    )


def infer_types(df: DataFrame) -> DataFrame:
    """First type that every non-blank value fits, one row per column, from one pass over the table.

    Cells become rows and are reduced per column before the shuffle, so the generated code has one copy of the
    parsers however wide the table is.
    """
    names = data_columns(df)
    cells = spread(df).select(F.posexplode(F.array(*map(_ref, names))).alias("ordinal", "cell"))
    fitting = cells.select("ordinal", _fitting_types(F.col("cell")).alias("bits"))
    masks = fitting.groupBy("ordinal").agg(F.bit_and("bits").alias("mask"))
    kind = F.when(F.col("mask").isNull(), STRING)
    for candidate, bit in _TYPE_BITS.items():
        kind = kind.when(F.col("mask").bitwiseAND(bit) != 0, candidate)
    name = F.element_at(F.array(*map(F.lit, names)), F.col("ordinal") + 1)
    return masks.select("ordinal", name.alias("name"), kind.otherwise(STRING).alias("data_type"))


def schema_diff(incoming: DataFrame, expected: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Case-insensitive name-set comparison: rows ``(*by, name, difference)``, none where the sets are equal.

    ``by`` names columns of both sides, such as the dataset; the name sets of each are compared on their own.
    """
    keys = [*by, "key"]
    left = incoming.select(*by, normalize(F.col("name")).alias("key"), "name").groupBy(*keys).agg(F.min("name").alias("a"))
    right = expected.select(*by, normalize(F.col("name")).alias("key"), "name").groupBy(*keys).agg(F.min("name").alias("b"))
    return (
        left.join(right, keys, "full_outer")
        .filter("a IS NULL OR b IS NULL")
        .select(
            *by,
            F.coalesce("a", "b").alias("name"),
            F.when(F.col("a").isNull(), "Missing").otherwise("Additional").alias("difference"),
        )
    )


def key_column_audit(keys: DataFrame, headers: DataFrame) -> DataFrame:
    """Requested key columns absent from their dataset's headers, with the message a user sees.

    Inputs are ``(dataset_id, key_name)`` and ``(dataset_id, header)``; a dataset has one schema of headers.
    """
    available = headers.select("dataset_id", clean_header(F.col("header")).alias("header"))
    unknown = (
        keys.select("dataset_id", clean_header(F.col("key_name")).alias("key_name"))
        .join(
            available.withColumn("folded", F.upper("header")),
            (keys["dataset_id"] == available["dataset_id"]) & (F.upper("key_name") == F.col("folded")),
            "left_anti",
        )
        .groupBy("dataset_id", F.upper("key_name").alias("folded"))
        .agg(F.min("key_name").alias("key_name"))
        .groupBy("dataset_id")
        .agg(F.array_join(F.array_sort(F.collect_set("key_name")), ", ").alias("unknown"))
    )
    listed = available.groupBy("dataset_id").agg(
        F.array_join(F.array_sort(F.collect_set("header")), ", ").alias("available")
    )
    return unknown.join(listed, "dataset_id", "left").select(
        "dataset_id",
        F.concat(
            F.lit("Unknown key column(s): "), "unknown",
            F.lit(". Available columns: "), F.coalesce("available", F.lit("")), F.lit("."),
        ).alias("message"),
    )


def validate_key_columns(keys: Sequence[str], headers: Sequence[str]) -> str | None:
    """The same audit for one dataset's header list, before a run starts."""
    available = {clean_name(header).lower(): clean_name(header) for header in headers}
    unknown = {}
    for key in map(clean_name, keys):
        if key.lower() not in available:
            unknown.setdefault(key.lower(), key)
    if not unknown:
        return None
    return (
        f"Unknown key column(s): {', '.join(unknown.values())}. "
        f"Available columns: {', '.join(sorted(available.values()))}."
    )


def registry_rows(inferred: DataFrame, dataset_id: str, workspace_id: str, keys: Sequence[str] = ()) -> DataFrame:
    """Registry rows for a first import: every column required, keys flagged."""
    folded = [clean_name(key).upper() for key in keys]
    return inferred.select(
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(workspace_id).alias("workspace_id"),
        clean_header(F.col("name")).alias("name"),
        F.upper(clean_header(F.col("name"))).alias("normalized_name"),
        "data_type",
        "ordinal",
        F.lit(True).alias("is_required"),
        (F.upper(clean_header(F.col("name"))).isin(folded) if folded else F.lit(False)).alias("is_key"),
    )


def read_registry(registry: DataFrame, dataset_id: str) -> tuple[ColumnSpec, ...]:
    """One dataset's schema by ordinal (a schema is small and bounded, so it is read on the driver)."""
    rows = registry.filter(F.col("dataset_id") == dataset_id).orderBy("ordinal").collect()
    return tuple(
        ColumnSpec(r["name"], r["data_type"], r["ordinal"], r["is_key"], r["is_required"]) for r in rows
    )


def set_key_columns(registry: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recompute key flags of the datasets named in ``keys``; a dataset with an unknown name is refused whole.

    Returns the new registry and the refused ``(dataset_id, key_name)`` rows.
    """
    wanted = keys.select("dataset_id", clean_header(F.col("key_name")).alias("key_name")).withColumn(
        "normalized_name", F.upper("key_name")
    )
    refused = wanted.join(registry, ["dataset_id", "normalized_name"], "left_anti").select("dataset_id", "key_name")
    accepted = wanted.join(refused.select("dataset_id").distinct(), "dataset_id", "left_anti")
    marks = accepted.select("dataset_id", "normalized_name").distinct().withColumn("_named", F.lit(True))
    touched = accepted.select("dataset_id").distinct().withColumn("_touched", F.lit(True))
    updated = (
        registry.join(touched, "dataset_id", "left")
        .join(marks, ["dataset_id", "normalized_name"], "left")
        .withColumn("is_key", F.when(F.col("_touched"), F.col("_named").isNotNull()).otherwise(F.col("is_key")))
        .select(*registry.columns)
    )
    return updated, refused


def conformance_check(df: DataFrame, columns: Sequence[ColumnSpec]) -> DataFrame:
    """One row per cell that does not fit its column's type."""
    typed = [c for c in columns if c.data_type != STRING]
    kept = carried(df, ("column_name", "invalid_value", "description"))
    flagged = df.select(*kept, *(
        column for i, c in enumerate(typed)
        for column in (_ref(c.name).alias(f"_cell{i}"), (~fits(_ref(c.name), c.data_type)).alias(f"_bad{i}"))
    ))
    cells = [
        F.struct(
            F.lit(c.name).alias("column_name"),
            F.col(f"_cell{i}").alias("invalid_value"),
            F.lit(f"Value is not compatible with {c.data_type}.").alias("description"),
            F.col(f"_bad{i}").alias("_bad"),
        )
        for i, c in enumerate(typed)
    ]
    return flagged.select(*flagged.columns[: len(kept)], F.inline(F.array(*cells))).filter("_bad").drop("_bad")


def typed_projection(df: DataFrame, columns: Sequence[ColumnSpec]) -> DataFrame:
    """Text columns as their declared types; blank and unparseable cells become null."""
    return df.select(
        *carried(df, [c.name for c in columns]), *(typed_value(_ref(c.name), c.data_type).alias(c.name) for c in columns))


def registry_from_specs(spark: SparkSession, columns: Sequence[ColumnSpec]) -> DataFrame:
    """A schema held on the driver as registry-shaped rows."""
    return spark.createDataFrame(
        [(c.name, c.data_type, c.ordinal, c.is_key, c.is_required) for c in columns],
        "name string, data_type string, ordinal int, is_key boolean, is_required boolean",
    )


def header_names(headers: DataFrame, has_header: bool = True) -> DataFrame:
    """``(file, ordinal, name)`` for every header of every file: cleaned text, or ``Column1..n`` without a header."""
    cells = headers.select("file", F.posexplode("headers").alias("_at", "_cell"))
    ordinal = F.col("_at") + 1
    name = (
        clean_header(F.coalesce("_cell", F.lit(""))) if has_header
        else F.concat(F.lit("Column"), ordinal.cast("string"))
    )
    return cells.select("file", ordinal.alias("ordinal"), name.alias("name"))
