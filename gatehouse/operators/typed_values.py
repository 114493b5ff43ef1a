"""Tall typed values: one row per (record, column) with exactly one typed field filled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gatehouse.functions.typed import BOOLEAN, DATETIME, DECIMAL_TYPE, INTEGER, STRING, SPARK_TYPES, typed_value
from gatehouse.operators.schema import ColumnSpec

# The typed field of each column type.
VALUE_FIELDS = {
    STRING: "string_value",
    INTEGER: "integer_value",
    DECIMAL_TYPE: "decimal_value",
    BOOLEAN: "boolean_value",
    DATETIME: "datetime_value",
}


def to_typed_long(df: DataFrame, columns: Sequence[ColumnSpec], record_id: str = "record_id") -> DataFrame:
    """Explode text columns to typed rows; the parser of a row is its column's, so each cell is parsed once."""
    cells = []
    for c in columns:
        text = F.col(f"`{c.name}`")
        fields = [
            (typed_value(text, kind) if kind == c.data_type else F.lit(None)).cast(SPARK_TYPES[kind]).alias(name)
            for kind, name in VALUE_FIELDS.items()
        ]
        cells.append(
            F.struct(
                F.lit(c.name).alias("column_name"), F.lit(c.data_type).alias("data_type"),
                text.alias("raw_value"), *fields,
            )
        )
    return df.select(record_id, F.inline(F.array(*cells)))


def from_typed_long(values: DataFrame, columns: Sequence[ColumnSpec], record_id: str = "record_id") -> DataFrame:
    """Wide typed rows again: one conditional pick per column."""
    picks = [
        F.any_value(F.when(F.col("column_name") == c.name, F.col(VALUE_FIELDS[c.data_type])), True).alias(c.name)
        for c in columns
    ]
    return values.groupBy(record_id).agg(*picks)
