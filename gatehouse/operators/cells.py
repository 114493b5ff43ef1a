"""Mapping and rule evaluation over whole tables.

Each rule position is one projection over all columns, so a long chain stays linear: a step reads the previous
step's column by name instead of nesting its expression.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gatehouse.functions.text import clean_name, is_blank, is_empty
from gatehouse.functions.typed import STRING, Cell, typed_value
from gatehouse.functions.working import ROW, carried, data_columns, working_columns
from gatehouse.operators.config import FieldMapping, Rule
from gatehouse.operators.rules import failure_message, find_transformation, find_validation

# Error types and the rule label of configured validations.
TRANSFORMATION_ERROR = "Transformation Error"
VALIDATION_ERROR = "Validation Error"
DUPLICATE_ERROR = "Duplicate Error"
PROCESSING_ERROR = "Processing Error"
CONFIGURED = "Configured validation"

ERROR_FIELDS = ("column_name", "invalid_value", "error_type", "validation_rule", "description")


def source_columns(df: DataFrame) -> dict[str, str]:
    """Case-insensitive header lookup without the working columns."""
    return {clean_name(name).lower(): name for name in data_columns(df)}


def map_columns(df: DataFrame, mappings: Sequence[FieldMapping]) -> DataFrame:
    """Rename source headers to target columns; the first mapping of a target wins."""
    headers = source_columns(df)
    _refuse_missing(mappings, headers)
    chosen = first_per_target(mappings)
    return df.select(
        *carried(df, [m.target for m in chosen]),
        *(F.col(_q(headers[m.source.strip().lower()])).alias(m.target) for m in chosen),
    )


def first_per_target(mappings: Sequence[FieldMapping]) -> list[FieldMapping]:
    chosen: dict[str, FieldMapping] = {}
    for mapping in mappings:
        chosen.setdefault(mapping.target.lower(), mapping)
    return list(chosen.values())


def _refuse_missing(mappings: Sequence[FieldMapping], headers: Mapping[str, str]) -> None:
    missing = [m.source for m in mappings if m.source.strip().lower() not in headers]
    if missing:
        raise ValueError(f"Mapping does not match the headers. Missing sources: {', '.join(missing)}.")


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def evaluate(df: DataFrame, mappings: Sequence[FieldMapping], types: Mapping[str, str]) -> DataFrame:
    """Run every mapping: each target becomes ``struct<original, value, typed, errors>``, plus row-level ``errors``.

    ``types`` gives the declared type of each target. Transformations run in sequence and stop at the first
    failure, which keeps the last good value and skips that cell's validations; all validations of other cells
    are evaluated. Every cell is then checked against its column type.
    """
    chosen = first_per_target(mappings)
    judged = judge(df, chosen, types)
    names = [*(m.target for m in chosen), "errors", "is_valid"]
    return judged.select(
        *carried(judged, names),
        *(F.col(f"_c{i}").alias(m.target) for i, m in enumerate(chosen)),
        F.col("_errors").alias("errors"),
        F.col("_valid").alias("is_valid"),
    )


def judge(df: DataFrame, chosen: Sequence[FieldMapping], types: Mapping[str, str]) -> DataFrame:
    """As :func:`evaluate` for mappings of different targets, with the i-th target as ``_c{i}``, the row's errors as
    ``_errors`` and its verdict as ``_valid``; no name of the batch can clash with these."""
    headers = source_columns(df)
    _refuse_missing(chosen, headers)
    working = working_columns(df)
    taken = ("_errors", "_valid")
    df = df.select(*carried(df, taken), *(F.col(_q(column)).alias(f"_h{i}") for i, column in enumerate(headers.values())))
    kept = df.columns[: len(working)]
    row = {name: F.col(f"_h{i}") for i, name in enumerate(headers)}

    originals = {f"_o{i}": row[m.source.strip().lower()] for i, m in enumerate(chosen)}
    values = {
        f"_v{i}": originals[f"_o{i}"]
        if m.default is None
        else F.when(is_empty(originals[f"_o{i}"]), F.lit(m.default)).otherwise(originals[f"_o{i}"])
        for i, m in enumerate(chosen)
    }
    step = df.withColumns({**originals, **values})
    chains = [sorted(m.transformations, key=lambda rule: rule.sequence) for m in chosen]
    fallible: set[int] = set()
    for level in range(max((len(chain) for chain in chains), default=0)):
        step = _transform_level(step, chains, level, row, fallible)

    kinds = [types.get(m.target, STRING) for m in chosen]
    step = step.withColumns({f"_p{i}": typed_value(F.col(f"_v{i}"), kind) for i, kind in enumerate(kinds)})
    # Predicates are their own projection: arrays built inside an array function would be evaluated row by row
    # outside generated code, and a flag is read several times below.
    flags, errors = {}, []
    for i, mapping in enumerate(chosen):
        reason = F.col(f"_t{i}") if i in fallible else F.lit(None).cast("string")
        for failed, error in _cell_checks(mapping, kinds[i], i, reason):
            flag = f"_f{len(flags)}"
            flags[flag] = failed
            errors.append(F.when(F.col(flag), F.array(error)).otherwise(_no_errors()))
    if flags:
        step = step.withColumns(flags)
        valid = ~reduce(lambda a, b: a | b, map(F.col, flags))
        found = F.when(valid, _no_errors()).otherwise(F.concat(*errors))
    else:
        valid, found = F.lit(True), _no_errors()
    step = step.withColumn("_errors", found)
    return step.select(
        *kept,
        *(
            F.struct(
                F.col(f"_o{i}").alias("original"), F.col(f"_v{i}").alias("value"), F.col(f"_p{i}").alias("typed"),
                _of_column(mapping.target).alias("errors"),
            ).alias(f"_c{i}")
            for i, mapping in enumerate(chosen)
        ),
        "_errors",
        valid.alias("_valid"),
    )


def _of_column(target: str) -> Column:
    return F.filter("_errors", lambda e: e["column_name"] == target)


def _transform_level(
    step: DataFrame, chains: list[list[Rule]], level: int, row: Mapping[str, Column], fallible: set[int]
) -> DataFrame:
    attempts, changes = {}, {}
    for i, chain in enumerate(chains):
        if level >= len(chain):
            continue
        rule = chain[level]
        transformation = find_transformation(rule)
        value = F.col(f"_v{i}")
        result = transformation.apply(value, rule.parameters, row)
        open_chain = F.col(f"_t{i}").isNull() if i in fallible else F.lit(True)
        if transformation.failure is None:
            changes[f"_v{i}"] = F.when(open_chain, result).otherwise(value) if i in fallible else result
            continue
        attempts[f"_n{i}"] = result
        failed = open_chain & F.col(f"_n{i}").isNull()
        earlier = F.col(f"_t{i}") if i in fallible else F.lit(None).cast("string")
        changes[f"_t{i}"] = F.when(failed, transformation.failure(value)).otherwise(earlier)
        changes[f"_v{i}"] = F.when(open_chain & F.col(f"_n{i}").isNotNull(), F.col(f"_n{i}")).otherwise(value)
        fallible.add(i)
    if attempts:
        step = step.withColumns(attempts)
    return step.withColumns(changes)


def _cell_checks(
    mapping: FieldMapping, data_type: str, i: int, reason: Column
) -> list[tuple[Column, Column]]:
    """(failed, error) of one cell, in the order errors are reported; ``failed`` is never null."""
    original, value = F.col(f"_o{i}"), F.col(f"_v{i}")
    cell = Cell(value, data_type, F.col(f"_p{i}"))
    checks = []
    if any(find_transformation(rule).failure for rule in mapping.transformations):
        checks.append((reason.isNotNull(), _error(mapping.target, original, TRANSFORMATION_ERROR, None, reason)))
    for rule in sorted(mapping.validations, key=lambda rule: rule.sequence):
        failed = find_validation(rule).failed(cell, rule.parameters)
        if mapping.required:
            failed = is_blank(value) | failed
        text = F.lit(failure_message(rule))
        checks.append((reason.isNull() & failed, _error(mapping.target, original, VALIDATION_ERROR, CONFIGURED, text)))
    if data_type != STRING:
        text = F.lit(f"Value is not compatible with {data_type}.")
        checks.append((~cell.fits(), _error(mapping.target, value, PROCESSING_ERROR, None, text)))
    return checks


def _error(column: str, value: Column, kind: str, rule: str | None, description: Column) -> Column:
    return F.struct(
        F.lit(column).alias("column_name"),
        value.alias("invalid_value"),
        F.lit(kind).alias("error_type"),
        F.lit(rule).cast("string").alias("validation_rule"),
        description.alias("description"),
    )


def _no_errors() -> Column:
    fields = ",".join(f"{name}:string" for name in ERROR_FIELDS)
    return F.array().cast(f"array<struct<{fields}>>")


def error_rows(df: DataFrame, *keys: str) -> DataFrame:
    """One row per error, with the row's ``keys``.

    A plain explode would infer a filter on ``errors`` and push it below every rule projection, evaluating all
    rules twice; the outer form with a filter on its output does not.
    """
    return (
        df.select(*keys, F.explode_outer("errors").alias("e"))
        .filter("e IS NOT NULL")
        .select(*keys, *(f"e.{name}" for name in ERROR_FIELDS))
    )


def preview(
    df: DataFrame, mappings: Sequence[FieldMapping], types: Mapping[str, str], limit: int = 25
) -> DataFrame:
    """First rows by row number with each cell's original, transformed value and errors; writes nothing."""
    if not 1 <= limit <= 100:
        raise ValueError("Preview limit must be between 1 and 100.")
    number = working_columns(df)[-1]
    first = df.orderBy(_q(number)).limit(limit)
    chosen = first_per_target(mappings)
    judged = judge(first, chosen, types)
    judged = judged.select(F.col(working_columns(judged)[-1]).alias("_number"), *(f"_c{i}" for i in range(len(chosen))))
    cells = [
        F.struct(
            F.lit(m.source).alias("source_column"),
            F.lit(m.target).alias("target_field"),
            F.col(f"_c{i}")["original"].alias("original_value"),
            F.col(f"_c{i}")["value"].alias("transformed_value"),
            (F.size(_configured(i)) == 0).alias("is_valid"),
            F.transform(_configured(i), lambda e: e["description"]).alias("errors"),
        )
        for i, m in enumerate(chosen)
    ]
    return judged.select(F.col("_number").alias(ROW), F.array(*cells).alias("cells")).select(
        ROW, F.forall("cells", lambda cell: cell["is_valid"]).alias("is_valid"), "cells"
    )


def _configured(i: int) -> Column:
    """A cell's rule errors; the type check belongs to the import, not to the preview."""
    return F.filter(F.col(f"_c{i}")["errors"], lambda e: e["error_type"] != PROCESSING_ERROR)
