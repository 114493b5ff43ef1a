"""Rule registry: transformations and validations as column expressions.

A new rule is one registered function. Parameters are checked when a configuration is compiled, so a bad
parameter stops the run before any row is read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession, functions as F

from gatehouse.functions.dates import format_datetime, to_datetime
from gatehouse.functions.numbers import DECIMAL, number_text, to_decimal
from gatehouse.functions.text import is_blank, is_empty, trim_ws
from gatehouse.functions.typed import Cell
from gatehouse.operators.config import Rule

Row = Mapping[str, Column]


@dataclass(frozen=True)
class Transformation:
    """``apply`` gives the new value; ``failure`` the error text when the new value is null."""

    apply: Callable[[Column, Mapping[str, str], Row], Column]
    required: tuple[str, ...] = ()
    failure: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class Validation:
    """``failed`` gives a never-null boolean."""

    failed: Callable[[Cell, Mapping[str, str]], Column]
    required: tuple[str, ...] = ()


TRANSFORMATIONS: dict[str, Transformation] = {}
VALIDATIONS: dict[str, Validation] = {}
_NAMES: dict[str, str] = {}


def register_transformation(name: str, required: tuple[str, ...] = (), failure=None):
    def add(function):
        TRANSFORMATIONS[name.lower()] = Transformation(function, required, failure)
        _NAMES[name.lower()] = name
        return function

    return add


def register_validation(name: str, required: tuple[str, ...] = ()):
    def add(function):
        VALIDATIONS[name.lower()] = Validation(function, required)
        _NAMES[name.lower()] = name
        return function

    return add


def find_transformation(rule: Rule) -> Transformation:
    return _find(TRANSFORMATIONS, rule, "transformation")


def find_validation(rule: Rule) -> Validation:
    return _find(VALIDATIONS, rule, "validation")


def _find(registry: dict, rule: Rule, kind: str):
    found = registry.get(rule.type.lower())
    if found is None:
        raise ValueError(f"Unsupported {kind} type '{rule.type}'.")
    for name in found.required:
        if name not in rule.parameters:
            raise ValueError(f"Parameter '{name}' is required.")
    return found


def rule_name(rule: Rule) -> str:
    return _NAMES[rule.type.lower()]


def failure_message(rule: Rule) -> str:
    return rule.message if rule.message is not None else f"{rule_name(rule)} validation failed."


def _number_failure(value: Column) -> Column:
    return F.concat(
        F.lit("The input string '"), F.coalesce(value, F.lit("")), F.lit("' was not in a correct format.")
    )


def _date_failure(value: Column) -> Column:
    return F.concat(
        F.lit("String '"), F.coalesce(value, F.lit("")), F.lit("' was not recognized as a valid DateTime.")
    )


# --- transformations -------------------------------------------------------------------------------------


@register_transformation("Trim")
def _trim(value, parameters, row):
    return trim_ws(value)


@register_transformation("Uppercase")
def _uppercase(value, parameters, row):
    return F.upper(value)


@register_transformation("Lowercase")
def _lowercase(value, parameters, row):
    return F.lower(value)


@register_transformation("Default")
def _default(value, parameters, row):
    if "value" not in parameters:
        return value
    return F.when(is_empty(value), F.lit(parameters["value"])).otherwise(value)


@register_transformation("Replace", required=("old", "new"))
def _replace(value, parameters, row):
    if parameters["old"] == "":
        raise ValueError("Parameter 'old' cannot be empty.")
    return F.replace(value, F.lit(parameters["old"]), F.lit(parameters["new"]))


@register_transformation("DateFormat", required=("format",), failure=_date_failure)
def _date_format(value, parameters, row):
    return format_datetime(value, parameters["format"])


@register_transformation("Numeric", failure=_number_failure)
def _numeric(value, parameters, row):
    return number_text(value)


@register_transformation("StringLength")
def _string_length(value, parameters, row):
    return F.substring(value, 1, int(parameters["max"])) if "max" in parameters else value


@register_transformation("Derived", required=("template",))
def _derived(value, parameters, row):
    pieces, position = [], 0
    for hole in re.finditer(r"\{([^}]+)\}", parameters["template"]):
        pieces.append(F.lit(parameters["template"][position : hole.start()]))
        source = row.get(hole.group(1).lower())
        pieces.append(F.lit("") if source is None else F.coalesce(source, F.lit("")))
        position = hole.end()
    pieces.append(F.lit(parameters["template"][position:]))
    return F.concat(*pieces)


# --- validations -----------------------------------------------------------------------------------------


@register_validation("Required")
def _required(cell, parameters):
    return is_blank(cell.text)


@register_validation("DataType")
def _data_type(cell, parameters):
    return ~cell.passes_data_type_rule()


@register_validation("MaximumLength", required=("value",))
def _maximum_length(cell, parameters):
    return F.coalesce(F.length(cell.text) > int(parameters["value"]), F.lit(False))


@register_validation("MinimumLength", required=("value",))
def _minimum_length(cell, parameters):
    return F.coalesce(F.length(cell.text) < int(parameters["value"]), F.lit(False))


def _constant(expression: Column, rule: str, name: str, text: str) -> Column:
    """A bound read once, on the driver, so that an unreadable one stops the run before any row is read."""
    value = SparkSession.active().range(1).select(expression.alias("value")).first()["value"]
    if value is None:
        raise ValueError(f"Parameter '{name}' of {rule} is not valid: '{text}'.")
    return F.lit(value)


@register_validation("NumericRange", required=("min", "max"))
def _numeric_range(cell, parameters):
    low, high = (
        _constant(to_decimal(F.lit(parameters[name])), "NumericRange", name, parameters[name]).cast(DECIMAL)
        for name in ("min", "max")
    )
    return ~F.coalesce(cell.number().between(low, high), F.lit(True))


@register_validation("DateRange", required=("min", "max"))
def _date_range(cell, parameters):
    low, high = (
        _constant(to_datetime(F.lit(parameters[name])).cast("string"), "DateRange", name, parameters[name])
        .cast("timestamp_ntz")
        for name in ("min", "max")
    )
    return ~F.coalesce(cell.moment().between(low, high), F.lit(True))


@register_validation("AllowedValues", required=("values",))
def _allowed_values(cell, parameters):
    allowed = [item.lower() for item in parameters["values"].split("|")]
    return ~F.coalesce(F.lower(cell.text).isin(allowed), F.lit(False))


@register_validation("Pattern", required=("pattern",))
def _pattern(cell, parameters):
    try:
        SparkSession.active().range(1).select(F.col("id").cast("string").rlike(parameters["pattern"])).first()
    except Exception as error:
        raise ValueError(f"Parameter 'pattern' of Pattern is not valid: '{parameters['pattern']}'.") from error
    return ~F.coalesce(cell.text.rlike(parameters["pattern"]), F.lit(True))


@register_validation("Duplicate")
def _duplicate(cell, parameters):
    return F.lit(False)  # key-hash de-duplication owns this rule
