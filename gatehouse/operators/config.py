"""Mapping configuration: field mappings, rules and their JSON form."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

CONFIG_SCHEMA = (
    "struct<mappings:array<struct<"
    "sourceColumn:string,targetColumn:string,isRequired:boolean,defaultValue:string,"
    "transformations:array<struct<type:string,sequence:int,parameters:map<string,string>>>,"
    "validations:array<struct<type:string,sequence:int,message:string,parameters:map<string,string>>>"
    ">>>"
)


@dataclass(frozen=True)
class Rule:
    """One transformation or validation step."""

    type: str
    sequence: int = 0
    parameters: dict[str, str] = field(default_factory=dict)
    message: str | None = None


@dataclass(frozen=True)
class FieldMapping:
    """How one source column becomes one target column."""

    source: str
    target: str
    required: bool = False
    default: str | None = None
    transformations: tuple[Rule, ...] = ()
    validations: tuple[Rule, ...] = ()


def decode_config(df: DataFrame, json_column: str = "config_json") -> DataFrame:
    """Add ``mappings`` parsed from the stored JSON."""
    return df.withColumn("mappings", F.from_json(json_column, CONFIG_SCHEMA)["mappings"])


def encode_config(mappings: Column) -> Column:
    """Stored JSON for a ``mappings`` array column."""
    return F.to_json(F.struct(mappings.alias("mappings")))


def mappings_from_rows(rows: Iterable) -> tuple[FieldMapping, ...]:
    """Driver-side mappings from one decoded configuration (its size is one schema, not data)."""
    return tuple(
        FieldMapping(
            source=row["sourceColumn"],
            target=row["targetColumn"],
            required=bool(row["isRequired"]),
            default=row["defaultValue"],
            transformations=_rules(row["transformations"]),
            validations=_rules(row["validations"]),
        )
        for row in rows
    )


def _rules(rows: Iterable | None) -> tuple[Rule, ...]:
    return tuple(
        Rule(
            type=row["type"],
            sequence=row["sequence"] or 0,
            parameters=dict(row["parameters"] or {}),
            message=row.asDict().get("message"),
        )
        for row in rows or ()
    )


def load_config(df: DataFrame, json_column: str = "config_json") -> tuple[FieldMapping, ...]:
    """Mappings of the single configuration row in ``df``."""
    rows = decode_config(df, json_column).select("mappings").take(2)
    if len(rows) != 1:
        raise ValueError("expected exactly one configuration")
    return mappings_from_rows(rows[0]["mappings"] or ())
