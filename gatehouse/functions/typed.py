"""The five column types: predicates and typed values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from gatehouse.functions.booleans import to_boolean, to_strict_boolean
from gatehouse.functions.dates import to_datetime
from gatehouse.functions.numbers import DECIMAL, to_any_number, to_decimal, to_integer
from gatehouse.functions.text import is_blank

# The column types a dataset schema may use.
STRING, INTEGER, DECIMAL_TYPE, BOOLEAN, DATETIME = "String", "Integer", "Decimal", "Boolean", "DateTime"
COLUMN_TYPES = (STRING, INTEGER, DECIMAL_TYPE, BOOLEAN, DATETIME)

SPARK_TYPES = {
    STRING: "string",
    INTEGER: "bigint",
    DECIMAL_TYPE: DECIMAL,
    BOOLEAN: "boolean",
    DATETIME: "timestamp_ntz",
}

_PARSERS = {INTEGER: to_integer, DECIMAL_TYPE: to_decimal, BOOLEAN: to_boolean, DATETIME: to_datetime}

def typed_value(value: Column, data_type: str) -> Column:
    """Text as its declared type; blank and unparseable text become null."""
    if data_type == STRING:
        return F.when(~is_blank(value), value)
    return _PARSERS[data_type](value)


def fits(value: Column, data_type: str) -> Column:
    """Whether a cell may be stored in a column of the type; blank always may."""
    if data_type == STRING:
        return F.lit(True)
    return is_blank(value) | _PARSERS[data_type](value).isNotNull()


@dataclass(frozen=True)
class Cell:
    """One processed cell: its text, its column type, and the text parsed as that type."""

    text: Column
    data_type: str
    typed: Column

    def number(self) -> Column:
        """The cell in the widest number grammar; the typed value is reused where it is already a number."""
        wide = to_any_number(self.text)
        return F.coalesce(self.typed.cast(DECIMAL), wide) if self.data_type in (INTEGER, DECIMAL_TYPE) else wide

    def moment(self) -> Column:
        return self.typed if self.data_type == DATETIME else to_datetime(self.text)

    def fits(self) -> Column:
        """Whether the cell may be stored in its column; blank always may."""
        return F.lit(True) if self.data_type == STRING else is_blank(self.text) | self.typed.isNotNull()

    def passes_data_type_rule(self) -> Column:
        """The data-type rule: wider numbers and stricter booleans than :meth:`fits`."""
        if self.data_type == STRING:
            return F.lit(True)
        parsed = {
            INTEGER: lambda: self.typed,
            DECIMAL_TYPE: self.number,
            BOOLEAN: lambda: to_strict_boolean(self.text),
            DATETIME: self.moment,
        }[self.data_type]()
        return is_blank(self.text) | parsed.isNotNull()
