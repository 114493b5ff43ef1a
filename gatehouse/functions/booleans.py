"""Boolean text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gatehouse.functions.text import trim_ws


def to_strict_boolean(value: Column) -> Column:
    """true/false in any case with outer whitespace, else null."""
    word = F.lower(trim_ws(value))
    return F.when(word.isin("true", "false"), word == "true")


def to_boolean(value: Column) -> Column:
    """As :func:`to_strict_boolean`, plus exactly '1' and '0'."""
    return F.when(value.isin("0", "1"), value == "1").otherwise(to_strict_boolean(value))
