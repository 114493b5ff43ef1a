"""Guarded number parsing.

A bare ``try_cast`` has a different grammar (it refuses ``1,234.5`` and ``5-`` and takes ``1e3``), so each
parser first matches the accepted grammar and casts only what matched. Normalisation is a chain of replacements
that mentions its input once, so expressions stay small when parsers are combined.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DECIMAL = "decimal(38,10)"

_WS = r"[\x09-\x0D ]*"
_DIGITS = r"(?:[0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+)"
_EXPONENT = r"(?:[eE][+-]?[0-9]+)?"
_FREE = rf"{_DIGITS}{_EXPONENT}"

INTEGER_PATTERN = rf"\A{_WS}[+-]?[0-9]+{_WS}\z"
NUMBER_PATTERN = rf"\A{_WS}(?:[+-]?{_DIGITS}|{_DIGITS}{_WS}[+-]){_WS}\z"
ANY_NUMBER_PATTERN = (
    rf"\A{_WS}(?:[+-]?¤?{_FREE}¤?|¤?[+-]{_FREE}|¤?{_FREE}{_WS}[+-]|\(¤?{_FREE}\)){_WS}\z"
)

_NOISE = " \t\n\x0b\x0c\r,)¤"
_TRAILING_SIGN = r"\A(.*[0-9.])([+-])\z"


def to_integer(value: Column) -> Column:
    """64-bit integer with optional sign and outer whitespace, else null."""
    return F.when(value.rlike(INTEGER_PATTERN), F.btrim(value, F.lit(" \t\n\x0b\x0c\r")).try_cast("bigint"))


def to_decimal(value: Column) -> Column:
    """Plain number: leading or trailing sign, thousands commas, decimal point; else null."""
    return F.when(value.rlike(NUMBER_PATTERN), _signed(value).try_cast(DECIMAL))


def to_any_number(value: Column) -> Column:
    """As :func:`to_decimal`, plus exponent, parentheses and the currency sign."""
    return F.when(value.rlike(ANY_NUMBER_PATTERN), _signed(value).try_cast(DECIMAL))


def _signed(value: Column) -> Column:
    """Matched number text with its sign, if any, in front; '(' stands for a minus sign."""
    bare = F.translate(value, "(" + _NOISE, "-")
    return F.regexp_replace(bare, _TRAILING_SIGN, "$2$1")


def number_text(value: Column) -> Column:
    """Canonical text of any accepted number, keeping the written scale; null if not a number."""
    signed = _signed(value)
    return F.when(
        to_any_number(value).isNotNull(),
        F.when(signed.rlike("[eE]"), _without_exponent(signed)).otherwise(_tidy(signed)),
    )


def _tidy(signed: Column) -> Column:
    """No plus sign, no leading zeros, a digit before the point, no bare point, no minus zero."""
    for pattern, replacement in (
        (r"\A\+", ""),
        (r"\A(-?)0+(?=[0-9])", "$1"),
        (r"\A(-?)\.", "$10."),
        (r"\.\z", ""),
        (r"\A-(0(?:\.0*)?)\z", "$1"),
    ):
        signed = F.regexp_replace(signed, pattern, replacement)
    return signed


def _without_exponent(signed: Column) -> Column:
    """Plain digits of exponent text; its scale is the written one less the exponent, at least 0."""
    fraction = F.length(F.regexp_extract(signed, r"\.([0-9]*)", 1))
    exponent = F.regexp_extract(signed, r"[eE]([+-]?[0-9]+)\z", 1).try_cast("int")
    scale = F.least(F.greatest(fraction - exponent, F.lit(0)), F.lit(10))
    fixed = signed.try_cast(DECIMAL).cast("string")
    return _tidy(F.substr(fixed, F.lit(1), F.length(fixed) - 10 + scale))
