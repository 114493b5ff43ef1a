"""Text predicates and normalisation, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The Unicode White_Space characters.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
BOM = "\ufeff"


def trim_ws(value: Column) -> Column:
    """Strip every kind of whitespace from both ends (plain ``trim`` strips spaces only)."""
    return F.btrim(value, F.lit(WHITESPACE))


def is_blank(value: Column) -> Column:
    """True for null, empty and all-whitespace text."""
    return F.coalesce(trim_ws(value), F.lit("")) == ""


def is_empty(value: Column) -> Column:
    """True for null and '' only."""
    return F.coalesce(value, F.lit("")) == ""


def normalize(value: Column) -> Column:
    """Comparison form of a name: trimmed, upper case."""
    return F.upper(trim_ws(value))


def clean_header(value: Column) -> Column:
    """Header text: trimmed, then a leading byte-order mark removed."""
    return F.ltrim(trim_ws(value), F.lit(BOM))


def clean_name(name: str) -> str:
    """Driver-side form of :func:`clean_header` for the few names in a schema."""
    return name.strip(WHITESPACE).lstrip(BOM)


def contains_ci(value: Column, needle: str) -> Column:
    """Case-insensitive substring test."""
    return F.contains(F.lower(value), F.lit(needle.strip(WHITESPACE).lower()))
