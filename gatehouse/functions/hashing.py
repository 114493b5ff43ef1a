"""Record keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from gatehouse.functions.text import trim_ws

UNIT_SEPARATOR = "\x1f"


def key_hash(values: Iterable[Column]) -> Column:
    """Upper-case hex SHA-256 of the trimmed values joined by the unit separator; null counts as ''."""
    parts = [F.coalesce(trim_ws(value), F.lit("")) for value in values]
    return F.upper(F.sha2(F.concat_ws(UNIT_SEPARATOR, *parts), 256))


def filter_bits(key: Column) -> Column:
    """Four bits of a 64-bit word of a Bloom filter, as a mask; which word a key is in, another hash of it tells."""
    mixed = F.xxhash64(key, F.lit("bits"))
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(mixed, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
            for i in range(4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])
