"""Sorting, paging and top-N.

An order is a list of ``(column name, ascending)`` pairs, or of sort expressions. A page near the beginning is a top-N,
which each task cuts before rows move. For a page far behind, the rows before it are never sorted: sampled bounds divide
the order into ranges, rows are counted per range, and only the ranges that hold the page are divided again, until they
are few rows. That needs the pairs, and takes one more pass for each division of the rows by BOUNDS.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

# Sort names a catalogue request may use, and the page limits.
SORT_FIELDS = {
    "name": "name", "datasetname": "name",
    "createdatutc": "created_at", "createddate": "created_at",
    "updatedatutc": "updated_at", "lastupdateddate": "updated_at", "lastmodifieddate": "updated_at",
}
MAX_PAGE_SIZE = 100
MAX_ERROR_PAGE_SIZE = 200

SortKey = Column | tuple[str, bool]
#: Rows that may be sorted as a top-N, and the ranges into which more are divided at once.
SHALLOW, BOUNDS = 10_000, 256


def requested_order(
    sort_by: str | None,
    direction: str | None,
    tie_breaker: str,
    fields: Mapping[str, str] = SORT_FIELDS,
    fallback: str = "updated_at",
) -> list[tuple[str, bool]]:
    """Whitelisted sort, descending unless 'asc'; an unknown name sorts by the fallback, descending."""
    field = fields.get((sort_by or "").strip().lower())
    ascending = field is not None and (direction or "").lower() == "asc"
    return [(field or fallback, ascending), (tie_breaker, True)]


def clamp_page(number: int, size: int, maximum: int = MAX_PAGE_SIZE) -> tuple[int, int]:
    return max(1, number), min(max(1, size), maximum)


def sort_columns(order: Sequence[SortKey]) -> list[Column]:
    """Sort expressions; nulls come first in ascending and last in descending order."""
    return [key if isinstance(key, Column) else F.col(key[0]).asc() if key[1] else F.col(key[0]).desc() for key in order]


def page(
    df: DataFrame, order: Sequence[SortKey], number: int = 1, size: int = 20, maximum: int = MAX_PAGE_SIZE
) -> tuple[DataFrame, int]:
    """One page and the total before paging; a page far behind takes the total from its own counts."""
    number, size = clamp_page(number, size, maximum)
    return _page(df, order, (number - 1) * size, size, df.count)


def page_rows(
    df: DataFrame, order: Sequence[SortKey], number: int = 1, size: int = 20, maximum: int = MAX_PAGE_SIZE
) -> DataFrame:
    number, size = clamp_page(number, size, maximum)
    return _page(df, order, (number - 1) * size, size, lambda: -1)[0]


def page_after(
    df: DataFrame, order: Sequence[tuple[str, bool]], last: Sequence[Any], size: int = 20, maximum: int = MAX_PAGE_SIZE
) -> DataFrame:
    """The page behind a row whose values of ``order``'s columns are ``last``: one filter and a top-N, however far."""
    _, size = clamp_page(1, size, maximum)
    return df.filter(_before([F.lit(value) for value in last], _values(order), order)).orderBy(*sort_columns(order)).limit(size)


def _page(df: DataFrame, order: Sequence[SortKey], offset: int, size: int, count: Callable[[], int]) -> tuple[DataFrame, int]:
    deep = offset + size > SHALLOW and not any(isinstance(key, Column) for key in order)
    rows, offset, total = _narrowed(df, order, offset, size) if deep else (df, offset, None)
    return rows.orderBy(*sort_columns(order)).offset(offset).limit(size), count() if total is None else total


def _values(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(name) for name, _ in order]


def _before(left: Sequence[Column], right: Sequence[Column], order: Sequence[tuple[str, bool]]) -> Column:
    """Whether the values of ``left`` come before those of ``right``."""
    result = F.lit(False)
    for a, b, (_, ascending) in reversed(list(zip(left, right, order, strict=True))):
        small, large = (a, b) if ascending else (b, a)
        less = F.coalesce(small < large, small.isNull() & large.isNotNull())
        result = less | (a.eqNullSafe(b) & result)
    return result


def _narrowed(df: DataFrame, order: Sequence[tuple[str, bool]], offset: int, size: int) -> tuple[DataFrame, int, int]:
    """(rows, offset, total): few rows that hold the page, the page's offset among them, and the number of all rows.

    The bounds are rows that a hash of the order's values chooses, so at most BOUNDS rows come to the driver a division;
    they are values, so counting and filtering agree without storing the rows.
    """
    names, rows, total = [name for name, _ in order], df, None
    while True:
        chosen = rows.select(*names).orderBy(F.xxhash64(*names)).limit(BOUNDS).distinct().orderBy(*sort_columns(order)).collect()
        types = [df.schema[name].dataType for name in names]

        def bound(row):
            return F.struct(*(F.lit(value).cast(kind).alias(name) for value, kind, name in zip(row, types, names, strict=True)))

        bounds = F.array(*(bound(row) for row in chosen)) if chosen else None
        if bounds is None:
            return rows, offset, total or 0
        steps = [1 << i for i in reversed(range(len(chosen).bit_length()))]
        # How many bounds are not behind the row, by binary search.
        place = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(
            (at + step <= len(chosen)) & ~_before(_values(order), [F.get(bounds, at + step - 1)[name] for name in names], order),
            at + step).otherwise(at))
        counts = dict(rows.groupBy(place.alias("range")).count().collect())
        n = sum(counts.values())
        total = n if total is None else total
        passed, first, last = 0, 0, len(chosen)
        for number in range(len(chosen) + 1):
            if passed + counts.get(number, 0) > offset:
                first = number
                break
            passed += counts.get(number, 0)
        else:
            return rows.limit(0), 0, total
        held = 0
        for number in range(first, len(chosen) + 1):
            held += counts.get(number, 0)
            if passed + held >= offset + size:
                last = number
                break
        if first:
            rows = rows.filter(~_before(_values(order), [F.lit(v).cast(t) for v, t in zip(chosen[first - 1], types, strict=True)], order))
        if last < len(chosen):
            rows = rows.filter(_before(_values(order), [F.lit(v).cast(t) for v, t in zip(chosen[last], types, strict=True)], order))
        offset -= passed
        if held <= SHALLOW or held == n:
            return rows, offset, total


def latest(df: DataFrame, order: Sequence[SortKey], n: int) -> DataFrame:
    return df.orderBy(*sort_columns(order)).limit(n)


def rank_by_list(value: Column, ranked: Sequence[str], other: int = 99) -> Column:
    """Custom sort rank: position in the list from 1, anything else last."""
    rank = F.lit(other)
    for position, item in reversed(list(enumerate(ranked, start=1))):
        rank = F.when(value == item, position).otherwise(rank)
    return rank
