"""Working columns of a batch: the file a row came from and its number there, beside the data columns.

Readers name them so that no header of the batch has the name, and mark them in the column's metadata, which selects,
joins and checkpoints keep. In a table without marks the two usual names, and no others, are working columns.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame

SOURCE, ROW = "_source_file", "_row_number"
_MARK = "gatehouse.working"


def working_columns(df: DataFrame) -> list[str]:
    """Names of the working columns that ``df`` has: the file first, then the row number."""
    marked = {field.metadata[_MARK]: field.name for field in df.schema.fields if _MARK in field.metadata}
    roles = marked or {name: name for name in (SOURCE, ROW) if name in df.columns}
    return [roles[role] for role in (SOURCE, ROW) if role in roles]


def data_columns(df: DataFrame) -> list[str]:
    """All columns that are not working columns."""
    working = working_columns(df)
    return [name for name in df.columns if name not in working]


def free_name(role: str, taken: Iterable[str]) -> str:
    """The role's usual name, with underscores in front until it differs from all of ``taken``, ignoring case."""
    folded = {name.strip().lower() for name in taken}
    while role in folded:
        role = f"_{role}"
    return role


def marked(column: Column, role: str, taken: Iterable[str]) -> Column:
    """``column`` as the working column of ``role`` beside columns named ``taken``."""
    return column.alias(free_name(role, taken), metadata={_MARK: role})


def carried(df: DataFrame, taken: Iterable[str]) -> list[Column]:
    """The working columns of ``df``, to stand beside columns named ``taken``."""
    names = working_columns(df)
    roles = [df.schema[name].metadata.get(_MARK, name) for name in names]
    return [marked(df[f"`{name}`"], role, taken) for name, role in zip(names, roles, strict=True)]
