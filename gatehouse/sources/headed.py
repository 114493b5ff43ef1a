"""Files that are checked against known columns, each for itself: one that cannot be read, or has another header, is
refused alone, with a reason, and the others go on.
"""

from __future__ import annotations

import sys
import zipfile
from collections.abc import Iterator, Sequence
from functools import reduce
from xml.etree.ElementTree import ParseError

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from gatehouse.functions.text import clean_header, is_blank
from gatehouse.functions.working import ROW, SOURCE, marked
from gatehouse.operators.schema import ColumnSpec
from gatehouse.session import materialize
from gatehouse.sources.delimited import number_rows, text_cells
from gatehouse.sources.workbooks import sheet_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EMPTY = "The file is empty."
UNREADABLE = "The workbook could not be read."


def raw_cells(columns: Sequence[ColumnSpec]) -> list[str]:
    """Names of the raw cells: one more than the schema has columns, to see that a row is wider."""
    return [f"c{i}" for i in range(len(columns) + 1)]


def bind_headers(rows: DataFrame, columns: Sequence[ColumnSpec]) -> tuple[DataFrame, DataFrame]:
    """``(rows, issues)``: numbered raw rows of headed files as columns of the schema, bound by each file's own header.

    A file whose header does not name exactly the schema's columns, or that has a row wider than its header, is refused
    whole: it gives one row of ``issues`` (file, description) and no rows. Rows of blank cells are not rows.
    """
    cells = raw_cells(columns)
    wanted = F.array(*(F.upper(clean_header(F.lit(c.name))) for c in columns))
    heads = rows.filter(F.col(ROW) == 1).select(
        F.col(SOURCE).alias("file"),
        F.filter(F.transform(F.array(*cells), lambda h: F.upper(clean_header(F.coalesce(h, F.lit(""))))), lambda h: h != "").alias("header"))
    width = reduce(lambda a, b: F.greatest(a, b), (
        F.when(~is_blank(F.coalesce(name, F.lit(""))), F.lit(i + 1)).otherwise(F.lit(0)) for i, name in enumerate(cells)))
    widths = rows.groupBy(F.col(SOURCE).alias("file")).agg(F.max(width).alias("width"))
    missing, extra = F.array_except(wanted, "header"), F.array_except("header", wanted)
    issue = (
        F.when((F.size(missing) > 0) | (F.size(extra) > 0), F.concat(
            F.lit("Schema mismatch. Missing: ["), F.array_join(missing, ", "), F.lit("]. Additional: ["), F.array_join(extra, ", "), F.lit("].")))
        .when(F.size("header") != F.size(F.array_distinct("header")), F.lit("File contains duplicate column names."))
        .when(F.col("width") > F.size("header"), F.lit("File contains missing or blank headers."))
    )
    judged = materialize(heads.join(widths, "file").withColumn("description", issue))
    good = judged.filter("description IS NULL").select(F.col("file").alias(SOURCE), "header")
    data = rows.filter(F.col(ROW) > 1).filter(~reduce(lambda a, b: a & b, (is_blank(F.coalesce(c, F.lit(""))) for c in cells)))
    names = [c.name for c in columns]
    bound = data.join(good, SOURCE).select(*(marked(F.col(role), role, names) for role in (SOURCE, ROW)), *(
        F.coalesce(F.get(F.array(*cells), F.array_position("header", F.upper(clean_header(F.lit(c.name)))).cast("int") - 1),
                   F.lit("")).alias(c.name) for c in columns))
    return bound, judged.filter("description IS NOT NULL").select("file", "description")


def read_headed(spark: SparkSession, path: str, columns: Sequence[ColumnSpec], delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """``(rows, issues)`` of all delimited files below ``path``; see :func:`bind_headers`."""
    if len(delimiter) != 1:
        raise ValueError("The delimiter must be one character.")
    width = len(columns)
    rows = text_cells(spark, path, width, delimiter, True).withColumnRenamed("overflow", f"c{width}")
    return bind_headers(number_rows(rows), columns)


def read_headed_workbooks(files: DataFrame, sheet: str, columns: Sequence[ColumnSpec]) -> tuple[DataFrame, DataFrame]:
    """``(rows, issues)`` of one sheet of all workbooks ``files(path, content)``; only that sheet is parsed.

    A file that is no workbook, that lacks the sheet, or whose sheet is empty is refused as one of another header is.
    """
    if not sheet or not sheet.strip():
        raise ValueError("WorksheetName is required for XLSX imports.")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield from _scanned(path, content, sheet)

    read = materialize(files.mapInPandas(scan, f"{SOURCE} string, {ROW} bigint, cells array<string>, issue string"))
    width = len(columns)
    wider = F.get(F.filter(F.slice("cells", width + 1, F.greatest(F.size("cells") - width, F.lit(0))), lambda c: ~is_blank(c)), F.lit(0))
    cells = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(width)]
    rows = read.filter("issue IS NULL").select(SOURCE, ROW, *cells, wider.alias(f"c{width}"))
    bound, issues = bind_headers(rows, columns)
    return bound, issues.unionByName(read.filter("issue IS NOT NULL").select(F.col(SOURCE).alias("file"), F.col("issue").alias("description")))


def _scanned(path: str, content: bytes, sheet: str) -> Iterator[pd.DataFrame]:
    """Rows of the sheet, 10,000 at a time, or one row with the reason why there are none. A workbook that turns out to be
    broken after its first rows is refused as a whole, so its rows, which the landing gate bounds, are held till then."""
    numbers, cells, reason = [], [], None
    try:
        for number, row in enumerate(sheet_rows(content, sheet), start=1):
            numbers.append(number)
            cells.append(row)
    except ValueError as problem:
        reason = str(problem)
    except (zipfile.BadZipFile, KeyError, ParseError, IndexError, EOFError, NotImplementedError):
        reason = UNREADABLE
    if reason is None and not cells:
        reason = EMPTY
    if reason is not None:
        yield pd.DataFrame({SOURCE: [path], ROW: [0], "cells": [None], "issue": [reason]})
        return
    for at in range(0, len(cells), 10_000):
        yield pd.DataFrame({SOURCE: path, ROW: numbers[at : at + 10_000], "cells": cells[at : at + 10_000], "issue": None})
