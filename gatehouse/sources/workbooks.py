"""Spreadsheet workbooks in parallel: one task parses one workbook at a time, row by row.

The landing gate bounds a workbook's size; the parallel unit is the file, so many workbooks spread over the cluster.
"""

from __future__ import annotations

import io
import posixpath
import sys
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from gatehouse.session import materialize
from gatehouse.functions.working import ROW, SOURCE, marked
from gatehouse.sources.delimited import resolve_headers

# Ship this module's functions with the task, so that workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def workbook_files(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, content)`` of the workbooks below a directory."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.xlsx")
        .option("recursiveFileLookup", "true")
        .load(directory)
        .select("path", "content")
    )


def workbook_sheets(files: DataFrame) -> DataFrame:
    """``(file, position, sheet)`` for every named sheet."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    names = [name for name, _ in _sheets(book) if name]
                yield pd.DataFrame({"file": path, "position": range(1, len(names) + 1), "sheet": names})

    return files.mapInPandas(scan, "file string, position int, sheet string")


def workbook_rows(files: DataFrame, sheet: str) -> DataFrame:
    """``(_source_file, _row_number, cells)``: non-blank rows of one sheet, numbered from 1 within the file."""
    if not sheet or not sheet.strip():
        raise ValueError("WorksheetName is required for XLSX imports.")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                numbers, cells = [], []
                for number, row in enumerate(sheet_rows(content, sheet), start=1):
                    numbers.append(number)
                    cells.append(row)
                    if len(cells) == 10_000:
                        yield pd.DataFrame({SOURCE: path, ROW: numbers, "cells": cells})
                        numbers, cells = [], []
                yield pd.DataFrame({SOURCE: path, ROW: numbers, "cells": cells})

    return files.mapInPandas(scan, f"{SOURCE} string, {ROW} bigint, cells array<string>")


def read_workbooks(files: DataFrame, sheet: str, header: bool = True) -> DataFrame:
    """One sheet of every workbook as text columns; all workbooks must share one header."""
    rows = materialize(workbook_rows(files, sheet))
    widest = rows.agg(F.max(F.size("cells"))).first()[0]
    if widest is None:
        raise ValueError("The file is empty.")
    if header:
        padded = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(widest)]
        heads = rows.filter(F.col(ROW) == 1).select(*padded).distinct().take(2)
        if len(heads) != 1:
            raise ValueError("The files do not share one header.")
        names = resolve_headers(list(heads[0]))
        rows = rows.filter(F.col(ROW) > 1)
    else:
        names = [f"Column{i + 1}" for i in range(widest)]
    cells = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(names)]
    return rows.select(*(marked(F.col(role), role, names) for role in (SOURCE, ROW)), *cells)


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part path) of each sheet in workbook order."""
    targets = {
        link.get("Id"): link.get("Target")
        for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{_PACKAGE_REL}Relationship")
    }
    found = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = targets.get(sheet.get(f"{_REL}id"), "")
        part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
        found.append((sheet.get("name") or "", part))
    return found


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in root.iter(f"{_MAIN}si")]


def sheet_rows(content: bytes, sheet: str) -> Iterator[list[str]]:
    """Non-blank rows of one sheet of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        parts = {name.lower(): part for name, part in reversed(_sheets(book))}
        part = parts.get(sheet.lower())
        if part is None:
            raise ValueError(f"Worksheet '{sheet}' was not found.")
        shared = _shared_strings(book)
        with book.open(part) as stream:
            for _, element in ElementTree.iterparse(stream):
                if element.tag != f"{_MAIN}row":
                    continue
                values: list[str] = []
                for cell in element.iter(f"{_MAIN}c"):
                    index = _column_index(cell.get("r"))
                    values.extend([""] * (index + 1 - len(values)))
                    values[index] = _text(cell, shared)
                element.clear()
                if any(value.strip() for value in values):
                    yield values


def _column_index(reference: str | None) -> int:
    index = 0
    for letter in reference or "":
        if not letter.isalpha():
            break
        index = index * 26 + ord(letter.upper()) - ord("A") + 1
    return max(0, index - 1)


def _text(cell: ElementTree.Element, shared: list[str]) -> str:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    value = cell.findtext(f"{_MAIN}v") or ""
    if kind == "s" and value.isdigit() and shared:
        return shared[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    return value
