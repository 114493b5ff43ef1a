"""Files that queries read back, written by Spark from the test tables."""

from __future__ import annotations

import io
import sys
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> str:
    """Quoted text files with a header, split as Spark likes."""
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').option("sep", delimiter).csv(path)
    return path


def write_ordered_lines(df: DataFrame, group: str, order: str, path: str) -> str:
    """One text file per group, its lines in order; ``df(group, order, value)``."""
    (
        df.repartition(group).sortWithinPartitions(group, order).select(group, "value")
        .write.partitionBy(group).text(path)
    )
    return path


def workbooks(df: DataFrame, group: str, columns: list[str], sheet: str) -> DataFrame:
    """One workbook per (small) group as ``(path, content)``: a notes sheet and a data sheet with a header row.

    Text cells alternate between shared and inline strings, and booleans are stored as booleans.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            files = [
                (f"book-{name}.xlsx", workbook_bytes([columns, *rows], sheet))
                for name, rows in zip(batch["group"], batch["rows"])
            ]
            yield pd.DataFrame(files, columns=["path", "content"])

    rows = F.sort_array(F.collect_list(F.struct(*columns)))
    grouped = df.groupBy(F.col(group).alias("group")).agg(rows.alias("cells")).select(
        "group", F.transform("cells", lambda r: F.array(*(r[c].cast("string") for c in columns))).alias("rows")
    )
    return grouped.mapInPandas(build, "path string, content binary")


def _reference(column: int, row: int) -> str:
    letters = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        letters = chr(ord("A") + rest) + letters
    return f"{letters}{row}"


def workbook_bytes(rows: list, sheet: str) -> bytes:
    """A minimal workbook; empty cells are left out, and a blank row follows the header."""
    shared: dict[str, int] = {}
    lines = []
    for number, row in enumerate(rows):
        position = number + 1 + (number > 0)
        cells = []
        for column, value in enumerate(row):
            if value is None or value == "":
                continue
            at = _reference(column, position)
            if value in ("true", "false"):
                cells.append(f'<c r="{at}" t="b"><v>{int(value == "true")}</v></c>')
            elif (number + column) % 2:
                cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>')
            else:
                index = shared.setdefault(value, len(shared))
                cells.append(f'<c r="{at}" t="s"><v>{index}</v></c>')
        lines.append(f'<row r="{position}">{"".join(cells)}</row>')
        if number == 0:
            lines.append('<row r="2"><c r="A2" t="inlineStr"><is><t> </t></is></c></row>')
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    strings = "".join(f'<si><t xml:space="preserve">{escape(text)}</t></si>' for text in shared)
    parts = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{office}"><sheets><sheet name="Notes" sheetId="1" r:id="rId1"/>'
        f'<sheet name="{escape(sheet)}" sheetId="2" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}">'
        f'<Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/>'
        f'<Relationship Id="rId2" Type="{office}/worksheet" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {main}><sheetData/></worksheet>",
        "xl/worksheets/sheet2.xml": f'<worksheet {main}><sheetData>{"".join(lines)}</sheetData></worksheet>',
        "xl/sharedStrings.xml": f"<sst {main}>{strings}</sst>",
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        for name, body in parts.items():
            book.writestr(name, f'<?xml version="1.0" encoding="UTF-8"?>{body}')
    return buffer.getvalue()
