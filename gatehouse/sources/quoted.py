"""Large delimited files with line breaks inside cells, read in splits.

A split may begin anywhere, also inside a quoted cell, so a line of it may be the middle of a record. Whether it is
follows from the number of quotes before it: a line begins a record if that number is even. Quotes are counted per split,
a prefix sum over a file's splits gives each split the parity it begins with, and a running sum inside the split settles
every line. Records of one line stay where they are; only the lines of longer records are put together by a shuffle.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gatehouse.functions.text import is_blank
from gatehouse.functions.working import ROW, SOURCE, marked
from gatehouse.session import materialize
from gatehouse.sources.delimited import drop_blank, without_header

STRAY = "Quotes stand inside cells that are not quoted; read the file as a whole."
_SPLIT = [SOURCE, "_split"]


def _valid(delimiter: str) -> str:
    """Pattern of a record whose quotes enclose cells; an escaped quote is doubled."""
    other = rf'[^"\x{ord(delimiter):02x}]*+'
    cell = rf'(?:"[^"]*+(?:""[^"]*+)*+"|{other})'
    return rf"\A{cell}(?:\x{ord(delimiter):02x}{cell})*+\z"


def records(spark: SparkSession, path: str) -> DataFrame:
    """(_source_file, _split, _record, value): the records of all files below ``path``, in order of split and number."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias(SOURCE), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_id"), "value")
    # Line numbers and splits are fixed first: both readers of them must agree.
    fixed = materialize(lines.withColumn("_quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))))
    earlier = Window.partitionBy(SOURCE).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    carried = fixed.groupBy(*_SPLIT).agg(F.sum("_quotes").alias("_n")).select(
        *_SPLIT, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*_SPLIT).orderBy("_id")
    before = F.col("_before") + F.coalesce(F.sum("_quotes").over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    settled = fixed.join(carried, _SPLIT).withColumn("_start", before % 2 == 0)
    own = F.sum(F.col("_start").cast("int")).over(local.rowsBetween(Window.unboundedPreceding, 0))
    alone = F.col("_start") & (F.col("_quotes") % 2 == 0)
    told = materialize(settled.select(*_SPLIT, "_id", "value", own.alias("_record"), alone.alias("_alone")))
    # Lines before the first record of a split belong to the last record of the splits before it.
    numbers = told.groupBy(*_SPLIT).agg(F.max("_record").alias("_last")).withColumn(
        "_owner", F.last(F.when(F.col("_last") > 0, F.struct("_split", "_last")), True).over(earlier)).drop("_last")
    placed = told.filter("NOT _alone").join(numbers, _SPLIT).withColumn("_first", F.col("_record") > 0)
    owned = placed.select(
        SOURCE, F.when(F.col("_first"), F.col("_split")).otherwise(F.col("_owner._split")).alias("_split"),
        F.when(F.col("_first"), F.col("_record")).otherwise(F.col("_owner._last")).alias("_record"),
        F.struct(F.col("_split").alias("at"), "_id", "value").alias("line"))
    joined = owned.groupBy(*_SPLIT, "_record").agg(F.sort_array(F.collect_list("line")).alias("lines")).select(
        *_SPLIT, "_record", F.array_join(F.transform("lines", lambda line: line["value"]), "\n").alias("value"))
    every = told.filter("_alone").select(*_SPLIT, "_record", "value").unionByName(joined)
    return every.withColumn("value", F.regexp_replace("value", r"\r\z", ""))


def read_quoted(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """All files below ``path``, each with the same header, as text columns with file and row number.

    The rows of ``delimited.read_delimited``, from splits of the files. Lines end with a line feed, with or without a
    carriage return; a quote may only enclose a cell or stand, doubled, in a quoted one, else the files are refused.
    """
    if len(delimiter) != 1:
        raise ValueError("The delimiter must be one character.")
    found = materialize(records(spark, path))
    if not found.filter(~F.rlike("value", F.lit(_valid(delimiter)))).isEmpty():
        raise ValueError(STRAY)
    first = found.filter(~is_blank(F.translate("value", delimiter + '"', "  "))).orderBy(*_SPLIT, "_record").limit(1).collect()
    if not first:
        raise ValueError("The file is empty.")
    width = len(next(csv.reader([first[0]["value"]], delimiter=delimiter)))
    schema = ", ".join([*(f"c{i} string" for i in range(width)), "overflow string"])
    options = {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1", "mode": "PERMISSIVE"}
    cells = found.select(*_SPLIT, "_record", F.from_csv("value", F.lit(schema), options).alias("cells")).select(
        *_SPLIT, "_record", *(F.coalesce(F.col(f"cells.c{i}"), F.lit("")).alias(f"c{i}") for i in range(width)), "cells.overflow")
    rows = materialize(drop_blank(cells, width))
    earlier = Window.partitionBy(SOURCE).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy(*_SPLIT).agg(F.count("*").alias("_n")).select(*_SPLIT, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    number = F.row_number().over(Window.partitionBy(*_SPLIT).orderBy("_record")) + F.col("_shift")
    numbered = rows.join(shift, _SPLIT).withColumn(ROW, number.cast("bigint")).drop("_split", "_record", "_shift")
    data, names = without_header(materialize(numbered), width)
    return data.select(*(marked(F.col(role), role, names) for role in (SOURCE, ROW)), *(F.col(f"c{i}").alias(name) for i, name in enumerate(names)))
