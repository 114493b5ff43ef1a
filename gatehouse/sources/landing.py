"""Checks on a landing directory before anything is read."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from gatehouse.operators.quality import FILE_EXTENSIONS, MAX_FILE_BYTES

# Reasons to refuse a file.
EMPTY = "The uploaded file is empty."
TOO_LARGE = "Maximum file size is 25 MB."
UNSUPPORTED = "Only CSV and XLSX files are supported."


def gate(files: DataFrame) -> DataFrame:
    """``(path, length)`` rows with the first reason to refuse the file, or null."""
    name = F.substring_index("path", "/", -1)
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    reason = (
        F.when(F.col("length") <= 0, EMPTY)
        .when(F.col("length") > MAX_FILE_BYTES, TOO_LARGE)
        .when(~extension.isin(list(FILE_EXTENSIONS)), UNSUPPORTED)
    )
    return files.select("path", "length", reason.alias("reason"))


def file_gate(spark: SparkSession, directory: str) -> DataFrame:
    """Gate every file below a directory; only metadata is read.

    Spark's scan leaves out empty files, so those come from the file listing that the scan already holds.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    found = scan.select("path", "length")
    paths = [(re.sub(r"^(\w+):///", r"\1:/", unquote(url)),) for url in scan.inputFiles()]
    empty = spark.createDataFrame(paths, "path string").join(found, "path", "left_anti")
    return gate(found.unionByName(empty.withColumn("length", F.lit(0).cast("bigint"))))
