"""Delimited text files as string columns with file names and row numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gatehouse.functions.text import clean_name, is_blank
from gatehouse.functions.working import ROW, SOURCE, marked
from gatehouse.session import materialize

_BROADCAST_SPLITS = 100_000


def _scan(spark: SparkSession, path: str, width: int, delimiter: str, multi_line: bool) -> DataFrame:
    """Every record as ``width`` text cells; one extra cell is filled exactly where a record is wider."""
    schema = ", ".join([f"c{i} string" for i in range(width)] + ["overflow string"])
    return (
        spark.read.schema(schema)
        .option("sep", delimiter)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("maxCharsPerColumn", -1)
        .option("mode", "PERMISSIVE")
        .csv(path)
        .select(
            F.col("_metadata.file_path").alias(SOURCE),
            F.col("_metadata.file_block_start").alias("_split"),
            *(F.coalesce(F.col(f"c{i}"), F.lit("")).alias(f"c{i}") for i in range(width)),
            "overflow",
        )
    )


def drop_blank(rows: DataFrame, width: int) -> DataFrame:
    cells = [is_blank(F.col(f"c{i}")) for i in range(width)] + [is_blank(F.col("overflow"))]
    return rows.filter(~reduce(lambda a, b: a & b, cells))


def text_cells(spark: SparkSession, path: str, width: int, delimiter: str = ",", multi_line: bool = True) -> DataFrame:
    """Every record that is not blank, as ``width`` text cells and ``overflow``, which wider records have."""
    return drop_blank(_scan(spark, path, width, delimiter, multi_line), width)


def number_rows(rows: DataFrame) -> DataFrame:
    """1-based position of each row within its file, without gathering a file in one task.

    Spark's row ids are consecutive inside a split, so a row's number is its offset in the split plus the rows of
    the splits before it. Ids are checkpointed first: the offsets must be computed from the same ids.
    """
    fixed = materialize(rows.withColumn("_id", F.monotonically_increasing_id()))
    splits = fixed.groupBy(SOURCE, "_split").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy(SOURCE).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(
        splits.select(
            SOURCE, "_split", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
        )
    )
    small = starts.count() <= _BROADCAST_SPLITS
    joined = fixed.join(F.broadcast(starts) if small else starts, [SOURCE, "_split"])
    return joined.withColumn(ROW, F.col("_id") + F.col("_shift") + 1).drop("_id", "_shift", "_split")


def read_delimited(
    spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, multi_line: bool = True
) -> DataFrame:
    """All files below ``path`` as one table of text columns.

    Values are not trimmed, rows whose cells are all blank are dropped, short rows are padded with ''. With a
    header, every file must carry the same one and a row wider than it is refused; without one, columns are
    ``Column1..n`` for the widest row. ``multi_line=False`` lets Spark split large files.
    """
    if len(delimiter) != 1:
        raise ValueError("The delimiter must be one character.")
    first = spark.read.option("sep", delimiter).option("escape", '"').option("multiLine", multi_line).csv(path)
    width = max(1, len(first.columns))
    rows = drop_blank(_scan(spark, path, width, delimiter, multi_line), width)
    if not header:
        while not rows.filter("overflow IS NOT NULL").isEmpty():
            width *= 2
            rows = drop_blank(_scan(spark, path, width, delimiter, multi_line), width)
        filled = rows.agg(*(F.bool_or(F.col(f"c{i}") != "").alias(f"c{i}") for i in range(width))).first()
        if filled is None or not any(filled):
            raise ValueError("The file is empty.")
        width = max(width if width == len(first.columns) else 0, max(i for i in range(width) if filled[i]) + 1)
        names = [f"Column{i + 1}" for i in range(width)]
        numbered = number_rows(rows)
    else:
        numbered, names = without_header(number_rows(rows), width)
    cells = [F.col(f"c{i}").alias(name) for i, name in enumerate(names)]
    return numbered.select(*(marked(F.col(role), role, names) for role in (SOURCE, ROW)), *cells)


def without_header(numbered: DataFrame, width: int) -> tuple[DataFrame, list[str]]:
    """(data rows, names) of numbered rows of ``width`` cells whose files must share one header and be no wider."""
    head = F.when(F.col(ROW) == 1, F.struct(*(f"c{i}" for i in range(width))))
    wide = F.when(F.col("overflow").isNotNull(), F.col(ROW))
    found = numbered.agg(F.min(wide).alias("wide"), F.min(head).alias("least"), F.max(head).alias("most")).first()
    if found["wide"] is not None:
        raise ValueError(f"File contains missing or blank headers: row {found['wide']} is wider than the header.")
    if found["least"] is None:
        raise ValueError("The file is empty.")
    if found["least"] != found["most"]:
        raise ValueError("The files do not share one header.")
    return numbered.filter(F.col(ROW) > 1), resolve_headers(list(found["least"]))


def resolve_headers(cells: list[str]) -> list[str]:
    """Clean header names; blank and repeated names (ignoring case) are refused."""
    names = [clean_name(cell or "") for cell in cells]
    if not names:
        raise ValueError("File contains no headers.")
    if any(not name for name in names):
        raise ValueError("File contains missing or blank headers.")
    folded = [name.lower() for name in names]
    for name in names:
        if folded.count(name.lower()) > 1:
            raise ValueError(f"Duplicate column name '{name}' was found.")
    return names


def file_headers(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """``(file, headers)`` of every file below ``path``: the first non-blank line, split outside quotes."""
    lines = (
        spark.read.text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), "value")
        .filter(~is_blank(F.translate("value", delimiter, " ")))
        .withColumn("_id", F.monotonically_increasing_id())
    )
    first = lines.groupBy("file").agg(F.min_by("value", F.struct("_split", "_id")).alias("line"))
    quoted = rf'{_escape(delimiter)}(?=(?:[^"]*"[^"]*")*[^"]*\z)'
    cells = F.transform(
        F.split("line", quoted, -1),
        lambda c: F.replace(F.regexp_replace(c, r'\A"|"\z', ""), F.lit('""'), F.lit('"')),
    )
    return first.select("file", cells.alias("headers"))


def _escape(delimiter: str) -> str:
    return "\\" + delimiter if not delimiter.isalnum() and not delimiter.isspace() else delimiter
