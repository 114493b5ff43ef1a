"""Rows kept in the shared scratch folder, and removal of marked rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gatehouse.functions.hashing import filter_bits
from gatehouse.session import scratch_path

_FOLDER: ContextVar[str | None] = ContextVar("scratch_folder", default=None)


@contextmanager
def scratch_tables(spark: SparkSession, label: str) -> Iterator[None]:
    """Tables that are ``stored`` meanwhile go into one folder, which is deleted at the end: what is to last longer must
    be stored outside, and nothing lazy may still read them."""
    path = scratch_path(spark, label)
    outer = _FOLDER.set(path)
    try:
        yield
    finally:
        _FOLDER.reset(outer)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored_at(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared scratch folder, inside the innermost ``scratch_tables``."""
    path, folder = scratch_path(spark, label), _FOLDER.get()
    return f"{folder}/{path.rsplit('/', 1)[-1]}" if folder else path


def stored(df: DataFrame, label: str, **options: str | int) -> DataFrame:
    """``df`` as a table in the shared scratch folder, written with ``options``: computed once, and its size known to the
    plans that read it."""
    path = stored_at(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


#: Words of 64 bits that a filter of marked rows has at most, 2 MB of bits, and rows to a word below that.
_WORDS, _ROWS_PER_WORD = 1 << 18, 6


def _row_hash(doc_id: Column, text_key: Column) -> Column:
    return F.xxhash64(doc_id, text_key)


def without(docs: DataFrame, find: Callable[[], DataFrame]) -> DataFrame:
    """``docs`` without the rows whose doc_id and ``xxhash64(text)`` are among those of ``find()`` (doc_id, text_key).

    Null ids match each other. The marks are written to the shared scratch folder first; what finding them stored is
    deleted. Their filter, whose size is bounded, is sent to every task, and a row that it rules out stays where it is,
    with its text; only rows that may be marked are compared with the marks. Of more marks than the filter has room for,
    it rules out fewer rows.
    """
    path = scratch_path(docs.sparkSession, "marked-rows")
    with scratch_tables(docs.sparkSession, "finding"):
        find().select(F.col("doc_id").alias("_marked_id"), F.col("text_key").alias("_marked_key")).distinct().write.parquet(path)
    marks = docs.sparkSession.read.parquet(path)
    words = F.lit(min(_WORDS, -(-marks.count() // _ROWS_PER_WORD) or 1))
    marked = _row_hash(F.col("_marked_id"), F.col("_marked_key"))
    filters = marks.groupBy(F.pmod(marked, words).alias("_word")).agg(F.bit_or(filter_bits(marked)).alias("_bits"))
    row_hash = _row_hash(docs["doc_id"].cast("bigint"), F.xxhash64(docs["text"]))
    placed = docs.alias("_row").join(F.broadcast(filters), F.pmod(row_hash, words) == filters["_word"], "left")
    possible = F.coalesce(filters["_bits"].bitwiseAND(filter_bits(row_hash)) == filter_bits(row_hash), F.lit(False))
    sure, unsure = (placed.filter(condition).select("_row.*") for condition in (~possible, possible))
    same = unsure["doc_id"].cast("bigint").eqNullSafe(marks["_marked_id"]) & (F.xxhash64(unsure["text"]) == marks["_marked_key"])
    return sure.unionAll(unsure.join(marks, same, "left_anti"))
