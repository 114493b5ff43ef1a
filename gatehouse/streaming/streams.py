"""Streams: each micro-batch runs the batch operators and publishes under its stream and batch id.

The manifest notes the last batch that each stream applied to a table, so a retried micro-batch is not applied twice,
and streams that share a target do not take each other's batches for their own. A stream's id is its checkpoint
location's, which outlives restarts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import replace
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gatehouse.operators.cells import PROCESSING_ERROR
from gatehouse.operators.catalogue import DRAFT, TRANSITIONS
from gatehouse.operators.dedup import FULL, REJECT, UPDATE, choose_rows, duplicate_errors, in_batch_message, in_target_message, upsert
from gatehouse.operators.schema import ColumnSpec
from gatehouse.functions.working import SOURCE
from gatehouse.plans.ingest import ImportRun, ingest, row_keys
from gatehouse.session import materialize
from gatehouse.sources.delimited import number_rows
from gatehouse.sources.headed import bind_headers, raw_cells
from gatehouse.sources.keyed import append_new, compact, known_keys, upsert_keyed, write_keyed
from gatehouse.sources.store import AUDIT_FIELDS, Conflict, read_manifest, read_table, write_errors, write_runs, write_staging
from gatehouse.streaming.stateful import FIRST, LATE, REPEATED, first_within, lifecycle

_ATTEMPTS = 5
LATE_MESSAGE = "Record arrived behind the watermark."
#: Columns of a record that an update keeps.
IDENTITY = ("record_id", "created_at")


def _drain(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process what is available in micro-batches, then stop; a batch that another writer overtook is applied anew."""

    def again(batch: DataFrame, batch_id: int) -> None:
        for attempt in range(_ATTEMPTS):
            try:
                return apply(batch, batch_id)
            except Conflict:
                if attempt == _ATTEMPTS - 1:
                    raise

    return (
        stream.writeStream.foreachBatch(again)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_id(checkpoint: str) -> str:
    """A stable name for the stream that keeps its progress at ``checkpoint``."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def _applied(manifest: dict, stream: str, batch_id: int) -> bool:
    return manifest["marks"].get(stream, -1) >= batch_id


def ingest_stream(
    spark: SparkSession, landing: str, columns: Sequence[ColumnSpec], run: ImportRun, checkpoint: str, target: str,
    delimiter: str = ",", files_per_batch: int = 1000, at: Callable[[int], str] | None = None,
) -> StreamingQuery:
    """Import headed files as they land; each micro-batch is one run against the published table.

    Writes ``records``, ``staging``, ``errors`` and ``runs`` below ``target``, to be read with ``read_table``. Columns
    bind by each file's header; a refused file gives an error row. ``at`` gives a batch's time, else it is the run's.
    ``records`` is a keyed table: a batch appends its new rows or replaces the parts that its keys are in, and small
    parts are joined from time to time.
    """
    stream, path = stream_id(checkpoint), f"{target}/records"
    lines = (
        spark.readStream.schema(", ".join(f"{c} string" for c in raw_cells(columns)))
        .option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(landing)
        .select(F.col("_metadata.file_path").alias(SOURCE), F.col("_metadata.file_block_start").alias("_split"), *raw_cells(columns))
    )

    def apply(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        run_id = f"{run.import_id}-{batch_id}"
        published = read_manifest(session, path)
        if _applied(published, stream, batch_id):
            return
        rows, issues = bind_headers(number_rows(batch), columns)
        settings = replace(run, import_id=run_id, at=at(batch_id) if at else run.at)
        result = ingest(rows, read_table(session, path), columns, settings,
                        known=lambda keys: known_keys(keys, path, manifest=published))
        refused = issues.select(
            *(column.alias(name) for column, name in zip((F.col("file"), F.lit(None).cast("bigint")), row_keys(result.staged), strict=True)),
            F.lit(None).cast("string").alias("column_name"),
            F.lit(None).cast("string").alias("invalid_value"), F.lit(PROCESSING_ERROR).alias("error_type"),
            F.lit(None).cast("string").alias("validation_rule"), "description")
        write_staging(result.staged, f"{target}/staging", run_id)
        write_errors(result.errors.unionByName(refused), f"{target}/errors", run_id)
        write_runs(result.run, f"{target}/runs", run_id)
        mark = (stream, batch_id)
        if settings.mode == FULL:
            write_keyed(result.added, path, run_id, mark=mark, base=published["version"])
        elif settings.behaviour == UPDATE:
            upsert_keyed(result.added, path, run_id, identity=IDENTITY, mark=mark, manifest=published)
        else:
            append_new(result.added, path, run_id, mark=mark, manifest=published)
        compact(session, path)

    return _drain(lines, checkpoint, apply)


def first_wins_stream(
    stream: DataFrame, key: str, order: str, checkpoint: str, target: str, behaviour: str = REJECT
) -> StreamingQuery:
    """The first row of each key, by arrival and then by ``order``, which is unique; later rows become errors.

    Writes ``records`` and ``errors`` below ``target``. A micro-batch writes its own new rows only, and reads the
    published keys of the parts that may hold one of its own.
    """
    name, path = stream_id(checkpoint), f"{target}/records"

    def apply(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        published = read_manifest(session, path)
        if _applied(published, name, batch_id):
            return
        run_id = f"{name}-{batch_id}"
        rows = materialize(batch)
        first = materialize(choose_rows(rows, key, order))
        later = rows.join(first.select(order), order, "left_anti")
        known = materialize(known_keys(first, path, key, published))
        repeated = first.join(known, key, "left_semi")
        errors = duplicate_errors(later, in_batch_message(behaviour), [order]).unionByName(
            duplicate_errors(repeated, in_target_message(behaviour), [order]))
        write_errors(errors, f"{target}/errors", run_id)
        append_new(first.join(known, key, "left_anti"), path, run_id, key, (name, batch_id), published)
        compact(session, path, key)

    return _drain(stream, checkpoint, apply)


def upsert_stream(
    stream: DataFrame, key: str, order: str, checkpoint: str, target: str, identity: Sequence[str] = ()
) -> StreamingQuery:
    """Last row per key wins within a micro-batch, then replaces the published row of that key; parts that hold none of
    the batch's keys stay as they are."""
    name = stream_id(checkpoint)

    def apply(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        published = read_manifest(session, target)
        if _applied(published, name, batch_id):
            return
        newest = choose_rows(batch, key, order, last=True)
        upsert_keyed(newest, target, f"{name}-{batch_id}", key, identity, (name, batch_id), published)
        compact(session, target, key)

    return _drain(stream, checkpoint, apply)


def first_within_stream(
    stream: DataFrame, key: str, time: str, order: Sequence[str], delay_ms: int, checkpoint: str, target: str, behaviour: str = REJECT
) -> StreamingQuery:
    """The first row of each key within a watermark; see ``stateful.first_within``. What the stream remembers is bounded
    by the keys within ``delay_ms`` of event time, and no published row is read.

    Appends to ``records`` and, for repeated and late rows, to ``errors`` below ``target``, to be read with ``read_table``.
    """
    name = stream_id(checkpoint)

    def apply(batch: DataFrame, batch_id: int) -> None:
        run_id = f"{name}-{batch_id}"
        judged = materialize(batch)
        repeated, late = (judged.filter(F.col("verdict") == verdict) for verdict in (REPEATED, LATE))
        errors = duplicate_errors(repeated, in_batch_message(behaviour), list(order)).unionByName(
            duplicate_errors(late, LATE_MESSAGE, list(order)).withColumn("error_type", F.lit(PROCESSING_ERROR)))
        write_errors(errors, f"{target}/errors", run_id)
        write_staging(judged.filter(F.col("verdict") == FIRST).drop("verdict"), f"{target}/records", run_id)

    return _drain(first_within(stream, key, time, order, delay_ms), checkpoint, apply)


def lifecycle_stream(
    stream: DataFrame, key: str, order: Sequence[str], checkpoint: str, target: str, action: str = "action", states: DataFrame | None = None
) -> StreamingQuery:
    """Lifecycle state machine over a stream of requests, with the state of each dataset in the stream's own store.

    The outcomes of each micro-batch are added to ``outcomes`` and the statuses that it leaves to ``states``, both to be
    read with ``read_table``; of ``states``, a keyed table with the key as text, only parts that hold a changed one are
    written anew. ``states(key, status)`` gives the state before the stream's first request; others begin as Draft.
    Requests must arrive in order between micro-batches, not within one; those without a dataset are judged as one, whose
    status is not published.
    """
    name, path = stream_id(checkpoint), f"{target}/states"

    def apply(batch: DataFrame, batch_id: int) -> None:
        session, run_id = batch.sparkSession, f"{name}-{batch_id}"
        published = read_manifest(session, path)
        if _applied(published, name, batch_id):
            return
        judged = materialize(batch)
        write_staging(judged, f"{target}/outcomes", run_id)
        changed = judged.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias(key)).agg(F.max_by("state_after", F.struct(*order)).alias("status"))
        upsert_keyed(changed, path, run_id, key, mark=(name, batch_id), manifest=published)
        compact(session, path, key)

    return _drain(lifecycle(stream, key, order, action, TRANSITIONS, DRAFT, states), checkpoint, apply)


def audit_stream(events: DataFrame, checkpoint: str, path: str) -> StreamingQuery:
    """Append audit events as they arrive."""
    return (
        events.select(*AUDIT_FIELDS)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
