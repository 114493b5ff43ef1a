"""The whole import: stage, de-duplicate, merge, count."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from gatehouse.functions.hashing import key_hash
from gatehouse.functions.text import clean_name
from gatehouse.functions.typed import SPARK_TYPES
from gatehouse.functions.working import ROW, carried, data_columns, working_columns
from gatehouse.operators.cells import ERROR_FIELDS, PROCESSING_ERROR, error_rows, judge
from gatehouse.operators.config import FieldMapping
from gatehouse.operators.dedup import (
    APPEND, BEHAVIOURS, FULL, MODES, UPDATE, choose_rows, counters_of, duplicate_errors, in_batch_message, in_target_message, merge,
    observed_facts, run_counters,
)
from gatehouse.operators.schema import ColumnSpec, infer_types, validate_key_columns
from gatehouse.session import materialize, spread

RECORD_COLUMNS = ("record_id", "dataset_id", "workspace_id", "source_import_id", "key_hash", "created_at", "updated_at")


@dataclass(frozen=True)
class ImportRun:
    """Settings of one import."""

    import_id: str
    dataset_id: str
    workspace_id: str
    mode: str
    behaviour: str
    keys: tuple[str, ...] = ()
    mappings: tuple[FieldMapping, ...] = ()
    at: str = "1970-01-01 00:00:00"

    def __post_init__(self):
        if self.mode not in MODES or self.behaviour not in BEHAVIOURS:
            raise ValueError("Unsupported import mode or duplicate behaviour.")


@dataclass(frozen=True)
class ImportResult:
    """``records`` is the whole table after the run, ``added`` what the run itself puts into it: the rows to append, or
    under Update those to upsert."""

    columns: tuple[ColumnSpec, ...]
    staged: DataFrame | None
    records: DataFrame | None
    errors: DataFrame
    run: DataFrame
    added: DataFrame | None = None


def establish_schema(batch: DataFrame, keys: Sequence[str]) -> tuple[ColumnSpec, ...]:
    """Infer a first import's columns; the result has one row per column and is read on the driver."""
    problem = validate_key_columns(keys, data_columns(batch))
    if problem:
        raise ValueError(problem)
    folded = {clean_name(key).lower() for key in keys}
    rows = infer_types(batch).collect()
    return tuple(
        ColumnSpec(clean_name(r["name"]), r["data_type"], r["ordinal"], clean_name(r["name"]).lower() in folded)
        for r in sorted(rows, key=lambda r: r["ordinal"])
    )


def check_schema(batch: DataFrame, columns: Sequence[ColumnSpec], run: ImportRun) -> None:
    """A later import without mappings must carry exactly the known columns; given keys must be the known keys."""
    if not run.mappings:
        incoming = {clean_name(name).lower(): clean_name(name) for name in data_columns(batch)}
        expected = {c.name.lower(): c.name for c in columns}
        missing = [name for key, name in expected.items() if key not in incoming]
        extra = [name for key, name in incoming.items() if key not in expected]
        if missing or extra:
            raise ValueError(
                f"Schema mismatch. Missing: [{', '.join(missing)}]. Additional: [{', '.join(extra)}]."
            )
    else:
        unknown = {m.target.lower() for m in run.mappings} - {c.name.lower() for c in columns}
        if unknown:
            raise ValueError("Mapping does not match the dataset schema.")
    configured = {c.name.lower() for c in columns if c.is_key}
    if run.keys and {clean_name(key).lower() for key in run.keys} != configured:
        raise ValueError("Import key columns do not match the dataset's configured key columns.")


def _mappings(batch: DataFrame, columns: Sequence[ColumnSpec], run: ImportRun) -> list[FieldMapping]:
    """One mapping per column: the configured one, else the column of the same name when the batch has it."""
    present = {clean_name(name).lower() for name in data_columns(batch)}
    configured: dict[str, FieldMapping] = {}
    for mapping in run.mappings:
        configured.setdefault(mapping.target.lower(), mapping)
    chosen = []
    for c in columns:
        mapping = configured.get(c.name.lower())
        if mapping is not None:
            chosen.append(FieldMapping(mapping.source, c.name, mapping.required, mapping.default,
                                       mapping.transformations, mapping.validations))
        elif c.name.lower() in present:
            chosen.append(FieldMapping(c.name, c.name))
    return chosen


def stage(batch: DataFrame, columns: Sequence[ColumnSpec], run: ImportRun) -> DataFrame:
    """Staged rows: per column original text, processed text and typed value, plus key hash, errors and verdict."""
    ordered = sorted(columns, key=lambda c: c.ordinal)
    mappings = _mappings(batch, ordered, run)
    judged = judge(spread(batch), mappings, {c.name: c.data_type for c in ordered})
    present = {m.target: f"_c{i}" for i, m in enumerate(mappings)}

    def fields(name: str) -> dict:
        return {
            c.name: F.col(present[c.name])[name] if c.name in present
            else F.lit(None).cast(SPARK_TYPES[c.data_type] if name == "typed" else "string")
            for c in ordered
        }

    original, text, typed = fields("original"), fields("value"), fields("typed")
    keys = [c.name for c in ordered if c.is_key] or [c.name for c in ordered]
    return judged.select(
        *carried(judged, [c.name for c in ordered]),
        key_hash(text[name] for name in keys).alias("key_hash"),
        F.col("_valid").alias("is_valid"),
        F.col("_errors").alias("errors"),
        F.struct(*(value.alias(name) for name, value in original.items())).alias("original"),
        F.struct(*(value.alias(name) for name, value in text.items())).alias("text"),
        F.struct(*(value.alias(name) for name, value in typed.items())).alias("typed"),
    )


def row_keys(df: DataFrame) -> list[str]:
    """Columns that identify a row of the batch: its file (if read from files) and row number, in that order."""
    return working_columns(df)


def records_from(kept: DataFrame, run: ImportRun) -> DataFrame:
    """Target rows of kept staged rows; record ids are hashes, so a rerun gives the same ones."""
    moment = F.lit(run.at).cast("timestamp_ntz")
    identity = F.sha2(F.concat_ws("\x1f", F.lit(run.dataset_id), F.lit(run.import_id), "key_hash"), 256)
    return kept.select(
        *row_keys(kept),
        identity.alias("record_id"),
        F.lit(run.dataset_id).alias("dataset_id"),
        F.lit(run.workspace_id).alias("workspace_id"),
        F.lit(run.import_id).alias("source_import_id"),
        "key_hash",
        moment.alias("created_at"),
        moment.alias("updated_at"),
        "typed.*",
    )


def ingest(
    batch: DataFrame,
    target: DataFrame | None,
    columns: Sequence[ColumnSpec] | None,
    run: ImportRun,
    keep: Callable[[DataFrame], DataFrame] = materialize,
    known: Callable[[DataFrame], DataFrame] | None = None,
) -> ImportResult:
    """Run one import over a batch of text columns whose ``row_keys`` are unique.

    ``target`` and ``columns`` are None before the first import, which must be Full and fixes the schema. ``keep``
    makes the staged rows and the winners durable (a checkpoint by default): errors, counters and records all read them.
    ``known`` gives those of a frame's ``key_hash`` that the target has, where there is a shorter way than to read all of
    the target's keys.
    """
    if columns is None:
        if run.mode != FULL:
            raise ValueError("The first successful import must be a Full Import.")
        columns = establish_schema(batch, run.keys)
    else:
        check_schema(batch, columns, run)
    # What writes the rows counts them as well; another ``keep`` may be lazy, then they are counted by jobs of their own.
    counts = {what: Observation() for what in ("staged", "kept")} if keep is materialize else {}
    watched = lambda rows, what: rows.observe(counts[what], *observed_facts(what)) if counts else rows
    staged = keep(watched(stage(batch, columns, run), "staged"))
    keys = row_keys(staged)
    valid = staged.filter("is_valid").withColumn("_position", F.struct(*keys))
    against = target if run.mode == APPEND and run.behaviour != UPDATE else None
    winners = choose_rows(valid, "key_hash", "_position", last=run.behaviour == UPDATE)
    # Winners, and which of them the target has, are found once; records, errors and counters read the mark.
    if against is None:
        winners = winners.withColumn("_known", F.lit(False))
    else:
        stored = (against if known is None else known(winners.select("key_hash"))).select(F.col("key_hash").alias("_stored"))
        winners = winners.join(stored, F.col("key_hash") == F.col("_stored"), "left").withColumn(
            "_known", F.col("_stored").isNotNull()).drop("_stored")
    kept = keep(watched(winners, "kept"))
    new, existing = kept.filter("NOT _known"), kept.filter("_known")
    records = records_from(new, run)
    cell_errors = error_rows(staged, *keys)
    failures = [cell_errors]
    if run.behaviour != UPDATE:
        dropped = valid.join(kept.select("_position"), "_position", "left_anti")
        failures.append(duplicate_errors(dropped, in_batch_message(run.behaviour), keys))
    if run.mode == FULL or target is None:
        result = records.drop(*keys)
    elif run.behaviour == UPDATE:
        result, _ = merge(records, target, run.behaviour, row_keys=keys)
    else:
        result = target.unionByName(records.select(*(F.col(f"`{name}`") for name in target.columns)))
        failures.append(duplicate_errors(existing, in_target_message(run.behaviour), keys))
    errors = failures[0]
    for more in failures[1:]:
        errors = errors.unionByName(more)
    if counts:
        facts = counts["staged"].get | counts["kept"].get
        row_type = ", ".join(f"{name} bigint" for name in facts)
        counters = counters_of(batch.sparkSession.createDataFrame([tuple(facts.values())], row_type), run.behaviour)
    else:
        counters = run_counters(staged, kept, existing if against is not None else None, run.mode, run.behaviour)
    row = counters.select(
        F.lit(run.import_id).alias("import_id"), F.lit(run.dataset_id).alias("dataset_id"),
        F.lit(run.workspace_id).alias("workspace_id"), F.lit(run.mode).alias("import_mode"),
        F.lit(run.behaviour).alias("duplicate_behavior"), *counters.columns,
    )
    return ImportResult(tuple(columns), staged, result, errors, row, records.drop(*keys))


# How a run ends that publishes nothing.
FAILED, CANCELLED = "Failed", "Cancelled"
_MESSAGE_LENGTH = 4000


def ended_run(
    spark: SparkSession, target: DataFrame | None, columns: Sequence[ColumnSpec] | None, run: ImportRun, status: str, message: str
) -> ImportResult:
    """The outcome of a run that ended without a result: the target as it was, one error row and the run row."""
    errors = spark.createDataFrame(
        [(None, None, None, PROCESSING_ERROR, None, message[:_MESSAGE_LENGTH])],
        f"{ROW} bigint, " + ", ".join(f"{name} string" for name in ERROR_FIELDS))
    row = spark.createDataFrame(
        [(run.import_id, run.dataset_id, run.workspace_id, run.mode, run.behaviour, 0, 0, 0, 1, 0, status)],
        "import_id string, dataset_id string, workspace_id string, import_mode string, duplicate_behavior string, total bigint,"
        "success bigint, rejected bigint, errors bigint, superseded bigint, status string")
    return ImportResult(tuple(columns or ()), None, target, errors, row)


def try_ingest(
    batch: DataFrame,
    target: DataFrame | None,
    columns: Sequence[ColumnSpec] | None,
    run: ImportRun,
    keep: Callable[[DataFrame], DataFrame] = materialize,
    cancelled: Callable[[], bool] = lambda: False,
) -> ImportResult:
    """As :func:`ingest`, with a refusal, a failure or a cancellation as an outcome instead of an exception.

    ``cancelled`` is asked before the run and once its rows are staged; a cancelled run publishes nothing.
    """
    spark = batch.sparkSession
    try:
        result = None if cancelled() else ingest(batch, target, columns, run, keep)
    except (ValueError, PySparkException) as problem:
        return ended_run(spark, target, columns, run, FAILED, str(problem))
    if result is None or cancelled():
        return ended_run(spark, target, columns, run, CANCELLED, "The import was cancelled.")
    return result
