"""Key-hash de-duplication, merge into a target, and run counters.

A hot key may hold a large share of a batch, so no step gathers one key's rows: winners are picked with a
row-number filter that Spark limits per map task before the shuffle, losers come from an anti join on the unique
row number, and target lookups join on hashes that are unique on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gatehouse.operators.aggregates import side_by_side
from gatehouse.operators.cells import DUPLICATE_ERROR
from gatehouse.session import materialize

# What a run may do with a key it has already seen, and how it treats the target.
SKIP, UPDATE, REJECT = "Skip", "Update", "Reject"
BEHAVIOURS = (SKIP, UPDATE, REJECT)
FULL, APPEND = "Full", "Append"
MODES = (FULL, APPEND)
COMPLETED, COMPLETED_WITH_ERRORS = "Completed", "Completed With Errors"


def choose_rows(df: DataFrame, key: str = "key_hash", order: str = "_row_number", last: bool = False) -> DataFrame:
    """The first (or last) row of each key."""
    ordering = F.col(order).desc() if last else F.col(order).asc()
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(ordering)))
    return ranked.filter("_rank = 1").drop("_rank")


def dedup(
    valid: DataFrame, behaviour: str, key: str = "key_hash", order: str = "_row_number"
) -> tuple[DataFrame, DataFrame]:
    """Valid rows to ``(kept, dropped)``: first wins for Skip and Reject, last wins for Update.

    ``order`` must be unique within the batch. Dropped rows are rejections under Skip and Reject and are merely
    superseded under Update.
    """
    kept = choose_rows(valid, key, order, last=behaviour == UPDATE)
    dropped = valid.join(kept.select(order), order, "left_anti")
    return kept, dropped


def duplicate_errors(rows: DataFrame, text: str, keys: Sequence[str] = ("_row_number",)) -> DataFrame:
    """Error rows for rejected duplicates, with the rows' ``keys``."""
    return rows.select(
        *keys,
        F.lit(None).cast("string").alias("column_name"),
        F.lit(None).cast("string").alias("invalid_value"),
        F.lit(DUPLICATE_ERROR).alias("error_type"),
        F.lit(None).cast("string").alias("validation_rule"),
        F.lit(text).alias("description"),
    )


def in_batch_message(behaviour: str) -> str:
    return f"Duplicate record detected. Behavior: {behaviour}."


def in_target_message(behaviour: str) -> str:
    return f"Duplicate record already exists in the dataset. Behavior: {behaviour}."


def split_against_target(kept: DataFrame, target: DataFrame, key: str = "key_hash") -> tuple[DataFrame, DataFrame]:
    """Kept rows to ``(new, existing)`` by key hash; the target is read once, for the marks that both are taken from."""
    known = target.select(F.col(key).alias("_stored"))
    marked = materialize(kept.join(known, kept[key] == known["_stored"], "left"))
    return marked.filter("_stored IS NULL").drop("_stored"), marked.filter("_stored IS NOT NULL").drop("_stored")


def upsert(target: DataFrame, batch: DataFrame, key: str = "key_hash", identity: Sequence[str] = ()) -> DataFrame:
    """Matched rows keep ``identity`` columns and take every other column from the batch; the rest is inserted.

    Both sides must be unique by key and share columns; one full outer join on the key does all three cases.
    """
    old, new = target.alias("t"), batch.alias("b")
    matched = F.col(f"b.{key}").isNotNull()

    def pick(name: str) -> Column:
        if name == key or name in identity:
            return F.coalesce(F.col(f"t.{name}"), F.col(f"b.{name}")).alias(name)
        return F.when(matched, F.col(f"b.{name}")).otherwise(F.col(f"t.{name}")).alias(name)

    return old.join(new, F.col(f"t.{key}") == F.col(f"b.{key}"), "full_outer").select(*map(pick, target.columns))


def merge(
    batch: DataFrame,
    target: DataFrame,
    behaviour: str,
    key: str = "key_hash",
    row_keys: Sequence[str] = ("_row_number",),
    identity: Sequence[str] = ("record_id", "created_at"),
) -> tuple[DataFrame, DataFrame]:
    """Append a de-duplicated batch: ``(new_target, errors)``.

    ``batch`` has the target's columns plus ``row_keys``. Update replaces matched rows; Skip and Reject report them.
    """
    rows = batch.select(*target.columns)
    if behaviour == UPDATE:
        return upsert(target, rows, key, identity), duplicate_errors(batch.limit(0), "", row_keys)
    new, existing = split_against_target(batch, target, key)
    return (
        target.unionByName(new.select(*target.columns)),
        duplicate_errors(existing, in_target_message(behaviour), row_keys),
    )


def completion_status(errors: Column, rejected: Column) -> Column:
    return F.when((errors > 0) | (rejected > 0), COMPLETED_WITH_ERRORS).otherwise(COMPLETED)


def run_counters(
    staged: DataFrame, kept: DataFrame, existing: DataFrame | None, mode: str, behaviour: str
) -> DataFrame:
    """One row: total, success, rejected, errors, superseded and final status.

    Losers are counted by subtraction, so counting needs no join beyond the target lookup.
    """
    base = staged.agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("bigint").alias("cell_errors"),
    )
    winners = kept.agg(F.count("*").alias("kept"))
    known = (
        existing.agg(F.count("*").alias("existing"))
        if existing is not None and mode == APPEND and behaviour != UPDATE
        else None
    )
    facts = side_by_side([base, winners] if known is None else [base, winners, known])
    if known is None:
        facts = facts.withColumn("existing", F.lit(0).cast("bigint"))
    return counters_of(facts, behaviour)


def observed_facts(what: str) -> list[Column]:
    """Counts of the ``staged`` rows, or of the ``kept`` ones with their mark ``_known``, to be observed while they are
    written."""
    if what == "staged":
        return [F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_valid")).alias("invalid"),
                F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("bigint").alias("cell_errors")]
    return [F.count(F.lit(1)).alias("kept"), F.count_if(F.col("_known")).alias("existing")]


def counters_of(facts: DataFrame, behaviour: str) -> DataFrame:
    """The run's counters from one row of total, invalid, cell_errors, kept and existing."""
    losers = F.col("total") - F.col("invalid") - F.col("kept")
    if behaviour == UPDATE:
        rejected, errors, superseded = F.col("invalid"), F.col("cell_errors"), losers
    else:
        repeated = losers + F.col("existing")
        rejected, errors, superseded = F.col("invalid") + repeated, F.col("cell_errors") + repeated, F.lit(0)
    counted = facts.select(
        "total",
        (F.col("kept") - F.col("existing")).alias("success"),
        rejected.cast("bigint").alias("rejected"),
        errors.cast("bigint").alias("errors"),
        superseded.cast("bigint").alias("superseded"),
    )
    return counted.withColumn("status", completion_status(F.col("errors"), F.col("rejected")))
