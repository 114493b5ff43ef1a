"""Catalogue history: versions, lifecycle, soft delete, codes, tags, configuration versions.

Every operator applies a table of requests to a table of state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gatehouse.functions.text import is_blank, normalize, trim_ws
from gatehouse.operators.dedup import choose_rows, upsert
from gatehouse.operators.filters import ACTIVE, ARCHIVED, DRAFT
from gatehouse.operators.joins import exists_filter, lookup_join
from gatehouse.operators.ordered import chunk, last_known, running_number
from gatehouse.session import materialize

# The metadata compared by an update (text fields are trimmed first).
TEXT_FIELDS = ("name", "description", "source_name", "source_type", "source_description")
REFERENCE_FIELDS = ("category_id", "owner_id")
MAX_TAGS, MAX_TAG_LENGTH = 25, 100

# The state a lifecycle request needs and the state it leads to.
TRANSITIONS = {
    "activate": (DRAFT, ACTIVE),
    "archive": (ACTIVE, ARCHIVED),
    "restore": (ARCHIVED, ACTIVE),
}


def normalized_tags(tags: Column) -> Column:
    """Trimmed, non-blank tags in comparison form, sorted; null counts as no tags."""
    kept = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: ~is_blank(t))
    return F.array_sort(F.transform(kept, normalize))


def content(fields: Sequence[str] | None = None, tags: str | None = "tags") -> Column:
    """Comparable metadata of a row; null texts equal empty ones."""
    names = list(TEXT_FIELDS + REFERENCE_FIELDS if fields is None else fields)
    parts = [
        F.coalesce(trim_ws(F.col(n)), F.lit("")).alias(n) if n in TEXT_FIELDS else F.col(n).alias(n) for n in names
    ]
    if tags:
        parts.append(normalized_tags(F.col(tags)).alias("tags"))
    return F.struct(*parts)


def detect_changes(current: DataFrame, requests: DataFrame, key: str = "dataset_id", **shape) -> DataFrame:
    """Requests with ``changed``: whether they differ from the stored metadata. Unknown keys are left out."""
    stored = current.select(F.col(key).alias("_key"), content(**shape).alias("_stored"))
    joined = lookup_join(
        requests.withColumn("_asked", content(**shape)), stored, {key: "_key"}, "inner"
    )
    return joined.withColumn("changed", ~F.col("_asked").eqNullSafe(F.col("_stored"))).select(
        *requests.columns, "changed"
    )


def version_edits(edits: DataFrame, key: str, order: Sequence[str], **shape) -> DataFrame:
    """A history of edits per key to version snapshots.

    The first edit registers version 1; an edit equal to the one before it makes no version; the newest version
    is current. Comparing neighbours is enough, since an edit without effect equals the state it meets.
    """
    keyed = chunk(edits.withColumn("_content", content(**shape)), [key], order)
    seen = last_known(keyed, [key], order, F.col("_content"), "_before", chunked=True)
    changed = seen.filter(~F.col("_content").eqNullSafe(F.col("_before"))).drop("_content", "_before")
    numbered = running_number(changed, [key], order, "version_number", chunked=True)
    newest = numbered.groupBy(key).agg(F.max("version_number").alias("_newest"))
    return (
        lookup_join(numbered, newest.withColumnRenamed(key, "_newest_key"), {key: "_newest_key"}, "inner")
        .withColumn("is_current", F.col("version_number") == F.col("_newest"))
        .select(*edits.columns, "version_number", "is_current")
    )


def snapshot_versions(versions: DataFrame, changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Add the changed edits of one batch to stored snapshots.

    A key's stored snapshots lose their current flag, its new ones continue its numbering, and the last is current.
    ``changes`` has the versions' columns except ``version_number`` and ``is_current``, plus ``order``.
    """
    numbered = running_number(changes, [key], order, "_step")
    base = versions.groupBy(F.col(key).alias("_key")).agg(F.max("version_number").alias("_base"))
    last = numbered.groupBy(F.col(key).alias("_last_key")).agg(F.max("_step").alias("_last"))
    added = lookup_join(lookup_join(numbered, base, {key: "_key"}, "left"), last, {key: "_last_key"}, "inner")
    added = added.withColumn(
        "version_number", (F.coalesce("_base", F.lit(0)) + F.col("_step")).cast("bigint")
    ).withColumn("is_current", F.col("_step") == F.col("_last"))
    touched = last.select("_last_key")
    kept = lookup_join(versions, touched, {key: "_last_key"}, "left").withColumn(
        "is_current", F.col("is_current") & F.col("_last_key").isNull()
    )
    return kept.select(*versions.columns).unionByName(added.select(*versions.columns))


def version_history(versions: DataFrame, key: str, value, order: str = "version_number") -> DataFrame:
    """One dataset's versions, newest first."""
    return versions.filter(F.col(key) == F.lit(value)).orderBy(F.col(order).desc())


def version_at(versions: DataFrame, requests: DataFrame, key: str = "dataset_id") -> DataFrame:
    """The exact versions asked for by ``(key, version_number)`` rows."""
    return versions.join(requests.select(key, "version_number").distinct(), [key, "version_number"], "left_semi")


def current_version_check(datasets: DataFrame, versions: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Every dataset with its number of current snapshots and a verdict."""
    current = F.col("is_current")
    facts = versions.groupBy(F.col(key).alias("_key")).agg(
        F.count("*").alias("_versions"),
        F.count_if(current).alias("_current"),
        F.max(F.when(current, F.col("version_number"))).alias("current_snapshot_version"),
    )
    joined = datasets.join(facts, F.col(key) == F.col("_key"), "left")
    return joined.select(
        key,
        "current_version",
        F.coalesce("_current", F.lit(0)).cast("bigint").alias("current_snapshot_count"),
        "current_snapshot_version",
        F.when(F.col("_versions").isNull(), "MISSING VERSION HISTORY")
        .when(F.col("_current") != 1, "INVALID CURRENT SNAPSHOT COUNT")
        .when(F.col("current_snapshot_version") != F.col("current_version"), "VERSION MISMATCH")
        .otherwise("OK")
        .alias("validation_status"),
    )


# Reasons of refused requests.
NOT_FOUND, NOT_DELETED = "Dataset was not found.", "Dataset is not soft deleted."
MUST_RESTORE = "An archived dataset must be restored before metadata can be updated."


def soft_delete_requests(datasets: DataFrame, requests: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Every delete or recover request, in order of ``happened_at`` within its dataset, with the ``reason`` for its
    refusal or null.

    Any request leaves its dataset as its action says, accepted or not, so the latest one before it tells the state.
    """
    order = ["happened_at", "user_id", "action"]
    flags = datasets.select(F.col(key).alias("_key"), F.col("is_deleted").alias("_deleted"))
    rows = lookup_join(requests, flags, {key: "_key"}, "left").select(
        *requests.columns, F.col("_key").isNotNull().alias("_found"), "_deleted")
    seen = last_known(rows, [key], order, F.col("action"), "_earlier")
    deleted = F.when(F.col("_earlier") == "delete", True).when(F.col("_earlier") == "recover", False).otherwise(F.col("_deleted"))
    reason = F.when(
        ~F.col("_found") | ((F.col("action") == "delete") & F.col("_state")), NOT_FOUND
    ).when((F.col("action") == "recover") & ~F.col("_state"), NOT_DELETED)
    return seen.withColumn("_state", deleted).withColumn("reason", reason).select(*requests.columns, "reason")


def apply_soft_delete(datasets: DataFrame, requests: DataFrame, key: str = "dataset_id") -> tuple[DataFrame, DataFrame]:
    """Delete or recover: ``requests(key, action, user_id, happened_at)``; returns (datasets, refused).

    Requests of one dataset count in order, and the last accepted one decides. Deleting a missing or deleted dataset,
    and recovering a missing or live one, is refused.
    """
    judged = materialize(soft_delete_requests(datasets, requests, key))
    last = judged.filter("reason IS NULL").groupBy(F.col(key).alias("_key")).agg(
        F.max(F.struct("happened_at", "user_id", "action")).alias("_last"))
    joined = datasets.join(last, datasets[key] == last["_key"], "left")
    accepted, deleting = F.col("_last").isNotNull(), F.col("_last.action") == "delete"
    new_values = {
        "is_deleted": F.when(accepted, deleting).otherwise(F.col("is_deleted")),
        "deleted_at": F.when(accepted, F.when(deleting, F.col("_last.happened_at"))).otherwise(F.col("deleted_at")),
        "deleted_by": F.when(accepted, F.when(deleting, F.col("_last.user_id"))).otherwise(F.col("deleted_by")),
        "updated_at": F.when(accepted, F.col("_last.happened_at")).otherwise(F.col("updated_at")),
    }
    state = joined.select(*(new_values.get(n, F.col(n)).alias(n) for n in datasets.columns))
    return state, judged.filter("reason IS NOT NULL").select(*requests.columns, "reason")


def lifecycle_requests(
    requests: DataFrame, key: str, order: Sequence[str], action: str = "action", states: DataFrame | None = None
) -> DataFrame:
    """Every request in order with the state it met, whether it was accepted, and the state after it.

    ``states(key, status)`` gives the state before the first request; keys not in it start as Draft. Once a dataset
    has left Draft its state is fixed by the latest archive or restore request alone, accepted or not, so the
    ordered fold needs only the latest such request and whether an activate came before.
    """
    kind = F.col(action)
    rows = requests.withColumn("_initial", F.lit(DRAFT))
    if states is not None:
        stored = states.select(F.col(key).alias("_key"), F.col("status").alias("_status"))
        rows = lookup_join(requests, stored, {key: "_key"}, "left").select(
            *requests.columns, F.coalesce("_status", F.lit(DRAFT)).alias("_initial")
        )
    parts = chunk(rows, [key], order)
    parts = last_known(parts, [key], order, F.when(kind == "activate", kind), "_activated", chunked=True)
    started = (F.col("_initial") != DRAFT) | F.col("_activated").isNotNull()
    # archive and restore requests count from the first activate on
    counted = F.when(kind.isin("archive", "restore") & started, kind)
    parts = last_known(parts, [key], order, counted, "_latest", chunked=True)
    before = (
        F.when(~started, DRAFT)
        .when(F.col("_latest") == "archive", ARCHIVED)
        .when(F.col("_latest") == "restore", ACTIVE)
        .when(F.col("_initial") == DRAFT, ACTIVE)
        .otherwise(F.col("_initial"))
    )
    accepted, after = F.lit(False), F.col("state_before")
    for name, (needed, target) in TRANSITIONS.items():
        met = (kind == name) & (F.col("state_before") == needed)
        accepted, after = accepted | met, F.when(met, target).otherwise(after)
    return (
        parts.withColumn("state_before", before)
        .withColumn("accepted", F.coalesce(accepted, F.lit(False)))
        .withColumn("state_after", after)
        .select(*requests.columns, "state_before", "accepted", "state_after")
    )


def lifecycle_apply(
    requests: DataFrame, key: str, order: Sequence[str], action: str = "action", states: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Final state per requested key, and the refused requests."""
    judged = lifecycle_requests(requests, key, order, action, states)
    final = judged.groupBy(key).agg(F.max_by("state_after", F.struct(*order)).alias("status"))
    return final, judged.filter("NOT accepted")


def lifecycle_checked(
    requests: DataFrame, catalogue: DataFrame, key: str, order: Sequence[str], action: str = "action"
) -> DataFrame:
    """Lifecycle requests judged against the catalogue ``(key, status, is_deleted)``, with a ``reason`` when refused.

    Requests for unknown and for soft deleted datasets meet no state and leave none.
    """
    live = catalogue.filter("NOT is_deleted").select(key, "status")
    marked = materialize(lookup_join(requests, live.select(F.col(key).alias("_live")), {key: "_live"}, "left"))
    known = marked.filter("_live IS NOT NULL").drop("_live")
    unknown = marked.filter("_live IS NULL").drop("_live")
    judged = lifecycle_requests(known, key, order, action, live)
    reason = F.lit(None).cast("string")
    for name, (needed, target) in TRANSITIONS.items():
        text = f"Invalid status transition. Dataset must be {needed} before changing to {target}."
        reason = F.when((F.col(action) == name) & ~F.col("accepted"), text).otherwise(reason)
    nothing = F.lit(None).cast("string")
    refused = unknown.select(
        *requests.columns, nothing.alias("state_before"), F.lit(False).alias("accepted"), nothing.alias("state_after"),
        F.lit(NOT_FOUND).alias("reason"))
    return judged.withColumn("reason", reason).unionByName(refused)


def config_versions(saves: DataFrame, key: str, order: Sequence[str], stored: DataFrame | None = None) -> DataFrame:
    """Number saved configurations per dataset; only the newest is active.

    With ``stored`` versions, which have the result's columns, the saves continue each dataset's numbers and take over
    its active flag; the stored rows are part of the result.
    """
    if stored is not None:
        names = {"version": "version_number", "is_active": "is_current"}
        versions = snapshot_versions(stored.withColumnsRenamed(names), saves, key, order)
        return versions.withColumnsRenamed({new: old for old, new in names.items()})
    numbered = running_number(saves, [key], order, "version")
    newest = numbered.groupBy(F.col(key).alias("_newest_key")).agg(F.max("version").alias("_newest"))
    return lookup_join(numbered, newest, {key: "_newest_key"}, "inner").select(
        *saves.columns, "version", (F.col("version") == F.col("_newest")).alias("is_active")
    )


def pin_config(
    runs: DataFrame, configs: DataFrame, key: str, run_time: str, config_time: str, run_id: str, config_id: str
) -> DataFrame:
    """As-of join: each run with the newest configuration of its dataset saved no later than the run (or null)."""
    # At equal times a configuration sorts before a run, so that the run sees it.
    saved = configs.select(
        F.col(key).alias("_key"), F.col(config_time).alias("_at"), F.lit(0).alias("_kind"),
        F.col(config_id).alias("_id"), F.lit(None).cast(runs.schema[run_id].dataType).alias(run_id),
    )
    asked = runs.select(
        F.col(key).alias("_key"), F.col(run_time).alias("_at"), F.lit(1).alias("_kind"),
        F.lit(None).cast(configs.schema[config_id].dataType).alias("_id"), F.col(run_id),
    )
    line = saved.unionByName(asked)
    filled = last_known(line, ["_key"], ["_at", "_kind", "_id", run_id], F.col("_id"), "pinned_config")
    return filled.filter("_kind = 1").select(
        F.col("_key").alias(key), F.col(run_id), F.col("_at").alias(run_time), "pinned_config"
    )


def unused_configs(configs: DataFrame, runs: DataFrame, config_id: str, used: str) -> DataFrame:
    """Configurations no run has used: the only ones that may be deleted."""
    return exists_filter(
        configs, runs.filter(F.col(used).isNotNull()), {config_id: used}, negate=True
    )


def allocate_codes(datasets: DataFrame, order: Sequence[str], code: str = "code") -> DataFrame:
    """Give rows with a blank code the next ``DS-`` number in order, continuing after the highest in use."""
    number = F.regexp_extract(F.col(code), r"(?i)^DS-([0-9]+)$", 1).try_cast("bigint")
    highest = datasets.agg(F.coalesce(F.max(number), F.lit(0))).first()[0]
    blank = is_blank(F.col(code))
    numbered = running_number(datasets.filter(blank), [], order, "_position")
    digits = (F.col("_position") + highest).cast("string")
    text = F.concat(F.lit("DS-"), F.when(F.length(digits) >= 6, digits).otherwise(F.lpad(digits, 6, "0")))
    return datasets.filter(~blank).unionByName(numbered.withColumn(code, text).select(*datasets.columns))


def tag_issues(requests: DataFrame) -> DataFrame:
    """Requests ``(dataset_id, workspace_id, tags)`` whose tag list is refused, with the reason."""
    return _with_tag_reason(requests).filter("reason IS NOT NULL")


def _with_tag_reason(requests: DataFrame) -> DataFrame:
    kept = F.filter(F.transform("tags", trim_ws), lambda t: F.coalesce(t, F.lit("")) != "")
    reason = (
        F.when(F.exists(kept, lambda t: F.length(t) > MAX_TAG_LENGTH), "Each tag must be 100 characters or fewer.")
        .when(F.size(kept) > MAX_TAGS, "A dataset can have a maximum of 25 tags.")
        .when(
            F.size(F.array_distinct(F.transform(kept, normalize))) < F.size(kept), "Duplicate tags are not allowed."
        )
    )
    return requests.withColumn("reason", reason)


def sync_tags(
    tags: DataFrame, bridge: DataFrame, requests: DataFrame, order: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replace tag lists: ``(tags, bridge, refused)``.

    ``tags(tag_id, workspace_id, name, normalized_name)``, ``bridge(dataset_id, tag_id)`` and ``requests(dataset_id,
    workspace_id, tags)``. Unknown tags are created per workspace with an id hashed from workspace and normalized name.
    With ``order``, a column of the requests' time, all are judged, and the last accepted one of a dataset counts;
    without it, the last one by its list is the only one that is judged, so that reruns agree.
    """
    # The judged requests feed four outputs and are kept once.
    if order is None:
        judged = materialize(_with_tag_reason(choose_rows(requests, "dataset_id", "tags", last=True)))
        accepted = judged.filter("reason IS NULL").drop("reason")
    else:
        judged = materialize(_with_tag_reason(requests))
        ranked = judged.filter("reason IS NULL").withColumn("_order", F.struct(order, "tags"))
        accepted = materialize(choose_rows(ranked, "dataset_id", "_order", last=True).drop("reason", "_order"))
    refused = judged.filter("reason IS NOT NULL")
    asked = (
        accepted.select("dataset_id", "workspace_id", F.posexplode("tags").alias("_at", "_raw"))
        .withColumn("name", trim_ws(F.col("_raw")))
        .filter(~is_blank(F.col("name")))
        .withColumn("normalized_name", F.upper("name"))
    )
    wanted = asked.groupBy("workspace_id", "normalized_name").agg(
        F.min_by("name", F.struct("dataset_id", "_at")).alias("name")
    )
    fresh = wanted.join(tags, ["workspace_id", "normalized_name"], "left_anti").select(
        F.sha2(F.concat_ws("\x1f", F.col("workspace_id").cast("string"), "normalized_name"), 256).alias("tag_id"),
        "workspace_id", "name", "normalized_name",
    )
    all_tags = tags.select(fresh.columns).unionByName(fresh)
    ids = all_tags.select(
        F.col("workspace_id").alias("_ws"), F.col("normalized_name").alias("_norm"), F.col("tag_id")
    )
    mapped = lookup_join(asked, ids, {"workspace_id": "_ws", "normalized_name": "_norm"}, "inner")
    untouched = exists_filter(bridge, accepted.select(F.col("dataset_id").alias("_touched")),
                              {"dataset_id": "_touched"}, negate=True)
    return all_tags, untouched.unionByName(mapped.select("dataset_id", "tag_id")), refused


def upsert_reference(target: DataFrame, source: DataFrame, key: str, update: Sequence[str]) -> DataFrame:
    """Reference merge: matched rows take the listed columns, new rows are inserted, the rest is untouched."""
    fixed = tuple(name for name in target.columns if name not in update and name != key)
    return upsert(target, source.select(*target.columns), key, identity=fixed)


def sync_to_required(
    existing: DataFrame, required: DataFrame, keys: Sequence[str], in_scope: Column
) -> DataFrame:
    """Make the mappings in scope equal to the required set; mappings out of scope stay."""
    wanted = required.select(*keys).distinct()
    kept = existing.filter(~F.coalesce(in_scope, F.lit(False))).unionByName(
        existing.filter(in_scope).join(wanted, list(keys), "left_semi")
    )
    added = wanted.join(existing, list(keys), "left_anti")
    return kept.select(*keys).unionByName(added)


def tag_lists(bridge_with_names: DataFrame, key: str, name: str) -> DataFrame:
    """Sorted distinct tag names per dataset, as an array (at most MAX_TAGS by the tag rules)."""
    return bridge_with_names.groupBy(key).agg(F.array_sort(F.collect_set(name)).alias("tags"))
