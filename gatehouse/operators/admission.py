"""Requests of one batch that compete with each other: starts of runs, and names.

Taken one at a time, each request would be judged by what the earlier ones left behind. Here the whole batch is judged
at once: chains of runs by pointer doubling, names by rounds that each judge all requests by the last round's outcome.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gatehouse.functions.text import is_blank, normalize
from gatehouse.operators.catalogue import MUST_RESTORE, NOT_FOUND
from gatehouse.operators.filters import ARCHIVED
from gatehouse.operators.joins import lookup_join
from gatehouse.operators.ordered import last_known, running_number, running_sum
from gatehouse.operators.quality import ACTIVE_RUNS
from gatehouse.session import materialize, release, settle

# The state a run is started from, and the reasons of a refusal.
CREATED = "Created"
RUN_NOT_FOUND = "Import not found or not accessible."
ANOTHER_ACTIVE = "Another import is already queued or processing for this dataset."
NAME_REQUIRED = "Dataset name is required."
NAME_TAKEN = "Dataset name must be unique within the workspace."
CATEGORY_REQUIRED = "An active dataset category is required."
OWNER_REQUIRED = "Dataset owner must be an active user in the same workspace."
_STARTED = "Queued"


def _not_startable(status) -> F.Column:
    return F.concat(F.lit("Import cannot be started from status '"), status, F.lit("'."))


def _reached(starts: DataFrame, jumps: DataFrame, key: str) -> DataFrame:
    """Positions (key, pos) that the pointers ``jumps(key, pos, next)`` reach from ``starts``, in a logarithm of rounds:
    what is reached jumps on by pointers that are twice as long each time."""
    reached = materialize(starts)
    while True:
        further = materialize(reached.join(jumps, [key, "pos"]).select(key, F.col("next").alias("pos")))
        if not further.limit(1).count():
            return reached
        reached = reached.unionByName(further)
        second = jumps.select(key, F.col("pos").alias("next"), F.col("next").alias("_after"))
        longer = materialize(jumps.join(second, [key, "next"]).select(key, "pos", F.col("_after").alias("next")))
        release(jumps)
        jumps = longer


def _chosen(asked: DataFrame, busy: DataFrame, key: str) -> DataFrame:
    """Of ``asked(key, request_id, asked_at, ends_at)``, the request_ids that start when each runs until its ``ends_at``,
    or for ever, and none starts while one runs; ``busy(key, until)`` tells until when a key is taken at first."""
    numbered = settle(lambda: running_number(asked, [key], ["asked_at", "request_id"], "pos"))
    # A pointer leads to the first request at or after a moment: the one behind the last request before the moment.
    ends = numbered.filter("ends_at IS NOT NULL").select(key, F.col("ends_at").alias("moment"), F.lit(0).alias("kind"), "pos")
    begins = busy.filter("until IS NOT NULL").select(key, F.col("until").alias("moment"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("pos"))
    points = numbered.select(key, F.col("asked_at").alias("moment"), F.lit(1).alias("kind"), "pos").unionByName(ends).unionByName(begins)
    pointers = settle(lambda: last_known(points, [key], ["moment", "kind", "pos"], F.when(F.col("kind") == 1, F.col("pos")), "_seen").filter(
        "kind = 0").select(key, "pos", F.greatest(F.coalesce("_seen", F.lit(0)), "pos").alias("_seen")))
    there = numbered.select(key, "pos")
    jumps = materialize(pointers.filter("pos > 0").select(key, "pos", (F.col("_seen") + 1).alias("next")).join(
        there.withColumnRenamed("pos", "next"), [key, "next"], "left_semi"))
    free = there.filter("pos = 1").join(busy, key, "left_anti")
    first = free.unionByName(pointers.filter("pos = 0").select(key, (F.col("_seen") + 1).alias("pos")).join(there, [key, "pos"], "left_semi"))
    return numbered.join(_reached(first, jumps, key), [key, "pos"], "left_semi").select("request_id")


def admit_starts(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Start requests ``(request_id, import_id, asked_at, ends_at)`` with ``accepted`` and, if refused, ``reason``.

    ``runs(import_id, dataset_id, status, ends_at)`` is the state before the batch. A run starts from the status Created,
    and only while no other run of its dataset is queued or processing: neither one of ``runs`` nor one that an earlier
    request started. A started run ends at the request's ``ends_at``, or not within the batch if that is null.
    """
    known = runs.select(F.col("import_id").alias("_import"), "dataset_id", "status")
    asked = materialize(lookup_join(requests, known, {"import_id": "_import"}).select(
        *requests.columns, F.col("_import").isNotNull().alias("_found"), "dataset_id", "status"))
    busy = materialize(runs.filter(F.col("status").isin(list(ACTIVE_RUNS))).groupBy("dataset_id").agg(
        F.when(F.count("*") == F.count("ends_at"), F.max("ends_at")).alias("until")))
    open_ = materialize(asked.filter(F.col("status") == CREATED).select("dataset_id", "request_id", "import_id", "asked_at", "ends_at"))
    settled = []
    while True:
        left = open_
        starts = settle(lambda: left.join(_chosen(left.drop("import_id"), busy, "dataset_id"), "request_id", "left_semi"))
        # An import starts once. Up to a dataset's first second start the choice is right, so later requests for what was
        # started up to there are out of the question, and the rest of such a dataset's requests is chosen from again.
        first = starts.groupBy("dataset_id", "import_id").agg(F.min(F.struct("asked_at", "request_id")).alias("first"))
        again = starts.join(first, ["dataset_id", "import_id"]).filter(F.struct("asked_at", "request_id") > F.col("first"))
        wrong = materialize(again.groupBy("dataset_id").agg(F.min(F.struct("asked_at", "request_id")).alias("wrong")))
        if not wrong.limit(1).count():
            settled.append(starts)
            break
        settled.append(materialize(starts.join(wrong, "dataset_id", "left_anti")))
        sure = first.join(wrong, "dataset_id").filter("first < wrong").select("import_id", "first")
        open_ = materialize(left.join(wrong, "dataset_id", "left_semi").join(sure, "import_id", "left").filter(
            F.col("first").isNull() | (F.struct("asked_at", "request_id") <= F.col("first"))).drop("first"))
        release(left, starts, wrong)
    starts = reduce(DataFrame.unionByName, settled)
    started = starts.select(F.col("import_id").alias("_started"), F.col("asked_at").alias("_since"), F.col("request_id").alias("_by"))
    judged = asked.join(started, asked["import_id"] == started["_started"], "left")
    accepted = F.coalesce(F.col("_by") == F.col("request_id"), F.lit(False))
    earlier = F.struct("_since", "_by") < F.struct("asked_at", "request_id")
    reason = (
        F.when(accepted, F.lit(None)).when(~F.col("_found"), RUN_NOT_FOUND)
        .when(F.col("status") != CREATED, _not_startable(F.col("status")))
        .when(F.col("_by").isNotNull() & earlier, _not_startable(F.lit(_STARTED)))
        .otherwise(ANOTHER_ACTIVE))
    return judged.select(*requests.columns, accepted.alias("accepted"), reason.alias("reason"))


def _names_round(rows: DataFrame, ids: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``_other``, whether another holds the name that a request asks for, and ``_now``, whether the request
    takes it, if those of them that ``_takes`` says take theirs."""
    def states() -> DataFrame:
        own = last_known(rows, ["_holder"], list(order), F.when(F.col("_takes"), F.struct("workspace_id", "_name")), "_taken")
        before = F.coalesce("_taken", F.when(F.col("_initial").isNotNull(), F.struct(F.col("_home").alias("workspace_id"), F.col("_initial").alias("_name"))))
        return own.withColumn("_before", before).drop("_taken")

    state = settle(states)
    stays = F.col("_before").eqNullSafe(F.struct("workspace_id", "_name"))
    moves = F.col("_takes") & ~stays
    claims = state.select(*ids, "workspace_id", "_name", F.when(moves, 1).otherwise(0).alias("_change"), F.lit(True).alias("_asks"))
    frees = state.filter(moves & F.col("_before").isNotNull()).select(
        *ids, F.col("_before.workspace_id").alias("workspace_id"), F.col("_before._name").alias("_name"),
        F.lit(-1).alias("_change"), F.lit(False).alias("_asks"))
    counted = settle(lambda: running_sum(claims.unionByName(frees), ["workspace_id", "_name"], list(order), F.col("_change"), "_net").filter(
        "_asks").select(F.col("request_id").alias("_id"), "_net"))
    others = F.col("_holders") + F.col("_net") - F.when(stays, 1).otherwise(0)
    judged = state.join(counted, state["request_id"] == counted["_id"]).withColumn("_other", others > 0)
    able = F.col("_first").isNull() & F.col("_last").isNull()
    return judged.withColumn("_now", able & ~F.col("_other")).drop("_id", "_net", "_before")


def metadata_outcomes(
    requests: DataFrame, datasets: DataFrame, categories: DataFrame, users: DataFrame, order: Sequence[str]
) -> DataFrame:
    """Registrations and updates of metadata, judged in ``order``, which is unique: ``accepted`` and, if refused, ``reason``.

    ``requests(request_id, dataset_id, workspace_id, name, category_id, owner_id)``, the dataset_id being null for a
    registration. As :func:`gatehouse.operators.quality.metadata_issues`, but requests meet the names that earlier ones
    have taken and given up: a name belongs to the earlier of two requests, and a rename frees the old name.

    Whether a name is free depends on earlier requests only, so each round settles at least the next request of every
    chain of such dependencies, and the rounds end when none changes. The rounds are held among the requests that nothing
    else refuses, since only these take names; the others meet what they left, once.
    """
    stored = datasets.select(
        F.col("dataset_id").alias("_d"), F.col("is_deleted").alias("_gone"), (F.col("status") == ARCHIVED).alias("_archived"),
        F.col("workspace_id").alias("_home"), normalize(F.col("name")).alias("_initial"))
    active = categories.filter("is_active").select(F.col("category_id").alias("_c"))
    owners = users.filter("is_active").select(F.col("user_id").alias("_u"), F.col("workspace_id").alias("_uw"))
    asked = requests.withColumn("_name", normalize(F.col("name"))).withColumn("_holder", F.when(
        F.col("dataset_id").isNull(), F.concat(F.lit("request "), F.col("request_id").cast("string"))).otherwise(F.col("dataset_id").cast("string")))
    joined = lookup_join(lookup_join(lookup_join(asked, stored, {"dataset_id": "_d"}), active, {"category_id": "_c"}), owners, {"owner_id": "_u"})
    update = F.col("dataset_id").isNotNull()
    first = F.when(update & (F.col("_d").isNull() | F.col("_gone")), NOT_FOUND).when(update & F.col("_archived"), MUST_RESTORE).when(
        F.col("name").isNull() | is_blank(F.col("name")), NAME_REQUIRED)
    last = F.when(F.col("_c").isNull(), CATEGORY_REQUIRED).when(
        ~F.coalesce(F.col("_uw") == F.col("workspace_id"), F.lit(False)), OWNER_REQUIRED)
    held = datasets.filter("NOT is_deleted").groupBy(
        F.col("workspace_id").alias("_nw"), normalize(F.col("name")).alias("_nn")).agg(F.count("*").alias("_holders"))
    rows = materialize(lookup_join(joined.withColumn("_first", first).withColumn("_last", last), held, {"workspace_id": "_nw", "_name": "_nn"}).select(
        *requests.columns, "_name", "_holder", "_initial", "_home", "_first", "_last", F.coalesce("_holders", F.lit(0)).alias("_holders"),
        (F.col("_first").isNull() & F.col("_last").isNull()).alias("_takes")))
    ids = list(dict.fromkeys(["request_id", *order]))
    kept = materialize(rows.filter("_takes"))
    able = kept
    while True:
        taking = able
        found = settle(lambda: _names_round(taking, ids, order).drop("_other"))
        release(kept)
        kept, able = found, found.withColumn("_takes", F.col("_now")).drop("_now")
        if not found.filter("_now <> _takes").limit(1).count():
            break
    every = able.unionByName(rows.filter("NOT _takes"))
    judged = settle(lambda: _names_round(every, ids, order))
    release(kept, rows)
    reason = F.coalesce("_first", F.when(F.col("_other"), NAME_TAKEN), "_last")
    return judged.select(*requests.columns, F.col("_now").alias("accepted"), reason.alias("reason"))
