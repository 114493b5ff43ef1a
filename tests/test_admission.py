"""Competing requests against the same requests taken one at a time."""

import datetime
import random

import pytest

from gatehouse.operators import admission

DAY = datetime.datetime(2024, 1, 1)


def at(hours):
    return None if hours is None else DAY + datetime.timedelta(hours=hours)


def one_by_one(requests, runs):
    """request_id -> reason, None if accepted."""
    known = {import_id: (dataset, status) for import_id, dataset, status, _ in runs}
    busy, started, out = {}, set(), {}
    for _, dataset, status, ends in runs:
        if status in ("Queued", "Processing"):
            busy[dataset] = max(busy.get(dataset, 0), 10**9 if ends is None else ends)
    for request, import_id, asked, ends in sorted(requests, key=lambda r: (r[2], r[0])):
        dataset, status = known.get(import_id, (None, None))
        if status is None:
            out[request] = admission.RUN_NOT_FOUND
        elif status != "Created" or import_id in started:
            out[request] = f"Import cannot be started from status '{'Queued' if import_id in started else status}'."
        elif asked < busy.get(dataset, -1):
            out[request] = admission.ANOTHER_ACTIVE
        else:
            out[request] = None
            started.add(import_id)
            busy[dataset] = 10**9 if ends is None else ends
    return out


@pytest.mark.parametrize("seed", range(3))
def test_starts(spark, seed):
    rng = random.Random(seed)
    runs = [(i, i % 4, rng.choice(["Created"] * 8 + ["Processing", "Failed"]), rng.choice([None, 3, 30])) for i in range(40)]
    requests = [(n, rng.randrange(44), asked := rng.randrange(120), rng.choice([None] + [asked + k for k in (0, 0, 1, 5, 20)] * 3)) for n in range(250)]
    found = admission.admit_starts(
        spark.createDataFrame([(r, i, at(a), at(e)) for r, i, a, e in requests],
                              "request_id long, import_id long, asked_at timestamp_ntz, ends_at timestamp_ntz"),
        spark.createDataFrame([(i, d, s, at(e)) for i, d, s, e in runs], "import_id long, dataset_id long, status string, ends_at timestamp_ntz"))
    rows = found.collect()
    assert {r["request_id"]: r["reason"] for r in rows} == one_by_one(requests, runs)
    assert all(r["accepted"] == (r["reason"] is None) for r in rows)


def names_one_by_one(requests, datasets):
    holders, out = {}, {}
    for dataset, workspace, name, status, deleted in datasets:
        if not deleted:
            holders[str(dataset)] = (workspace, name.strip().upper())
    stored = {d: (status, deleted) for d, _, _, status, deleted in datasets}
    for request, dataset, workspace, name, category, owner in sorted(requests):
        holder = f"request {request}" if dataset is None else str(dataset)
        folded = (workspace, (name or "").strip().upper())
        status, deleted = stored.get(dataset, (None, True))
        if dataset is not None and deleted:
            reason = "Dataset was not found."
        elif dataset is not None and status == "Archived":
            reason = "An archived dataset must be restored before metadata can be updated."
        elif not folded[1]:
            reason = admission.NAME_REQUIRED
        elif any(other != holder and held == folded for other, held in holders.items()):
            reason = admission.NAME_TAKEN
        elif category != 1:
            reason = admission.CATEGORY_REQUIRED
        elif owner != workspace:
            reason = admission.OWNER_REQUIRED
        else:
            reason, holders[holder] = None, folded
        out[request] = reason
    return out


@pytest.mark.parametrize("seed", range(2))
def test_names(spark, seed):
    rng = random.Random(seed)
    name = lambda: rng.choice(["a", "A ", "b", " B", "c", "d", "", "e"])
    used, datasets = set(), []
    for i in range(12):
        own = (i % 2, f"{'abcde'[i % 5]}{'' if i < 6 else i}")
        if own not in used:
            used.add(own)
            datasets.append((i, *own, rng.choice(["Active", "Active", "Archived"]), rng.random() < 0.2))
    requests = [(n, rng.choice([None, *range(13)]), rng.randrange(2), name(), rng.choice([1, 1, 1, 2]), rng.choice([0, 1])) for n in range(120)]
    requests = [(n, d, d % 2 if d is not None else w, text, c, o) for n, d, w, text, c, o in requests]
    found = admission.metadata_outcomes(
        spark.createDataFrame(requests, "request_id long, dataset_id long, workspace_id long, name string, category_id long, owner_id long"),
        spark.createDataFrame(datasets, "dataset_id long, workspace_id long, name string, status string, is_deleted boolean"),
        spark.createDataFrame([(1, True), (2, False)], "category_id long, is_active boolean"),
        spark.createDataFrame([(0, 0, True), (1, 1, True)], "user_id long, workspace_id long, is_active boolean"), ["request_id"])
    rows = found.collect()
    assert {r["request_id"]: r["reason"] for r in rows} == names_one_by_one(requests, datasets)
    assert any(r["accepted"] for r in rows) and any(r["reason"] == admission.NAME_TAKEN for r in rows)
