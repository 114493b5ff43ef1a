"""Rounds over a large table leave the checkpoints of their result only, however many they are."""

import datetime
import os

from gatehouse.operators import admission
from gatehouse.session import materialize, release, scratch_root, settle

DAY = datetime.datetime(2024, 1, 1)


def kept(spark):
    # The files of checkpoints that something may still read.
    root = scratch_root(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:") or root
    return {name for name in os.listdir(folder) if name.startswith("rdd-")}


def test_settle_keeps_its_result_only(spark):
    before = kept(spark)

    def build():
        half = materialize(spark.range(100).filter("id % 2 = 0"))
        return settle(lambda: materialize(half.filter("id % 4 = 0"))).unionByName(half)

    found = settle(build)
    assert len(kept(spark) - before) == 1
    assert found.count() == 75 and found.filter("id % 4 = 0").count() == 50
    release(found)
    assert kept(spark) <= before


def test_a_chain_of_renames_leaves_no_rounds_behind(spark):
    before, n = kept(spark), 6
    # Each dataset asks for the name of the one before it, which is free once that one has moved on, from the last to the first.
    datasets = spark.createDataFrame([(i, 0, f"n{i}", "Active", False) for i in range(n)], "dataset_id long, workspace_id long, name string, status string, is_deleted boolean")
    requests = [(i, i, 0, f"n{i + 1}", 1, 0) for i in range(n)] + [(100 + i, n - 1 - i, 0, f"n{n - i}", 1, 0) for i in range(n)]
    # One is refused for its owner, and meets a name that the others left.
    requests += [(200, 3, 0, "n0", 1, 9), (201, 3, 0, "N6 ", 1, 9), (202, 0, 0, "other", 2, 0)]
    outcomes = admission.metadata_outcomes(
        spark.createDataFrame(requests, "request_id long, dataset_id long, workspace_id long, name string, category_id long, owner_id long"),
        datasets, spark.createDataFrame([(1, True)], "category_id long, is_active boolean"),
        spark.createDataFrame([(0, 0, True)], "user_id long, workspace_id long, is_active boolean"), ["request_id"])
    reasons = {r["request_id"]: r["reason"] for r in outcomes.collect()}
    taken = admission.NAME_TAKEN
    # The last one moves first, to a free name; of those before it, each finds its neighbour's name free only afterwards.
    assert reasons == {**{i: taken for i in range(n - 1)}, n - 1: None, 100: None, **{100 + i: None for i in range(1, n)},
                       200: admission.OWNER_REQUIRED, 201: taken, 202: admission.CATEGORY_REQUIRED}
    assert len(kept(spark) - before) == 1


def test_starts_leave_no_rounds_behind(spark):
    def rest(n):
        before = kept(spark)
        at = lambda hours: DAY + datetime.timedelta(hours=hours)
        runs = spark.createDataFrame([(i, i % 2, "Created", None) for i in range(n)], "import_id long, dataset_id long, status string, ends_at timestamp_ntz")
        requests = spark.createDataFrame(
            [(r, r % n // 2 * 2 % n, at(r), at(r + 1)) for r in range(4 * n)], "request_id long, import_id long, asked_at timestamp_ntz, ends_at timestamp_ntz")
        found = admission.admit_starts(requests, runs)
        assert {r["import_id"] for r in found.filter("accepted").collect()} == set(range(0, n, 2))
        assert found.filter("accepted").count() == n // 2 and found.count() == 4 * n
        return len(kept(spark) - before)

    # What a round settles is read by the result; the pointers, chunks and choices of its rounds are gone.
    assert rest(4) <= 8
