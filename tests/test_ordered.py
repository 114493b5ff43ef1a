"""Ordered operators against plain Python, with one key holding a third of all rows and tied times."""

import random

import pytest
from pyspark.sql import functions as F

from gatehouse.operators import catalogue as cat
from gatehouse.operators.ordered import chunk, last_known, running_number

N = 3000


@pytest.fixture(scope="module")
def rows():
    source = random.Random(7)
    actions = ["activate", "archive", "restore", "other", None]
    return [
        ("hot" if i % 3 == 0 else f"k{source.randrange(40)}", source.randrange(200), i, source.choice(actions))
        for i in range(N)
    ]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "key string, ts int, id int, action string").repartition(8)


def by_key(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


def test_hot_key_spans_chunks(spark, table):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunks = chunk(table, ["key"], ["ts", "id"]).filter("key = 'hot'").select("_chunk").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert chunks > 1


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_running_number(spark, table, rows, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    found = {r["id"]: r["position"] for r in running_number(table, ["key"], ["ts", "id"]).collect()}
    assert found == {row[2]: i for group in by_key(rows).values() for i, row in enumerate(group, 1)}
    overall = {r["id"]: r["position"] for r in running_number(table, [], ["ts", "id"]).collect()}
    assert overall == {row[2]: i for i, row in enumerate(sorted(rows, key=lambda r: (r[1], r[2])), 1)}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("inclusive", [False, True])
def test_last_known(spark, table, rows, inclusive):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    value = F.when(F.col("action") == "archive", F.col("id"))
    found = {r["id"]: r["seen"] for r in last_known(table, ["key"], ["ts", "id"], value, "seen", inclusive).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = {}
    for group in by_key(rows).values():
        latest = None
        for row in group:
            here = row[2] if row[3] == "archive" else None
            if inclusive and here is not None:
                latest = here
            expected[row[2]] = latest
            if here is not None:
                latest = here
    assert found == expected


@pytest.mark.parametrize("initial", [None, "Draft", "Active", "Archived"])
def test_lifecycle_replays_one_request_at_a_time(spark, table, rows, initial):
    states = None if initial is None else spark.createDataFrame([("hot", initial)], "key string, status string")
    judged = cat.lifecycle_requests(table, "key", ["ts", "id"], states=states)
    found = {r["id"]: (r["state_before"], r["accepted"], r["state_after"]) for r in judged.collect()}
    expected = {}
    for key, group in by_key(rows).items():
        state = initial or "Draft" if key == "hot" else "Draft"
        for row in group:
            needed, target = cat.TRANSITIONS.get(row[3], (None, None))
            accepted = needed == state
            after = target if accepted else state
            expected[row[2]] = (state, accepted, after)
            state = after
    assert found == expected
    final, refused = cat.lifecycle_apply(table, "key", ["ts", "id"], states=states)
    assert refused.count() == sum(not accepted for _, accepted, _ in expected.values())
    assert {r["key"]: r["status"] for r in final.collect()} == {k: expected[g[-1][2]][2] for k, g in by_key(rows).items()}


def test_version_edits_skip_unchanged(spark, table, rows):
    edits = table.withColumn("name", F.coalesce("action", F.lit(" "))).withColumn("category_id", F.lit(1))
    shape = {"fields": ["name", "category_id"], "tags": None}
    found = {
        r["id"]: (r["version_number"], r["is_current"])
        for r in cat.version_edits(edits, "key", ["ts", "id"], **shape).collect()
    }
    expected = {}
    for group in by_key(rows).values():
        version, before, ids = 0, object(), []
        for row in group:
            if (row[3] or "") != before:
                version, before = version + 1, row[3] or ""
                ids.append(row[2])
                expected[row[2]] = (version, False)
        expected[ids[-1]] = (version, True)
    assert found == expected


def test_same_rows_at_any_partition_count(spark, table):
    results = []
    for partitions in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        judged = cat.lifecycle_requests(table, "key", ["ts", "id"])
        results.append(sorted(map(tuple, judged.select("id", "state_after").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_codes_continue_after_the_highest(spark):
    df = spark.createDataFrame(
        [(1, 5, "DS-000041"), (2, 3, None), (3, 1, " "), (4, 2, "odd"), (5, 1, "")], "id int, created int, code string"
    )
    codes = {r["id"]: r["code"] for r in cat.allocate_codes(df, ["created", "id"]).collect()}
    assert codes == {1: "DS-000041", 2: "DS-000044", 3: "DS-000042", 4: "odd", 5: "DS-000043"}
    wide = spark.createDataFrame([(1, "DS-999999"), (2, None)], "id int, code string")
    assert {r["code"] for r in cat.allocate_codes(wide, ["id"]).collect()} == {"DS-999999", "DS-1000000"}
