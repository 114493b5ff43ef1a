"""Keyed state of streams over many batches and restarts, against the same rows taken one at a time."""

import datetime
import random

from gatehouse.sources.keyed import parts_table
from gatehouse.sources.store import read_table
from gatehouse.streaming import streams

DAY = datetime.datetime(2024, 1, 1)
ACTIONS = {"activate": ("Draft", "Active"), "archive": ("Active", "Archived"), "restore": ("Archived", "Active")}


def drop_in(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_lifecycle_of_a_hot_dataset_over_restarts(spark, tmp_path):
    rng, schema = random.Random(1), "id long, n long, action string"
    rows = [(rng.choice([1] * 8 + [2, 3, None]), n, rng.choice([*ACTIONS, "other"])) for n in range(300)]
    states, wanted = {3: "Archived"}, {}
    for key, n, action in rows:
        before = states.get(key, "Draft")
        needed, target = ACTIONS.get(action, (None, None))
        states[key] = target if needed == before else before
        wanted[n] = (before, needed == before, states[key])
    known = spark.createDataFrame([(3, "Archived")], "id long, status string")
    for at in range(0, 300, 75):
        # Each round starts the stream anew from its checkpoint.
        drop_in(spark, tmp_path / "in", rows[at : at + 75], schema)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        streams.lifecycle_stream(stream, "id", ["n"], str(tmp_path / "checkpoint"), str(tmp_path / "out"), states=known).awaitTermination()
    outcomes = read_table(spark, str(tmp_path / "out/outcomes")).collect()
    assert {r["n"]: (r["state_before"], r["accepted"], r["state_after"]) for r in outcomes} == wanted
    assert len(outcomes) == 300


def test_first_rows_within_a_watermark(spark, tmp_path):
    rng, schema, delay = random.Random(2), "k string, n long, ts timestamp_ntz", 10 * 3_600_000
    batches = [[(rng.choice("aaaabcd"), 100 * b + i, DAY + datetime.timedelta(hours=4 * b + rng.randint(-14, 4))) for i in range(40)] for b in range(6)]
    wanted, until, watermark, latest = {}, {}, 0, None
    ms = lambda ts: int((ts - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)
    for batch in batches:
        for k, n, ts in sorted(batch, key=lambda r: (r[0], r[2], r[1])):
            if ms(ts) < watermark:
                wanted[n] = "late"
            elif until.get(k, 0) > watermark:
                wanted[n] = "repeated"
            else:
                wanted[n], until[k] = "first", ms(ts) + delay
        latest = max([latest or 0, *(ms(ts) for _, _, ts in batch)])
        watermark = max(watermark, latest - delay)
    for batch in batches:
        drop_in(spark, tmp_path / "in", batch, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.first_within_stream(stream, "k", "ts", ["n"], delay, str(tmp_path / "checkpoint"), str(tmp_path / "out")).awaitTermination()
    found = {r["n"]: "first" for r in read_table(spark, str(tmp_path / "out/records")).collect()}
    for row in read_table(spark, str(tmp_path / "out/errors")).collect():
        assert row["n"] not in found
        found[row["n"]] = "late" if row["error_type"] == "Processing Error" else "repeated"
    assert found == wanted and set(wanted.values()) == {"first", "repeated", "late"}


def test_upserts_leave_other_parts(spark, tmp_path):
    schema, target = "key_hash string, n long", str(tmp_path / "table")
    for number, keys in enumerate((range(100), range(200, 300), range(5))):
        drop_in(spark, tmp_path / "in", [(f"k{k:03d}", number) for k in keys], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.upsert_stream(stream, "key_hash", "n", str(tmp_path / "checkpoint"), target).awaitTermination()
    assert {r["key_hash"]: r["n"] for r in read_table(spark, target).collect()} == {
        **{f"k{k:03d}": 2 if k < 5 else 0 for k in range(100)}, **{f"k{k:03d}": 1 for k in range(200, 300)}}
    parts = {r["least"]: r["part"] for r in parts_table(spark, target).collect()}
    streams_of = {least: part.rsplit("/", 1)[1] for least, part in parts.items()}
    assert streams_of == {"k000": "_piece=t0", "k200": "_piece=n0"}
