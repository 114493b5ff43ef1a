"""Keyed tables against the same steps on dictionaries, and what they read and write."""

import random

import pytest

from gatehouse.sources import keyed, store

SCHEMA = "key_hash string, n int, kept int"


def table(spark, path):
    return {r["key_hash"]: (r["n"], r["kept"]) for r in store.read_table(spark, path).collect()}


def parts(spark, path):
    return [part for _, part in store.read_manifest(spark, path)["runs"]]


def frame(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], SCHEMA)


@pytest.mark.parametrize("plain", [False, True])
def test_batches_match_a_dictionary(spark, tmp_path, plain):
    rng, path = random.Random(plain), str(tmp_path / "table")
    expected = {f"k{rng.randrange(400):03d}": (i, i) for i in range(200)}
    if plain:
        store.full_replace(frame(spark, expected), path, "seed")
    else:
        keyed.write_keyed(frame(spark, expected), path, "seed", part_rows=20)
    for number in range(4):
        batch = {f"k{rng.randrange(400):03d}": (number, -number) for _ in range(30)}
        if number % 2:
            keyed.append_records(frame(spark, batch), path, f"run {number}/a", part_rows=10)
            expected = batch | expected
        else:
            keyed.upsert_keyed(frame(spark, batch), path, f"run-{number}", identity=("kept",), part_rows=10)
            expected |= {k: (n, expected[k][1] if k in expected else kept) for k, (n, kept) in batch.items()}
        assert table(spark, path) == expected
    assert keyed.compact(spark, path, small_rows=15, many=2, part_rows=50) > 2
    assert table(spark, path) == expected
    store.vacuum(spark, path)
    assert table(spark, path) == expected
    asked = frame(spark, {f"k{i:03d}": (0, 0) for i in range(500)})
    assert {r["key_hash"] for r in keyed.known_keys(asked, path).collect()} == set(expected)


def test_only_touched_parts_are_written_anew(spark, tmp_path):
    path = str(tmp_path / "table")
    keyed.write_keyed(frame(spark, {f"k{i:05d}": (0, 0) for i in range(2000)}), path, "seed", part_rows=100)
    before = parts(spark, path)
    keyed.upsert_keyed(frame(spark, {f"k{i:05d}": (1, 1) for i in range(700, 720)}), path, "r1")
    after = parts(spark, path)
    assert len(before) == len(after) and 1 <= len(set(before) - set(after)) <= 2
    keyed.upsert_keyed(frame(spark, {"z": (1, 1)}), path, "r2")
    assert set(after) < set(parts(spark, path))


def test_filters_rule_parts_out(spark, tmp_path):
    """Of 40 parts of one key range each, keys beside the stored ones need few, and none is missed."""
    path = str(tmp_path / "table")
    keyed.write_keyed(frame(spark, {f"k{2 * i:05d}": (0, 0) for i in range(4000)}), path, "seed", part_rows=100)
    manifest = store.read_manifest(spark, path)
    names = [part for _, part in manifest["runs"]]
    absent = frame(spark, {f"k{200 * i + 1:05d}": (0, 0) for i in range(40)})
    assert keyed.possible_parts(absent, path, "key_hash", manifest, names).count() <= 12
    present = frame(spark, {f"k{200 * i:05d}": (0, 0) for i in range(40)})
    assert keyed.possible_parts(present, path, "key_hash", manifest, names).count() == 40
    assert keyed.known_keys(present, path).count() == 40 and keyed.known_keys(absent, path).count() == 0


def test_retries_conflicts_and_empty_batches(spark, tmp_path):
    path = str(tmp_path / "table")
    keyed.upsert_keyed(frame(spark, {}), path, "r0", mark=("s", 0))
    assert table(spark, path) == {} and store.read_manifest(spark, path)["marks"] == {"s": 0}
    keyed.append_records(frame(spark, {"a": (1, 1)}), path, "r1")
    keyed.append_records(frame(spark, {"a": (2, 2), "b": (2, 2)}), path, "r1")
    assert table(spark, path) == {"a": (2, 2), "b": (2, 2)}
    stale = store.read_manifest(spark, path)
    keyed.upsert_keyed(frame(spark, {"a": (3, 3)}), path, "r2")
    with pytest.raises(store.Conflict):
        keyed.upsert_keyed(frame(spark, {"b": (4, 4)}), path, "r3", manifest=stale)
    keyed.upsert_keyed(frame(spark, {}), path, "r4", mark=("s", 1))
    assert table(spark, path) == {"a": (3, 3), "b": (2, 2)} and store.read_manifest(spark, path)["marks"] == {"s": 1}
    assert keyed.compact(spark, path) == 0
