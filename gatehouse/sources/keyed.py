"""Keyed tables: parts cut by key range, upserts that rewrite only what they touch, appends that read only what may match.

The manifest notes of each part its least and greatest key, its rows and its layer. What one write cuts by range is a
layer: its parts do not overlap, so a key can be in one part of a layer at most, which a binary search over the layer's
bounds finds. With each part goes a Bloom filter, one word of 64 bits for about six keys, so that most keys a part does
not hold are ruled out without reading it; what remains is compared exactly. An upsert replaces each part that holds one
of its keys by a part of the same layer and adds its new keys as a layer of their own; ``compact`` joins small parts to
a new layer, so that there are few layers to ask.

Bounds and filters are those of the keys' text; keys are unique in a table, and a null one equals no other. All functions publish on top of the manifest they read and raise
``Conflict`` when another writer was first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gatehouse.functions.hashing import filter_bits
from gatehouse.session import materialize
from gatehouse.sources.store import FILTERS, new_part, publish, read_manifest, read_parts

#: Rows of a part on average, and those below which it is a small one.
PART_ROWS, SMALL_ROWS = 1_000_000, 500_000
#: Small parts that are worth a compaction.
MANY = 8
KEYS_PER_WORD = 6

_PIECE, _PART = "_piece", "_part"


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def _cut(df: DataFrame, key: str, rows: int, label: str, part_rows: int) -> DataFrame:
    """``df`` with ``_piece``, cut by key range into parts of about ``part_rows``."""
    pieces = max(1, -(-rows // part_rows))
    return df.repartitionByRange(pieces, _text(key)).withColumn(_PIECE, F.concat(F.lit(label), F.spark_partition_id()))


def _write(df: DataFrame, path: str, run_id: str, key: str) -> dict[str, dict]:
    """Write the pieces of ``df`` as parts with their filters; what the manifest is to note of each, by piece."""
    spark, folder = df.sparkSession, new_part(run_id)
    df.sortWithinPartitions(_PIECE, key).write.mode("errorifexists").partitionBy(_PIECE).parquet(f"{path}/{folder}")
    written = spark.read.parquet(f"{path}/{folder}").select(F.col(_PIECE), _text(key).alias("key"))
    found = written.groupBy(_PIECE).agg(F.count("*").alias("rows"), F.min("key").alias("least"), F.max("key").alias("greatest")).collect()
    details = {
        row[_PIECE]: {"part": f"{folder}/{_PIECE}={row[_PIECE]}", "layer": folder, "rows": row["rows"], "least": row["least"],
                      "greatest": row["greatest"], "words": -(-row["rows"] // KEYS_PER_WORD)} for row in found}
    sizes = spark.createDataFrame([(piece, d["part"], d["words"]) for piece, d in details.items()], f"{_PIECE} string, {_PART} string, words bigint")
    filters = written.join(sizes, _PIECE).groupBy(_PART, F.pmod(F.xxhash64("key"), "words").alias("word")).agg(
        F.bit_or(filter_bits(F.col("key"))).alias("bits"))
    filters.write.parquet(f"{path}/{FILTERS}/{folder}")
    return details


def _noted(details: dict[str, dict]) -> dict[str, dict]:
    return {d["part"]: {name: value for name, value in d.items() if name != "part"} for d in details.values()}


def write_keyed(
    df: DataFrame, path: str, run_id: str, key: str = "key_hash", mark: tuple[str, int] | None = None, base: int | None = None,
    part_rows: int = PART_ROWS,
) -> None:
    """Publish ``df``, which has unique keys, as the whole table, in parts cut by key range."""
    spark = df.sparkSession
    rows = materialize(df)
    n = rows.count()
    if not n:
        part = new_part(run_id)
        rows.write.parquet(f"{path}/{part}")
        return publish(spark, path, run_id, lambda runs: [[run_id, part]], mark, base)
    details = _write(_cut(rows, key, n, "r", part_rows), path, run_id, key)
    publish(spark, path, run_id, lambda runs: [[run_id, d["part"]] for d in details.values()], mark, base, _noted(details))


def _position(key: Column, bounds: Sequence[str]) -> Column:
    """How many of the ascending ``bounds`` are not above the key, by binary search."""
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    known = F.lit(list(bounds))
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(
        (at + step <= len(bounds)) & (F.get(known, at + step - 1) <= key), at + step).otherwise(at))


def _layers(manifest: dict, parts: Sequence[str]) -> list[list[tuple[str, dict]]]:
    """The parts of each layer in the order of their keys."""
    layers: dict[str, list] = {}
    for part in parts:
        layers.setdefault(manifest["parts"][part]["layer"], []).append((part, manifest["parts"][part]))
    return [sorted(layer, key=lambda entry: entry[1]["least"].encode()) for layer in layers.values()]


def possible_parts(keys: DataFrame, path: str, key: str, manifest: dict, parts: Sequence[str]) -> DataFrame:
    """(key, _part): the parts that may hold a key of ``keys``, by their bounds and filters. It misses none."""
    spark, places = keys.sparkSession, []
    layers = _layers(manifest, parts)
    for layer in layers:
        at = _position(F.col("_key"), [d["least"] for _, d in layer]) - 1
        inside = (at >= 0) & (F.col("_key") <= F.get(F.lit([d["greatest"] for _, d in layer]), at))
        word = F.pmod(F.xxhash64("_key"), F.get(F.lit([d["words"] for _, d in layer]), at).cast("bigint"))
        places.append(F.when(inside, F.struct(F.get(F.lit([p for p, _ in layer]), at).alias(_PART), word.alias("word"))))
    asked = keys.select(F.col(f"`{key}`"), _text(key).alias("_key"))
    if not places:
        return asked.select(key, F.lit(None).cast("string").alias(_PART)).limit(0)
    placed = asked.withColumn("place", F.explode(F.filter(F.array(*places), lambda place: place.isNotNull()))).select(
        key, "_key", f"place.{_PART}", "place.word")
    filters = spark.read.parquet(*sorted({f"{path}/{FILTERS}/{part.split('/')[0]}" for part in parts}))
    mask = filter_bits(F.col("_key"))
    return placed.join(filters, [_PART, "word"]).filter(F.col("bits").bitwiseAND(mask) == mask).select(key, _PART)


def _split(manifest: dict, parts: Sequence[str]) -> tuple[list[str], list[str]]:
    """(parts with filters, parts without)."""
    return [p for p in parts if p in manifest["parts"]], [p for p in parts if p not in manifest["parts"]]


def _hit(maybe: DataFrame) -> list[str]:
    return [row[_PART] for row in maybe.select(_PART).distinct().collect()]


def known_keys(keys: DataFrame, path: str, key: str = "key_hash", manifest: dict | None = None, parts: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``keys`` (key), unique ones, whose key the table has (or the given ``parts`` of it).

    Only parts that may hold a key are read, and of these only the key column.
    """
    spark = keys.sparkSession
    manifest = manifest or read_manifest(spark, path)
    filtered, plain = _split(manifest, [p for _, p in manifest["runs"]] if parts is None else parts)
    asked = keys.select(key)
    maybe = materialize(possible_parts(asked, path, key, manifest, filtered))
    read = _hit(maybe) + plain
    if not read:
        return asked.limit(0)
    asked = asked if plain else asked.join(maybe.select(key), key, "left_semi")
    return asked.join(read_parts(spark, path, read).select(key), key, "left_semi")


def append_records(
    df: DataFrame, path: str, run_id: str, key: str = "key_hash", mark: tuple[str, int] | None = None, part_rows: int = PART_ROWS
) -> None:
    """Add the rows whose key no other run has put into the table; only they are written.

    A retry of a published run replaces that run's rows once the new part is complete.
    """
    spark = df.sparkSession
    manifest = read_manifest(spark, path)
    others = [entry for entry in manifest["runs"] if entry[0] != run_id]
    rows = materialize(df)
    known = known_keys(rows, path, key, manifest, [part for _, part in others])
    append_new(rows.join(known, key, "left_anti"), path, run_id, key, mark, manifest, part_rows)


def append_new(
    df: DataFrame, path: str, run_id: str, key: str = "key_hash", mark: tuple[str, int] | None = None, manifest: dict | None = None,
    part_rows: int = PART_ROWS,
) -> None:
    """Add rows that are known to be new to ``manifest``'s table, in place of what this run has published before."""
    spark = df.sparkSession
    manifest = manifest or read_manifest(spark, path)
    rows = materialize(df)
    n, details, parts = rows.count(), {}, []
    others = [entry for entry in manifest["runs"] if entry[0] != run_id]
    if n:
        details = _write(_cut(rows, key, n, "n", part_rows), path, run_id, key)
        parts = [d["part"] for d in details.values()]
    elif not others:
        parts = [new_part(run_id)]
        rows.write.parquet(f"{path}/{parts[0]}")
    publish(spark, path, run_id, lambda runs: [*others, *([run_id, part] for part in parts)], mark, manifest["version"], _noted(details))


def upsert_keyed(
    batch: DataFrame, path: str, run_id: str, key: str = "key_hash", identity: Sequence[str] = (), mark: tuple[str, int] | None = None,
    manifest: dict | None = None, part_rows: int = PART_ROWS,
) -> None:
    """Put ``batch``, which has unique keys and the table's columns, into the table: matched rows keep their ``identity``
    columns and take every other column from the batch, the rest is added.

    A part that holds none of the keys stays as it is. Parts without a filter, which another function wrote, are cut anew.
    """
    spark = batch.sparkSession
    manifest = manifest or read_manifest(spark, path)
    if not manifest["runs"]:
        return write_keyed(batch, path, run_id, key, mark, manifest["version"], part_rows)
    rows = materialize(batch)
    filtered, plain = _split(manifest, [p for _, p in manifest["runs"]])
    read = _hit(materialize(possible_parts(rows, path, key, manifest, filtered))) + plain
    columns = read_parts(spark, path, [manifest["runs"][0][1]]).columns
    new = rows.select(*columns)
    touched, merged = [], []
    if read:
        # Parts are found again by the folder of their files.
        folder = F.regexp_extract(F.col("_metadata.file_path"), rf"/(part=[^/]*(?:/{_PIECE}=[^/]*)?)/[^/]*$", 1)
        old = read_parts(spark, path, read).withColumn(_PART, folder)
        matched = materialize(old.join(rows.select(key), key, "left_semi").select(key, _PART))
        touched = [part for part in _hit(matched) if part in manifest["parts"]]
        new = new.join(matched.select(key), key, "left_anti")
        replaced = old.filter(F.col(_PART).isin(touched + plain)).alias("t").join(
            rows.withColumn("_new", F.lit(True)).alias("b"), F.col(f"t.{key}") == F.col(f"b.{key}"), "left")
        merged = [replaced.select(*(
            F.col(f"t.{name}") if name == key or name in identity
            else F.when(F.col("b._new"), F.col(f"b.{name}")).otherwise(F.col(f"t.{name}")).alias(name) for name in columns), f"t.{_PART}")]
    fresh = new
    if plain:
        fresh = fresh.unionByName(merged[0].filter(F.col(_PART).isin(plain)).drop(_PART))
    fresh = materialize(fresh)
    n, pieces = fresh.count(), []
    if n:
        pieces.append(_cut(fresh, key, n, "n", part_rows))
    if touched:
        number = {part: f"t{i}" for i, part in enumerate(touched)}
        names = spark.createDataFrame(list(number.items()), f"{_PART} string, {_PIECE} string")
        pieces.append(merged[0].filter(F.col(_PART).isin(touched)).join(names, _PART).drop(_PART).repartition(len(touched), _PIECE))
    details = {}
    if pieces:
        every = pieces[0] if len(pieces) == 1 else pieces[0].unionByName(pieces[1])
        details = _write(every, path, run_id, key)
    by_old = {part: details[f"t{i}"] for i, part in enumerate(touched)}
    for part, detail in by_old.items():
        detail["layer"] = manifest["parts"][part]["layer"]
    runs = [[run, by_old[part]["part"] if part in by_old else part] for run, part in manifest["runs"] if part not in plain]
    runs += [[run_id, d["part"]] for piece, d in details.items() if piece.startswith("n")]
    publish(spark, path, run_id, lambda _: runs, mark, manifest["version"], _noted(details))


def compact(
    spark: SparkSession, path: str, key: str = "key_hash", small_rows: int = SMALL_ROWS, many: int = MANY, part_rows: int = PART_ROWS
) -> int:
    """Join the parts with fewer than ``small_rows`` rows to one layer, if there are ``many``; the number of parts joined.

    They no longer belong to a run: an append that is tried again finds its keys known and adds nothing.
    """
    manifest = read_manifest(spark, path)
    small = [part for _, part in manifest["runs"] if part in manifest["parts"] and manifest["parts"][part]["rows"] < small_rows]
    if len(small) < many:
        return 0
    rows = sum(manifest["parts"][part]["rows"] for part in small)
    run_id = "compacted"
    details = _write(_cut(read_parts(spark, path, small), key, rows, "c", part_rows), path, run_id, key)
    runs = [entry for entry in manifest["runs"] if entry[1] not in small] + [[run_id, d["part"]] for d in details.values()]
    publish(spark, path, run_id, lambda _: runs, None, manifest["version"], _noted(details))
    return len(small)


def parts_table(spark: SparkSession, path: str, key: str = "key_hash") -> DataFrame:
    """(run, part, layer, rows, least, greatest) of the table's current parts, from the manifest alone."""
    manifest = read_manifest(spark, path)
    rows = [(run, part, d.get("layer"), d.get("rows"), d.get("least"), d.get("greatest"))
            for run, part in manifest["runs"] for d in [manifest["parts"].get(part, {})]]
    return spark.createDataFrame(rows, "run string, part string, layer string, rows bigint, least string, greatest string")
