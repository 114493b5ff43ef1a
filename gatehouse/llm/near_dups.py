"""Near-duplicate classes by order MinHash.

Texts are first collapsed to different word sequences. Each sequence gets ``SKETCHES`` sketches: the ``KEPT`` smallest
hashes among its occurrence-labelled five-word shingles, kept in text order, so that two sequences share a sketch only
if they share these shingles in the same order. Sequences that share a sketch are candidates; a candidate pair is
verified by its shingle similarity and by an alignment in a band around the diagonal. Members of a bucket that is too
large to be compared as a whole are joined once more, exactly, by their rarest shingles. Classes are the connected
components of the verified links.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from gatehouse.llm.arrow_text import mix, text_blocks, word_hashes
from gatehouse.llm.components import components
from gatehouse.llm.rows import scratch_tables, stored, without
from gatehouse.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 misses all sketches with probability (1 - 0.8 ** KEPT) ** SKETCHES, about 3e-6.
SKETCHES, KEPT = 24, 4
#: Of few shingles, four are seldom all common: a sequence of up to SHORT has as many sketches of KEPT_SHORT as well. A
#: pair of which only one sequence is so short has at least 17 shingles each.
SHORT, KEPT_SHORT = 20, 2
#: Single minima of further hash functions, one byte each. A pair of similarity 0.8 agrees in 96 of 120 on average, and
#: in fewer than LEAST_AGREEING, when it is not verified, with probability 4e-5.
MINIMA, LEAST_AGREEING = 120, 78
#: Up to SMALL members, a bucket gives its pairs, which are verified once for all buckets. A larger one is verified in
#: place and gives the links that connect it. Beyond BUCKET members it is salted, and its parts share a hub; pairs that
#: no part holds are found by ``_across``.
SMALL, BUCKET = 32, 1000
#: Words of a bucket that a task holds at once, and cells of its matrix.
_HELD_BYTES, _CELLS = 64 << 20, 4_000_000
#: Counters by which shingles are ranked from rare to frequent; any ranking finds all pairs.
_SLOTS = 1 << 18
#: Shingles that a task hands on at once.
_GATHERED = 200_000

_ODD = np.random.default_rng(20240301).integers(1, 1 << 63, SKETCHES + MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)

_SEQUENCE = "doc_id bigint, text_key bigint, node binary, words binary, minima binary, sketches array<bigint>"


def shingles(words: np.ndarray) -> np.ndarray:
    """Hash of each run of five words; a shorter sequence is one shingle, an empty one has none."""
    size = min(SHINGLE, len(words))
    if not size:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out = out * _STEP + words[i : len(words) - size + 1 + i].astype(np.uint64)
    return mix(out)


def labelled_by_occurrence(values: np.ndarray) -> np.ndarray:
    """The first, second, ... occurrence of a shingle become different values."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if new.all():
        return values
    first = np.flatnonzero(new)
    number = np.empty(len(values), np.uint64)
    number[order] = (np.arange(len(values)) - np.repeat(first, np.diff(np.append(first, len(values))))).astype(np.uint64)
    return mix(values + number * _STEP)


def sketch(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sketches, minima): order-sensitive keys, and bytes of the smallest value under each further hash function. The
    sketches count repeated shingles, the minima, like the similarity, do not."""
    every = shingles(words)
    values, distinct = labelled_by_occurrence(every), np.unique(every)
    keys = [_sketches(values, KEPT, 0)]
    if len(distinct) <= SHORT:
        keys.append(_sketches(values, KEPT_SHORT, SKETCHES))
    minima = np.empty(MINIMA, np.uint8)
    group = max(1, 500_000 // len(distinct))
    for at in range(0, MINIMA, group):
        odd = _ODD[SKETCHES + at : min(SKETCHES + at + group, SKETCHES + MINIMA), None]
        minima[at : at + len(odd)] = mix((distinct[None, :] * odd).min(axis=1)) >> np.uint64(56)
    return np.concatenate(keys), minima


def _sketches(values: np.ndarray, most: int, first: int) -> np.ndarray:
    """One key per hash function, of the ``most`` smallest values in text order; keys are numbered from ``first`` on."""
    kept, keys = min(most, len(values)), np.empty(SKETCHES, np.uint64)
    group = max(1, 500_000 // len(values))
    for at in range(0, SKETCHES, group):
        hashed = values[None, :] * _ODD[at : min(at + group, SKETCHES), None]
        near = np.argpartition(hashed, kept - 1, axis=1)[:, :kept] if kept < len(values) else np.tile(
            np.arange(kept), (len(hashed), 1))
        near.sort(axis=1)
        key = np.arange(first + at, first + at + len(hashed), dtype=np.uint64)
        for place in range(kept):
            key = mix(key * _STEP + values[near[:, place]])
        keys[at : at + len(hashed)] = key
    return keys


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        valid = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        for block in text_blocks(batch.column(2)):
            words, bounds = word_hashes(block)
            small = (words >> np.uint64(32)).astype(np.uint32)
            nodes, texts, minima, keys = [], [], [], []
            for i in range(block.count):
                own = words[bounds[i] : bounds[i + 1]]
                content = own.tobytes() if len(own) else b"text" + block.data[block.offsets[i] : block.offsets[i + 1]].tobytes()
                nodes.append(hashlib.blake2b(content, digest_size=16).digest() if valid[block.first + i] else None)
                texts.append(small[bounds[i] : bounds[i + 1]].tobytes())
                found = sketch(own) if len(own) else (np.empty(0, np.uint64), np.empty(0, np.uint8))
                keys.append(found[0].view(np.int64))
                minima.append(found[1].tobytes())
            yield pa.RecordBatch.from_arrays([
                *(batch.column(i).slice(block.first, block.count) for i in (0, 1)), pa.array(nodes, pa.binary()), pa.array(texts, pa.binary()),
                pa.array(minima, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
            ], names=["doc_id", "text_key", "node", "words", "minima", "sketches"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, bytes]]]:
    """The (node, value) rows of one bucket after the other, from rows sorted by (sketch, salt). A bucket of too many
    rows or bytes is cut, and its first row, the hub, is the first of what follows as well."""
    held: list[tuple[bytes, bytes]] = []
    size, bucket = 0, None
    for batch in batches:
        for sketch_, salt, node, value in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if (sketch_, salt) != bucket or len(held) >= 2 * BUCKET or size >= _HELD_BYTES:
                if len(held) > 1:
                    yield held
                held = held[:1] if (sketch_, salt) == bucket else []
                size, bucket = sum(len(row[1]) for row in held), (sketch_, salt)
            held.append((node, value))
            size += len(value)
    if len(held) > 1:
        yield held


def _batch(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    both = [sorted(pair) for pair in pairs]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in both], pa.binary()) for i in (0, 1)], names=["a", "b"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each small bucket's (node, minima) rows that may be similar."""
    for rows in _grouped(batches):
        minima = np.frombuffer(b"".join(row[1] for row in rows), np.uint8).reshape(len(rows), MINIMA)
        agreeing = (minima[:, None] == minima[None]).sum(axis=2) >= LEAST_AGREEING
        yield _batch([(rows[i][0], rows[j][0]) for i, j in np.argwhere(np.triu(agreeing, 1)).tolist()])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect each large bucket's (node, words) rows."""
    for rows in _grouped(batches):
        yield _batch(_bucket_links(rows))


def _bucket_links(rows: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the bucket's links, the most similar first: the shingle similarity of all pairs comes from
    one product of the matrix of texts by shingles with itself, and a pair is aligned if it would connect two trees."""
    words = [np.frombuffer(row[1], np.uint32) for row in rows]
    sets = [np.unique(shingles(own)) for own in words]
    sizes = np.array([len(x) for x in sets])
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    row = np.repeat(np.arange(len(rows)), sizes)
    both = np.zeros((len(rows), len(rows)), np.float32)
    step = max(1, _CELLS // len(rows))
    for first in range(0, int(column.max(initial=-1)) + 1, step):
        inside = (column >= first) & (column < first + step)
        block = np.zeros((len(rows), step), np.float32)
        block[row[inside], column[inside] - first] = 1
        both += block @ block.T
    similarity = both / np.maximum(sizes[:, None] + sizes[None] - both, 1)
    left, right = np.nonzero(np.triu(similarity >= SIMILARITY - 1e-6, 1))
    order = np.argsort(-similarity[left, right], kind="stable")
    tree = list(range(len(rows)))

    def root(i: int) -> int:
        while tree[i] != i:
            tree[i] = tree[tree[i]]
            i = tree[i]
        return i

    links, trees = [], len(rows)
    for i, j in zip(left[order].tolist(), right[order].tolist(), strict=True):
        if trees == 1:
            break
        a, b = root(i), root(j)
        if a != b and similar(words[i], words[j]):
            tree[b] = a
            trees -= 1
            links.append((rows[i][0], rows[j][0]))
    return links


def shingle_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the sets of five-word shingles."""
    left, right = np.unique(shingles(a)), np.unique(shingles(b))
    both = len(left) + len(right) - len(np.union1d(left, right))
    return both / max(1, len(left) + len(right) - both)


def banded_distance(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Edits (insert, delete, replace a word) from ``a`` to ``b`` if at most ``band``, else ``band + 1``.

    The furthest point reached on each diagonal of the band is carried from one number of edits to the next.
    """
    left, right, n, m = a.tobytes(), b.tobytes(), len(a), len(b)

    def slide(i: int, k: int) -> int:
        """The furthest point of ``a`` on diagonal ``k`` up to which both agree from ``i`` on."""
        step = 16
        while step:
            size = min(step, n - i, m - i - k)
            if size > 0 and left[4 * i : 4 * (i + size)] == right[4 * (i + k) : 4 * (i + k + size)]:
                i, step = i + size, step * 2
            elif size <= 0:
                break
            else:
                step = size // 2
        return i

    if abs(n - m) > band:
        return band + 1
    reached = {0: slide(0, 0)}
    for edits in range(band + 1):
        if reached.get(m - n, -1) >= n:
            return edits
        further = {}
        for k in range(-min(edits + 1, band), min(edits + 1, band) + 1):
            replaced, inserted, deleted = reached.get(k, -2) + 1, reached.get(k - 1, -1), reached.get(k + 1, -2) + 1
            best = min(max(replaced, inserted, deleted), n, m - k)
            if best >= max(0, -k):
                further[k] = slide(best, k)
        reached = further
    return band + 1


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the pair is linked: shingle similarity, then edits inside the band, both to ``similarity``."""
    if shingle_similarity(a, b) < similarity:
        return False
    band = int((1 - similarity) * max(len(a), len(b)))
    return banded_distance(a, b, band) <= band


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [similar(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32))
                for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by slot of their shingles."""
    counts = np.zeros(_SLOTS, np.int64)
    for batch in batches:
        for words in batch.column(0):
            own = np.unique(shingles(np.frombuffer(words.as_py(), np.uint32)))
            counts += np.bincount((own % np.uint64(_SLOTS)).astype(np.int64), minlength=_SLOTS)
    slots = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(counts[slots])], names=["slot", "n"])


def _prefixes(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rarest shingles of each (node, label, words) row, with their place in the ranking; those of many rows at once."""
    for batch in batches:
        rows, parts, held = [], [], 0
        for i, words in enumerate(batch.column(2)):
            own = np.unique(shingles(np.frombuffer(words.as_py(), np.uint32)))
            size = len(own)
            ranked = own[np.lexsort((own, counts[(own % np.uint64(_SLOTS)).astype(np.int64)]))]
            # The first common shingle of a similar pair is among these of both, and among the fewer of the smaller set.
            longer = size - int(np.ceil(SIMILARITY * size - 1e-6)) + 1
            smaller = size - int(np.ceil(2 * SIMILARITY / (1 + SIMILARITY) * size - 1e-6)) + 1
            place = np.arange(longer)
            rows.append(np.full(longer, i))
            parts.append((ranked[:longer], np.full(longer, size), place, place < smaller))
            held += longer
            if held >= _GATHERED or i == batch.num_rows - 1:
                shingle, sizes, places, few = (np.concatenate(x) for x in zip(*parts, strict=True))
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([
                    pa.array(shingle.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(sizes.astype(np.int32)),
                    pa.array(places.astype(np.int32)), pa.array(few),
                ], names=["shingle", "node", "label", "size", "place", "smaller"])
                rows, parts, held = [], [], 0


def _across(words: DataFrame, found: DataFrame) -> DataFrame:
    """Every pair (a, b) of the (node, words) rows that may be similar and that the links ``found`` do not connect.

    A pair of similarity SIMILARITY has a common shingle so early in both rankings that enough others can follow. A
    shingle of many texts is salted: the smaller sets' entries meet each part of the others.
    """
    context = words.sparkSession.sparkContext
    members = stored(words.join(components(found), "node", "left").select(
        "node", F.coalesce("label", "node").alias("label"), "words"), "cut-members")
    counts = np.zeros(_SLOTS, np.int64)
    for slot, n in members.select("words").mapInArrow(_counted, "slot int, n bigint").groupBy("slot").agg(F.sum("n")).collect():
        counts[slot] = n
    sent = context.broadcast(counts)
    prefixes = stored(members.select("node", "label", "words").mapInArrow(
        lambda batches: _prefixes(batches, sent.value),
        "shingle bigint, node binary, label binary, size int, place int, smaller boolean"), "prefixes")
    shared = prefixes.groupBy("shingle").agg(
        F.count("*").alias("n"), F.bool_or("smaller").alias("any"), F.min("label").alias("least"), F.max("label").alias("most"),
    ).filter("any AND least <> most").select("shingle", F.ceil(F.col("n") / BUCKET).alias("salts"))
    useful = stored(prefixes.join(shared, "shingle"), "shared-prefixes")
    one = useful.filter("smaller").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))).alias("x")
    other = useful.withColumn("salt", F.pmod(F.xxhash64("node", "shingle"), "salts")).alias("y")
    common = F.ceil((F.col("x.size") + F.col("y.size")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6)
    pairs = one.join(
        other, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.salt") == F.col("y.salt"))
        & (F.col("x.label") != F.col("y.label")) & (F.struct("x.size", "x.node") < F.struct("y.size", "y.node"))
        & (F.col("x.place") + common <= F.col("x.size")) & (F.col("y.place") + common <= F.col("y.size")))
    return stored(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "across")


def _buckets(sketched: DataFrame) -> DataFrame:
    """(sketch, salt, node, n, cut): the sequences that share a sketch with n - 1 others, and whether its bucket is too
    large for all of them to meet."""
    members = sketched.select("node", "bytes", F.explode("sketches").alias("sketch"))
    cut = (F.col("n") > BUCKET) | ((F.col("n") > SMALL) & (F.col("held") >= _HELD_BYTES))
    shared = members.groupBy("sketch").agg(
        F.count("*").alias("n"), F.min("node").alias("hub"), F.sum("bytes").alias("held"),
    ).filter("n > 1").withColumn("cut", cut).drop("held")
    salts = F.ceil(F.col("n") / BUCKET)
    salted = members.join(shared, "sketch").withColumn("salt", F.pmod(F.xxhash64("node", "sketch"), salts))
    # The hub of a salted bucket is a member of each of its parts.
    extra = shared.filter(F.col("n") > BUCKET).select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"), "sketch", F.col("hub").alias("node"), "n", "cut")
    rows = salted.select("sketch", "salt", "node", "n", "cut").unionByName(extra)
    return stored(rows, "buckets")


def _dealt(rows: DataFrame, value: str) -> DataFrame:
    return rows.select("sketch", "salt", "node", value).distinct().repartition("sketch", "salt").sortWithinPartitions(
        "sketch", "salt", "node")


def links(sequences: DataFrame) -> DataFrame:
    """Verified links (a, b) between different sequences, enough to connect each class."""
    nodes = sequences.filter("node IS NOT NULL AND size(sketches) > 0")
    sketched = stored(nodes.groupBy("node").agg(
        F.first("minima").alias("minima"), F.first("sketches").alias("sketches"),
        F.first(F.octet_length("words")).alias("bytes")), "sketches")
    buckets = _buckets(sketched)
    # Words move once, and only those of sequences that share a sketch are kept.
    words = stored(nodes.select("node", "words").join(buckets.select("node").distinct(), "node", "left_semi").dropDuplicates(
        ["node"]), "candidate-words")
    small = buckets.filter(F.col("n") <= SMALL).join(sketched.select("node", "minima"), "node")
    pairs = stored(_dealt(small, "minima").mapInArrow(_pairs, "a binary, b binary").distinct(), "pairs")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(words.select(F.col("node").alias("a"), F.col("words").alias("left")), "a").join(
            words.select(F.col("node").alias("b"), F.col("words").alias("right")), "b")
        return both.select("a", "b", "left", "right").mapInArrow(_verified, "a binary, b binary")

    large = buckets.filter(F.col("n") > SMALL).join(words, "node")
    found = stored(verified(pairs).union(_dealt(large, "words").mapInArrow(_linked, "a binary, b binary")).distinct(), "links")
    cut = buckets.filter("cut").select("node").distinct()
    if not cut.limit(1).count():
        return found
    return stored(found.union(verified(_across(words.join(cut, "node", "left_semi"), found))), "all-links")


def sequences_of(docs: DataFrame) -> DataFrame:
    """Write each row's word sequence and sketches to the shared scratch folder, once, and return them."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").alias("text"))
    return stored(rows.mapInArrow(_sequences, _SEQUENCE), "sequences")


def _classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, class_id, class_size, kept) of every row of ``docs``."""
    sequences = sequences_of(docs)
    labels = components(links(sequences))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    contents = sequences.filter("node IS NOT NULL").groupBy("node").agg(F.min(order).alias("least"), F.count("*").alias("n"))
    named = contents.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = named.groupBy("label").agg(F.min("least").alias("chosen"), F.sum("n").alias("n_rows"))
    by_node = named.join(classes, "label").select("node", "chosen", "n_rows")
    alone = F.col("node").isNull()
    return sequences.select("doc_id", "text_key", "node").join(by_node, "node", "left").select(
        "doc_id", "text_key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("chosen.doc_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("n_rows")).cast("bigint").alias("class_size"),
        (alone | order.eqNullSafe(F.col("chosen"))).alias("kept"),
    )


def near_dup_classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept.

    ``class_id`` is the smallest doc_id of the class. Texts with the same words are in one class, texts without words
    only with equal ones; a null text is a class of its own. Null doc_ids come last, and a class with no other has a
    null class_id. ``kept`` marks the first row of the class by doc_id and text; rows that repeat both are all marked,
    and ``deduplicate`` keeps one of them.
    """
    return _classes(docs).drop("text_key")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the one of the smallest doc_id. Every row without a text stays."""
    spark = docs.sparkSession
    path = scratch_path(spark, "classes")
    with scratch_tables(spark, "near-duplicates"):
        _classes(docs).write.parquet(path)
    classes = spark.read.parquet(path)
    kept = without(docs, lambda: classes.filter("NOT kept"))
    repeats = classes.filter("kept").groupBy("doc_id", "text_key").count().filter("count > 1")
    if not repeats.limit(1).count():
        return kept
    return kept.filter("text IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(kept.filter("text IS NULL"))
