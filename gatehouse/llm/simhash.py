"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint's eight bytes are eight positional tokens. Fingerprints that differ in at most four bits differ in at most
four bytes, so they share at least four positional bytes: the guaranteed minimum. The index is kept under three
positional bytes at a time, in 20 sets of positions that between them hold a part of any four: a list then holds a
fraction of 2^-24 of unrelated fingerprints, not 2^-8. In each list the shared positional bytes of every pair are
tallied, pairs that reach the minimum are verified by their differing bits, and the links that connect the list's
fingerprints are kept.

A list that is too long is replaced by its five parts that share a fourth byte, which a linked pair has too. Parts that
are still too long are narrowed further, which links most of their members, and are then compared block by block between
members that no link connects yet.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from gatehouse.llm.arrow_text import LOWER, TOKEN, Block, text_blocks, tokens
from gatehouse.llm.components import components
from gatehouse.llm.rows import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, SEED, BITS = 4, 42, 4
POSITIONS = 8
LEAST_SHARED = POSITIONS - BITS
#: Fingerprints that a list holds; longer ones are narrowed. Seven shared bytes leave 256 at most.
LIST = 4096
#: Shingles whose bits are counted at once.
_COUNTED = 100_000

#: Three groups of positions: the sets of three inside a group, and those of two of a group and one of the next, meet
#: every set of four.
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def covering_sets() -> list[tuple[int, ...]]:
    """Sets of three positions, one of which is inside any set of four."""
    inside = [c for group in _GROUPS for c in combinations(group, 3)]
    across = [(*pair, one) for i, group in enumerate(_GROUPS) for pair in combinations(group, 2) for one in _GROUPS[(i + 1) % 3]]
    return inside + across


def _mask(positions: tuple[int, ...]) -> int:
    """The bytes at these positions, as a signed 64-bit mask."""
    bits = sum(0xFF << 8 * p for p in positions)
    return bits - (1 << 64) if bits >> 63 else bits


def shingle_spans(block: Block) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(text, starts, ends, bounds): the block's words, lower-cased and joined by blanks, the byte spans of its shingles,
    and the shingles of each text."""
    found = tokens(block, TOKEN)
    sizes = found.ends - found.starts
    first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    text = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
    inside = TOKEN[block.data]
    text[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = LOWER[block.data[inside]]
    words = np.diff(found.bounds)
    number = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    bounds = np.concatenate([[0], np.cumsum(number)])
    owner = np.repeat(np.arange(block.count), number)
    begin = np.arange(bounds[-1]) - bounds[owner] + found.bounds[owner]
    last = np.minimum(begin + SHINGLE, found.bounds[owner + 1]) - 1
    return text.tobytes(), first[begin], first[last] + sizes[last], bounds


def simhash(block: Block) -> np.ndarray:
    """Fingerprint of each text of the block; of a text without words, zero."""
    text, starts, ends, bounds = shingle_spans(block)
    votes = np.zeros((block.count, 64), np.int64)
    for at in range(0, len(starts), _COUNTED):
        spans = zip(starts[at : at + _COUNTED].tolist(), ends[at : at + _COUNTED].tolist(), strict=True)
        hashed = np.fromiter((xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in spans), np.uint64)
        bits = np.unpackbits(hashed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        low = np.clip(bounds[:-1] - at, 0, len(hashed))
        some = np.flatnonzero(np.clip(bounds[1:] - at, 0, len(hashed)) > low)
        votes[some] += np.add.reduceat(bits, low[some], axis=0, dtype=np.int64)
    above = 2 * votes > np.diff(bounds)[:, None]
    return np.packbits(above, axis=1, bitorder="little").reshape(-1).view("<u8")


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in text_blocks(batch.column(1)):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(block.first, block.count), pa.array(simhash(block).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row of ``docs``; a null text has no words."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(
        _fingerprinted, "doc_id bigint, fp bigint")


def shared_bytes(difference: np.ndarray) -> np.ndarray:
    """Number of positional bytes that a pair shares, from the exclusive or of its fingerprints."""
    tally = np.zeros(len(difference), np.int8)
    for position in range(POSITIONS):
        tally += (difference >> np.uint64(8 * position)) & np.uint64(0xFF) == 0
    return tally


class Forest:
    """Trees over numbered rows; ``root`` is right after every ``join``."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            left, right = self.root[a], self.root[b]
            apart = left != right
            if not apart.any():
                return
            np.minimum.at(self.root, np.maximum(left, right)[apart], np.minimum(left, right)[apart])
            while (self.root != self.root[self.root]).any():
                self.root = self.root[self.root]


def list_links(run: np.ndarray, fp: np.ndarray, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the fingerprints of each list; ``run`` numbers the lists and ascends. Rows of equal ``label``
    count as connected."""
    forest = Forest(len(fp))
    if label is not None and len(label):
        order = np.lexsort((label, run))
        same = (run[order][1:] == run[order][:-1]) & (label[order][1:] == label[order][:-1])
        forest.join(order[1:][same], order[:-1][same])
    rows, step = np.arange(len(fp)), 1
    while len(rows):
        rows = rows[rows + step < len(fp)]
        rows = rows[run[rows] == run[rows + step]]
        apart = rows[forest.root[rows] != forest.root[rows + step]]
        difference = fp[apart] ^ fp[apart + step]
        some = shared_bytes(difference) >= LEAST_SHARED
        linked = apart[some][np.bitwise_count(difference[some]) <= BITS]
        forest.join(linked, linked + step)
        step += 1
    inner = np.flatnonzero(forest.root != np.arange(len(fp)))
    return fp[inner], fp[forest.root[inner]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the lists of (list columns ..., label, fp) rows that are sorted by list: the fingerprints of each tree of
    a list with its first one, which other members connect to it."""
    kept = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if kept is None else pa.concat_tables([kept, table])
        keys = [column.to_numpy() for column in table.columns[:-2]]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.logical_or.reduce([key[1:] != key[:-1] for key in keys])
        last = int(np.flatnonzero(new)[-1]) if table.num_rows else 0
        if last:
            yield _list_batch(table.slice(0, last), np.cumsum(new[:last]))
        kept = table.slice(last).combine_chunks()
    if kept is not None and kept.num_rows:
        yield _list_batch(kept, np.zeros(kept.num_rows, np.int64))


def _list_batch(table: pa.Table, run: np.ndarray) -> pa.RecordBatch:
    fp = table.column("fp").to_numpy().view(np.uint64)
    labels = table.column("label")
    a, b = list_links(run, fp, None if labels.null_count else labels.to_numpy())
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])


def _linked(lists: DataFrame, keys: list[str]) -> DataFrame:
    """Links (a, b) of all ``lists`` (keys, label, fp)."""
    dealt = lists.select(*keys, "label", "fp").repartition(*keys).sortWithinPartitions(*keys, "fp")
    return dealt.mapInArrow(_links, "a bigint, b bigint").distinct()


_KEYS = ["mask", "value"]


def _entries(members: DataFrame, masks: Column) -> DataFrame:
    """Index entries of (fp, ...) rows: the shared bytes' positions and values."""
    return members.select("fp", F.explode(masks).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))).withColumn(
        "label", F.lit(None).cast("bigint"))


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b), enough to connect every class of the different fingerprints ``fps`` (fp) that differ in at most
    BITS bits from one to the next."""
    entries = _entries(fps, F.array(*(F.lit(_mask(s)) for s in covering_sets())))
    found, unsettled = [], None
    for shared in range(3, POSITIONS):
        long = stored(entries.groupBy(*_KEYS).count().filter(F.col("count") > LIST), "long-lists")
        if not long.limit(1).count():
            found.append(stored(_linked(entries, _KEYS), "links"))
            break
        found.append(stored(_linked(entries.join(long, _KEYS, "left_anti"), _KEYS), "links"))
        members = stored(entries.join(long.select(*_KEYS), _KEYS, "left_semi"), "long-members")
        if shared == LEAST_SHARED:
            unsettled = members
        narrower = F.transform(F.filter(F.array(*(F.lit(_mask((p,))) for p in range(POSITIONS))), lambda m: F.col("mask").bitwiseAND(m) == 0),
                               lambda m: F.col("mask").bitwiseOR(m))
        entries = _entries(members, narrower).distinct()
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    if unsettled is not None:
        every = every.unionByName(_across(unsettled.select(*_KEYS, "fp"), components(every)))
    return every


def _across(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between members of a long list that have different ``labels`` so far.

    A list's members are cut into units of about LIST: a label with more has units of its own, which need not meet each
    other. Each pair of units that may hold a link is compared in one task, so the work grows with the members beside
    the largest label.
    """
    labelled = members.join(labels, members["fp"] == labels["node"], "left").select(
        *_KEYS, "fp", F.coalesce("label", "fp").alias("label"))
    sizes = labelled.groupBy(*_KEYS, "label").count()
    per_list = sizes.groupBy(*_KEYS).agg(F.sum(F.when(F.col("count") <= LIST, F.col("count")).otherwise(0)).alias("rest"))
    salted = labelled.join(sizes, [*_KEYS, "label"]).join(per_list, _KEYS).withColumn(
        "alone", F.when(F.col("count") > LIST, F.col("label")))
    parts = F.when(F.col("alone").isNotNull(), F.ceil(F.col("count") / LIST)).otherwise(F.greatest(F.ceil(F.col("rest") / LIST), F.lit(1)))
    units = stored(salted.withColumn("salt", F.pmod(F.xxhash64("fp"), parts)).select(
        *_KEYS, "fp", "label", "alone", F.xxhash64("alone", "salt").alias("unit")), "units")
    each = units.select(*_KEYS, "alone", "unit").distinct()
    one, other = each.alias("x"), each.select(*_KEYS, F.col("alone").alias("alone_2"), F.col("unit").alias("unit_2"))
    meet = stored(one.join(other, _KEYS).filter("unit <= unit_2 AND NOT (alone IS NOT NULL AND alone_2 IS NOT NULL AND alone = alone_2)"),
                  "unit-pairs").select(*_KEYS, "unit", "unit_2")
    sides = meet.select(*_KEYS, F.col("unit").alias("own"), "unit", "unit_2").unionByName(
        meet.select(*_KEYS, F.col("unit_2").alias("own"), "unit", "unit_2")).distinct()
    rows = units.withColumnRenamed("unit", "own").join(sides, [*_KEYS, "own"])
    return stored(_linked(rows, [*_KEYS, "unit", "unit_2"]), "links-across")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id.

    Fingerprints that differ in at most BITS bits are linked, and ``component_id`` is the smallest doc_id that links
    reach, the row's own included; null doc_ids count only where a component has no other, which then has a null one.
    A text without words, or a null one, has the fingerprint zero, linked like any other. Equal rows stay equal rows;
    other columns are not read.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "different-fingerprints")
    labels = components(links(fps.select("fp")))
    named = stored(fps.join(labels, fps["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "named")
    classes = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_fp = named.join(classes, "label").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
