"""Benchmark decontamination with a positional inverted index.

The index is cut by documents: a segment holds whole documents of about a million words, and for each of its terms the
sorted word positions (the postings). All postings of a document are in one segment, so a query needs no shuffle of
postings: every segment answers the benchmark, which is the stated query set and is written in blocks of bounded size;
a task holds one segment and one block at a time, and only what documents hold of a block is put together. A window's
postings are intersected from its rarest term in the segment, each list shifted by the term's offset.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from gatehouse.llm.arrow_text import text_blocks, word_hashes
from gatehouse.llm.rows import stored, without

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEGMENT_WORDS = 1_000_000
WINDOW = 10
BLOCK_WINDOWS = 200_000
_STEP = 1_000_000

_INDEX = pa.schema([
    ("seg", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("text_keys", pa.list_(pa.int64())), ("word_starts", pa.list_(pa.int64())),
    ("terms", pa.binary()), ("term_starts", pa.binary()), ("postings", pa.binary()),
])
_FOUND = pa.schema([
    ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
    ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("n_near", pa.int64()),
])


class Queries(NamedTuple):
    """A block of distinct windows: rows of term numbers (-1 beyond a short window) and the items that hold each."""

    terms: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    item_bounds: np.ndarray
    items: list[str]


def index_documents(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Write the positional index of ``docs`` (doc_id, text) to the shared scratch folder and return it.

    One row, and one file, per segment, as readers and writers hold many rows at a time; every row of ``docs`` is in exactly
    one segment, also repeated ones and those without words.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").alias("text")
    )
    return stored(rows.mapInArrow(
        lambda batches: _segments(batches, segment_words), "seg bigint, doc_ids array<bigint>, text_keys array<bigint>,"
        "word_starts array<bigint>, terms binary, term_starts binary, postings binary"), "positional-index", maxRecordsPerFile=1)


def _segments(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    ids, keys, counts, hashes, size = [], [], [], [], 0
    seg = TaskContext.get().partitionId() << 24
    for batch in batches:
        for block in text_blocks(batch.column(2)):
            words, bounds = word_hashes(block)
            part = batch.slice(block.first, block.count)
            ids.extend(part.column(0).to_pylist())
            keys.extend(part.column(1).to_pylist())
            counts.append(np.diff(bounds))
            hashes.append(words)
            size += len(words)
            if size >= limit or len(ids) >= limit:
                yield _segment(seg, ids, keys, counts, hashes)
                ids, keys, counts, hashes, size, seg = [], [], [], [], 0, seg + 1
    if ids:
        yield _segment(seg, ids, keys, counts, hashes)


def _segment(seg: int, ids: list, keys: list, counts: list, hashes: list) -> pa.RecordBatch:
    words = np.concatenate(hashes)
    starts = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)
    order = np.argsort(words, kind="stable")
    ranked = words[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.empty(0, np.int64)
    blob = [ranked[first].tobytes(), np.append(first, len(ranked)).astype(np.int64).tobytes(), order.astype(np.int32).tobytes()]
    return pa.RecordBatch.from_arrays(
        [pa.array([seg]), pa.array([ids], _INDEX[1].type), pa.array([keys], _INDEX[2].type), pa.array([starts], _INDEX[3].type),
         *(pa.array([x], pa.binary()) for x in blob)], schema=_INDEX)


def query_blocks(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(windows): the benchmark's distinct windows with the items that hold each, about BLOCK_WINDOWS a row, written to the
    shared scratch folder.

    An item with fewer words than ``window``, but not none, is one window. A null text has no words; a null item_id
    counts as the item named "null"; items that repeat an item_id count as one.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").alias("text"))
    held = items.mapInArrow(lambda batches: _windows(batches, window), "item string, window binary")
    found = stored(held.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items")), "windows")
    blocks = max(1, -(-found.count() // BLOCK_WINDOWS))
    together = found.groupBy(F.pmod(F.xxhash64("window"), F.lit(blocks))).agg(F.collect_list(F.struct("window", "items")).alias("windows"))
    return stored(together.select("windows"), "query-blocks")


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in text_blocks(batch.column(1)):
            words, bounds = word_hashes(block)
            names, found = [], []
            for i in range(block.count):
                own = words[bounds[i] : bounds[i + 1]]
                for at in range(max(len(own) - window + 1, min(len(own), 1))):
                    names.append(block.first + i)
                    found.append(own[at : at + window].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(names, pa.int64())), pa.array(found, pa.binary())], names=["item", "window"])


def _queries(windows: pa.ListScalar, window: int) -> Queries:
    """The block of a row of ``query_blocks``."""
    held = windows.values
    rows = [np.frombuffer(x.as_buffer(), np.uint64) for x in held.field("window")]
    items = held.field("items").to_pylist()
    terms = np.unique(np.concatenate(rows))
    out = np.full((len(rows), window), -1, np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = np.searchsorted(terms, row)
    return Queries(terms, out, np.array([len(x) for x in rows]), np.cumsum([0, *map(len, items)]), [i for x in items for i in x])


class Postings:
    """The postings of a query block's terms in one segment, as one sorted array of (term number, position)."""

    def __init__(self, terms: np.ndarray, term_starts: np.ndarray, postings: np.ndarray, wanted: np.ndarray):
        self.size = len(postings) + 1
        at = np.searchsorted(terms, wanted)
        there = at < len(terms)
        there[there] = terms[at[there]] == wanted[there]
        low = np.where(there, term_starts[np.minimum(at, len(term_starts) - 1)], 0)
        high = np.where(there, term_starts[np.minimum(at + 1, len(term_starts) - 1)], 0)
        self.count = high - low
        self.start = np.concatenate([[0], np.cumsum(self.count)])
        take = np.arange(self.start[-1]) + np.repeat(low - self.start[:-1], self.count)
        self.keys = np.repeat(np.arange(len(wanted)), self.count) * self.size + postings[take]

    def positions(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``term`` all its positions, with the number of the one it belongs to."""
        count = self.count[term]
        owner = np.repeat(np.arange(len(term)), count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + self.start[term][owner]
        return owner, self.keys[at] % self.size

    def holds(self, term: np.ndarray, position: np.ndarray, slop: int = 0, first=0, end=None) -> np.ndarray:
        """Whether the term stands at the position, or at most ``slop`` words from it, from ``first`` on and before ``end``."""
        low = np.maximum(position - slop, first)
        high = np.minimum(position + slop, (self.size - 1 if end is None else end) - 1)
        at = np.searchsorted(self.keys, term * self.size + low)
        found = (at < len(self.keys)) & (low <= high)
        found[found] = self.keys[at[found]] <= (term * self.size + high)[found]
        return found


def matches(postings: Postings, queries: Queries, word_starts: np.ndarray):
    """Exact matches as (window, position), a bounded number of candidates, the positions of a window's rarest term, at a
    time."""
    order, count = _by_rarity(postings, queries)
    for part in _parts(count[:, 0]):
        owner, position = postings.positions(queries.windows[part, order[part, 0]])
        window = part[owner]
        start = position - order[window, 0]
        document = np.searchsorted(word_starts, position, "right") - 1
        fits = (start >= word_starts[document]) & (start + queries.lengths[window] <= word_starts[document + 1])
        exact, exact_at = window[fits], start[fits]
        for k in range(1, queries.windows.shape[1]):
            place = order[exact, k]
            term = queries.windows[exact, place]
            keep = (term < 0) | postings.holds(np.maximum(term, 0), exact_at + place)
            exact, exact_at = exact[keep], exact_at[keep]
        yield exact, exact_at


def near_matches(postings: Postings, queries: Queries, word_starts: np.ndarray, slop: int, share: float):
    """Proximity matches as (window, document): from some start, at least ``share`` of the window's words are in the
    document, each at most ``slop`` words from its place.

    A match lacks at most ``spare`` words, so it has one of the ``spare + 1`` rarest. The positions of each of these are
    candidates for the matches that lack all rarer ones; how the rows are cut into segments changes only their order.
    """
    order, count = _by_rarity(postings, queries)
    needed = np.ceil(share * queries.lengths - 1e-9).astype(np.int64)
    spare = queries.lengths - needed
    for rank in range(int(spare.max(initial=-1)) + 1):
        for part in _parts(np.where(spare >= rank, count[:, rank], 0)):
            owner, position = postings.positions(queries.windows[part, order[part, rank]])
            window = part[owner]
            start = position - order[window, rank]
            document = np.searchsorted(word_starts, position, "right") - 1
            # The start may be ``slop`` words off, which puts a word at most twice as far from here.
            lacking = np.full(len(window), rank)
            for k in range(rank + 1, queries.windows.shape[1]):
                place = order[window, k]
                term = queries.windows[window, place]
                lacking += (term >= 0) & ~postings.holds(
                    np.maximum(term, 0), start + place, 2 * slop, word_starts[document], word_starts[document + 1])
                keep = lacking <= spare[window]
                window, start, document, lacking = window[keep], start[keep], document[keep], lacking[keep]
            window, start, document = np.unique(np.stack([window, start, document]), axis=1)
            for shift in sorted(range(-slop, slop + 1), key=abs):
                near = np.zeros(len(window), np.int64)
                for k in range(queries.windows.shape[1]):
                    term = queries.windows[window, k]
                    near += (term >= 0) & postings.holds(
                        np.maximum(term, 0), start + shift + k, slop, word_starts[document], word_starts[document + 1])
                found = near >= needed[window]
                yield window[found], document[found]
                window, start, document = window[~found], start[~found], document[~found]


def _by_rarity(postings: Postings, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts): the places of each window from its rarest term in the segment on, and how often these occur."""
    count = np.where(queries.windows >= 0, postings.count[queries.windows], np.iinfo(np.int64).max)
    order = np.argsort(count, axis=1, kind="stable")
    return order, np.take_along_axis(count, order, 1)


def _parts(count: np.ndarray) -> list[np.ndarray]:
    """Windows with candidates, in parts of about _STEP candidates."""
    alive = np.flatnonzero(count > 0)
    group = np.cumsum(count[alive]) // _STEP
    return np.split(alive, np.flatnonzero(np.diff(group)) + 1) if len(alive) else []


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 3, share: float = 0.8) -> DataFrame:
    """One row per indexed document: its words, those inside an occurring window, and the items that occur.

    ``n_near`` counts items with a proximity match. Documents without words, and all of them when the benchmark is
    empty, have zeros and the digest of the empty text.
    """
    # Every segment meets every block of the stated queries; Spark broadcasts the smaller side if its size allows it.
    pairs = index.crossJoin(query_blocks(benchmark, window))
    found = pairs.mapInArrow(
        lambda batches: _answers(batches, window, slop, share),
        "seg bigint, document int, hit binary, items array<string>, near array<string>")
    listed = index.select("seg", "doc_ids", "text_keys", "word_starts")
    return listed.groupBy("seg").cogroup(found.groupBy("seg")).applyInArrow(
        _together, "doc_id bigint, text_key bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string,"
        "contaminated boolean, n_near bigint")


def _answers(batches: Iterator[pa.RecordBatch], window: int, slop: int, share: float) -> Iterator[pa.RecordBatch]:
    """What the documents of each (segment, block) row hold of the block; others have no row."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            yield _answer(row, _queries(row["windows"], window), slop, share)


def _answer(row: dict, queries: Queries, slop: int, share: float) -> pa.RecordBatch:
    terms, term_starts, postings = (
        np.frombuffer(row[name].as_buffer(), kind)
        for name, kind in (("terms", np.uint64), ("term_starts", np.int64), ("postings", np.int32))
    )
    word_starts = row["word_starts"].values.to_numpy()
    edges = np.zeros(len(postings) + 1, np.int32)
    items: dict[int, set[str]] = {}
    near: dict[int, set[str]] = {}
    found = Postings(terms, term_starts, postings, queries.terms)
    for window, start in matches(found, queries, word_starts):
        np.add.at(edges, start, 1)
        np.add.at(edges, start + queries.lengths[window], -1)
        _note(items, queries, window, np.searchsorted(word_starts, start, "right") - 1)
    for window, document in near_matches(found, queries, word_starts, slop, share):
        _note(near, queries, window, document)
    hit = np.cumsum(edges[:-1]) > 0
    some = sorted({*items, *near})
    places = [np.flatnonzero(hit[word_starts[d] : word_starts[d + 1]]).astype(np.int32).tobytes() for d in some]
    names = pa.list_(pa.string())
    return pa.RecordBatch.from_arrays([
        pa.array([row["seg"].as_py()] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(places, pa.binary()),
        pa.array([sorted(items.get(d, ())) for d in some], names), pa.array([sorted(near.get(d, ())) for d in some], names),
    ], names=["seg", "document", "hit", "items", "near"])


def _note(items: dict[int, set[str]], queries: Queries, window: np.ndarray, document: np.ndarray) -> None:
    for d, w in np.unique(np.stack([document, window], 1), axis=0).tolist():
        items.setdefault(d, set()).update(queries.items[queries.item_bounds[w] : queries.item_bounds[w + 1]])


def _together(segment: pa.Table, found: pa.Table) -> pa.Table:
    """One row per document of a segment, from what it holds of each block."""
    doc_ids, text_keys, word_starts = (segment.column(name).combine_chunks()[0].values for name in ("doc_ids", "text_keys", "word_starts"))
    hit: dict[int, np.ndarray] = {}
    items: dict[int, set[str]] = {}
    near: dict[int, set[str]] = {}
    for d, places, own, close in zip(*(found.column(name).to_pylist() for name in ("document", "hit", "items", "near")), strict=True):
        hit[d] = np.union1d(hit.get(d, np.empty(0, np.int32)), np.frombuffer(places, np.int32))
        items.setdefault(d, set()).update(own)
        near.setdefault(d, set()).update(close)
    rows = range(len(doc_ids))
    n_hit = [len(hit.get(d, ())) for d in rows]
    empty = hashlib.sha256(b"").hexdigest()
    names = [hashlib.sha256(",".join(sorted(items[d])).encode()).hexdigest() if d in items else empty for d in rows]
    return pa.Table.from_arrays([
        doc_ids, text_keys, pa.array(np.diff(word_starts.to_numpy())), pa.array(n_hit, pa.int64()),
        pa.array([len(items.get(d, ())) for d in rows], pa.int64()), pa.array(names, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_()),
        pa.array([len(near.get(d, ())) for d in rows], pa.int64()),
    ], schema=_FOUND)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: see ``search``. ``text_key`` is ``xxhash64(text)``, to join the result back to rows."""
    return search(index_documents(docs), benchmark, window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; null ids and repeated rows are judged by their text."""
    return without(docs, lambda: contamination(docs, benchmark, window).filter("contaminated"))
