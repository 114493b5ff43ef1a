"""Ranked lexical search with per-term geometric blocking.

Documents are indexed in segments of about a million terms: the terms that occur, and every document's vector of
impacts, the part of a score that does not depend on the query. Every segment answers every block of queries. There, a
term's posting list is clustered into blocks by the similarity of its documents, as soon as a query opens the list, and
each block has the coordinatewise maximum of its documents' vectors. The product of a query with that summary bounds the
score of every document of the block, so a block is skipped only if its bound is below the least of the highest scores
found so far; all other documents are scored exactly. A query opens its lists by falling bound and stops when all lists
left cannot reach that score together.

All arithmetic is in 64-bit integers, so bounds and scores are exact. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from gatehouse.llm.arrow_text import text_blocks, word_hashes
from gatehouse.llm.rows import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP = 20
SEGMENT_TERMS = 1_000_000
#: Documents of a block on average; a shorter list is one block, and needs no summary.
BLOCK = 32
#: Queries that are answered together.
QUERIES_TOGETHER = 256
#: Cells of the matrix of documents by query terms that a task holds, and of the summaries it keeps.
_CELLS, _KEPT_CELLS = 4_000_000, 16_000_000
#: Distinct (text, term) pairs after which a task adds up its counts.
_ADDED = 4_000_000
_DIMENSIONS = 64
#: Fixed values of the score.
_SATURATION, _SCALE, _LENGTH = 12, 1_000_000_000, 25

_DOCUMENTS, _TERMS, _DF = 0, 1, 2


def _different(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, documents, numbers, tf): the block's sorted terms, and per document each of its terms once."""
    terms, number = np.unique(words, return_inverse=True)
    document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pair, tf = np.unique(document * max(1, len(terms)) + number, return_counts=True)
    return terms, pair // max(1, len(terms)), pair % max(1, len(terms)), tf


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, term, n) of a task: documents with a term, all terms, and documents that hold each term."""
    found, n, size, totals = [], [], 0, [0, 0]

    def added():
        terms, at = np.unique(np.concatenate(found), return_inverse=True)
        return [terms], [np.bincount(at, np.concatenate(n)).astype(np.int64)]

    for batch in batches:
        for block in text_blocks(batch.column(0)):
            words, bounds = word_hashes(block)
            totals[0] += int((np.diff(bounds) > 0).sum())
            totals[1] += len(words)
            terms, _, number, _ = _different(words, bounds)
            found.append(terms)
            n.append(np.bincount(number, minlength=len(terms)))
            size += len(terms)
            if size >= _ADDED:
                found, n = added()
                size = 0
    terms, n = added() if found else ([np.empty(0, np.uint64)], [np.empty(0, np.int64)])
    for at in range(0, len(terms[0]), 100_000):
        part = terms[0][at : at + 100_000].view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(part), _DF, np.int32)), pa.array(part), pa.array(n[0][at : at + 100_000])], names=["kind", "term", "n"])
    yield pa.RecordBatch.from_arrays(
        [pa.array([_DOCUMENTS, _TERMS], pa.int32()), pa.array([0, 0], pa.int64()), pa.array(totals, pa.int64())], names=["kind", "term", "n"])


def statistics(docs: DataFrame) -> DataFrame:
    """(kind, term, n) over all rows of ``docs``: the number of documents with a term (kind 0), of all terms with repeats
    (1), and of the documents that hold a term (2)."""
    counted = docs.select(F.col("text").alias("text")).mapInArrow(_counted, "kind int, term bigint, n bigint")
    return stored(counted.groupBy("kind", "term").agg(F.sum("n").alias("n")), "term-statistics")


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in text_blocks(batch.column(2)):
            words, bounds = word_hashes(block)
            terms, row, number, tf = _different(words, bounds)
            at = pa.array(block.first + row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(terms[number].view(np.int64)), pa.array(tf.astype(np.int64))],
                names=["item_id", "text_key", "term", "times"])


def query_blocks(benchmark: DataFrame, counted: DataFrame, documents: int, together: int = QUERIES_TOGETHER) -> DataFrame:
    """(items): blocks of about ``together`` queries, each a list of (item_id, text_key, terms, weights). Rows of
    ``benchmark`` that repeat item_id and text are one query; a term that no document holds is left out."""
    kind = benchmark.schema["item_id"].dataType.simpleString()
    texts = benchmark.select(F.col("item_id"), F.xxhash64("text").alias("text_key"), F.col("text").alias("text")).dropDuplicates(
        ["item_id", "text_key"])
    terms = texts.mapInArrow(_query_terms, f"item_id {kind}, text_key bigint, term bigint, times bigint")
    known = counted.filter(F.col("kind") == _DF).select("term", F.col("n").alias("df"))
    ratio = F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1).cast("double")
    weighed = terms.join(known, "term").withColumn("weight", F.col("times") * F.floor(1000 * F.log(ratio)))
    items = stored(weighed.groupBy("item_id", "text_key").agg(
        F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("own")), "queries")
    blocks = max(1, -(-items.count() // together))
    each = F.struct("item_id", "text_key", F.col("own.term").alias("terms"), F.col("own.weight").alias("weights"))
    return stored(items.groupBy(F.pmod(F.xxhash64("item_id", "text_key"), F.lit(blocks))).agg(F.collect_list(each).alias("items")).select("items"),
                  "query-blocks")


def _segments(batches: Iterator[pa.RecordBatch], documents: int, terms: int, limit: int) -> Iterator[pa.RecordBatch]:
    ids, hashes, counts, size = [], [], [], 0
    for batch in batches:
        for block in text_blocks(batch.column(1)):
            words, bounds = word_hashes(block)
            ids.extend(batch.column(0).slice(block.first, block.count).to_pylist())
            hashes.append(words)
            counts.append(np.diff(bounds))
            size += len(words)
            if size >= limit or len(ids) >= limit:
                yield _segment(ids, hashes, counts, documents, terms)
                ids, hashes, counts, size = [], [], [], 0
    if size:
        yield _segment(ids, hashes, counts, documents, terms)


def _segment(ids: list, hashes: list, counts: list, documents: int, terms: int) -> pa.RecordBatch:
    n = np.concatenate(counts).astype(np.int64)
    own, row, number, tf = _different(np.concatenate(hashes), np.concatenate([[0], np.cumsum(n)]))
    length = 100 - _LENGTH + (_LENGTH * n * documents) // terms
    impact = (_SCALE * tf) // (1000 * tf + _SATURATION * length[row])
    starts = np.searchsorted(row, np.arange(len(n) + 1))
    blobs = [own, starts.astype(np.int64), number.astype(np.int32), impact.astype(np.int32)]
    return pa.RecordBatch.from_arrays(
        [pa.array([ids], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)],
        names=["doc_ids", "terms", "starts", "numbers", "impacts"])


def index_documents(docs: DataFrame, documents: int, terms: int, segment_terms: int = SEGMENT_TERMS) -> DataFrame:
    """Write the segments of ``docs`` to the shared scratch folder and return them; rows without a term are in none that
    could be found, all others in exactly one."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    return stored(rows.mapInArrow(
        lambda batches: _segments(batches, documents, terms, segment_terms),
        "doc_ids array<bigint>, terms binary, starts binary, numbers binary, impacts binary"), "search-segments")


class PostingList(NamedTuple):
    """Documents of a term, cut into blocks, with the blocks' maxima; a list of one block has none."""

    documents: np.ndarray
    bounds: np.ndarray
    summary: np.ndarray | None


class Segment:
    """Impacts of some documents of a segment by the terms of a query block, and the lists that queries have opened."""

    def __init__(self, impacts: np.ndarray):
        self.impacts = impacts
        self.most = impacts.max(axis=0, initial=0).astype(np.int64)
        self.lists: dict[int, PostingList] = {}
        self.kept = 0
        sign = np.random.default_rng(impacts.shape[1]).choice(np.array([-1, 1], np.float32), (impacts.shape[1], _DIMENSIONS))
        direction = impacts.astype(np.float32) @ sign
        self.direction = direction / np.maximum(np.linalg.norm(direction, axis=1, keepdims=True), 1e-9)

    def opened(self, term: int) -> PostingList:
        """The term's list, clustered around evenly chosen ones of its documents."""
        if term not in self.lists:
            documents = np.flatnonzero(self.impacts[:, term])
            if len(documents) <= BLOCK:
                made = PostingList(documents, np.array([0, len(documents)]), None)
            else:
                near = (self.direction[documents] @ self.direction[documents[::BLOCK]].T).argmax(axis=1)
                order = np.argsort(near, kind="stable")
                first = np.flatnonzero(np.diff(near[order], prepend=-1))
                documents = documents[order]
                made = PostingList(
                    documents, np.append(first, len(documents)), np.maximum.reduceat(self.impacts[documents], first, axis=0))
            size = 0 if made.summary is None else made.summary.size
            if self.kept + size > _KEPT_CELLS:
                self.lists, self.kept = {}, 0
            self.lists[term] = made
            self.kept += size
        return self.lists[term]

    def scores(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return self.impacts[np.ix_(rows, terms)].astype(np.int64) @ weights


def best(segment: Segment, doc_ids: np.ndarray, terms: np.ndarray, weights: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the segment's ``top`` documents by score, then doc_id, with score above 0."""
    bound = weights * segment.most[terms]
    order = np.argsort(-bound, kind="stable")
    left = int(bound.sum())
    scored = np.zeros(len(segment.impacts), bool)
    rows, scores, least = np.empty(0, np.int64), np.empty(0, np.int64), 1

    def score(documents: np.ndarray) -> None:
        nonlocal rows, scores, least
        new = documents[~scored[documents]]
        if not len(new):
            return
        scored[new] = True
        found = segment.scores(new, terms, weights)
        rows, scores = np.append(rows, new[found >= least]), np.append(scores, found[found >= least])
        keep = np.lexsort((doc_ids[rows], -scores))[:top]
        rows, scores = rows[keep], scores[keep]
        if len(rows) == top:
            least = int(scores[-1])

    for place in order:
        if left < least:
            break
        own = segment.opened(int(terms[place]))
        left -= int(bound[place])
        if own.summary is None:
            score(own.documents)
            continue
        reach = own.summary[:, terms].astype(np.int64) @ weights
        ranked = np.argsort(-reach, kind="stable")
        at, step = 0, 1
        while at < len(ranked) and reach[ranked[at]] >= least:
            part = [b for b in ranked[at : at + step] if reach[b] >= least]
            score(np.concatenate([own.documents[own.bounds[b] : own.bounds[b + 1]] for b in part]))
            at, step = at + step, step * 2
    return rows, scores


def _answers(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """The best documents of each (segment, query block) row."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield from _answered({name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}, top)


def _answered(row: dict, top: int) -> Iterator[pa.RecordBatch]:
    terms, starts, numbers, impacts = (
        np.frombuffer(row[name].as_buffer(), kind)
        for name, kind in (("terms", np.uint64), ("starts", np.int64), ("numbers", np.int32), ("impacts", np.int32)))
    ids = row["doc_ids"].values
    # Null ids come last among equal scores.
    doc_ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
    items = row["items"].values
    bounds = items.field("terms").offsets.to_numpy()
    wanted = items.field("terms").flatten().to_numpy().view(np.uint64)
    weights = items.field("weights").flatten().to_numpy()
    bounds = bounds - bounds[0]
    vocabulary = np.intersect1d(wanted, terms)
    if not len(vocabulary):
        return
    column = np.full(len(terms), -1, np.int64)
    column[np.searchsorted(terms, vocabulary)] = np.arange(len(vocabulary))
    at = np.minimum(np.searchsorted(vocabulary, wanted), len(vocabulary) - 1)
    known = vocabulary[at] == wanted
    step = max(1, _CELLS // len(vocabulary))
    for first in range(0, len(starts) - 1, step):
        last = min(first + step, len(starts) - 1)
        cells = slice(starts[first], starts[last])
        inside = column[numbers[cells]] >= 0
        matrix = np.zeros((last - first, len(vocabulary)), np.int32)
        owner = np.repeat(np.arange(last - first), np.diff(starts[first : last + 1]))
        matrix[owner[inside], column[numbers[cells]][inside]] = impacts[cells][inside]
        segment = Segment(matrix)
        found, where, scores = [], [], []
        for q in range(len(bounds) - 1):
            own = np.arange(bounds[q], bounds[q + 1])
            own = own[known[own] & (weights[own] > 0)]
            rows, values = best(segment, doc_ids[first:last], at[own], weights[own], top)
            found.append(np.full(len(rows), q))
            where.append(rows + first)
            scores.append(values)
        query = pa.array(np.concatenate(found).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [items.field("item_id").take(query), items.field("text_key").take(query), ids.take(pa.array(np.concatenate(where))),
             pa.array(np.concatenate(scores))], names=["item_id", "text_key", "doc_id", "score"])


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, text_key, rank, doc_id, score): the ``top`` highest-scoring rows of ``docs`` for each row of
    ``benchmark``, all with a score above 0 if fewer; equal scores by ascending doc_id, a null one last.

    Rows of ``docs`` that repeat a doc_id are documents of their own. Rows of ``benchmark`` that repeat item_id and text
    are one query, those that share only an item_id are ranked apart (``text_key`` tells which). A null or empty text has
    no terms, and no other column is read.
    """
    counted = statistics(docs)
    totals = {row["kind"]: row["n"] for row in counted.filter(F.col("kind") != _DF).collect()}
    documents, terms = totals.get(_DOCUMENTS, 0), totals.get(_TERMS, 0)
    kind = benchmark.schema["item_id"].dataType.simpleString()
    queries = query_blocks(benchmark, counted, documents)
    # Every segment meets every block of the stated queries; Spark broadcasts the smaller side if its size allows it.
    pairs = index_documents(docs, documents, max(1, terms)).crossJoin(queries)
    found = pairs.mapInArrow(lambda batches: _answers(batches, top), f"item_id {kind}, text_key bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("item_id", "text_key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "item_id", "text_key", "rank", "doc_id", "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: DuckDB SQL that scores every document that has a term of the item.
CHECKING_SQL = f"""
WITH split AS (
  SELECT row_number() OVER () AS line, doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_PATTERN}')) AS term
  FROM documents),
posting AS (SELECT line, doc_id, term, count(*) AS tf FROM split GROUP BY ALL),
size AS (SELECT line, count(*) AS n FROM split GROUP BY line),
total AS (SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS terms FROM size),
weight AS (
  SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM posting, total GROUP BY term, documents),
query AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_PATTERN}')) AS term FROM benchmark)
  GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, line,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * documents) // terms)))))::BIGINT AS score
  FROM query JOIN weight USING (term) JOIN posting USING (term) JOIN size USING (line), total
  GROUP BY item_id, doc_id, line)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= {TOP}"""
