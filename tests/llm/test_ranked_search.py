"""Ranked search against every document's score, computed term by term."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from gatehouse.llm import ranked_search
from gatehouse.llm.queries import ORACLE, QUERIES

DOCS = "doc_id long, text string, score string, term string"
BENCH = "item_id int, text string, rank string"
FOLDER = "/root/testdata/sf0.001"


def terms(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def expected(documents, benchmark, top=20):
    split = [(doc_id, Counter(own), len(own)) for doc_id, own in ((d, terms(t)) for d, t in documents) if own]
    n_docs, n_terms = len(split), sum(n for _, _, n in split)
    df = Counter(term for _, own, _ in split for term in own)
    out = []
    for item_id, text in set(benchmark):
        scored = []
        for doc_id, own, n in split:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * own[t]) // (1000 * own[t] + 12 * m))
                        for t in terms(text) if t in own)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id, score))
        out.extend((item_id, rank, doc_id, score) for rank, (_, _, doc_id, score) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:top], 1))
    return sorted(out, key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, rows, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 20, 60])))) for i in range(rows)]
    return docs + [(rows + i, docs[3][1]) for i in range(40)], [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)]


@pytest.mark.parametrize(("segment", "cells", "block"), [(10**6, 4_000_000, 32), (500, 4_000_000, 3), (2_000, 300, 2)])
def test_scores_match_for_any_cut(spark, monkeypatch, segment, cells, block):
    documents, benchmark = corpus(segment + block, 500)
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    monkeypatch.setattr(ranked_search, "_CELLS", cells)
    monkeypatch.setattr(ranked_search, "_KEPT_CELLS", 500)
    monkeypatch.setattr(ranked_search, "QUERIES_TOGETHER", 5)
    default = ranked_search.index_documents
    monkeypatch.setattr(ranked_search, "index_documents", lambda d, n, t: default(d, n, t, segment))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in documents], DOCS).repartition(3)
    bench = spark.createDataFrame([(i, t, "z") for i, t in benchmark], BENCH)
    assert found(ranked_search.search(docs, bench)) == expected(documents, benchmark)


def test_cases(spark):
    documents = [(1, None), (2, ""), (3, "... !!"), (4, "Alpha beta"), (4, "alpha BETA"), (None, "alpha beta"), (5, "long " * 30_000 + "alpha"),
                 (6, "Überfluß x_y"), (7, "ÜBERFLUß"), (8, "gamma 1 2 3"), (9, "delta"), (10, "epsilon zeta"), (11, "eta theta")]
    benchmark = [(1, "alpha Alpha"), (1, "alpha Alpha"), (1, "beta"), (2, None), (3, ""), (4, "überfluß x"), (None, "gamma"), (5, "unknown"), (6, "1-2;3")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in documents], DOCS)
    bench = spark.createDataFrame([(i, t, "z") for i, t in benchmark], BENCH)
    assert found(ranked_search.search(docs, bench)) == expected(documents, benchmark)


def test_empty_tables(spark):
    none, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "alpha", "z")], BENCH)
    assert ranked_search.search(none, bench).count() == 0
    assert ranked_search.search(spark.createDataFrame([(1, "alpha", "", "")], DOCS), bench.limit(0)).count() == 0


def test_blocks_are_skipped():
    """A query that one cluster answers leaves the other blocks of a common term unscored."""
    import numpy as np

    rng = np.random.default_rng(0)
    impacts = np.zeros((2000, 40), np.int32)
    impacts[:, 0] = rng.integers(1, 100, 2000)
    impacts[:200, 1:20] = rng.integers(5000, 9000, (200, 19))
    impacts[200:, 20:] = rng.integers(1, 50, (1800, 20))
    segment, scored = ranked_search.Segment(impacts), []
    whole = segment.scores
    segment.scores = lambda rows, terms, weights: scored.extend(rows) or whole(rows, terms, weights)
    query = np.arange(0, 20), np.ones(20, np.int64)
    rows, scores = ranked_search.best(segment, np.arange(2000), *query, 20)
    exact = impacts[:, :20].astype(np.int64).sum(axis=1)
    assert sorted(scores.tolist()) == sorted(np.sort(exact)[-20:].tolist())
    assert len(scored) < 400


def test_query_matches_sql(spark):
    database = duckdb.connect()
    for name in ("documents", "benchmark"):
        database.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    rows = sorted((tuple(r) for r in database.execute(ORACLE["op12_ranked_search"]).fetchall()), key=repr)
    assert rows and found(QUERIES["op12_ranked_search"](spark, FOLDER)) == rows
