"""Positional index against the contract read literally."""

import hashlib
import random
import re

import pytest

from gatehouse.llm import decontaminate
from gatehouse.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, n_words string"


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def expected(documents, benchmark, window=10):
    wanted = {}
    for item, text in benchmark:
        own = words(text)
        for at in range(max(len(own) - window + 1, min(len(own), 1))):
            wanted.setdefault(tuple(own[at : at + window]), set()).add("null" if item is None else str(item))
    lengths = {len(x) for x in wanted}
    out = []
    for doc_id, text in documents:
        own, hit, items = words(text), set(), set()
        for size in lengths:
            for i in range(len(own) - size + 1):
                found = wanted.get(tuple(own[i : i + size]))
                if found:
                    hit.update(range(i, i + size))
                    items |= found
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(items), digest, bool(hit)))
    return sorted(out, key=repr)


def rows(frame):
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=repr)


ITEM = "One two three four five six seven eight nine ten eleven twelve"
CASES = [
    (1, f"x {ITEM} y"), (1, f"x {ITEM} y"), (2, None), (3, ""), (4, "!!! ..."), (None, ITEM.upper()),
    (5, "one two three four five six seven eight nine"), (6, "Short Überfluß item"), (7, "a " * 3000 + ITEM + " b" * 3000),
    (8, "one-two,three.four;five six\tseven\neight nine ten"), (9, "the the the the"),
    (10, "one two three four five six seven EIGHTH nine ten"),
]
BENCH = [(1, ITEM), (2, "short überfluß ITEM"), (3, None), (None, "the the"), (4, ""), (1, "the"), (5, ITEM)]


def test_cases_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en", "x") for i, t in CASES], DOCS)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert rows(decontaminate.contamination(docs, bench)) == expected(CASES, BENCH)


def test_blocks_and_small_segments_give_the_same_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, "en", "x") for i, t in CASES], DOCS)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 2)
    monkeypatch.setattr(decontaminate, "_STEP", 3)
    assert decontaminate.query_blocks(bench).count() > 1
    index = decontaminate.index_documents(docs, segment_words=5)
    assert rows(decontaminate.search(index, bench)) == expected(CASES, BENCH)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontaminate.contamination(docs, bench).count() == 0
    some = spark.createDataFrame([(1, ITEM, "en", "x")], DOCS)
    assert rows(decontaminate.contamination(some, bench.limit(0))) == expected([(1, ITEM)], [])


def test_proximity_match(spark):
    docs = spark.createDataFrame([(1, "one two three four so five six seven eight nine ten", "en", "x")], DOCS)
    found = decontaminate.contamination(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).first()
    assert not found["contaminated"] and found["n_near"] == 1


def near_items(documents, benchmark, window=10, slop=3):
    """doc_id -> items, by every start of every window."""
    out = {}
    for doc_id, text in documents:
        own = words(text)
        places = {}
        for i, word in enumerate(own):
            places.setdefault(word, []).append(i)
        for item, passage in benchmark:
            of_item = words(passage)
            for at in range(max(len(of_item) - window + 1, min(len(of_item), 1))):
                part = of_item[at : at + window]
                if any(5 * sum(any(abs(p - start - k) <= slop for p in places.get(w, ())) for k, w in enumerate(part)) >= 4 * len(part)
                       for start in range(-window - slop, len(own) + slop)):
                    out.setdefault(doc_id, set()).add(item)
    return {doc_id: len(out.get(doc_id, ())) for doc_id, _ in documents}


def test_proximity_with_the_rarest_word_replaced(spark):
    docs = [(1, "one two three four five six seven eight rare ten"), (2, "one two three four five six seven eight other ten"),
            (3, "one two three four five"), (4, "six seven eight rare ten"), (5, "one two"),
            (6, "two one three four so so five six ten seven eight")] + [(10 + i, "one two three four five six seven eight") for i in range(5)]
    bench = [(1, docs[0][1]), (2, "alpha beta"), (3, "two three four five six")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame(bench, "item_id long, text string")
    expected_near = near_items(docs, bench)
    assert expected_near[2] == 2 and expected_near[4] == 0
    for size in (1, 12, 1_000_000):
        index = decontaminate.index_documents(frame, segment_words=size)
        assert {r.doc_id: r.n_near for r in decontaminate.search(index, items).collect()} == expected_near


def test_proximity_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "_STEP", 7)
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnopqrst") for _ in range(n))
    bench = [(i, text(rng.choice([3, 6, 10, 13]))) for i in range(12)]
    docs = []
    for i in range(60):
        own = rng.choice(bench)[1].split()
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(own))
            own[at : at + 1] = [[], ["z"], [own[at], "z"]][rng.randrange(3)]
            own = own or ["z"]
        docs.append((i, " ".join([text(rng.randint(0, 9)), *own, text(rng.randint(0, 9))])))
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    items = spark.createDataFrame(bench, "item_id long, text string")
    for size in (20, 1_000_000):
        index = decontaminate.index_documents(frame, segment_words=size)
        assert {r.doc_id: r.n_near for r in decontaminate.search(index, items).collect()} == near_items(docs, bench)


def test_clean_rows_stay(spark):
    docs = spark.createDataFrame([(i, t, "en", "x") for i, t in CASES], DOCS)
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    bad = [r[0] for r in expected(CASES, [(1, ITEM)]) if r[5]]
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, (i for i, t in CASES if i not in bad)))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_query_matches_brute_force(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows(QUERIES["op10_decontaminate"](spark, folder)) == expected(docs, bench)


def test_every_segment_is_a_file(spark):
    docs = spark.createDataFrame([(i, "one " * 300_000) for i in range(3)], "doc_id long, text string").coalesce(1)
    index = decontaminate.index_documents(docs, 1000)
    assert index.count() == len(index.inputFiles()) == 3
