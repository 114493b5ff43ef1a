"""Collocations against every n-gram counted directly."""

import random
import re
from collections import Counter
from itertools import groupby

import duckdb
import numpy as np
import pytest

from gatehouse.llm import collocations
from gatehouse.llm.queries import ORACLE, QUERIES

DOCS = "doc_id long, text string, lang string, n string, phrase string"
NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
FOLDER = "/root/testdata/sf0.001"


def expected(documents, least, longest=5, top=2000):
    counts, totals = Counter(), Counter()
    for text, lang in documents:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            own = tuple(re.findall(r"[^\x20\x09]+", piece))
            totals[lang] += len(own)
            counts.update((lang, own[i : i + size]) for size in range(1, longest + 1) for i in range(len(own) - size + 1))
    wanted = {(lang, words): a for (lang, words), a in counts.items() if a >= least and len(words) >= 2}
    hidden = {(lang, words[i : i + size]) for (lang, words), f in wanted.items() for size in range(2, len(words))
              for i in range(len(words) - size + 1) if f >= wanted[(lang, words[i : i + size])]}
    found = []
    for (lang, words), a in wanted.items():
        if (lang, words) not in hidden:
            score, k = min((1000 * a * totals[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words)))
            found.append((lang, -score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return [(lang, rank, phrase.decode(), -a, left, right, totals[lang], -score)
            for _, rows in groupby(sorted(found), key=lambda row: row[0])
            for rank, (lang, score, a, phrase, left, right) in enumerate(rows, 1) if rank <= top]


def rows(frame):
    return sorted(tuple(r[name] for name in NAMES) for r in frame.collect())


def invented(seed, n):
    rng = random.Random(seed)
    words = ["New", "york", "city", "of", "the", "Übersee", "hafen", "a b", "x\x00y", *(f"w{i}" for i in range(20))]
    return [(" ".join(rng.choices(words, k=rng.randint(0, 30))).replace("w1 ", "w1. ").replace("of ", rng.choice(["of ", "of the ", "of\n"])),
             rng.choice(["en", "de", None, "und"])) for _ in range(n)]


CASES = [(None, "en"), ("", "en"), (" \t. , \n", "de"), ("one two three four five six " * 4000, "en"), ("one two! One TWO? one two", None),
         ("a", "fr"), ("x" * 50_000, "fr"), ("a b a b a b a b a", "fr")]


@pytest.mark.parametrize(("least", "block_words"), [(2, 100), (5, 2_000_000), (20, 1000)])
def test_phrases_match_direct_counting(spark, monkeypatch, least, block_words):
    documents = invented(least, 400) + CASES
    default = collocations.word_blocks
    monkeypatch.setattr(collocations, "word_blocks", lambda docs, _: default(docs, block_words))
    monkeypatch.setattr(collocations, "BUCKET_WORDS", 1500)
    docs = spark.createDataFrame([(i, t, lang, "x", "y") for i, (t, lang) in enumerate(documents)], DOCS).repartition(3)
    assert rows(collocations.collocations(docs, least)) == expected(documents, least)


def test_top_and_shorter_phrases(spark):
    documents = invented(1, 200)
    docs = spark.createDataFrame([(i, t, lang, "x", "y") for i, (t, lang) in enumerate(documents)], DOCS)
    assert rows(collocations.collocations(docs, 3, longest=2, top=5)) == expected(documents, 3, 2, 5)


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    """With four fingerprints in all, only the text behind the pointers tells phrases apart."""
    default = collocations.Words.fingerprints
    monkeypatch.setattr(collocations.Words, "fingerprints", lambda self, starts, size: default(self, starts, size) % np.uint64(4))
    documents = invented(7, 150)
    docs = spark.createDataFrame([(i, t, lang, "x", "y") for i, (t, lang) in enumerate(documents)], DOCS)
    assert rows(collocations.collocations(docs, 4)) == expected(documents, 4)


def test_products_beyond_64_bits(spark):
    every = spark.createDataFrame([("en", "a", 1, 10**12), ("en", "b", 1, 10**12), ("en", "a b", 2, 10**12 - 1)], "lang string, phrase string, size int, f bigint")
    totals = spark.createDataFrame([("en", 10**13)], "lang string, n bigint")
    collocations_of = collocations.phrases
    try:
        collocations.phrases = lambda *_: (every, totals)
        found = rows(collocations.collocations(every))
    finally:
        collocations.phrases = collocations_of
    assert found[0][-1] == 1000 * (10**12 - 1) * 10**13 // 10**24


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, "", "")], DOCS)).count() == 0


def test_query_matches_sql(spark):
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    wanted = sorted(tuple(r) for r in database.execute(ORACLE["op13_collocations"]).fetchall())
    assert wanted and rows(QUERIES["op13_collocations"](spark, FOLDER)) == wanted
