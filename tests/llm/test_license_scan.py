"""License phrases against the contract read literally, and the query against its SQL."""

import re

import duckdb

from gatehouse.llm import license_scan
from gatehouse.llm.queries import ORACLE, QUERIES

PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def expected(doc_id, text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = [(i, label) for label, phrase in PHRASES.items() for i in range(len(words))
             if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return (doc_id, len(words), len(found), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in found})))


def rows(frame):
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=repr)


CASES = [
    None, "", "...", "Under THE (MIT) license. under the mit license under the mit", "apache\x00license,version-2.0 Apache License",
    "cc-by-nc 4.0 CC BY NC cc by cc by nc", "under the miKt license", "K İ under the MIT License", "le MIT license",
    "w " * 4000 + "under the mit license " * 50, "nc", "mit mit license the", "GNU General Public License, version 3.",
]


def test_cases(spark):
    data = [(i, t, "x", 1) for i, t in enumerate(CASES)] + [(None, "cc by nc", "y", 2)] * 2
    docs = spark.createDataFrame(data, "doc_id long, text string, words string, places int")
    assert rows(license_scan.licenses(docs)) == sorted((expected(i, t) for i, t, *_ in data), key=repr)
    assert license_scan.licenses(docs.limit(0)).count() == 0


def test_partial_notices_need_their_phrase(spark):
    texts = ["permission is hereby granted free of charge to any human obtaining a copy of this software",
             "permission is hereby granted for a small charge to any person obtaining a copy of this software",
             "licensed under the gnu general public license version 3", "public license version 3"] + ["other words"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in license_scan.licenses(docs).collect()}
    assert found[0].labels == "mit" and 0.8 <= found[0].score < 1 and found[0].base_labels == ""
    assert found[1].labels == "" and found[1].score == 0
    assert found[2].labels == "gpl-3" and found[2].score == 1
    assert found[3].labels == ""


def test_places_without_the_rarest_words(spark):
    """Whichever words are missing, a place with enough of the weight and the phrase is found."""
    notices = {label: notice.split() for label, notice, _ in license_scan.TEMPLATES if len(notice.split()) > 20}
    whole = license_scan.TEMPLATES[8][1]
    texts = ["permission is hereby granted free of charge for any person obtaining a copy of the software"]
    for word in set(whole.split()) - {"free", "of", "charge"}:
        texts.append(whole.replace(word, "other", 1))
    texts += [" ".join(notice) for notice in notices.values()]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1000 + i, "plain words to read") for i in range(200)], "doc_id long, text string")
    found = {r.doc_id: r for r in license_scan.licenses(docs).collect()}
    assert all("mit" in found[i].labels.split(",") for i in range(len(texts) - len(notices)))
    for i, label in enumerate(notices, len(texts) - len(notices)):
        assert label in found[i].labels.split(",") and found[i].score == 1


def test_query_matches_sql_and_contract(spark):
    folder = "/root/testdata/sf0.01"
    frame = QUERIES["op8_licenses"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert rows(frame) == sorted((expected(i, t) for i, t in docs), key=repr)
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    relation = database.execute(ORACLE["op8_licenses"])
    names = [d[0] for d in relation.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(tuple, frame.select(*names).collect())) == sorted(relation.fetchall())
