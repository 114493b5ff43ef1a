"""String kernel: exact kernel values, held-out accuracy and the defined cases."""

import random
import zlib

import numpy as np

from gatehouse.llm import language_id
from gatehouse.llm.queries import QUERIES

SAMPLE = [("en", f"the {w} of this house and that {w} with the others") for w in ("dog", "tree", "water", "morning", "paper")] + [
    ("de", f"der {w} von dem Haus und das {w} mit den anderen") for w in ("Hund", "Baum", "Wasser", "Morgen", "Papier")]


def spectrum(text):
    raw = bytes(language_id._TEXT[np.frombuffer(text.encode(), np.uint8)].astype(np.uint8))
    return {(n, raw[i : i + n]) for n in (1, 2, 3) for i in range(len(raw) - n + 1)}


def kernel(model, texts, landmarks):
    """Shared n-grams that the model compares, by the root of the product of both texts' own n-grams, from sets."""
    columns = {(n, bytes(int(c).to_bytes(n, "big"))) for n, codes in zip(language_id.SPECTRUM, model.grams) for c in codes}
    return np.array([[len(spectrum(a) & spectrum(b) & columns) / np.sqrt(max(1, len(spectrum(a))) * max(1, len(spectrum(b)))) for b in landmarks]
                     for a in texts])


OTHERS = ["the Über house", "a", "Wasser und dog", "zzz the", "der Baum", "qqq xyz jjj"]


def test_kernel_is_the_blended_spectrum_kernel(monkeypatch):
    monkeypatch.setattr(language_id, "GRAMS", 150)
    model = language_id.fit(SAMPLE)
    texts = [t for _, t in sorted(SAMPLE, key=lambda row: row[0])]
    found = language_id.embedded(model, language_id.one_block(OTHERS)) @ model.landmarks.T
    assert np.allclose(found, kernel(model, OTHERS, texts), atol=1e-5)


def test_predictions_are_those_of_the_ridge_regression():
    """Landmarks, Nystroem features and the penalised least squares, from the kernel of sets and a general solver."""
    model = language_id.fit(SAMPLE)
    own = sorted(SAMPLE, key=lambda row: row[0])
    landmarks, languages = [t for _, t in own], ["de", "en"]
    values, vectors = np.linalg.eigh(kernel(model, landmarks, landmarks))
    root = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    points = kernel(model, landmarks, landmarks) @ root
    targets = np.array([[1.0 if lang == other else -1.0 for other in languages] for lang, _ in own])
    centred, size = points - points.mean(axis=0), points.shape[1]
    penalty = np.sqrt(language_id.RIDGE * len(points) / 100)
    weights = np.linalg.lstsq(np.vstack([centred, penalty * np.eye(size)]), np.vstack([targets - targets.mean(axis=0), np.zeros((size, 2))]),
                              rcond=None)[0]
    wanted = (kernel(model, OTHERS, landmarks) @ root - points.mean(axis=0)) @ weights + targets.mean(axis=0)
    assert np.allclose(language_id.scores(model, language_id.one_block(OTHERS)), wanted, atol=1e-3)


def test_blocks_do_not_share_grams():
    model = language_id.fit(SAMPLE)
    both = language_id.presence(model, language_id.one_block(["the", "", "dog"]))
    assert np.array_equal(both[0], language_id.presence(model, language_id.one_block(["the"]))[0])
    assert np.array_equal(both[2], language_id.presence(model, language_id.one_block(["dog"]))[0]) and not both[1].any()


def test_defined_cases(spark):
    rows = [(i, t, lang, "s", 0.5) for i, (lang, t) in enumerate(SAMPLE)] + [
        (100, None, "en", "s", 1.0), (101, "", "en", "s", 1.0), (102, "123 ... 5", None, "s", 1.0), (103, "the dog", None, None, None),
        (None, "das Haus und der Baum", "en", "s", 1.0), (104, "Ü", None, "s", 0.0), (105, "the dog and the tree " * 9000, None, "s", 0.0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    found = sorted(((r.doc_id, r.held_out, r.lang_pred) for r in language_id.identify(docs).collect()), key=repr)
    assert len(found) == len(rows)
    own = dict((i, (h, p)) for i, h, p in found)
    assert {own[i][1] for i in (100, 101, 102)} == {"und"}
    assert own[103][1] == own[105][1] == "en" and own[None] == (True, "de") and own[104][1] != "und"
    assert all(h == (i is None or zlib.crc32(str(i).encode()) % 5 == 0) for i, h, _ in found)
    assert language_id.identify(docs.limit(0)).count() == 0
    unlabelled = docs.withColumn("lang", docs["lang"].substr(9, 1)).filter("lang <> ''")
    assert unlabelled.count() == 0
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.filter("text IS NULL OR doc_id IN (101, 102)").count() == 0
    assert kept.count() == len(rows) - 6


def test_one_language_and_none(spark):
    docs = spark.createDataFrame([(i, "the dog", "en") for i in range(20)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(docs).collect()} == {"en"}
    docs = spark.createDataFrame([(i, "the dog", None) for i in range(20)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language_id.identify(docs).collect()} == {("und", 0.0)}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op9_language_id"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_unlearned_scripts_and_random_letters_go_and_labelled_languages_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n))
    strange = ["это язык которого нет в таблице и никто его не знает", "これは表にない言語のテキストです", "a これは表にない言語のテキストです",
               "αυτή η γλώσσα δεν υπάρχει στον πίνακα", *(letters(n) for n in (100, 300, 1000, 20_000))]
    added = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(strange)], docs.schema)
    kept = {r.doc_id: r.lang for r in language_id.keep_identified(docs.union(added)).collect()}
    assert not any(i >= 10**9 for i in kept)
    before = {r.doc_id: r.lang for r in docs.filter("text IS NOT NULL AND lang IS NOT NULL").collect()}
    assert set(before.values()) == {"en", "fr", "de", "es"} and len(set(before) - set(kept)) <= 3


def test_tables_are_small():
    """Every place of the three-byte n-grams that a text can have, and no more."""
    model = language_id.fit([("en", "the house is old"), ("de", "das Haus ist älter")])
    assert sum(table.nbytes for table in language_id._numbers(model)) <= 16_000_000
    codes = np.array([a << 16 | b << 8 | c for a in (0x20, 0x7A, 0xFF) for b in (0x61, 0x80) for c in (0x20, 0xF4)], np.uint32)
    assert len(set(language_id._place(codes, 3).tolist())) == len(codes)
