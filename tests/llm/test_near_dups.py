"""Order MinHash classes against all pairs."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from gatehouse.llm import near_dups
from gatehouse.llm.queries import QUERIES


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def as_words(values):
    return np.array(values, np.uint32)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=40), st.integers(0, 12))
def test_banded_distance(a, b, band):
    assert near_dups.banded_distance(as_words(a), as_words(b), band) == min(edit_distance(a, b), band + 1)


def test_long_runs():
    a = list(range(5000))
    b = a[:1000] + [9999] + a[1000:3000] + a[3002:]
    assert near_dups.banded_distance(as_words(a), as_words(b), 50) == 3


def corpus(seed, groups=12):
    """Originals, exact copies and copies with a few edits, unrelated texts and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "th", "er", "on", "re", "ti", "es"]) for _ in range(3))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(60, 300))]
        texts.append(base)
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = [[], [word()], [copy[at], word()]][rng.randrange(3)]
            texts.append(copy)
        texts.append([word() for _ in range(rng.randint(1, 120))] + passage)
    texts += [["one"], ["one"], ["one", "two"], ["one", "two", "three"]]
    return [" ".join(x) for x in texts]


def all_pairs(texts):
    shingles = []
    for text in texts:
        own = text.lower().split()
        shingles.append({tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else None)
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = shingles[i], shingles[j]
            if texts[i] == texts[j] or (a and b and len(a & b) / len(a | b) >= 0.8):
                label[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("bucket", [1000, 3])
def test_classes_match_all_pairs(spark, monkeypatch, bucket):
    monkeypatch.setattr(near_dups, "BUCKET", bucket)
    monkeypatch.setattr(near_dups, "SMALL", min(near_dups.SMALL, bucket))
    texts = corpus(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_dups.near_dup_classes(docs).collect()}
    assert [found[i] for i in range(len(texts))] == all_pairs(texts)


def test_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = [" ".join(base)]
    for i in range(300):
        copy = list(base)
        copy[rng.randrange(150)] = f"e{i}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = near_dups.near_dup_classes(docs).collect()
    assert {r.class_id for r in found} == {0} and {r.class_size for r in found} == {301}
    assert [r.doc_id for r in found if r.kept] == [0]


@pytest.mark.parametrize(("bucket", "held"), [(8, 64 << 20), (1000, 8 * 800)])
def test_isolated_pairs_in_a_group_that_shares_a_template(spark, monkeypatch, bucket, held):
    monkeypatch.setattr(near_dups, "BUCKET", bucket)
    monkeypatch.setattr(near_dups, "SMALL", 4)
    monkeypatch.setattr(near_dups, "_HELD_BYTES", held)
    template = [f"t{i}" for i in range(176)]
    texts = []
    for i in range(160):
        own = [f"u{i}x{k}" for k in range(24)]
        texts.append(" ".join(template + own))
        if i % 4 == 0:
            texts.append(" ".join(template + own[:8] + [f"v{i}x{k}" for k in range(16)]))
    expected = all_pairs(texts)
    assert len(set(expected)) == 160
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_dups.near_dup_classes(docs).collect()}
    assert [found[i] for i in range(len(texts))] == expected


def test_minima_agree_for_equal_sets_of_shingles():
    x, y = [1, 2, 3, 4, 5, 6], [7, 8, 9, 10, 11, 12]
    a, b = as_words((x * 50) + (y * 50)), as_words((x * 30) + (y * 70))
    assert near_dups.shingle_similarity(a, b) == 1
    assert np.array_equal(near_dups.sketch(a)[1], near_dups.sketch(b)[1])


def test_short_texts_of_similarity_four_fifths_share_a_sketch():
    rng = np.random.default_rng(2)
    for _ in range(3000):
        words = rng.integers(1, 1 << 32, 9, dtype=np.uint32)
        assert set(near_dups.sketch(words)[0].tolist()) & set(near_dups.sketch(words[:-1])[0].tolist())


def test_nulls_repeats_and_other_columns(spark):
    rows = [(1, "a b c d e f g", "x", 1), (1, "a b c d e f g", "x", 1), (None, "A b, c d e f g", None, None), (2, None, "x", 1),
            (3, None, "x", 1), (4, "", "x", 1), (5, "", "x", 1), (6, "!!", "x", 1), (7, "??", "x", 1), (None, "alone here", "x", 2),
            (8, "z " * 20_000, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string, node int")
    found = sorted(((r.doc_id, r.class_id, r.class_size, r.kept) for r in near_dups.near_dup_classes(docs).collect()), key=repr)
    assert found == sorted([
        (1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (2, 2, 1, True), (3, 3, 1, True), (4, 4, 2, True), (5, 4, 2, False),
        (6, 6, 1, True), (7, 7, 1, True), (None, None, 1, True), (8, 8, 1, True)], key=repr)
    assert near_dups.near_dup_classes(docs.limit(0)).count() == 0
    kept = near_dups.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, [1, 2, 3, 4, 6, 7, None, 8]))


def test_query_matches_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    sets, index = [], {}
    words = [near_dups.word_hashes(b)[0] for _, t in docs for b in near_dups.text_blocks(near_dups.pa.array([t]))]
    for i, own in enumerate(words):
        sets.append(set(near_dups.shingles(own).tolist()))
        for x in sets[-1]:
            index.setdefault(x, []).append(i)
    linked = {}
    for i, own in enumerate(sets):
        counts = {}
        for x in own:
            for j in index[x]:
                if j < i:
                    counts[j] = counts.get(j, 0) + 1
        linked[i] = [j for j, n in counts.items() if n / (len(own) + len(sets[j]) - n) >= 0.8]
    label = {}
    for i in linked:
        label[i] = i
        for j in linked[i]:
            a, b = i, j
            while label[a] != a:
                a = label[a]
            while label[b] != b:
                b = label[b]
            label[max(a, b)] = min(a, b)
    for i in label:
        while label[i] != label[label[i]]:
            label[i] = label[label[i]]
    found = {r.doc_id: r.class_id for r in QUERIES["op2_order_minhash"](spark, folder).collect()}
    assert found == {docs[i][0]: docs[label[i]][0] for i in label}
