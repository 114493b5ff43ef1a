"""Base scores against direct counting; the model by its sums, its seating and its perplexity."""

import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from gatehouse.llm import lm_scoring as lm
from gatehouse.llm.arrow_text import text_blocks
from gatehouse.llm.queries import QUERIES


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def expected(rows):
    counts = Counter(t for i, text, *_ in rows if not held(i) for t in tokens(text))
    total, different = sum(counts.values()), len(counts)
    return sorted((repr(i), held(i), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), total,
                   round(sum(log10((counts[x] + 0.1) / (total + 0.1 * (different + 1))) for x in tokens(t)), 6) + 0.0) for i, t, *_ in rows)


def found(frame):
    return sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6) + 0.0) for r in frame)


ROWS = [(i, f"The cat {i} sat\ton the\x0bmat number{i % 5} é", "x", 1) for i in range(60)] + [
    (None, "the cat", "x", 1), (None, None, None, None), (100, None, "x", 1), (101, "", "x", 1), (102, " \n ", "x", 1),
    (103, "Ünïcode\x1ftoken" * 3, "x", 1), (2**60 + 1, "big id", "x", 1), (5, "repeat repeat", "x", 1), (5, "repeat repeat", "x", 1),
    (104, "long " * 30_000, "x", 1)]


def block_of(texts):
    import pyarrow as pa

    return next(text_blocks(pa.array(texts)))


def test_spelling():
    data, bounds = lm.spelled(block_of(["A b\n", "", "cé"]))
    lead = "\n" * lm.ORDER
    assert data.tobytes().decode() == f"{lead}a b \n{lead}\n{lead}cé \n"
    assert [int(x) for x in np.diff(bounds)] == [lm.ORDER + 5, lm.ORDER + 1, lm.ORDER + 5]
    own = lm.grams(data)[lm._inside(bounds)]
    assert [int(x) & 255 for x in own] == list("a b \n\ncé \n".encode())


def test_rows(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, held string, seg int")
    one = lm.score(docs).collect()
    assert found(one) == expected(ROWS)
    assert all(r.score < 0 for r in one)
    monkeypatch.setattr(lm, "SEGMENT_BYTES", 500)
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 40)
    monkeypatch.setattr(lm, "TOGETHER", 2)
    many = lm.score(docs).collect()
    assert found(many) == expected(ROWS)
    assert sorted(r.score for r in many) == pytest.approx(sorted(r.score for r in one), rel=1e-6)


def test_without_training_rows(spark):
    docs = spark.createDataFrame([(None, "ab"), (None, "")], "doc_id long, text string")
    rows = sorted(lm.score(docs).collect(), key=lambda r: r.n_tokens)
    assert [(r.train_tokens, r.n_known, r.base_score) for r in rows] == [(0, 0, 0.0)] * 2
    assert rows[1].score == pytest.approx(4 * log10(1 / 256)) and rows[0].score == pytest.approx(log10(1 / 256))
    assert lm.score(docs.limit(0)).count() == 0


def test_seating_like_one_customer_after_the_other():
    random, start, discount, customers = np.random.default_rng(1), 2.5, 0.6, 200
    one_by_one = []
    for _ in range(400):
        tables = 1
        for j in range(1, customers):
            tables += random.random() < start / (start + j - discount * tables)
        one_by_one.append(tables)
    grouped = lm.seat(np.full(4000, customers), np.full(4000, start), discount, random)
    assert grouped.mean() == pytest.approx(np.mean(one_by_one), rel=0.05)
    assert lm.seat(np.array([1, 2, 10**9]), np.full(3, 0.5), discount, random).tolist()[0] == 1


def spelling(text):
    """The bytes that the model spells, and each one's six-byte gram."""
    data = b"\n" * lm.ORDER + b"".join(t.encode() + b" " for t in tokens(text)[:-1]) + b"\n"
    return [data[i - lm.ORDER : i + 1] for i in range(lm.ORDER, len(data))]


def code(gram):
    return int.from_bytes(gram, "big")


def bucket_of(gram):
    return int(lm.bucket_of(np.array([code(gram)], np.uint64))[0])


def sampled(rows):
    """The model of some rows, from grams that a dictionary counts: probabilities of the shared level, and the subtrees."""
    counts = Counter(g for i, text, *_ in rows if not held(i) for g in spelling(text))
    arrays = lambda c: (np.array(sorted(map(code, c)), np.uint64), np.array([c[g] for g in sorted(c)], np.int64))
    bytes_ = Counter()
    for g, n in counts.items():
        bytes_[g[-1]] += n
    root = np.array([(bytes_[b] + 1) / (sum(bytes_.values()) + 256) for b in range(256)])
    shared = np.tile(root, (256, 1))
    every = np.arange(256, dtype=np.uint64)
    for last in {g[-2] for g in counts}:
        short = Counter()
        for g, n in counts.items():
            if g[-2] == last:
                short[g[-3:]] += n
        levels = lm.subtree(*arrays(short), lambda own: root[own & np.uint64(255)], last, range(1, 3))
        shared[last] = lm.averaged(levels[:1], every | np.uint64(last << 8), root)
    trees = {}
    for bucket in {bucket_of(g) for g in counts}:
        own = Counter({g: n for g, n in counts.items() if bucket_of(g) == bucket})
        above = lambda x: shared[(x >> np.uint64(8)) & np.uint64(255), x & np.uint64(255)]
        trees[bucket] = lm.subtree(*arrays(own), above, bucket, range(2, lm.ORDER + 1))
    return shared, trees


def probability(model, gram):
    """Predictive probability of a gram's last byte, by the recursion over its contexts, in plain Python."""
    shared, trees = model
    total = 0.0
    for sweep in range(lm.SWEEPS - lm.BURN_IN):
        p = shared[gram[-2], gram[-1]]
        for level in trees.get(bucket_of(gram), ()):
            context, own = code(gram[-level.length - 1 : -1]), code(gram[-level.length - 1 :])
            if context in level.contexts.tolist():
                p *= level.back[sweep][level.contexts.tolist().index(context)]
            if own in level.grams.tolist():
                p += level.own[sweep][level.grams.tolist().index(own)]
        total += p
    return total / (lm.SWEEPS - lm.BURN_IN)


def test_scores_of_a_tiny_corpus(spark, monkeypatch):
    """Sums over bytes, one at a time, against the segments, buckets and cogroups."""
    rows = [(i, t) for i, t in enumerate(["abra cadabra", "Bra Cab", "a", None, "dab", "cad abra bar", "x yz", "abra", "brac", "cab"] * 2)]
    model = sampled(rows)
    wanted = {i: sum(log10(probability(model, g)) for g in spelling(text)) for i, text in rows}
    monkeypatch.setattr(lm, "SEGMENT_BYTES", 200)
    monkeypatch.setattr(lm, "TOGETHER", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.score for r in lm.score(docs).collect()} == pytest.approx(wanted, rel=1e-5)


def test_probabilities_of_all_bytes_add_up():
    rng = np.random.default_rng(2)
    rows = [(i, "".join(rng.choice(list("abcde "), 300))) for i in range(12)]
    model = sampled(rows)
    for context in (b"abcde", b"zzzza", b"zz ab", b"eeeee", b"\n\n\nab", b"\xff\xfe\xfd\xfc\xfb", spelling(rows[1][1])[40][:5]):
        every = np.array([code(context + bytes([b])) for b in range(256)], np.uint64)
        levels = model[1].get(bucket_of(context + b"a"), [])
        found = lm.averaged(levels, every, model[0][context[-1]])
        assert found.sum() == pytest.approx(1, abs=1e-6) and found.min() > 0
        assert found[97] == pytest.approx(probability(model, context + b"a"))


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    frame = QUERIES["op7_lm_scoring"](spark, folder).cache()
    assert found(frame.collect()) == expected(docs)
    rows = {r.held_out: r for r in lm.perplexity(frame).collect()}
    assert rows[True].perplexity < rows[True].base_perplexity
