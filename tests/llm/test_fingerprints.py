"""Prefix hashes against direct comparison of texts."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from gatehouse.llm import fingerprints as fp
from gatehouse.llm.queries import QUERIES


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab𝔘", max_size=40), st.text(alphabet="ab𝔘", max_size=40), st.integers(0, 40), st.integers(0, 40))
def test_spans_and_common_extensions(a, b, i, j):
    i, j = min(i, len(a)), min(j, len(b))
    both, bounds = fp.together([fp.code_points(a), fp.code_points(b)])
    common = 0
    while i + common < len(a) and j + common < len(b) and a[i + common] == b[j + common]:
        common += 1
    start, at = np.array([i]), bounds[1:2] + j
    assert both.common_extension(start, at, np.array([min(len(a) - i, len(b) - j)])).tolist() == [common]
    before = 0
    while before < min(i, j) and a[i - before - 1] == b[j - before - 1]:
        before += 1
    assert both.common_extension(start, at, np.array([min(i, j)]), back=True).tolist() == [before]
    for length in range(min(6, len(a) - i + 1, len(b) - j + 1)):
        assert both.equal(start, at, np.array([length])).tolist() == [a[i : i + length] == b[j : j + length]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab𝔘 ", max_size=80), max_size=6))
def test_a_block_of_texts_has_the_fingerprints_of_each(texts):
    found = fp.fingerprints_of(*fp.together([fp.code_points(t) for t in texts]))
    assert [x.text() for x in found] == [of(t).text() for t in texts]


def of(text):
    return fp.fingerprint(fp.code_points(text))


def noise(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefghijklmnop é") for _ in range(n))


def test_likeness():
    text = noise(3000, 1)
    assert of(text).text() == of(text).text()
    assert fp.likeness(of(text), of(text)) == 1
    assert fp.likeness(of(text), of(noise(3000, 2))) < 0.05
    assert abs(fp.likeness(of(text), of(text[:1500] + noise(1500, 3))) - 0.5) < 0.1
    assert fp.likeness(of(text), of(text[:1000] + "x" + text[1000:])) > 0.9
    moved = noise(700, 4) + text[200:2000] + noise(500, 5)
    assert 0.4 < fp.likeness(of(text), of(moved)) < 0.8
    passage = noise(400, 11)
    apart = fp.likeness(of(noise(1500, 12) + passage + noise(1500, 13)), of(noise(600, 14) + passage + noise(2400, 15)))
    assert 0 < apart < 0.3
    assert fp.likeness(of(""), of("")) == 1 and fp.likeness(of(""), of("a")) == 0
    assert fp.likeness(of("ab"), of("ab")) == 1 and 0 < fp.likeness(of("abcd"), of("abxx")) < 1
    long = noise(200_000, 6)
    assert fp.likeness(of(long), of(long[:100_000] + noise(100_000, 8))) == pytest.approx(0.5, abs=0.05)


def directly(text):
    """The fingerprint's parts from whole numbers, one code point at a time."""
    codes, prime = [ord(c) + 1 for c in text], fp.PRIME

    def span(a, b):
        both = [sum(c * pow(base, j, prime) for j, c in enumerate(codes[a:b])) % prime for base in fp.BASES]
        return both[0] << 31 | both[1]

    def short(value):
        value = (value ^ value >> 31) * 0x7FB5D329728EA185 % 2**64
        return (value ^ value >> 27) * 0x81DADEF4BC2DD44D % 2**64 >> 32

    n, step = len(codes), 1
    while n // step > fp.GRID:
        step *= 2
    grid, size = range(step, n + 1, step), min(fp.SPAN, n)
    least = sorted({short(span(i, i + size)) for i in range(n - size + 1)} if n else set())[: fp.KEPT]
    numbers = [short(span(0, k)) for k in grid] + [short(span(n - k, n)) for k in grid] + least
    return f"{n:x}.{span(0, n):x}.{step:x}.{len(grid):x}." + "".join(f"{x:08x}" for x in numbers)


@pytest.mark.parametrize("text", ["", "a", "ab𝔘é", "abc" * 30, noise(150, 21), noise(70, 22) + "z" * 200])
def test_fingerprints_match_whole_numbers(text):
    assert of(text).text() == directly(text)


def test_written_and_read():
    for text in ("", "a", "aaaa" * 500, noise(5000, 7)):
        one, two = of(text), fp.parse(of(text).text())
        assert one.text() == two.text() and fp.likeness(one, two) == 1


def common(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def text_hash(text):
    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def expected(rows):
    own = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), text_hash(r[1]), r[1].encode()))
    out = []
    for k, (doc_id, text) in enumerate(own):
        half, following = len(text) // 2, own[(k + 1) % len(own)][1]
        changed = text[: len(text) - half] + following[:half]
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), of(text).text(), of(changed).text(),
                    fp.likeness(of(text), of(changed)), fp.likeness(of(text), of(following)),
                    common(text, following), common(text[::-1], following[::-1])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("stretch", [1000, 3, 1])
def test_rows(spark, monkeypatch, stretch):
    monkeypatch.setattr(fp, "STRETCH_ROWS", stretch)
    rows = [(i * i, noise(i * 7, i)) for i in range(40)] + [(None, "null id"), (None, None), (5, None), (7, ""), (9, "twice"), (9, "twice"), (9, "a"),
                                                          (10**15, noise(50_000, 9)), (-4, "é𝔘z")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, stretch int")
    assert sorted(map(tuple, fp.fingerprints(docs).collect()), key=repr) == expected(rows)


@pytest.mark.parametrize("stretch", [1000, 4])
def test_one_doc_id_of_many_rows(spark, monkeypatch, stretch):
    monkeypatch.setattr(fp, "STRETCH_ROWS", stretch)
    rows = [(7, noise(50 + i, i)) for i in range(60)] + [(None, noise(60, i)) for i in range(40)] + [(i, noise(40, 90 + i)) for i in range(20)]
    rows += [(7, "same")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, fp.fingerprints(docs).collect()), key=repr) == expected(rows)


def test_small_tables(spark):
    docs = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert sorted(map(tuple, fp.fingerprints(docs).collect())) == expected([(1, "abcdef")])
    assert fp.fingerprints(docs.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(map(tuple, QUERIES["op6_fingerprints"](spark, folder).collect()), key=repr)
    assert found == expected(docs)
    by_text = {}
    for doc_id, text in docs:
        by_text.setdefault(text, set()).add(next(r[3] for r in found if r[0] == doc_id))
    assert all(len(x) == 1 for x in by_text.values())
    assert len({next(iter(x)) for x in by_text.values()}) == len(by_text)
    assert np.median([r[5] for r in found if r[1] > 200]) == pytest.approx(0.5, abs=0.05)
