"""Importance weights against n-grams counted directly."""

import re
from collections import Counter

import numpy as np
import pytest

from gatehouse.llm import importance
from gatehouse.llm.arrow_text import mix, span_hashes
from gatehouse.llm.queries import QUERIES


def bins(text):
    raw = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    parts = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x60\x7B-\x7F]+", raw)
    hashes = [span_hashes(np.frombuffer(p.encode(), np.uint8), np.array([0]), np.array([len(p.encode())]))[0] for p in parts]
    pairs = [mix(np.array([a], np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.array([b], np.uint64))[0]
             for a, b in zip(hashes, hashes[1:], strict=False)]
    return [int(h >> np.uint64(48)) for h in [*hashes, *pairs]]


def expected(rows, good):
    raw, target = Counter(), Counter()
    for doc_id, text, *_ in rows:
        raw.update(bins(text))
        if doc_id in good:
            target.update(bins(text))
    total, wanted = sum(raw.values()) + importance.BINS, sum(target.values()) + importance.BINS
    return sorted((repr(i), len(bins(t)), round(sum(
        np.log((target[b] + 1) / wanted) - np.log((raw[b] + 1) / total) for b in bins(t)), 6) + 0.0) for i, t, *_ in rows)


ROWS = [(i, f"good plain words number {i} here", "x", 1.0) for i in range(30)] + [
    (100 + i, f"SPAM!! $$$ now{i} !!!", "x", 1.0) for i in range(10)] + [
    (200, None, None, None), (201, "", "x", 1.0), (None, "good words", "x", 1.0), (None, "good words", "x", 1.0), (202, "w " * 20_000, "x", 0.0)]
LABELS = [(i, 1, 0) for i in range(20)] + [(i, 1, 0) for i in range(3)] + [(100 + i, 0, 1) for i in range(5)] + [(None, 1, 0), (7777, 1, None), (1, None, 1)]


def frames(spark):
    return (spark.createDataFrame(ROWS, "doc_id long, text string, rank string, noise double"),
            spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))


def test_weights(spark):
    docs, labels = frames(spark)
    found = importance.resample(docs, labels).collect()
    assert sorted((repr(r.doc_id), r.n_grams, round(r.log_weight, 6) + 0.0) for r in found) == expected(ROWS, set(range(20)))
    assert sorted(r["rank"] for r in found) == list(range(1, len(ROWS) + 1))
    by_key = sorted(found, key=lambda r: -r.gumbel_key)
    share = 25 / 30
    assert {r["rank"] for r in by_key[: round(share * len(ROWS))]} == {r["rank"] for r in found if r.kept}
    again = importance.resample(docs.repartition(7), labels).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


def test_empty_tables(spark):
    docs, labels = frames(spark)
    assert importance.resample(docs.limit(0), labels).count() == 0
    found = importance.resample(docs, labels.limit(0)).collect()
    assert all(r.kept and r.log_weight == 0 and r.score == 0.5 for r in found) and len(found) == len(ROWS)


def test_gumbel_noise_draws_by_weight():
    noise = mix(np.arange(200_000, dtype=np.uint64))
    uniform = ((noise >> np.uint64(12)).astype(float) + 0.5) / 2.0**52
    keys = np.where(np.arange(200_000) % 2 == 0, np.log(3.0), 0.0) - np.log(-np.log(uniform))
    first = keys[0::2] > keys[1::2]
    assert first.mean() == pytest.approx(0.75, abs=0.01)


def test_query_separates_labelled_quality(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op3_importance"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in found if r.quality == 1]
    junk = [r.kept for r in found if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(junk) < 0.2
