"""SimHash classes against all pairs of fingerprints that are computed word by word."""

import random
import re
from itertools import combinations

import pytest
import xxhash

from gatehouse.llm import simhash
from gatehouse.llm.queries import QUERIES

DOCS = "doc_id long, text string, fp string, label string"


def fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [words[i : i + 4] for i in range(len(words) - 3)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def classes(pairs):
    """Smallest id that links reach, by comparing all fingerprints."""
    parent = {fp: fp for _, fp in pairs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(parent), 2):
        if (a ^ b).bit_count() <= 4 and root(a) != root(b):
            parent[root(b)] = root(a)
    least = {}
    for doc_id, fp in pairs:
        if doc_id is not None:
            least[root(fp)] = min(doc_id, least.get(root(fp), doc_id))
    return sorted(((d, f"{fp:016x}", least.get(root(fp))) for d, fp in pairs), key=repr)


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def near(rng, fp, bits):
    for bit in rng.sample(range(64), bits):
        fp ^= 1 << bit
    return fp


def signed(fp):
    return fp - (1 << 64) if fp >> 63 else fp


def test_sets_of_three_positions_meet_every_set_of_four():
    sets = simhash.covering_sets()
    assert len(sets) == 20
    assert all(any(set(s) <= set(four) for s in sets) for four in combinations(range(8), 4))


def test_texts_match_word_by_word(spark):
    texts = [None, "", " \t\n", "one", "Two words", "Exactly four words here", "now FIVE words are here", "Ünï cödé ÄÖ words x",
             "a " * 5000, "a b " * 60_000, "x" * 100_000, "one", "non breaking blanks stay in words here"]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "one", "", ""), (3, "one", "", "")], DOCS)
    expected = classes([(r["doc_id"], fingerprint(r["text"])) for r in docs.collect()])
    assert rows(simhash.near_duplicates(docs)) == expected


def test_component_of_null_ids_only(spark):
    docs = spark.createDataFrame([(None, "some words stand here alone", "", ""), (1, "others", "", "")], DOCS)
    assert sorted(r["component_id"] is None for r in simhash.near_duplicates(docs).collect()) == [False, True]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("length", [4096, 256, 12])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, length):
    """Short lists force the narrowing and the comparison between units."""
    rng = random.Random(length)
    centre, template = rng.getrandbits(64), rng.getrandbits(64)
    fps = {centre, 0} | {near(rng, centre, rng.randint(1, 12)) for _ in range(300)}
    # One list of four shared bytes whose members are mostly too far apart to be linked.
    fps |= {template & ~0xFFFFFFFF | rng.getrandbits(32) for _ in range(200)}
    fps |= {near(rng, fp, 4) for fp in list(fps)[:60]} | {rng.getrandbits(64) for _ in range(100)}
    monkeypatch.setattr(simhash, "LIST", length)
    frame = spark.createDataFrame([(signed(fp),) for fp in fps], "fp bigint")
    found = {r["node"]: r["label"] for r in simhash.components(simhash.links(frame)).collect()}
    ids = {fp: i for i, fp in enumerate(sorted(fps))}
    wanted = {fp: least for (_, digits, least) in classes([(ids[fp], fp) for fp in fps]) for fp in [int(digits, 16)]}
    groups, labels = {}, {}
    for fp in fps:
        groups.setdefault(wanted[fp], set()).add(fp)
        labels.setdefault(found.get(signed(fp), signed(fp)), set()).add(fp)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, labels.values()))


def test_query_over_the_test_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], fingerprint(r["text"])) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(QUERIES["op11_simhash"](spark, folder)) == classes(docs)
