"""Mixing against a sequential version."""

import math
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from gatehouse.llm import mixing
from gatehouse.llm.queries import QUERIES


def shares(sizes):
    """Share by weight, cap, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    cap = {s: 2.0 * sizes[s] for s in order}
    target, budget, open_ = {}, 1.5 * sum(sizes.values()), list(order)
    while open_:
        level = budget / sum(weight[s] for s in open_)
        above = [s for s in open_ if level * weight[s] > cap[s]]
        if not above:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in above:
            target[s] = cap[s]
            budget -= cap[s]
        open_ = [s for s in open_ if s not in above]
    return target


def judge(found, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size(text)
    target = shares(sizes)
    assert sorted((repr(r["doc_id"]), r["size"], r["source_size"]) for r, _ in found) == sorted(
        (repr(i), size(t), sizes[s]) for i, t, s in rows)
    taken = defaultdict(int)
    for r, source in found:
        assert r["target"] == pytest.approx(target[source], rel=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    for source, goal in target.items():
        assert abs(taken[source] - math.floor(goal)) <= 1, (source, taken[source], goal)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text(max_size=2)), st.integers(0, 50), min_size=1, max_size=8))
def test_level_is_the_repeated_division(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    ranked = sorted(order, key=lambda s: (2 * sizes[s] / weight[s]))
    budget, tries = 1.5 * sum(sizes.values()), []
    for i, s in enumerate(ranked):
        level = (budget - sum(2 * sizes[x] for x in ranked[:i])) / sum(weight[x] for x in ranked[i:])
        if level <= 2 * sizes[s] / weight[s] + 1e-12:
            tries.append(level)
    level = max(tries, default=math.inf)
    for s, goal in shares(sizes).items():
        assert min(2 * sizes[s], level * weight[s]) == pytest.approx(goal, abs=1e-9)


@pytest.mark.parametrize("range_rows", [20_000, 3])
def test_rows(spark, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    rows = [(i, "w " * (i % 7), f"s{min(i % 9, 4)}") for i in range(80)]
    rows += [(1, "a b\x0bc\x1fd", "s1")] * 2 + [(None, "x y", None), (90, None, None), (91, "", "empty"), (92, "z " * 3000, "s0"), (93, "q", "é")]
    docs = spark.createDataFrame([(i, t, s, 5, 6) for i, t, s in rows], "doc_id long, text string, source string, _key int, taken int")
    found = mixing.mix(docs)
    assert found.columns == ["doc_id", "text", "source", "_key", "size", "source_size", "target", "taken"]
    collected = [(r, r["source"]) for r in found.collect()]
    judge(collected, rows)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(repr, again)) == sorted(repr(r) for r, _ in collected)
    assert sorted(r.doc_id or -1 for r in mixing.mixture(docs).collect()) == sorted(r.doc_id or -1 for r, _ in collected if r.taken)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()
    source = {r.doc_id: r.source for r in docs}
    judge([(r, source[r.doc_id]) for r in QUERIES["op5_mixing"](spark, folder).collect()], [tuple(r) for r in docs])


def test_query_matches_sql(spark):
    import duckdb

    from gatehouse.llm.queries import ORACLE

    folder = "/root/testdata/sf0.01"
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    relation = database.execute(ORACLE["op5_mixing"])
    names = [d[0] for d in relation.description]
    found = QUERIES["op5_mixing"](spark, folder)
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(relation.fetchall())
