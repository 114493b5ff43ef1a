"""Deep pages against a sorted list."""

import random
import re

import pytest

from gatehouse.operators import paging

ORDER = [("name", False), ("score", True), ("id", True)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(i, rng.choice(["a", "b", None, "ä"]), rng.choice([None, 0.5, 1.5, 2.5])) for i in range(3000)]


def ordered(rows):
    """Names descending with nulls last, then scores with nulls first, then ids."""
    ranked = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    return sorted(ranked, key=lambda r: (r[1] is None, [-b for b in (r[1] or "").encode()]))


@pytest.mark.parametrize(("shallow", "bounds"), [(100, 8), (300, 64), (10, 3)])
def test_pages_anywhere(spark, monkeypatch, rows, shallow, bounds):
    monkeypatch.setattr(paging, "SHALLOW", shallow)
    monkeypatch.setattr(paging, "BOUNDS", bounds)
    df, wanted = spark.createDataFrame(rows, "id int, name string, score double").repartition(4), ordered(rows)
    for number in (1, 2, 31, 59, 60, 61, 500):
        found, total = paging.page(df, ORDER, number, 50)
        assert [tuple(r) for r in found.collect()] == wanted[(number - 1) * 50 : number * 50]
        assert total == 3000


def test_equal_rows_and_an_empty_table(spark, monkeypatch):
    monkeypatch.setattr(paging, "SHALLOW", 10)
    same = spark.range(100).selectExpr("1 AS n")
    assert paging.page_rows(same, [("n", True)], 5, 20).count() == 20 and paging.page_rows(same, [("n", True)], 6, 20).count() == 0
    found, total = paging.page(same.limit(0), [("n", True)], 5, 20)
    assert found.count() == 0 and total == 0


def test_deep_page_sorts_few_rows(spark, monkeypatch):
    """The plan's top-N is bounded by SHALLOW and a page, not by the offset."""
    monkeypatch.setattr(paging, "SHALLOW", 1000)
    found = paging.page_rows(spark.range(200_000).withColumnRenamed("id", "n"), [("n", True)], 1500, 100)
    assert [r["n"] for r in found.collect()] == list(range(149_900, 150_000))
    limits = [int(x) for x in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", found._jdf.queryExecution().toString())]
    assert limits and max(limits) <= 1100


def test_seek_cursor(spark, rows):
    df, wanted = spark.createDataFrame(rows, "id int, name string, score double"), ordered(rows)
    for at in (0, 700, 1499, 2990):
        last = dict(zip(("id", "name", "score"), wanted[at], strict=True))
        found = paging.page_after(df, ORDER, [last[name] for name, _ in ORDER], 20)
        assert [tuple(r) for r in found.collect()] == wanted[at + 1 : at + 21]
