"""The index of grams holds each gram of a key once, and cuts the texts after they are brought together."""

from gatehouse.operators import trigrams


def test_index_of_repeated_and_null_keys(spark):
    rows = spark.createDataFrame(
        [(1, "Abcd", "abc"), (1, "xBCD", None), (2, "ab", ""), (None, "abc", "abc"), (None, "ABC", None), (3, None, "ÄÖÜß")],
        "id long, a string, b string")
    index = trigrams.gram_index(rows, "id", ["a", "b"])
    assert sorted((r["gram"], r["id"] or 0) for r in index.collect()) == sorted(
        [("abc", 1), ("bcd", 1), ("xbc", 1), ("abc", 0), ("äöü", 3), ("öüß", 3)])


def test_entries_are_not_dealt_out_again(spark):
    rows = spark.createDataFrame([(1, "abcd")], "id long, a string")
    plan = trigrams.gram_index(rows, "id", ["a"])._jdf.queryExecution().optimizedPlan().toString()
    # The plan is read from its top: nothing is gathered above the place where entries come to be.
    assert "Aggregate" not in plan[: plan.index("Generate")] and "Aggregate" in plan
