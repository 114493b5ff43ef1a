"""Truth tables of single rules and chains."""

import pytest
from pyspark.sql import functions as F

from gatehouse.operators.cells import error_rows, evaluate, map_columns, preview
from gatehouse.operators.config import FieldMapping, Rule


def run(spark, value, mapping, data_type="String", **others):
    schema = ", ".join(["_row_number bigint", "Source string", *(f"{name} string" for name in others)])
    df = spark.createDataFrame([(2, value, *others.values())], schema)
    row = evaluate(df, [mapping], {"Target": data_type}).first()
    return row["Target"]["value"], row["errors"], row["is_valid"]


def mapping(transformations=(), validations=(), default=None, required=False):
    return FieldMapping("Source", "Target", required, default, tuple(transformations), tuple(validations))


def test_default_then_ordered_transformations_then_validation(spark):
    m = mapping(
        [Rule("Uppercase", 2), Rule("Trim", 1)], [Rule("AllowedValues", 1, {"values": "UNKNOWN|ACTIVE"})], " unknown "
    )
    assert run(spark, None, m) == ("UNKNOWN", [], True)


def test_all_validations_are_collected(spark):
    m = mapping([], [Rule("MinimumLength", 1, {"value": "5"}, "Too short"), Rule("Pattern", 2, {"pattern": "^[A-Z]+$"}, "Bad pattern")])
    value, errors, valid = run(spark, "a1", m)
    assert [e["description"] for e in errors] == ["Too short", "Bad pattern"] and not valid


def test_bad_number_is_a_transformation_error(spark):
    m = mapping([Rule("Numeric", 1), Rule("Uppercase", 2)], [Rule("Required", 1)])
    value, errors, valid = run(spark, "abc", m, "Decimal")
    assert value == "abc" and not valid
    assert [e["error_type"] for e in errors] == ["Transformation Error", "Processing Error"]
    assert errors[0]["description"] == "The input string 'abc' was not in a correct format."


def test_derived_reads_row_columns(spark):
    m = mapping([Rule("Derived", 1, {"template": "{First} {LAST}{none}!"})])
    assert run(spark, None, m, First="Ada", Last="Lovelace")[0] == "Ada Lovelace!"


@pytest.mark.parametrize(
    "rule, value, expected",
    [
        (Rule("Trim"), " \t x ", "x"),
        (Rule("Uppercase"), "aé", "AÉ"),
        (Rule("Lowercase"), "AÉ", "aé"),
        (Rule("Replace", 0, {"old": "a", "new": "b"}), "banana", "bbnbnb"),
        (Rule("Replace", 0, {"old": "a", "new": "b"}), None, None),
        (Rule("Default", 0, {"value": "d"}), "", "d"),
        (Rule("Default", 0, {"value": "d"}), " ", " "),
        (Rule("Default"), None, None),
        (Rule("DateFormat", 0, {"format": "dd/MM/yyyy"}), "2024-03-09", "09/03/2024"),
        (Rule("Numeric"), "(1,234.50)", "-1234.50"),
        (Rule("StringLength", 0, {"max": "3"}), "abcdef", "abc"),
        (Rule("StringLength"), "abcdef", "abcdef"),
    ],
)
def test_transformations(spark, rule, value, expected):
    assert run(spark, value, mapping([rule]))[0] == expected


@pytest.mark.parametrize(
    "rule, data_type, good, bad",
    [
        (Rule("Required"), "String", ["x"], [None, "", " \t"]),
        (Rule("DataType"), "Integer", ["12", " -3 ", "", None], ["1.0", "x"]),
        (Rule("DataType"), "Decimal", ["1e3", "(5)", "1,2"], ["x", "1.2.3"]),
        (Rule("DataType"), "Boolean", ["TRUE", " false "], ["1", "yes"]),
        (Rule("DataType"), "DateTime", ["2024-01-31", "1/31/2024"], ["2024-02-30", "31/1/2024"]),
        (Rule("MaximumLength", 0, {"value": "3"}), "String", ["abc", None], ["abcd"]),
        (Rule("MinimumLength", 0, {"value": "3"}), "String", ["abc", None], ["ab", ""]),
        (Rule("NumericRange", 0, {"min": "1", "max": "5"}), "String", ["1", "5.0", "x", None], ["0.99", "5.01"]),
        (Rule("DateRange", 0, {"min": "2024-01-01", "max": "2024-12-31"}), "String", ["2024-12-31", "x", None], ["2025-01-01"]),
        (Rule("AllowedValues", 0, {"values": "a|B"}), "String", ["A", "b"], [None, "", "c"]),
        (Rule("Pattern", 0, {"pattern": "[0-9]"}), "String", ["a1", None], ["abc", ""]),
        (Rule("Duplicate"), "String", ["x", None], []),
    ],
)
def test_validations(spark, rule, data_type, good, bad):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(good + bad)], "_row_number bigint, Source string")
    judged = evaluate(df, [mapping([], [rule])], {"Target": data_type})
    failed = {
        r["_row_number"]
        for r in error_rows(judged, "_row_number").filter("error_type = 'Validation Error'").collect()
    }
    assert failed == set(range(len(good), len(good) + len(bad)))


def test_required_mapping_adds_an_error_per_rule(spark):
    rules = [Rule("MaximumLength", 1, {"value": "3"}), Rule("MinimumLength", 2, {"value": "0"})]
    assert len(run(spark, " ", mapping([], rules, required=True))[1]) == 2
    assert run(spark, " ", mapping([], [], required=True))[2]


def test_parameters_are_checked_when_compiled(spark):
    for rule in (Rule("Replace", 0, {"old": ""}), Rule("Replace", 0, {"old": "", "new": ""}), Rule("Nope")):
        with pytest.raises(ValueError):
            run(spark, "x", mapping([rule]))
    with pytest.raises(ValueError):
        run(spark, "x", mapping([], [Rule("Pattern")]))
    with pytest.raises(ValueError):
        map_columns(spark.createDataFrame([("a",)], "x string"), [FieldMapping("y", "z")])


def test_preview_shows_cells_in_row_order(spark):
    df = spark.createDataFrame([(3, "b"), (2, " a "), (4, None)], "_row_number bigint, Source string")
    m = mapping([Rule("Trim", 1), Rule("Numeric", 2)])
    rows = preview(df, [m], {"Target": "Integer"}, 2).collect()
    assert [r["_row_number"] for r in rows] == [2, 3]
    assert rows[0]["cells"][0]["original_value"] == " a " and not rows[0]["is_valid"]
    assert len(rows[0]["cells"][0]["errors"]) == 1
    with pytest.raises(ValueError):
        preview(df, [m], {}, 0)


def test_long_chain_keeps_one_projection_per_step(spark):
    chain = [Rule(kind, i) for i, kind in enumerate(["Trim", "Numeric", "Uppercase"] * 6)]
    df = spark.createDataFrame([(1, "1.50")], "_row_number bigint, Source string")
    out = evaluate(df, [mapping(chain)], {"Target": "Decimal"})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 200_000
    assert out.first()["Target"]["value"] == "1.50"


@pytest.mark.parametrize(
    "rule",
    [Rule("DateRange", 0, {"min": "2024-01-01", "max": "1/1/2x"}), Rule("NumericRange", 0, {"min": "1", "max": "x"}),
     Rule("Pattern", 0, {"pattern": "("})],
)
def test_unreadable_bounds_stop_the_run(spark, rule):
    df = spark.createDataFrame([(1, "2020-01-01")], "_row_number bigint, Source string")
    with pytest.raises(ValueError, match="is not valid"):
        evaluate(df, [mapping([], [rule])], {"Target": "String"})


def test_bounds_in_other_shapes(spark):
    df = spark.createDataFrame([(1, "2020-01-02"), (2, "900")], "_row_number bigint, Source string")
    rules = [Rule("DateRange", 0, {"min": "1/1/19", "max": "1/1/20"}), Rule("NumericRange", 0, {"min": "0", "max": "1,000"})]
    judged = evaluate(df, [mapping([], rules)], {"Target": "String"})
    assert [r["_row_number"] for r in error_rows(judged, "_row_number").collect()] == [1]


def test_rarer_date_shapes(spark):
    from gatehouse.functions.dates import to_datetime

    shapes = {
        "1/5/24": "2024-01-05 00:00:00", "1-5-49": "2049-01-05 00:00:00", "1/5/50 3:04": "1950-01-05 03:04:00",
        "2024-01": "2024-01-01 00:00:00", "2024-01-05T10:00Z": "2024-01-05 10:00:00", "2024-01-05T10:00+02:00": "2024-01-05 08:00:00",
        "2024-01-05 10:00:00 +02:00": "2024-01-05 08:00:00", "Friday, January 5, 2024": "2024-01-05 00:00:00",
        "Fri, 05 Jan 2024 10:00:00 GMT": "2024-01-05 10:00:00", "1/5/24 10:00 PM": "2024-01-05 22:00:00",
        "13/5/24": None, "Friday": None, "2024-13": None, "Fried, 1/5/2024": None, "1/5/2": None, "1/5/245": None,
    }
    rows = spark.createDataFrame([(k,) for k in shapes], "v string").select("v", to_datetime(F.col("v")).cast("string").alias("d"))
    assert {r["v"]: r["d"] for r in rows.collect()} == shapes
