"""The golden two-file ingest and its variants."""

import pytest
from pyspark.sql import functions as F

from gatehouse.operators.config import FieldMapping, Rule
from gatehouse.plans.ingest import ImportRun, ingest

HEADER = ["CraneNo", "Name", "Depot", "Pull", "Status"]
FIRST = [("E000", "Initial User", "initial.user@example.com", "50000", "ACTIVE")]
SECOND = [
    ("E001", " Alice Smith ", "ALICE@EXAMPLE.COM", "75000", "active"),
    ("BAD", "", "not-an-email", "abc", "BLOCKED"),
    ("E001", "Duplicate User", "duplicate@example.com", "90000", "ACTIVE"),
]
CONFIG = (
    FieldMapping("CraneNo", "CraneNo", transformations=(Rule("Trim", 1),)),
    FieldMapping("Name", "Name", transformations=(Rule("Trim", 1),), validations=(Rule("Required", 1),)),
    FieldMapping("Depot", "Depot", transformations=(Rule("Trim", 1), Rule("Lowercase", 2)),
                 validations=(Rule("Pattern", 1, {"pattern": "^[^@]+@[^@]+$"}),)),
    FieldMapping("Pull", "Pull", transformations=(Rule("Numeric", 1),),
                 validations=(Rule("NumericRange", 1, {"min": "0", "max": "1000000"}),)),
    FieldMapping("Status", "Status", transformations=(Rule("Trim", 1), Rule("Uppercase", 2)),
                 validations=(Rule("AllowedValues", 1, {"values": "ACTIVE|INACTIVE"}),)),
)


def feed(spark, rows):
    schema = "_row_number bigint, " + ", ".join(f"{h} string" for h in HEADER)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, start=2)], schema)


def settings(mode, behaviour, **more):
    return ImportRun("run-" + mode, "cranes", "ws", mode, behaviour, ("CraneNo",), **more)


@pytest.fixture(scope="module")
def first(spark):
    return ingest(feed(spark, FIRST), None, None, settings("Full", "Reject"))


def counters(result):
    row = result.run.first()
    return tuple(row[n] for n in ("total", "success", "rejected", "errors", "superseded", "status"))


def test_first_import_fixes_the_schema(first):
    assert [(c.name, c.data_type, c.is_key) for c in first.columns] == [
        ("CraneNo", "String", True), ("Name", "String", False), ("Depot", "String", False),
        ("Pull", "Integer", False), ("Status", "String", False),
    ]
    assert counters(first) == (1, 1, 0, 0, 0, "Completed")
    assert first.records.first()["key_hash"] == "42FEB26E871A2E88933BD08339D1C8A076CDEC073A92DDD8333321A2DA57DD78"


def test_append_reject(spark, first):
    result = ingest(feed(spark, SECOND), first.records, first.columns, settings("Append", "Reject", mappings=CONFIG))
    assert counters(result) == (3, 1, 2, 6, 0, "Completed With Errors")
    records = {r["CraneNo"]: r for r in result.records.collect()}
    assert set(records) == {"E000", "E001"}
    alice = records["E001"]
    assert (alice["Name"], alice["Depot"], alice["Pull"], alice["Status"]) == ("Alice Smith", "alice@example.com", 75000, "ACTIVE")
    assert alice["key_hash"] == "A6634568695C7BD7463914EF7404A939DAB3FB7A15C189847E783693B0B0AEBC"
    errors = sorted((r["_row_number"], r["column_name"] or "", r["error_type"]) for r in result.errors.collect())
    assert errors == [
        (3, "Depot", "Validation Error"), (3, "Name", "Validation Error"), (3, "Pull", "Processing Error"),
        (3, "Pull", "Transformation Error"), (3, "Status", "Validation Error"), (4, "", "Duplicate Error"),
    ]


def test_append_update_last_row_wins(spark, first):
    result = ingest(feed(spark, SECOND), first.records, first.columns, settings("Append", "Update", mappings=CONFIG))
    assert counters(result) == (3, 1, 1, 5, 1, "Completed With Errors")
    row = result.records.filter("CraneNo = 'E001'").first()
    assert (row["Name"], row["Pull"]) == ("Duplicate User", 90000)


def test_full_replaces_everything(spark, first):
    result = ingest(feed(spark, SECOND), first.records, first.columns, settings("Full", "Reject", mappings=CONFIG))
    assert [r["CraneNo"] for r in result.records.collect()] == ["E001"]


def test_existing_key_is_rejected_or_updated(spark, first):
    again = feed(spark, [("E000", "New Name", "n@example.com", "1", "ACTIVE"), ("E002", "B", "b@x", "2", "ACTIVE")])
    skipped = ingest(again, first.records, first.columns, settings("Append", "Skip"))
    assert counters(skipped) == (2, 1, 1, 1, 0, "Completed With Errors")
    assert skipped.errors.first()["description"] == "Duplicate record already exists in the dataset. Behavior: Skip."
    run = ImportRun("later", "cranes", "ws", "Append", "Update", ("CraneNo",), at="2024-05-01 00:00:00")
    updated = ingest(again, first.records, first.columns, run)
    old, new = first.records.first(), updated.records.filter("CraneNo = 'E000'").first()
    assert counters(updated) == (2, 2, 0, 0, 0, "Completed")
    assert new["record_id"] == old["record_id"] and new["created_at"] == old["created_at"]
    assert new["Name"] == "New Name" and new["source_import_id"] == "later" and str(new["updated_at"]) == "2024-05-01 00:00:00"


def test_refusals(spark, first):
    with pytest.raises(ValueError, match="must be a Full Import"):
        ingest(feed(spark, FIRST), None, None, settings("Append", "Skip"))
    with pytest.raises(ValueError, match=r"Missing: \[Status\]. Additional: \[\]"):
        ingest(feed(spark, FIRST).drop("Status"), first.records, first.columns, settings("Append", "Skip"))
    with pytest.raises(ValueError, match="do not match the dataset's configured key columns"):
        ingest(feed(spark, FIRST), first.records, first.columns, ImportRun("r", "d", "w", "Full", "Skip", ("Name",)))
    with pytest.raises(ValueError, match="Unknown key column"):
        ingest(feed(spark, FIRST), None, None, ImportRun("r", "d", "w", "Full", "Skip", ("Nope",)))


def test_hot_key_in_batch(spark, first):
    """A third of all rows share one key; nothing is lost and the first row wins."""
    rows = [("HOT" if i % 3 == 0 else f"K{i}", "n", "e@x", str(i), "ACTIVE") for i in range(3000)]
    result = ingest(feed(spark, rows).repartition(7), first.records, first.columns, settings("Append", "Skip"))
    assert counters(result) == (3000, 2001, 999, 999, 0, "Completed With Errors")
    assert result.records.filter("CraneNo = 'HOT'").first()["Pull"] == 0


def test_headers_with_underscores_are_data(spark, tmp_path):
    from gatehouse.sources.delimited import read_delimited

    (tmp_path / "a.csv").write_text("_id,name,_Row_Number,_v0\n1,ann,7,x\n2,ann,8,x\n2,bob,9,y\n")
    batch = read_delimited(spark, str(tmp_path / "a.csv"))
    first = ingest(batch, None, None, ImportRun("r", "d", "w", "Full", "Reject", ("_id",)))
    assert [c.name for c in first.columns] == ["_id", "name", "_Row_Number", "_v0"]
    rows = sorted((r["_id"], r["name"], r["_Row_Number"], r["_v0"]) for r in first.records.collect())
    assert rows == [(1, "ann", 7, "x"), (2, "ann", 8, "x")]
    second = ingest(batch, first.records, first.columns, ImportRun("r2", "d", "w", "Append", "Update", ("_id",)))
    assert sorted((r["_id"], r["name"]) for r in second.records.collect()) == [(1, "ann"), (2, "bob")]
    assert {r["description"] for r in first.errors.collect()} == {"Duplicate record detected. Behavior: Reject."}
