"""Files, workbooks, the landing gate and the versioned store."""

import datetime
import pathlib

import pytest
from pyspark.sql import functions as F

from gatehouse.operators.schema import header_audit, validate_key_columns
from gatehouse.sources import delimited, keyed, landing, store, workbooks
from suite.fixtures import workbook_bytes


def lay(folder: pathlib.Path, **files: str) -> str:
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / name.replace("_", ".")).write_bytes(text.encode("utf-8"))
    return str(folder)


def test_csv_rows_numbers_padding_and_quotes(spark, tmp_path):
    path = lay(tmp_path / "a", x_csv='﻿Id, Name ,Note\r\n1, a ,"x, ""y""\nz"\r\n\r\n , ,\r\n2,b\r\n')
    rows = [tuple(r)[1:] for r in delimited.read_delimited(spark, path).orderBy("_row_number").collect()]
    assert rows == [(2, "1", " a ", 'x, "y"\nz'), (3, "2", "b", "")]
    assert delimited.read_delimited(spark, path).columns[2:] == ["Id", "Name", "Note"]


def test_csv_without_header_takes_the_widest_row(spark, tmp_path):
    path = lay(tmp_path / "a", x_csv="1;2\n3;4;5;6;7\n8\n")
    df = delimited.read_delimited(spark, path, ";", header=False)
    assert df.columns[2:] == [f"Column{i}" for i in range(1, 6)]
    assert [tuple(r)[1:] for r in df.orderBy("_row_number").collect()] == [
        (1, "1", "2", "", "", ""), (2, "3", "4", "5", "6", "7"), (3, "8", "", "", "", ""),
    ]


def test_csv_refusals(spark, tmp_path):
    with pytest.raises(ValueError, match="row 2 is wider"):
        delimited.read_delimited(spark, lay(tmp_path / "wide", x_csv="a,b\n1,2,3\n"))
    with pytest.raises(ValueError, match="blank headers"):
        delimited.read_delimited(spark, lay(tmp_path / "blank", x_csv="a, \n1,2\n"))
    with pytest.raises(ValueError, match="Duplicate column name 'a'"):
        delimited.read_delimited(spark, lay(tmp_path / "twice", x_csv="a,A\n1,2\n"))
    with pytest.raises(ValueError, match="one header"):
        delimited.read_delimited(spark, lay(tmp_path / "two", x_csv="a,b\n1,2\n", y_csv="b,a\n1,2\n"))
    with pytest.raises(ValueError, match="one character"):
        delimited.read_delimited(spark, str(tmp_path), ";;")


def test_row_numbers_of_a_split_file(spark, tmp_path):
    lines = "\n".join(["id,v", *(f"{i},{'x' * 50}" for i in range(5000))])
    path = lay(tmp_path / "big", x_csv=lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = delimited.read_delimited(spark, path, multi_line=False)
        assert df.filter(F.col("_row_number") != F.col("id").cast("bigint") + 2).count() == 0
        assert df.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_file_headers_and_audit(spark, tmp_path):
    path = lay(tmp_path / "h", a_csv='id,"last, first",x\n1,2,3\n', b_csv="\n\nid,,x\n", c_csv="a,b, A\n")
    headers = delimited.file_headers(spark, path)
    found = {r["file"].rsplit("/", 1)[1]: r["headers"] for r in headers.collect()}
    assert found["a.csv"] == ["id", "last, first", "x"]
    issues = {r["file"].rsplit("/", 1)[1]: r["issue"] for r in header_audit(headers).collect()}
    assert issues == {
        "b.csv": "File contains missing or blank headers.", "c.csv": "Duplicate column name 'a' was found.",
    }


def test_key_columns():
    assert validate_key_columns(["Crane Number"], ["Crane Number", "Status"]) is None
    assert validate_key_columns([" crane number "], ["﻿Crane Number", "Status"]) is None
    assert validate_key_columns([], ["a"]) is None
    assert validate_key_columns(["Crane Number"], ["CraneNumber", "Status"]) == (
        "Unknown key column(s): Crane Number. Available columns: CraneNumber, Status."
    )


@pytest.mark.parametrize(
    "name, size, reason",
    [
        ("data.csv", 100, None), ("data.XLSX", 100, None), ("data.txt", 100, "Only CSV and XLSX files are supported."),
        ("data.csv", 0, "The uploaded file is empty."), ("data.csv", 25 * 1024 * 1024, None),
        ("data.csv", 25 * 1024 * 1024 + 1, "Maximum file size is 25 MB."),
    ],
)
def test_gate(spark, name, size, reason):
    files = spark.createDataFrame([(f"/in.x/{name}", size)], "path string, length bigint")
    assert landing.gate(files).first()["reason"] == reason


def test_gate_on_a_folder(spark, tmp_path):
    path = lay(tmp_path / "in", a_csv="x\n", b_txt="x", c_csv="")
    found = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in landing.file_gate(spark, path).collect()}
    assert found == {
        "a.csv": None, "b.txt": "Only CSV and XLSX files are supported.", "c.csv": "The uploaded file is empty.",
    }


def test_workbooks(spark, tmp_path):
    folder = tmp_path / "books"
    folder.mkdir()
    (folder / "one.xlsx").write_bytes(workbook_bytes([["Id", "Name", "Ok"], ["1", "A & B", "true"], ["2", "", "false"]], "Data"))
    (folder / "two.xlsx").write_bytes(workbook_bytes([["Id", "Name", "Ok"], ["3", "", ""]], "data"))
    files = workbooks.workbook_files(spark, str(folder))
    rows = workbooks.read_workbooks(files, "DATA").orderBy("Id")
    assert [tuple(r)[1:] for r in rows.collect()] == [(2, "1", "A & B", "true"), (3, "2", "", "false"), (2, "3", "", "")]
    assert workbooks.workbook_sheets(files).filter("sheet = 'Notes'").count() == 2
    with pytest.raises(ValueError, match="WorksheetName is required"):
        workbooks.read_workbooks(files, " ")
    with pytest.raises(Exception, match="was not found"):
        workbooks.read_workbooks(files, "other")


def test_store_publishes_whole_versions(spark, tmp_path):
    path = str(tmp_path / "table")
    assert store.read_table(spark, path) is None
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "key_hash string, n int")
    store.full_replace(rows, path, "r1")
    keyed.append_records(rows.union(spark.createDataFrame([("c", 3)], rows.schema)), path, "r2")
    keyed.append_records(rows.union(spark.createDataFrame([("c", 3)], rows.schema)), path, "r2")
    assert sorted(r["key_hash"] for r in store.read_table(spark, path).collect()) == ["a", "b", "c"]
    manifest = store.read_manifest(spark, path)
    assert manifest["run"] == "r2" and [run for run, _ in manifest["runs"]] == ["r1", "r2"]
    store.full_replace(rows.limit(0), path, "r3")
    assert store.read_table(spark, path).count() == 0


def test_failed_write_leaves_the_published_version(spark, tmp_path):
    path = str(tmp_path / "table")
    store.full_replace(spark.range(3).withColumnRenamed("id", "n"), path, "r1")
    broken = spark.range(3).select(F.raise_error(F.lit("stop")).cast("bigint").alias("n"))
    with pytest.raises(Exception, match="stop"):
        store.full_replace(broken, path, "r2")
    with pytest.raises(Exception, match="stop"):
        store.full_replace(broken, path, "r1")
    with pytest.raises(Exception, match="stop"):
        keyed.append_records(broken.withColumn("key_hash", F.col("n")), path, "r1")
    assert store.read_table(spark, path).count() == 3


def test_conflicting_writers(spark, tmp_path):
    path = str(tmp_path / "table")
    store.full_replace(spark.range(3), path, "r1")
    base = store.read_manifest(spark, path)["version"]
    store.full_replace(spark.range(4), path, "r2")
    with pytest.raises(store.Conflict):
        store.full_replace(spark.range(5), path, "r3", base=base)
    assert store.read_table(spark, path).count() == 4
    assert not store._add_manifest(spark, path, {"version": base + 1, "runs": [], "run": None, "marks": {}})
    assert store.vacuum(spark, path) > 0 and store.read_table(spark, path).count() == 4


def test_staging_rewrites_only_its_run(spark, tmp_path):
    path = str(tmp_path / "staging")
    store.write_staging(spark.range(3), path, "r1")
    store.write_staging(spark.range(4), path, "r2")
    store.write_staging(spark.range(1), path, "r1")
    counts = {r["import_id"]: r["count"] for r in store.read_table(spark, path).groupBy("import_id").count().collect()}
    assert counts == {"r1": 1, "r2": 4}
    store.write_staging(spark.range(0), path, "r1")
    assert {r["import_id"] for r in store.read_table(spark, path).collect()} == {"r2"}


def test_run_audit(spark):
    at = datetime.datetime(2024, 1, 1)
    runs = spark.createDataFrame(
        [("1", "Failed", 0, 3, 9, 1, at), ("2", "Completed", 5, 0, 9, 1, at)],
        "import_id string, status string, success int, rejected int, user_id int, workspace_id int, completed_at timestamp_ntz",
    )
    rows = store.run_audit(runs).orderBy("entity_id").collect()
    assert [(r["action"], r["details"]) for r in rows] == [
        ("Import Failure", "Import failed: 0 imported, 3 rejected."),
        ("Import Completion", "Import completed: 5 imported, 0 rejected."),
    ]
