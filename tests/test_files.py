"""Files read in splits, and files refused one by one."""

import io
import random
import zipfile

import pytest

from gatehouse.operators.schema import ColumnSpec
from gatehouse.sources import delimited, headed, quoted
from suite.fixtures import workbook_bytes

COLUMNS = (ColumnSpec("id", "Integer", 0, True), ColumnSpec("name", "String", 1))


def by_row(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_splits_settle_quotes(spark, tmp_path, small_splits, end):
    rng = random.Random(end)
    for number in range(3):
        lines = ["id;text;\"no\nte\""]
        for i in range(400):
            cell = "".join(rng.choice(["a", "é", "\n", ";", '""', " ", "\n\n", "x" * 40]) for _ in range(rng.randint(0, 12)))
            lines.append(rng.choice([f'{i};"{cell}";z', f'{i};plain;"{cell}"', f"{i};;", ";;", f'"{i}";"{"long " * rng.choice([1, 300])}"', '" ";"";']))
        (tmp_path / f"f{number}.csv").write_bytes((end.join(lines) + (end if number else "")).encode())
    whole = delimited.read_delimited(spark, str(tmp_path), ";")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    parts = quoted.read_quoted(spark, str(tmp_path), ";")
    assert parts.columns == whole.columns
    if end == "\r\n":
        # Spark's reader of whole files guesses the line end by the first breaks it sees, and may keep carriage returns.
        strip = lambda rows: sorted(tuple(str(v).replace("\r", "") for v in row) for row in rows)
        assert strip(by_row(parts)) == strip(by_row(whole))
    else:
        assert by_row(parts) == by_row(whole)


def test_refusals(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,5" pipe\n')
    with pytest.raises(ValueError, match="not quoted"):
        quoted.read_quoted(spark, str(tmp_path))
    (tmp_path / "a.csv").write_text("\n , \n")
    with pytest.raises(ValueError, match="empty"):
        quoted.read_quoted(spark, str(tmp_path))
    (tmp_path / "a.csv").write_text("id,name\n1,a,b\n")
    with pytest.raises(ValueError, match="wider"):
        quoted.read_quoted(spark, str(tmp_path))


def test_one_file_is_refused_and_others_go_on(spark, tmp_path):
    (tmp_path / "good.csv").write_text("Name,ID\na,1\n,\nb,2\n")
    (tmp_path / "also.csv").write_text("id,name\n3,c\n")
    (tmp_path / "other.csv").write_text("id,label\n4,d\n")
    (tmp_path / "wide.csv").write_text("id,name\n5,e,f\n")
    rows, issues = headed.read_headed(spark, str(tmp_path), COLUMNS)
    assert sorted((r["id"], r["name"]) for r in rows.collect()) == [("1", "a"), ("2", "b"), ("3", "c")]
    assert sorted((r["file"].rsplit("/", 1)[1], r["description"]) for r in issues.collect()) == [
        ("other.csv", "Schema mismatch. Missing: [NAME]. Additional: [LABEL]."), ("wide.csv", "File contains missing or blank headers.")]


def test_workbooks_are_refused_one_by_one(spark):
    good = workbook_bytes([["name", "id"], ["a", "1"], ["b", "2"]], "Data")
    broken = good[: len(good) // 2]
    torn = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(good)) as book, zipfile.ZipFile(torn, "w") as out:
        for name in book.namelist():
            out.writestr(name, book.read(name)[:-40] if name.endswith("sheet2.xml") else book.read(name))
    files = {"good": good, "broken": broken, "torn": torn.getvalue(), "text": b"id,name\n1,a\n", "sheet": workbook_bytes([["id", "name"], ["3", "c"]], "Else"),
             "header": workbook_bytes([["id", "label"], ["4", "d"]], "data"), "wide": workbook_bytes([["id", "name"], ["5", "e", "f"]], "data"),
             "empty": workbook_bytes([], "data")}
    frame = spark.createDataFrame([(f"{name}.xlsx", bytearray(content)) for name, content in files.items()], "path string, content binary")
    rows, issues = headed.read_headed_workbooks(frame, "DATA", COLUMNS)
    assert sorted((r["_source_file"], r["_row_number"], r["id"], r["name"]) for r in rows.collect()) == [("good.xlsx", 2, "1", "a"), ("good.xlsx", 3, "2", "b")]
    assert {r["file"].removesuffix(".xlsx"): r["description"] for r in issues.collect()} == {
        "broken": headed.UNREADABLE, "torn": headed.UNREADABLE, "text": headed.UNREADABLE, "sheet": "Worksheet 'DATA' was not found.",
        "header": "Schema mismatch. Missing: [NAME]. Additional: [LABEL].", "wide": "File contains missing or blank headers.", "empty": headed.EMPTY}
    with pytest.raises(ValueError, match="WorksheetName is required"):
        headed.read_headed_workbooks(frame, " ", COLUMNS)
