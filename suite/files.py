"""File sources and sinks: tables are written by Spark and read back by the operator."""

from pyspark.sql import functions as F

from gatehouse.functions.hashing import key_hash
from gatehouse.sources import delimited, headed, keyed, landing, quoted, store, workbooks
from suite import fixtures
from gatehouse.operators.schema import ColumnSpec, header_audit
from gatehouse.plans.ingest import ImportRun, ingest
from suite.registry import query


@query("a1_read_delimited", """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, upper(sha256(text)) AS text_hash FROM {documents}""")
def a1(t):
    """Whole documents with quotes, delimiters and line breaks inside cells."""
    docs = t("documents").select(F.col("doc_id").cast("string"), "text", "lang", "source")
    path = fixtures.write_csv(docs, t.scratch("documents"), ";")
    rows = delimited.read_delimited(t.spark, path, ";")
    return rows.select("doc_id", "lang", "source", F.upper(F.sha2("text", 256)).alias("text_hash"))


@query("a1_split_by_quotes", """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, upper(sha256(text)) AS text_hash, 1 + row_number() OVER (ORDER BY doc_id) AS row_number
    FROM {documents}""")
def a1_split(t):
    """One file of whole documents, read in splits of a hundredth of it, which begin anywhere in their cells."""
    docs = t("documents").orderBy("doc_id").select(F.col("doc_id").cast("string"), "text", "lang", "source")
    path = fixtures.write_csv(docs.coalesce(1), t.scratch("documents"), ";")
    size = t.spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    settings = {"spark.sql.files.maxPartitionBytes": str(max(1000, size // 100)), "spark.sql.files.openCostInBytes": "0"}
    before = {name: t.spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            t.spark.conf.set(name, value)
        rows = quoted.read_quoted(t.spark, path, ";")
    finally:
        for name, value in before.items():
            t.spark.conf.set(name, value)
    return rows.select("doc_id", "lang", "source", F.upper(F.sha2("text", 256)).alias("text_hash"), F.col("_row_number").alias("row_number"))


CUSTOMER_COLUMNS = (ColumnSpec("id", "Integer", 0, True), ColumnSpec("name", "String", 1))


@query("a1_refused_files", """
    SELECT c_nationkey AS g, CASE WHEN c_nationkey % 3 = 0 THEN 'Schema mismatch. Missing: [NAME]. Additional: [LABEL].'
           WHEN c_nationkey % 3 = 1 THEN 'File contains missing or blank headers.' ELSE 'read' END AS outcome,
           CASE WHEN c_nationkey % 3 = 2 THEN count(*) ELSE 1 END AS n_rows
    FROM {customer} GROUP BY c_nationkey""")
def a1_refused(t):
    """Files of another header, or with a row wider than the header, are refused; the rows of the others are read."""
    lines = t.sql("""SELECT c_nationkey, c_custkey, CASE WHEN c_nationkey % 3 = 1 THEN concat(c_custkey, ',x,y') ELSE concat(c_custkey, ',x') END AS value
        FROM {customer}""")
    heads = t.sql("""SELECT DISTINCT c_nationkey, CAST(-1 AS BIGINT) AS c_custkey,
        CASE WHEN c_nationkey % 3 = 0 THEN 'id,label' ELSE 'id,name' END AS value FROM {customer}""")
    path = fixtures.write_ordered_lines(lines.unionByName(heads), "c_nationkey", "c_custkey", t.scratch("landing"))
    rows, issues = headed.read_headed(t.spark, f"{path}/*/*", CUSTOMER_COLUMNS)
    told = rows.select(F.col("_source_file").alias("file"), F.lit("read").alias("outcome")).unionByName(
        issues.select("file", F.col("description").alias("outcome")))
    group = F.regexp_extract("file", r"c_nationkey=(\d+)/", 1).cast("int").alias("g")
    return told.groupBy(group, "outcome").agg(F.count("*").alias("n_rows"))


@query("a2_refused_workbooks", """
    SELECT 'book-' || CAST(book AS VARCHAR) || '.xlsx' AS file, CASE book % 4 WHEN 1 THEN 'The workbook could not be read.'
           WHEN 2 THEN 'Worksheet ''Data'' was not found.' WHEN 3 THEN 'Schema mismatch. Missing: [NAME]. Additional: [LABEL].' ELSE 'read' END AS outcome,
           CASE WHEN book % 4 = 0 THEN count(*) ELSE 1 END AS n_rows
    FROM (SELECT c_custkey // 20 AS book FROM {customer}) GROUP BY book""")
def a2_refused(t):
    """Good workbooks between broken ones, ones without the sheet, and ones of another header."""
    feed = t.sql("SELECT c_custkey DIV 20 AS book, CAST(c_custkey AS STRING) AS id, c_name AS name, c_name AS label FROM {customer}")
    good = fixtures.workbooks(feed.filter("book % 4 < 2"), "book", ["id", "name"], "Data")
    books = good.withColumn("content", F.when(
        F.regexp_extract("path", r"(\d+)", 1).cast("int") % 4 == 1, F.substring("content", 1, 300)).otherwise(F.col("content")))
    other = fixtures.workbooks(feed.filter("book % 4 = 2"), "book", ["id", "name"], "Else")
    label = fixtures.workbooks(feed.filter("book % 4 = 3"), "book", ["id", "label"], "Data")
    rows, issues = headed.read_headed_workbooks(books.unionByName(other).unionByName(label), "Data", CUSTOMER_COLUMNS)
    told = rows.select(F.col("_source_file").alias("file"), F.lit("read").alias("outcome")).unionByName(
        issues.select("file", F.col("description").alias("outcome")))
    return told.groupBy("file", "outcome").agg(F.count("*").alias("n_rows"))


@query("a1_read_single_lines", """
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment, 2 AS first_row FROM {customer}""")
def a1_lines(t):
    customers = t("customer").select(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    path = fixtures.write_csv(customers, t.scratch("customers"))
    rows = delimited.read_delimited(t.spark, path, multi_line=False)
    first = rows.groupBy("_source_file").agg(F.min("_row_number").cast("int").alias("first_row"))
    return rows.join(first, "_source_file").select("c_custkey", "c_name", "c_mktsegment", "first_row")


BOOK_SQL = """
    SELECT c_custkey // 500 AS book, c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS segment, c_acctbal >= 0 AS active FROM {customer}"""


def customer_books(t):
    feed = t.sql("""SELECT c_custkey DIV 500 AS book, c_custkey AS id, c_name AS name,
        CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment, c_acctbal >= 0 AS active FROM {customer}""")
    return fixtures.workbooks(feed, "book", ["id", "name", "segment", "active"], "Data & more")


@query("a2_read_workbooks", f"""
    SELECT 'book-' || CAST(book AS VARCHAR) || '.xlsx' AS source, 1 + row_number() OVER (PARTITION BY book ORDER BY c_custkey) AS row_number,
           CAST(c_custkey AS VARCHAR) AS id, c_name AS name, segment, CAST(active AS VARCHAR) AS active FROM ({BOOK_SQL})""")
def a2(t):
    rows = workbooks.read_workbooks(customer_books(t), "data & MORE")
    return rows.select(
        F.col("_source_file").alias("source"), F.col("_row_number").alias("row_number"), "id", "name", "segment", "active"
    )


@query("a3_workbook_sheets", f"""
    SELECT DISTINCT 'book-' || CAST(book AS VARCHAR) || '.xlsx' AS file, s.position, s.sheet
    FROM ({BOOK_SQL}) CROSS JOIN (VALUES (1, 'Notes'), (2, 'Data & more')) s(position, sheet)""")
def a3(t):
    return workbooks.workbook_sheets(customer_books(t))


@query("a4_file_gate", """
    SELECT path, size AS length, CASE WHEN size <= 0 THEN 'The uploaded file is empty.' WHEN size > 26214400 THEN 'Maximum file size is 25 MB.'
           WHEN lower(extension) NOT IN ('.csv', '.xlsx') THEN 'Only CSV and XLSX files are supported.' END AS reason
    FROM (SELECT '/landing/' || CAST(file_id AS VARCHAR) || extension AS path, size, extension FROM {files})""")
def a4(t):
    listing = t("files").select(
        F.concat(F.lit("/landing/"), F.col("file_id").cast("string"), "extension").alias("path"), F.col("size").alias("length")
    )
    return landing.gate(listing)


@query("a4_file_gate_on_folder", """
    SELECT count(*) AS files, CAST(0 AS BIGINT) AS refused_csv, count(*) AS refused_text
    FROM (SELECT DISTINCT c_nationkey FROM {customer})""")
def a4_folder(t):
    """One CSV and one text file per nation, gated from file metadata."""
    path = t.scratch("landing")
    lines = t("customer").select("c_nationkey", "c_custkey", F.col("c_name").alias("value"))
    fixtures.write_ordered_lines(lines, "c_nationkey", "c_custkey", f"{path}/text")
    lines.select("c_nationkey", "value").repartition("c_nationkey").write.partitionBy("c_nationkey").csv(f"{path}/csv")
    gated = landing.file_gate(t.spark, path)
    csv = F.col("path").endswith(".csv")
    return gated.agg(
        F.count_if(csv).alias("files"), F.count_if(csv & F.col("reason").isNotNull()).alias("refused_csv"),
        F.count_if(~csv & (F.col("reason") == "Only CSV and XLSX files are supported.")).alias("refused_text"),
    )


NUMBERED = """
    SELECT c_nationkey AS g, c_custkey,
           CASE WHEN c_custkey % 10 = 0 THEN ' , ,' WHEN c_custkey % 10 = 1 THEN CAST(c_custkey AS STRING)
                WHEN c_custkey % 10 = 2 THEN '"' || c_name || ', Ltd",' ELSE CAST(c_custkey AS STRING) || ',' || c_name || ', ' || c_mktsegment END AS value
    FROM {customer}"""


@query("a6_number_and_pad_rows", f"""
    WITH lines AS ({NUMBERED}), kept AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c_custkey) AS row_number FROM lines WHERE c_custkey % 10 <> 0)
    SELECT g, row_number, CASE WHEN c_custkey % 10 = 2 THEN replace(string_split(value, ',')[1], '"', '') || ', Ltd' ELSE string_split(value, ',')[1] END AS Column1,
           CASE WHEN c_custkey % 10 IN (1, 2) THEN '' ELSE string_split(value, ',')[2] END AS Column2,
           CASE WHEN c_custkey % 10 IN (1, 2) THEN '' ELSE string_split(value, ',')[3] END AS Column3 FROM kept""")
def a6(t):
    path = fixtures.write_ordered_lines(t.sql(NUMBERED), "g", "c_custkey", t.scratch("lines"))
    rows = delimited.read_delimited(t.spark, f"{path}/*/*", header=False)
    group = F.regexp_extract("_source_file", r"/g=(-?\d+)/", 1).cast("int")
    return rows.select(group.alias("g"), F.col("_row_number").alias("row_number"), "Column1", "Column2", "Column3")


@query("b1_header_audit_of_files", """
    SELECT DISTINCT c_nationkey AS g, CASE WHEN c_nationkey % 3 = 0 THEN 'Duplicate column name ''id'' was found.' ELSE 'File contains missing or blank headers.' END AS issue
    FROM {customer} WHERE c_nationkey % 3 <> 2""")
def b1_files(t):
    header = F.when(F.col("c_nationkey") % 3 == 0, 'id,name," Id "').when(F.col("c_nationkey") % 3 == 1, "id,,name").otherwise("id,name,segment")
    rows = t("customer").select("c_nationkey", F.col("c_custkey"), F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment").alias("value"))
    heads = t("customer").select("c_nationkey", F.lit(-1).cast("bigint").alias("c_custkey"), header.alias("value")).distinct()
    path = fixtures.write_ordered_lines(rows.unionByName(heads), "c_nationkey", "c_custkey", t.scratch("headers"))
    issues = header_audit(delimited.file_headers(t.spark, f"{path}/*/*"))
    return issues.select(F.regexp_extract("file", r"c_nationkey=(\d+)/", 1).cast("int").alias("g"), "issue")


STAGED = "SELECT _row_number, customer, status FROM {order_feed}"


@query("a7_write_staging", """
    SELECT 'first' AS import_id, _row_number, customer, upper(status) AS status FROM {order_feed}
    UNION ALL SELECT 'second', _row_number, customer, status FROM {order_feed}""")
def a7(t):
    """A repeated run replaces its own rows and leaves the other run's alone."""
    path, rows = t.scratch("staging"), t.sql(STAGED)
    store.write_staging(rows, path, "first")
    store.write_staging(rows, path, "second")
    store.write_staging(rows.withColumn("status", F.upper("status")), path, "first")
    return store.read_table(t.spark, path).select("import_id", "_row_number", "customer", "status")


@query("a8_write_errors", """
    SELECT 'run-1' AS import_id, event_id AS row_number, event_type AS column_name FROM {events}
    UNION ALL SELECT 'run-2', error_id, column_name FROM {import_errors} WHERE workspace_id = 94""")
def a8(t):
    path = t.scratch("errors")
    everything = t("events").select(F.col("event_id").alias("row_number"), F.col("event_type").alias("column_name"))
    some = t("import_errors").filter("workspace_id = 94").select(F.col("error_id").alias("row_number"), "column_name")
    store.write_errors(everything, path, "run-1")
    store.write_errors(some, path, "run-2")
    return store.read_table(t.spark, path).select("import_id", "row_number", "column_name")


@query("a8_retry_without_errors", """
    SELECT 'run-2' AS import_id, event_id AS row_number, event_type AS column_name FROM {events} WHERE event_type = 'error'""")
def a8_retry(t):
    """A run whose second attempt has no errors leaves none behind."""
    path = t.scratch("errors")
    rows = t("events").select(F.col("event_id").alias("row_number"), F.col("event_type").alias("column_name"))
    store.write_errors(rows, path, "run-1")
    store.write_errors(rows.filter("column_name = 'error'"), path, "run-2")
    store.write_errors(rows.filter("false"), path, "run-1")
    return store.read_table(t.spark, path).select("import_id", "row_number", "column_name")


@query("a9_full_replace", "SELECT s_suppkey AS id, s_name AS name FROM {supplier}")
def a9(t):
    path = t.scratch("table")
    store.full_replace(t.sql("SELECT c_custkey AS id, c_name AS name FROM {customer}"), path, "run-1")
    store.full_replace(t.sql("SELECT s_suppkey AS id, s_name AS name FROM {supplier}"), path, "run-2")
    return store.read_table(t.spark, path)


@query("a10_append_records", """
    SELECT CAST(c_custkey * 2 AS VARCHAR) AS key_hash, 'stored' AS origin FROM {customer}
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'appended' FROM {orders} WHERE o_orderkey NOT IN (SELECT c_custkey * 2 FROM {customer})""")
def a10(t):
    path = t.scratch("table")
    batch = t.sql("SELECT CAST(o_orderkey AS STRING) AS key_hash, 'appended' AS origin FROM {orders}")
    store.full_replace(t.sql("SELECT CAST(c_custkey * 2 AS STRING) AS key_hash, 'stored' AS origin FROM {customer}"), path, "run-1")
    keyed.append_records(batch, path, "run-2")
    keyed.append_records(batch, path, "run-2")
    return store.read_table(t.spark, path)


RUN_AUDIT_SQL = """
    SELECT CASE status WHEN 'Failed' THEN 'Import Failure' WHEN 'Cancelled' THEN 'Import Cancellation' ELSE 'Import Completion' END AS action,
           'DataImport' AS entity_type, CAST(import_id AS VARCHAR) AS entity_id, user_id, completed_at AS happened_at FROM {runs}"""


@query("a12_audit_append", RUN_AUDIT_SQL + f" UNION ALL {RUN_AUDIT_SQL}")
def a12(t):
    path = t.scratch("audit")
    store.audit_append(store.run_audit(t("runs")), path)
    store.audit_append(store.run_audit(t("runs")), path)
    return t.spark.read.parquet(path).select("action", "entity_type", "entity_id", "user_id", "happened_at")


@query("a9_replace_from_itself", "SELECT c_custkey AS id, upper(c_name) AS name FROM {customer}")
def a9_retry(t):
    """A published run may be repeated, also when its rows are computed from the table it replaces."""
    path = t.scratch("table")
    store.full_replace(t.sql("SELECT c_custkey AS id, c_name AS name FROM {customer}"), path, "run-1")
    store.full_replace(store.read_table(t.spark, path).withColumn("name", F.upper("name")), path, "run-1")
    store.vacuum(t.spark, path)
    return store.read_table(t.spark, path)


@query("a1_underscore_headers", """
    SELECT upper(sha256(CAST(c_custkey AS VARCHAR))) AS key_hash, c_custkey AS "_id", c_nationkey AS "_row_number", c_name AS "_source_file",
           c_mktsegment AS "_o0", 'x' AS errors
    FROM {customer}""")
def a1_underscore(t):
    """Headers named like working columns or like inner names are data like any other."""
    feed = t.sql("""SELECT CAST(c_custkey AS STRING) AS `_id`, CAST(c_nationkey AS STRING) AS `_row_number`, c_name AS `_source_file`,
        c_mktsegment AS `_o0`, 'x' AS errors FROM {customer}""")
    batch = delimited.read_delimited(t.spark, fixtures.write_csv(feed, t.scratch("underscores")))
    records = ingest(batch, None, None, ImportRun("run-1", "customers", "ws", "Full", "Reject", ("_id",))).records
    return records.select("key_hash", "_id", F.col("_row_number").cast("int").alias("_row_number"), "_source_file", "_o0", "errors")
