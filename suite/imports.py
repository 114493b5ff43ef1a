"""Keys, de-duplication, upsert and whole imports."""

from pyspark.sql import functions as F

from gatehouse.functions.hashing import key_hash
from gatehouse.operators import dedup as dd
from gatehouse.operators.config import FieldMapping, Rule
from gatehouse.operators.schema import ColumnSpec
from gatehouse.plans.ingest import ImportRun, ingest, try_ingest
from gatehouse.sources import keyed
from gatehouse.sources.store import read_manifest, read_table
from suite.registry import query


@query("e1_key_hash", """
    SELECT _row_number, upper(sha256(coalesce(trim(name, ' ' || chr(9)), '') || chr(31) || coalesce(trim(segment), ''))) AS key_hash FROM {people}""")
def e1(t):
    return t("people").select("_row_number", key_hash([F.col("name"), F.col("segment")]).alias("key_hash"))


BATCH = """
    SELECT o_orderkey AS _row_number, CAST(o_custkey AS STRING) AS key_hash, o_orderpriority AS priority, o_orderstatus <> 'P' AS is_valid
    FROM {orders}"""
TARGET = """
    SELECT CAST(c_custkey * 2 AS STRING) AS key_hash, c_custkey AS record_id, c_mktsegment AS priority, 'old' AS created_at FROM {customer}"""
WINNERS = f"""
    WITH batch AS ({BATCH}), target AS ({TARGET}),
    first_rows AS (SELECT * FROM batch WHERE is_valid QUALIFY row_number() OVER (PARTITION BY key_hash ORDER BY _row_number) = 1),
    last_rows AS (SELECT * FROM batch WHERE is_valid QUALIFY row_number() OVER (PARTITION BY key_hash ORDER BY _row_number DESC) = 1)"""


def valid_rows(t):
    return t.sql(BATCH).filter("is_valid")


@query("e2_first_wins", WINNERS + """
    SELECT b._row_number, f._row_number IS NOT NULL AS kept FROM batch b LEFT JOIN first_rows f ON f._row_number = b._row_number WHERE b.is_valid""")
def e2(t):
    kept, dropped = dd.dedup(valid_rows(t), dd.REJECT)
    return kept.select("_row_number", F.lit(True).alias("kept")).unionByName(dropped.select("_row_number", F.lit(False).alias("kept")))


@query("e2_duplicate_errors", WINNERS + """
    SELECT _row_number, 'Duplicate Error' AS error_type, 'Duplicate record detected. Behavior: Skip.' AS description
    FROM batch WHERE is_valid AND _row_number NOT IN (SELECT _row_number FROM first_rows)""")
def e2_errors(t):
    _, dropped = dd.dedup(valid_rows(t), dd.SKIP)
    return dd.duplicate_errors(dropped, dd.in_batch_message(dd.SKIP)).select("_row_number", "error_type", "description")


@query("e3_last_wins", WINNERS + " SELECT _row_number, key_hash, priority FROM last_rows")
def e3(t):
    kept, _ = dd.dedup(valid_rows(t), dd.UPDATE)
    return kept.select("_row_number", "key_hash", "priority")


@query("e4_append_against_target", WINNERS + """
    SELECT _row_number, key_hash, key_hash IN (SELECT key_hash FROM target) AS is_rejected FROM first_rows""")
def e4(t):
    kept, _ = dd.dedup(valid_rows(t), dd.SKIP)
    new, existing = dd.split_against_target(kept, t.sql(TARGET))
    return new.select("_row_number", "key_hash", F.lit(False).alias("is_rejected")).unionByName(
        existing.select("_row_number", "key_hash", F.lit(True).alias("is_rejected"))
    )


@query("e5_upsert", WINNERS + """
    SELECT coalesce(t.key_hash, b.key_hash) AS key_hash, coalesce(t.record_id, -b._row_number) AS record_id,
           CASE WHEN b.key_hash IS NULL THEN t.priority ELSE b.priority END AS priority, coalesce(t.created_at, 'new') AS created_at
    FROM target t FULL JOIN last_rows b ON b.key_hash = t.key_hash""")
def e5(t):
    kept, _ = dd.dedup(valid_rows(t), dd.UPDATE)
    batch = kept.select("key_hash", (-F.col("_row_number")).alias("record_id"), "priority", F.lit("new").alias("created_at"))
    return dd.upsert(t.sql(TARGET), batch, identity=("record_id", "created_at"))


@query("e4_append_by_filters", WINNERS + """
    SELECT _row_number, key_hash, key_hash IN (SELECT key_hash FROM target) AS is_rejected FROM first_rows""")
def e4_filters(t):
    """The target is a keyed table: bounds and filters say which of its parts may hold a key of the batch."""
    path = t.scratch("target")
    keyed.write_keyed(t.sql(TARGET), path, "seed", part_rows=200)
    kept, _ = dd.dedup(valid_rows(t), dd.SKIP)
    known = keyed.known_keys(kept, path).withColumn("is_rejected", F.lit(True))
    return kept.join(known, "key_hash", "left").select("_row_number", "key_hash", F.coalesce("is_rejected", F.lit(False)).alias("is_rejected"))


@query("e5_upsert_by_parts", WINNERS + """
    SELECT coalesce(t.key_hash, b.key_hash) AS key_hash, coalesce(t.record_id, -b._row_number) AS record_id,
           CASE WHEN b.key_hash IS NULL THEN t.priority ELSE b.priority END AS priority, coalesce(t.created_at, 'new') AS created_at
    FROM target t FULL JOIN last_rows b ON b.key_hash = t.key_hash""")
def e5_parts(t):
    """The rows of e5_upsert from a table of many parts, after two batches and a compaction."""
    path = t.scratch("target")
    keyed.write_keyed(t.sql(TARGET), path, "seed", part_rows=200)
    kept, _ = dd.dedup(valid_rows(t), dd.UPDATE)
    batch = kept.select("key_hash", (-F.col("_row_number")).alias("record_id"), "priority", F.lit("new").alias("created_at"))
    for number, part in enumerate((batch.filter("record_id % 2 = 0"), batch.filter("record_id % 2 <> 0"))):
        keyed.upsert_keyed(part, path, f"run-{number}", identity=("record_id", "created_at"), part_rows=500)
    keyed.compact(t.spark, path, small_rows=300, many=2, part_rows=400)
    return read_table(t.spark, path)


@query("e5_untouched_parts", """
    SELECT count(*) AS n_rows, count(*) FILTER (p_partkey BETWEEN lo AND lo + n // 100) AS updated, 0 AS updated_in_kept, true AS most_kept, 1 AS runs_added
    FROM (SELECT *, (SELECT max(p_partkey) // 2 FROM {part}) AS lo, (SELECT count(*) FROM {part}) AS n FROM {part}) GROUP BY lo, n""")
def e5_untouched(t):
    """An upsert of a hundredth of the keys, all near each other: parts that hold none of them keep their names."""
    path = t.scratch("parts")
    rows = t.sql("SELECT lpad(p_partkey, 12, '0') AS key_hash, p_name AS name, 0 AS version FROM {part}")
    keyed.write_keyed(rows, path, "seed", part_rows=max(1, rows.count() // 20))
    before = {part for _, part in read_manifest(t.spark, path)["runs"]}
    batch = t.sql("""SELECT lpad(p_partkey, 12, '0') AS key_hash, upper(p_name) AS name, 1 AS version FROM {part}
        WHERE p_partkey BETWEEN (SELECT max(p_partkey) div 2 FROM {part}) AND (SELECT max(p_partkey) div 2 FROM {part}) + (SELECT count(*) div 100 FROM {part})""")
    keyed.upsert_keyed(batch, path, "run-2")
    after = read_manifest(t.spark, path)
    kept = [part for _, part in after["runs"] if part in before]
    runs_added = len({run for run, _ in after["runs"]})
    in_kept = t.spark.read.parquet(*(f"{path}/{part}" for part in kept)).agg(F.count_if(F.col("version") == 1).alias("updated_in_kept"))
    return read_table(t.spark, path).agg(F.count("*").alias("n_rows"), F.sum("version").alias("updated")).crossJoin(in_kept).select(
        "n_rows", "updated", "updated_in_kept", F.lit(len(kept) >= 0.8 * len(before)).alias("most_kept"), F.lit(runs_added).alias("runs_added"))


@query("e6_run_counters", WINNERS + """
    SELECT (SELECT count(*) FROM batch) AS total,
           (SELECT count(*) FROM first_rows WHERE key_hash NOT IN (SELECT key_hash FROM target)) AS success,
           (SELECT count(*) FROM batch) - (SELECT count(*) FROM first_rows WHERE key_hash NOT IN (SELECT key_hash FROM target)) AS rejected,
           (SELECT count(*) FROM batch) - (SELECT count(*) FROM first_rows WHERE key_hash NOT IN (SELECT key_hash FROM target)) AS errors,
           CAST(0 AS BIGINT) AS superseded, 'Completed With Errors' AS status""")
def e6(t):
    staged = t.sql(BATCH).withColumn("errors", F.when(F.col("is_valid"), F.array()).otherwise(F.array(F.lit("bad"))))
    kept, _ = dd.dedup(staged.filter("is_valid"), dd.SKIP)
    _, existing = dd.split_against_target(kept, t.sql(TARGET))
    return dd.run_counters(staged, kept, existing, dd.APPEND, dd.SKIP)


@query("e7_completion_status", """
    SELECT import_id, CASE WHEN errors > 0 OR rejected > 0 THEN 'Completed With Errors' ELSE 'Completed' END AS status FROM {runs}""")
def e7(t):
    return t("runs").select("import_id", dd.completion_status(F.col("errors"), F.col("rejected")).alias("status"))


# --- whole imports of the orders feed --------------------------------------------------------------------

ORDER_COLUMNS = (
    ColumnSpec("customer", "Integer", 0, True), ColumnSpec("status", "String", 1), ColumnSpec("total", "Decimal", 2),
    ColumnSpec("ordered", "DateTime", 3), ColumnSpec("priority", "String", 4),
)
ORDER_MAPPINGS = (
    FieldMapping("customer", "customer", True, None, (Rule("Trim", 1),), (Rule("Required", 1),)),
    FieldMapping("status", "status", False, None, (Rule("Uppercase", 1),), (Rule("AllowedValues", 1, {"values": "O|F|P"}),)),
    FieldMapping("total", "total", False, None, (), (Rule("NumericRange", 1, {"min": "1000", "max": "400000"}),)),
    FieldMapping("ordered", "ordered", False, None, (), (Rule("DateRange", 1, {"min": "1993-01-01", "max": "2030-01-01"}),)),
    FieldMapping("priority", "priority", False, None, (Rule("Trim", 1), Rule("Lowercase", 2))),
)
JUDGED = """
    WITH judged AS (
        SELECT f._row_number, customer, upper(status) AS status, TRY_CAST(total AS DECIMAL(18,2)) AS total, CAST(ordered AS TIMESTAMP) AS ordered,
               lower(trim(priority)) AS priority, upper(sha256(customer)) AS key_hash,
               upper(status) NOT IN ('O', 'F', 'P') AS bad_status, coalesce(TRY_CAST(total AS DECIMAL(18,2)) NOT BETWEEN 1000 AND 400000, false) AS bad_range,
               total = 'n/a' AS bad_type, ordered < '1993-01-01' AS bad_date FROM {order_feed} f),
    valid AS (SELECT * FROM judged WHERE NOT (bad_status OR bad_range OR bad_type OR bad_date)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY key_hash ORDER BY _row_number) AS from_first,
               row_number() OVER (PARTITION BY key_hash ORDER BY _row_number DESC) AS from_last FROM valid)"""
STORED = """
    SELECT 'r' || CAST(c_custkey AS STRING) AS record_id, 'orders' AS dataset_id, 'ws' AS workspace_id, 'seed' AS source_import_id,
           CAST(c_custkey * 2 AS STRING) AS key_text, TIMESTAMP '2020-01-01 00:00:00' AS seeded, c_custkey * 2 AS customer FROM {customer}"""


def stored_records(t):
    """An existing target: one record for every even customer number, also beyond those in the feed."""
    moment = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    return t.sql("SELECT c_custkey * 2 AS customer, c_custkey FROM {customer}").select(
        F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("record_id"), F.lit("orders").alias("dataset_id"),
        F.lit("ws").alias("workspace_id"), F.lit("seed").alias("source_import_id"),
        key_hash([F.col("customer").cast("string")]).alias("key_hash"), moment.alias("created_at"), moment.alias("updated_at"),
        "customer", F.lit("O").alias("status"), F.lit(1).cast("decimal(38,10)").alias("total"),
        moment.alias("ordered"), F.lit("seed").alias("priority"),
    )


def run_orders(t, mode, behaviour):
    run = ImportRun("run-7", "orders", "ws", mode, behaviour, ("customer",), ORDER_MAPPINGS, "2024-05-01 00:00:00")
    return ingest(t("order_feed"), stored_records(t), ORDER_COLUMNS, run)


def shown(records):
    return records.select(
        "key_hash", "source_import_id", "customer", "status", F.col("total").cast("double").alias("total"), "ordered", "priority",
        "created_at", "updated_at",
    )


SEEDED = """
    SELECT upper(sha256(CAST(c_custkey * 2 AS VARCHAR))) AS key_hash, 'seed' AS source_import_id, c_custkey * 2 AS customer, 'O' AS status,
           CAST(1 AS DOUBLE) AS total, TIMESTAMP '2020-01-01' AS ordered, 'seed' AS priority, TIMESTAMP '2020-01-01' AS created_at, TIMESTAMP '2020-01-01' AS updated_at
    FROM {customer}"""
NEW_ROW = """
    SELECT key_hash, 'run-7' AS source_import_id, CAST(customer AS BIGINT) AS customer, status, CAST(total AS DOUBLE) AS total, ordered, priority,
           TIMESTAMP '2024-05-01' AS created_at, TIMESTAMP '2024-05-01' AS updated_at FROM ranked"""


@query("e8_ingest_full", JUDGED + f" {NEW_ROW} WHERE from_first = 1")
def e8_full(t):
    return shown(run_orders(t, "Full", "Skip").records)


@query("e8_ingest_append_skip", JUDGED + f", seeded AS ({SEEDED}) SELECT * FROM seeded UNION ALL SELECT * FROM ({NEW_ROW} WHERE from_first = 1) n WHERE n.key_hash NOT IN (SELECT key_hash FROM seeded)")
def e8_append(t):
    return shown(run_orders(t, "Append", "Skip").records)


@query("e8_ingest_append_update", JUDGED + f""", seeded AS ({SEEDED}), news AS ({NEW_ROW} WHERE from_last = 1)
    SELECT * FROM seeded WHERE key_hash NOT IN (SELECT key_hash FROM news)
    UNION ALL SELECT n.* REPLACE (coalesce(s.created_at, n.created_at) AS created_at) FROM news n LEFT JOIN seeded s ON s.key_hash = n.key_hash""")
def e8_update(t):
    return shown(run_orders(t, "Append", "Update").records)


@query("e8_added_rows", JUDGED + f" {NEW_ROW} WHERE from_first = 1 AND CAST(customer AS BIGINT) % 2 = 1")
def e8_added(t):
    """What an appending import puts into the table: its new rows alone."""
    return shown(run_orders(t, "Append", "Skip").added)


ORDER_ERRORS = """
    SELECT _row_number, 'status' AS column_name, 'Validation Error' AS error_type, 'AllowedValues validation failed.' AS description FROM judged WHERE bad_status
    UNION ALL SELECT _row_number, 'total', 'Validation Error', 'NumericRange validation failed.' FROM judged WHERE bad_range
    UNION ALL SELECT _row_number, 'total', 'Processing Error', 'Value is not compatible with Decimal.' FROM judged WHERE bad_type
    UNION ALL SELECT _row_number, 'ordered', 'Validation Error', 'DateRange validation failed.' FROM judged WHERE bad_date
    UNION ALL SELECT _row_number, NULL, 'Duplicate Error', 'Duplicate record detected. Behavior: Reject.' FROM ranked WHERE from_first > 1
    UNION ALL SELECT _row_number, NULL, 'Duplicate Error', 'Duplicate record already exists in the dataset. Behavior: Reject.' FROM ranked
        WHERE from_first = 1 AND CAST(customer AS BIGINT) % 2 = 0"""


@query("e8_ingest_errors", JUDGED + ORDER_ERRORS)
def e8_errors(t):
    return run_orders(t, "Append", "Reject").errors.select("_row_number", "column_name", "error_type", "description")


COUNTERS = f"""
    SELECT (SELECT count(*) FROM judged) AS total,
           (SELECT count(*) FROM ranked WHERE from_first = 1 AND CAST(customer AS BIGINT) % 2 = 1) AS success,
           (SELECT count(*) FROM judged) - (SELECT count(*) FROM ranked WHERE from_first = 1 AND CAST(customer AS BIGINT) % 2 = 1) AS rejected,
           (SELECT count(*) FROM ({ORDER_ERRORS})) AS errors"""


@query("e8_ingest_run_row", JUDGED + COUNTERS)
def e8_run(t):
    return run_orders(t, "Append", "Reject").run.select("total", "success", "rejected", "errors")


@query("e8_ingest_report", JUDGED + f""", counters AS ({COUNTERS}), found AS ({ORDER_ERRORS})
    SELECT coalesce(column_name, '(row)') AS column_name, error_type, count(*) AS error_count, any_value(c.total) AS run_total,
           any_value(c.success) AS run_success, any_value(c.rejected) AS run_rejected, 'Completed With Errors' AS run_status
    FROM found, counters c GROUP BY column_name, error_type""")
def e8_report(t):
    """The run's counters beside its errors by column and type."""
    result = run_orders(t, "Append", "Reject")
    run = result.run.select(
        F.col("total").alias("run_total"), F.col("success").alias("run_success"), F.col("rejected").alias("run_rejected"),
        F.col("status").alias("run_status"), "import_id",
    )
    by_column = result.errors.groupBy(F.coalesce("column_name", F.lit("(row)")).alias("column_name"), "error_type").agg(
        F.count("*").alias("error_count")
    )
    return by_column.withColumn("import_id", F.lit("run-7")).join(run, "import_id").drop("import_id")


@query("e8_first_import", """
    SELECT upper(sha256(CAST(o_orderkey AS VARCHAR))) AS key_hash, o_orderkey, o_orderstatus AS status, CAST(o_orderdate AS TIMESTAMP) AS ordered
    FROM {orders}""")
def e8_first(t):
    """No target and no schema: types are inferred from the whole feed."""
    feed = t.sql("""SELECT o_orderkey AS _row_number, CAST(o_orderkey AS STRING) AS id, o_orderstatus AS status,
        CAST(CAST(o_orderdate AS DATE) AS STRING) AS ordered FROM {orders}""")
    result = ingest(feed, None, None, ImportRun("run-1", "orders", "ws", "Full", "Reject", ("ID",)))
    return result.records.select("key_hash", F.col("id").alias("o_orderkey"), "status", "ordered")


@query("e8_failed_run", """
    SELECT status, description, count(*) AS stored FROM {customer} CROSS JOIN (VALUES
        ('Failed', 'Schema mismatch. Missing: [name]. Additional: [label].'), ('Cancelled', 'The import was cancelled.')) x(status, description)
    GROUP BY ALL""")
def e8_failed(t):
    """A refused and a cancelled import leave the target as it was, with an error row and a run row each."""
    feed = t.sql("SELECT c_custkey AS _row_number, CAST(c_custkey AS STRING) AS id, c_name AS name FROM {customer}")
    first = ingest(feed, None, None, ImportRun("run-1", "customers", "ws", "Full", "Reject", ("id",)))
    run = ImportRun("run-2", "customers", "ws", "Append", "Skip", ("id",))
    bad = try_ingest(feed.withColumnRenamed("name", "label"), first.records, first.columns, run)
    stopped = try_ingest(feed, first.records, first.columns, run, cancelled=lambda: True)
    told = [
        outcome.records.agg(F.count("*").alias("stored")).select(
            F.lit(outcome.run.first()["status"]).alias("status"), F.lit(outcome.errors.first()["description"]).alias("description"), "stored")
        for outcome in (bad, stopped)
    ]
    return told[0].unionByName(told[1])
