"""Streams drained to the end, then read back."""

from pyspark.sql import functions as F

from gatehouse.operators.schema import ColumnSpec
from gatehouse.plans.ingest import ImportRun
from gatehouse.sources.keyed import parts_table
from gatehouse.sources.store import read_table
from gatehouse.streaming import streams
from suite import fixtures
from suite.history import LIFECYCLE_SQL
from suite.registry import query


def events_stream(t):
    """The events table as a stream: it arrives in four files in order, one file per micro-batch."""
    folder, last = t.scratch("events"), t("events").agg(F.max("event_id")).first()[0]
    arrivals = t("events").withColumn("arrival", F.expr(f"width_bucket(event_id, 0, {last + 1}, 4)"))
    for arrival in range(1, 5):
        arrivals.filter(F.col("arrival") == arrival).drop("arrival").repartition(1).write.mode("append").parquet(folder)
    return t.spark.readStream.schema(t("events").schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query("s1_ingest_stream", """
    SELECT upper(sha256(CAST(c_custkey AS VARCHAR))) AS key_hash, c_custkey AS id, c_name AS name, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS balance
    FROM {customer}""")
def s1(t):
    """Half of the files have their columns in another order, and some have rows of blanks; columns bind by name."""
    feed = t.sql("SELECT c_custkey AS id, c_name AS name, CAST(c_acctbal AS DECIMAL(18,2)) AS balance FROM {customer}")
    blank = t.sql("SELECT CAST(NULL AS STRING) AS balance, ' ' AS name, CAST(NULL AS BIGINT) AS id FROM {nation}")
    landing, target = t.scratch("landing"), t.scratch("target")
    fixtures.write_csv(feed.filter("id % 2 = 0").repartitionByRange(2, "id"), f"{landing}/a")
    turned = feed.filter("id % 2 = 1").select(F.col("balance").cast("string"), "name", "id")
    fixtures.write_csv(turned.unionByName(blank).repartition(2), f"{landing}/b")
    columns = (ColumnSpec("id", "Integer", 0, True), ColumnSpec("name", "String", 1), ColumnSpec("balance", "Decimal", 2))
    run = ImportRun("stream", "customers", "ws", "Append", "Update", ("id",))
    streams.ingest_stream(t.spark, f"{landing}/*", columns, run, t.scratch("checkpoint"), target, files_per_batch=2).awaitTermination()
    rows = read_table(t.spark, f"{target}/records")
    return rows.select("key_hash", "id", "name", F.col("balance").cast("double").alias("balance"))


@query("s1_appended_parts", """
    WITH fed AS (SELECT c_custkey % 4 AS batch, c_custkey AS id FROM {customer} UNION ALL SELECT 3, c_custkey FROM {customer} WHERE c_custkey % 4 < 2)
    SELECT 'stream-' || batch AS run, count(DISTINCT id) AS n_rows FROM fed WHERE batch = id % 4 GROUP BY batch""")
def s1_appended(t):
    """Each micro-batch writes a part of its new rows; the last file repeats half of the keys, which are errors there."""
    landing, target = t.scratch("landing"), t.scratch("target")
    feed = t.sql("SELECT c_custkey % 4 AS batch, c_custkey AS id, c_name AS name FROM {customer}")
    for number in range(4):
        again = feed.filter("batch < 2") if number == 3 else feed.limit(0)
        fixtures.write_csv(feed.filter(F.col("batch") == number).unionByName(again).drop("batch").coalesce(1), f"{landing}/{number}")
        columns = (ColumnSpec("id", "Integer", 0, True), ColumnSpec("name", "String", 1))
        run = ImportRun("stream", "customers", "ws", "Append", "Reject", ("id",))
        checkpoint = f"{target}/checkpoint"
        streams.ingest_stream(t.spark, f"{landing}/*", columns, run, checkpoint, target, files_per_batch=1).awaitTermination()
    return parts_table(t.spark, f"{target}/records").groupBy("run").agg(F.sum("rows").alias("n_rows"))


@query("s1_refused_files", """
    SELECT g, CASE WHEN g % 3 = 0 THEN 'Schema mismatch. Missing: [NAME]. Additional: [LABEL].' ELSE 'File contains missing or blank headers.' END AS description
    FROM (SELECT DISTINCT c_nationkey AS g FROM {customer}) WHERE g % 3 < 2""")
def s1_refused(t):
    """A file with another header, or with a row wider than its header, is refused alone."""
    landing, target = t.scratch("landing"), t.scratch("target")
    lines = t.sql("""SELECT c_nationkey, c_custkey, CASE WHEN c_nationkey % 3 = 1 THEN concat(c_custkey, ',x,y') ELSE concat(c_custkey, ',x') END AS value
        FROM {customer}""")
    heads = t.sql("""SELECT DISTINCT c_nationkey, CAST(-1 AS BIGINT) AS c_custkey,
        CASE WHEN c_nationkey % 3 = 0 THEN 'id,label' ELSE 'id,name' END AS value FROM {customer}""")
    fixtures.write_ordered_lines(lines.unionByName(heads), "c_nationkey", "c_custkey", landing)
    columns = (ColumnSpec("id", "Integer", 0, True), ColumnSpec("name", "String", 1))
    run = ImportRun("stream", "customers", "ws", "Append", "Update", ("id",))
    streams.ingest_stream(t.spark, f"{landing}/*", columns, run, t.scratch("checkpoint"), target).awaitTermination()
    errors = read_table(t.spark, f"{target}/errors")
    return errors.select(F.regexp_extract("_source_file", r"c_nationkey=(\d+)/", 1).cast("int").alias("g"), "description")


@query("s2_first_wins_stream", """
    SELECT user_id, event_type, min(event_id) AS event_id FROM {events} GROUP BY user_id, event_type""")
def s2(t):
    keyed = events_stream(t).withColumn("key_hash", F.sha2(F.concat_ws("/", "user_id", "event_type"), 256))
    target = t.scratch("first")
    streams.first_wins_stream(keyed, "key_hash", "event_id", t.scratch("checkpoint"), target).awaitTermination()
    return read_table(t.spark, f"{target}/records").select("user_id", "event_type", "event_id")


@query("s2_duplicate_errors", """
    SELECT event_id, 'Duplicate Error' AS error_type FROM {events}
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1""")
def s2_errors(t):
    keyed = events_stream(t).withColumn("key_hash", F.sha2(F.concat_ws("/", "user_id", "event_type"), 256))
    target = t.scratch("first")
    streams.first_wins_stream(keyed, "key_hash", "event_id", t.scratch("checkpoint"), target).awaitTermination()
    return read_table(t.spark, f"{target}/errors").select("event_id", "error_type")


#: Four batches by event time; every ninth event comes with the next batch, and every 21st is sent again two batches later.
LATE_EVENTS = """
    SELECT event_id, CAST(user_id AS STRING) || '/' || event_type AS key_hash, ts, least(quarter + CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END, 4) AS batch
    FROM (SELECT *, 1 + event_id * 4 DIV (SELECT max(event_id) + 1 FROM {events}) AS quarter FROM {events})
    UNION ALL
    SELECT event_id + 1000000000, CAST(user_id AS STRING) || '/' || event_type, ts, least(1 + event_id * 4 DIV (SELECT max(event_id) + 1 FROM {events}) + 2, 4)
    FROM {events} WHERE event_id % 21 = 0"""
DELAY_MS = 259_200_000
WITHIN_SQL = f"""
    WITH RECURSIVE sent AS ({LATE_EVENTS.replace(" DIV ", " // ").replace("AS STRING", "AS VARCHAR")}),
    timed AS (SELECT *, epoch_ms(ts) AS ms FROM sent),
    mark AS (SELECT b.batch, coalesce((SELECT max(ms) FROM timed e WHERE e.batch < b.batch) - {DELAY_MS}, 0) AS watermark FROM (SELECT DISTINCT batch FROM timed) b),
    line AS (SELECT event_id, key_hash, ms, watermark, row_number() OVER (PARTITION BY key_hash ORDER BY batch, ts, event_id) AS step
             FROM timed JOIN mark USING (batch)),
    replay(event_id, key_hash, step, verdict, until) AS (
        SELECT event_id, key_hash, step, CASE WHEN ms < watermark THEN 'late' ELSE 'first' END, CASE WHEN ms < watermark THEN -1 ELSE ms + {DELAY_MS} END
        FROM line WHERE step = 1
        UNION ALL
        SELECT l.event_id, l.key_hash, l.step,
               CASE WHEN l.ms < l.watermark THEN 'late' WHEN r.until > l.watermark THEN 'repeated' ELSE 'first' END,
               CASE WHEN l.ms < l.watermark OR r.until > l.watermark THEN r.until ELSE l.ms + {DELAY_MS} END
        FROM replay r JOIN line l ON l.key_hash = r.key_hash AND l.step = r.step + 1)"""


def within_watermark(t):
    """The events, some late and some repeated, one file per micro-batch; (records, errors)."""
    folder, target = t.scratch("events"), t.scratch("first")
    sent = t.sql(LATE_EVENTS)
    for batch in range(1, 5):
        sent.filter(F.col("batch") == batch).drop("batch").repartition(1).write.mode("append").parquet(folder)
    stream = t.spark.readStream.schema("event_id bigint, key_hash string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(folder)
    streams.first_within_stream(stream, "key_hash", "ts", ["event_id"], DELAY_MS, t.scratch("checkpoint"), target).awaitTermination()
    return read_table(t.spark, f"{target}/records"), read_table(t.spark, f"{target}/errors")


@query("s2_first_within_watermark", WITHIN_SQL + " SELECT event_id, key_hash FROM replay WHERE verdict = 'first'")
def s2_within(t):
    return within_watermark(t)[0].select("event_id", "key_hash")


@query("s2_late_and_repeated", WITHIN_SQL + """
    SELECT event_id, CASE verdict WHEN 'late' THEN 'Processing Error' ELSE 'Duplicate Error' END AS error_type FROM replay WHERE verdict <> 'first'""")
def s2_late(t):
    return within_watermark(t)[1].select("event_id", "error_type")


@query("s4_published_states", LIFECYCLE_SQL + """
    SELECT CAST(dataset_id AS VARCHAR) AS dataset_id, arg_max(state_after, step) AS status FROM replay GROUP BY dataset_id""")
def s4_states(t):
    asked = t("requests").select("event_id", "dataset_id", "ts", "action")
    folder, target = t.scratch("requests"), t.scratch("target")
    half = asked.agg(F.max("event_id")).first()[0] // 2
    checkpoint = t.scratch("checkpoint")
    for part in (asked.filter(F.col("event_id") <= half), asked.filter(F.col("event_id") > half)):
        # The second half meets a stream that starts again from its checkpoint.
        part.write.mode("append").parquet(folder)
        stream = t.spark.readStream.schema(asked.schema).parquet(folder)
        streams.lifecycle_stream(stream, "dataset_id", ["ts", "event_id"], checkpoint, target).awaitTermination()
    return read_table(t.spark, f"{target}/states")


@query("s3_two_streams_one_target", """
    SELECT CAST(user_id AS VARCHAR) AS key_hash, max(event_id) AS event_id FROM {events} GROUP BY user_id
    UNION ALL SELECT 'order ' || CAST(o_custkey AS VARCHAR), max(o_orderkey) FROM {orders} GROUP BY o_custkey""")
def s3_two(t):
    """A second stream into the same table applies its own batches, whatever numbers the first one used."""
    rows = events_stream(t).select(F.col("user_id").cast("string").alias("key_hash"), "event_id")
    folder, target = t.scratch("orders"), t.scratch("target")
    t.sql("SELECT concat('order ', o_custkey) AS key_hash, o_orderkey AS event_id FROM {orders}").write.parquet(folder)
    more = t.spark.readStream.schema("key_hash string, event_id bigint").parquet(folder)
    for stream in (rows, more):
        streams.upsert_stream(stream, "key_hash", "event_id", t.scratch("checkpoint"), target).awaitTermination()
    return read_table(t.spark, target)


@query("s3_last_wins_upsert_stream", """
    SELECT CAST(user_id AS VARCHAR) AS key_hash, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM {events} GROUP BY user_id""")
def s3(t):
    rows = events_stream(t).select(F.col("user_id").cast("string").alias("key_hash"), "event_id", "event_type")
    target = t.scratch("target")
    streams.upsert_stream(rows, "key_hash", "event_id", t.scratch("checkpoint"), target).awaitTermination()
    return read_table(t.spark, target)


@query("s4_lifecycle_stream", LIFECYCLE_SQL + " SELECT dataset_id, event_id, state_before, accepted, state_after FROM replay")
def s4(t):
    action = (
        F.when(F.col("event_type") == "signup", "activate").when(F.col("event_type") == "purchase", "archive")
        .when(F.col("event_type") == "view", "restore").otherwise(F.col("event_type"))
    )
    asked = events_stream(t).select("event_id", F.col("user_id").alias("dataset_id"), "ts", action.alias("action"))
    target = t.scratch("target")
    streams.lifecycle_stream(asked, "dataset_id", ["ts", "event_id"], t.scratch("checkpoint"), target).awaitTermination()
    outcomes = read_table(t.spark, f"{target}/outcomes")
    return outcomes.select("dataset_id", "event_id", "state_before", "accepted", "state_after")


@query("s5_audit_stream", """
    SELECT event_type AS action, 'Event' AS entity_type, CAST(event_id AS VARCHAR) AS entity_id, user_id, ts AS happened_at FROM {events}""")
def s5(t):
    events = events_stream(t).select(
        F.col("event_type").alias("action"), F.lit("Event").alias("entity_type"), F.col("event_id").cast("string").alias("entity_id"),
        F.col("props").alias("details"), "user_id", (F.col("user_id") % 5).alias("workspace_id"), F.col("ts").alias("happened_at"),
    )
    path = t.scratch("audit")
    streams.audit_stream(events, t.scratch("checkpoint"), path).awaitTermination()
    return t.spark.read.parquet(path).select("action", "entity_type", "entity_id", "user_id", "happened_at")
