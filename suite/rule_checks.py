"""Mapping, transformations, validations and schema operators over whole tables."""

from pyspark.sql import functions as F

from gatehouse.functions.typed import COLUMN_TYPES
from gatehouse.operators import schema
from gatehouse.operators.cells import error_rows, evaluate, map_columns, preview
from gatehouse.operators.config import (
    FieldMapping, Rule, decode_config, encode_config, load_config, mappings_from_rows,
)
from gatehouse.operators.rules import register_transformation
from gatehouse.operators.schema import ColumnSpec
from gatehouse.operators.typed_values import from_typed_long, to_typed_long
from suite.quality_checks import PEOPLE_COLUMNS
from suite.registry import query


def transformed(t, source, *rules, default=None, table="people"):
    """One mapping over a whole table: key, new value, transformation error."""
    judged = evaluate(t(table), [FieldMapping(source, "result", False, default, rules)], {})
    return judged.select(
        "_row_number", F.col("result")["value"].alias("value"), F.get("errors", F.lit(0))["description"].alias("error")
    )


def failing(t, source, rule, data_type="String", required=False, table="people"):
    """Keys of the rows that break one validation."""
    judged = evaluate(t(table), [FieldMapping(source, "result", required, None, (), (rule,))], {"result": data_type})
    return error_rows(judged, "_row_number").filter("error_type = 'Validation Error'").select("_row_number", "description")


@query("c0_map_columns", "SELECT _row_number, segment AS market, name AS full_name FROM {people}")
def c0(t):
    return map_columns(t("people"), [
        FieldMapping(" SEGMENT", "market"), FieldMapping("Name", "full_name"), FieldMapping("balance", "Market"),
    ])


@query("c1_mapping_default", """
    SELECT _row_number, CASE WHEN coalesce(name, '') = '' THEN 'nobody' ELSE name END AS value, NULL AS error FROM {people}""")
def c1(t):
    return transformed(t, "name", default="nobody")


@query("c2_trim", "SELECT _row_number, trim(name, ' ' || chr(9)) AS value, NULL AS error FROM {people}")
def c2(t):
    return transformed(t, "name", Rule("Trim"))


@query("c3_uppercase", "SELECT _row_number, upper(segment) AS value, NULL AS error FROM {people}")
def c3(t):
    return transformed(t, "segment", Rule("Uppercase"))


@query("c4_lowercase", "SELECT _row_number, lower(name) AS value, NULL AS error FROM {people}")
def c4(t):
    return transformed(t, "name", Rule("lowercase"))


@query("c5_replace", "SELECT _row_number, replace(name, '#', '-no-') AS value, NULL AS error FROM {people}")
def c5(t):
    return transformed(t, "name", Rule("Replace", 0, {"old": "#", "new": "-no-"}))


@query("c6_default", "SELECT _row_number, CASE WHEN coalesce(segment, '') = '' THEN 'OTHER' ELSE segment END AS value, NULL AS error FROM {people}")
def c6(t):
    return transformed(t, "segment", Rule("Default", 0, {"value": "OTHER"}))


@query("c7_date_format", """
    SELECT _row_number, CASE WHEN joined_ts IS NULL THEN joined ELSE strftime(joined_ts, '%d.%m.%Y') END AS value,
           CASE WHEN joined_ts IS NULL THEN 'String ''' || coalesce(joined, '') || ''' was not recognized as a valid DateTime.' END AS error
    FROM {people_parsed}""")
def c7(t):
    return transformed(t, "joined", Rule("DateFormat", 0, {"format": "dd.MM.yyyy"}))


@query("c8_numeric", """
    SELECT _row_number, CASE WHEN balance_num IS NULL THEN balance WHEN balance LIKE ' +%' THEN substr(balance, 3)
                             ELSE CAST(balance_num AS VARCHAR) END AS value,
           CASE WHEN balance_num IS NULL THEN 'The input string ''' || coalesce(balance, '') || ''' was not in a correct format.' END AS error
    FROM {people_parsed}""")
def c8(t):
    return transformed(t, "balance", Rule("Numeric"))


@query("c9_string_length", "SELECT doc_id AS _row_number, substr(text, 1, 40) AS value, NULL AS error FROM {documents}")
def c9(t):
    docs = t("documents").select(F.col("doc_id").alias("_row_number"), "text")
    judged = evaluate(docs, [FieldMapping("text", "result", False, None, (Rule("StringLength", 0, {"max": "40"}),))], {})
    return judged.select("_row_number", F.col("result")["value"].alias("value"), F.get("errors", F.lit(0))["description"].alias("error"))


@query("c10_derived", """
    SELECT _row_number, coalesce(segment, '') || ' <' || coalesce(name, '') || '> ' AS value, NULL AS error FROM {people}""")
def c10(t):
    return transformed(t, "visits", Rule("Derived", 0, {"template": "{Segment} <{NAME}> {unknown}"}))


@query("c11_rule_chain", """
    SELECT _row_number,
           CASE WHEN d.text IS NULL OR joined_ts IS NULL THEN coalesce(d.text, 'none') ELSE replace(strftime(joined_ts, '%Y/%m'), '/', '-') END AS value,
           CASE WHEN joined_ts IS NULL THEN 'String ''' || coalesce(d.text, 'none') || ''' was not recognized as a valid DateTime.' END AS error
    FROM (SELECT *, joined AS text FROM {people_parsed}) d""")
def c11(t):
    return transformed(
        t, "joined", Rule("Replace", 40, {"old": "/", "new": "-"}), Rule("Default", 10, {"value": "none"}),
        Rule("DateFormat", 30, {"format": "yyyy'/'MM"}), Rule("Trim", 20),
    )


@query("d1_required", "SELECT _row_number, 'Required validation failed.' AS description FROM {people_parsed} WHERE name_blank")
def d1(t):
    return failing(t, "name", Rule("Required"))


@query("d2_data_type", """
    SELECT _row_number, 'balance' AS field FROM {people_parsed} WHERE balance_num IS NULL AND trim(coalesce(balance, '')) <> ''
    UNION ALL SELECT _row_number, 'joined' FROM {people_parsed} WHERE joined_ts IS NULL AND joined IS NOT NULL
    UNION ALL SELECT _row_number, 'visits' FROM {people_parsed} WHERE visits_int IS NULL AND visits IS NOT NULL
    UNION ALL SELECT _row_number, 'active' FROM {people_parsed} WHERE lower(active) NOT IN ('true', 'false', ' ')""")
def d2(t):
    types = {"balance": "Decimal", "joined": "DateTime", "visits": "Integer", "active": "Boolean"}
    mappings = [FieldMapping(name, name, validations=(Rule("DataType"),)) for name in types]
    errors = error_rows(evaluate(t("people"), mappings, types), "_row_number")
    return errors.filter("error_type = 'Validation Error'").select("_row_number", F.col("column_name").alias("field"))


@query("d3_maximum_length", "SELECT doc_id AS _row_number, 'too long' AS description FROM {documents} WHERE length(text) > 2000")
def d3(t):
    docs = t("documents").select(F.col("doc_id").alias("_row_number"), "text")
    rule = Rule("MaximumLength", 0, {"value": "2000"}, "too long")
    judged = evaluate(docs, [FieldMapping("text", "text", validations=(rule,))], {})
    return error_rows(judged, "_row_number").select("_row_number", "description")


@query("d4_minimum_length", "SELECT _row_number, 'MinimumLength validation failed.' AS description FROM {people} WHERE length(name) < 5")
def d4(t):
    return failing(t, "name", Rule("MinimumLength", 0, {"value": "5"}))


@query("d5_numeric_range", """
    SELECT _row_number, 'NumericRange validation failed.' AS description FROM {people_parsed} WHERE balance_num < -500 OR balance_num > 5000""")
def d5(t):
    return failing(t, "balance", Rule("NumericRange", 0, {"min": "-500", "max": "5000"}))


@query("d6_date_range", """
    SELECT _row_number, 'DateRange validation failed.' AS description FROM {people_parsed}
    WHERE joined_ts < TIMESTAMP '2023-04-01' OR joined_ts > TIMESTAMP '2024-03-15'""")
def d6(t):
    return failing(t, "joined", Rule("DateRange", 0, {"min": "2023-04-01", "max": "3/15/2024"}))


@query("d7_allowed_values", """
    SELECT _row_number, 'AllowedValues validation failed.' AS description FROM {people}
    WHERE segment IS NULL OR lower(segment) NOT IN ('building', 'machinery')""")
def d7(t):
    return failing(t, "segment", Rule("AllowedValues", 0, {"values": "Building|MACHINERY"}))


@query("d8_pattern", """
    SELECT doc_id AS _row_number, 'no digit' AS description FROM {documents} WHERE NOT regexp_matches(text, '[0-9]')""")
def d8(t):
    docs = t("documents").select(F.col("doc_id").alias("_row_number"), "text")
    rule = Rule("Pattern", 0, {"pattern": "[0-9]"}, "no digit")
    judged = evaluate(docs, [FieldMapping("text", "text", validations=(rule,))], {})
    return error_rows(judged, "_row_number").select("_row_number", "description")


@query("d9_duplicate_rule_is_delegated", "SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS failures FROM {people}")
def d9(t):
    judged = evaluate(t("people"), [FieldMapping("name", "name", validations=(Rule("Duplicate"),))], {})
    return judged.agg(F.count("*").alias("row_count"), F.count_if(~F.col("is_valid")).alias("failures"))


@query("d10_required_mapping", """
    SELECT _row_number, 'a' AS description FROM {people_parsed} WHERE name_blank
    UNION ALL SELECT _row_number, 'b' FROM {people_parsed} WHERE name_blank OR length(name) > 18""")
def d10(t):
    rules = (Rule("Duplicate", 1, {}, "a"), Rule("MaximumLength", 2, {"value": "18"}, "b"))
    judged = evaluate(t("people"), [FieldMapping("name", "name", True, None, (), rules)], {})
    return error_rows(judged, "_row_number").select("_row_number", "description")


PEOPLE_MAPPINGS = (
    FieldMapping("name", "name", True, None, (Rule("Trim", 1),), (Rule("Required", 1), Rule("MinimumLength", 2, {"value": "19"}))),
    FieldMapping("balance", "balance", False, "0", (Rule("Numeric", 1),), (Rule("NumericRange", 1, {"min": "-900", "max": "9000"}),)),
    FieldMapping("visits", "visits", False, None, (), (Rule("Pattern", 1, {"pattern": "[0-9]"}),)),
)
PEOPLE_TYPES = {"name": "String", "balance": "Decimal", "visits": "Integer"}
PEOPLE_ERRORS = """
    SELECT _row_number, 'name' AS column_name, 'Validation Error' AS error_type, 'Required validation failed.' AS description
        FROM {people_parsed} WHERE name_blank
    UNION ALL SELECT _row_number, 'name', 'Validation Error', 'MinimumLength validation failed.' FROM {people_parsed}
        WHERE name_blank OR length(name_trim) < 19
    UNION ALL SELECT _row_number, 'balance', 'Transformation Error', 'The input string ''' || balance || ''' was not in a correct format.'
        FROM {people_parsed} WHERE balance = 'abc'
    UNION ALL SELECT _row_number, 'balance', 'Processing Error', 'Value is not compatible with Decimal.' FROM {people_parsed} WHERE balance = 'abc'
    UNION ALL SELECT _row_number, 'balance', 'Validation Error', 'NumericRange validation failed.' FROM {people_parsed}
        WHERE balance_num < -900 OR balance_num > 9000
    UNION ALL SELECT _row_number, 'visits', 'Validation Error', 'Pattern validation failed.' FROM {people} WHERE NOT regexp_matches(visits, '[0-9]')
    UNION ALL SELECT _row_number, 'visits', 'Processing Error', 'Value is not compatible with Integer.' FROM {people_parsed}
        WHERE visits_int IS NULL AND trim(visits) <> ''"""


@query("d11_all_errors", PEOPLE_ERRORS)
def d11(t):
    judged = evaluate(t("people"), PEOPLE_MAPPINGS, PEOPLE_TYPES)
    return error_rows(judged, "_row_number").select("_row_number", "column_name", "error_type", "description")


@query("d12_row_verdict", f"""
    SELECT p._row_number, count(e._row_number) = 0 AS is_valid, count(e._row_number) AS error_count
    FROM {{people}} p LEFT JOIN ({PEOPLE_ERRORS}) e ON e._row_number = p._row_number GROUP BY p._row_number""")
def d12(t):
    judged = evaluate(t("people"), PEOPLE_MAPPINGS, PEOPLE_TYPES)
    return judged.select("_row_number", "is_valid", F.size("errors").cast("bigint").alias("error_count"))


@query("d13_preview", """
    SELECT _row_number, 'name' AS target_field, name AS original_value, trim(name, ' ' || chr(9)) AS transformed_value, NOT name_blank AS is_valid
    FROM (SELECT * FROM {people_parsed} ORDER BY _row_number LIMIT 50)
    UNION ALL SELECT _row_number, 'balance', balance, CASE WHEN balance_num IS NULL THEN balance WHEN balance LIKE ' +%' THEN substr(balance, 3)
        ELSE CAST(balance_num AS VARCHAR) END, balance_num IS NOT NULL
    FROM (SELECT * FROM {people_parsed} ORDER BY _row_number LIMIT 50)""")
def d13(t):
    mappings = [
        FieldMapping("name", "name", transformations=(Rule("Trim"),), validations=(Rule("Required"),)),
        FieldMapping("balance", "balance", transformations=(Rule("Numeric"),)),
    ]
    rows = preview(t("people"), mappings, {"balance": "Integer"}, 50)
    return rows.select("_row_number", F.inline("cells")).select(
        "_row_number", "target_field", "original_value", "transformed_value", "is_valid"
    )


@register_transformation("Initial")
def _initial(value, parameters, row):
    return F.substring(value, 1, 1)


@query("u1_registered_rule", "SELECT _row_number, lower(substr(segment, 1, 1)) AS value, NULL AS error FROM {people}")
def u1(t):
    return transformed(t, "segment", Rule("initial", 1), Rule("Lowercase", 2))


# --- configuration and schema ----------------------------------------------------------------------------

CONFIG_JSON = (
    '{"mappings":[{"sourceColumn":"segment","targetColumn":"market","isRequired":false,"defaultValue":"none",'
    '"transformations":[{"type":"Trim","sequence":1,"parameters":null},{"type":"Uppercase","sequence":2,"parameters":{}}],'
    '"validations":[{"type":"MaximumLength","sequence":1,"message":"long","parameters":{"value":"9"}}]}]}'
)


@query("a13_decode_and_apply_config", """
    SELECT _row_number, upper(trim(coalesce(segment, 'none'))) AS market, length(trim(coalesce(segment, 'none'))) > 9 AS failed FROM {people}""")
def a13(t):
    stored = t.spark.createDataFrame([(1, CONFIG_JSON)], "version int, config_json string")
    round_trip = decode_config(stored).select("version", encode_config(F.col("mappings")).alias("config_json"))
    judged = evaluate(t("people"), load_config(round_trip), {})
    return judged.select("_row_number", F.col("market")["value"].alias("market"), (~F.col("is_valid")).alias("failed"))


@query("a13_config_rules", """
    SELECT event_id AS config_id, 'segment' AS source, 'Trim' AS first_rule, props AS limits FROM {events}""")
def a13_rules(t):
    stored = t("events").select(
        F.col("event_id").alias("config_id"),
        F.concat(
            F.lit('{"mappings":[{"sourceColumn":"segment","targetColumn":"market","transformations":[{"type":"Trim","sequence":1,"parameters":'),
            "props", F.lit("}]}]}"),
        ).alias("config_json"),
    )
    first = decode_config(stored)
    rule = F.col("mappings")[0]["transformations"][0]
    limits = F.concat(F.lit('{"k": '), rule["parameters"]["k"], F.lit("}"))
    return first.select("config_id", F.col("mappings")[0]["sourceColumn"].alias("source"), rule["type"].alias("first_rule"), limits.alias("limits"))


HEADERS_SQL = """
    SELECT file, unnest(string_split(line, ',')) AS header, generate_subscripts(string_split(line, ','), 1) AS ordinal FROM {header_lines}"""


@query("a5_resolve_headers", f"""
    SELECT file, CAST(ordinal AS BIGINT) AS ordinal, trim(header) AS name FROM ({HEADERS_SQL})
    UNION ALL SELECT -1 - file, CAST(ordinal AS BIGINT), 'Column' || CAST(ordinal AS VARCHAR) FROM ({HEADERS_SQL})""")
def a5(t):
    headers = t("header_lines").select("file", F.split("line", ",").alias("headers"))
    with_header = schema.header_names(headers)
    without = schema.header_names(headers.withColumn("file", -1 - F.col("file")), has_header=False)
    return with_header.unionByName(without).withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query("b1_header_audit", """
    SELECT file, CASE WHEN file % 7 = 0 THEN 'Duplicate column name ''' || trim(string_split(line, ',')[1]) || ''' was found.'
                      ELSE 'File contains missing or blank headers.' END AS issue
    FROM {header_lines} WHERE file % 7 = 0 OR file % 11 = 0""")
def b1(t):
    return schema.header_audit(t("header_lines").select("file", F.split("line", ",").alias("headers")))


def text_of(t, table, *columns):
    return t(table).select(*(F.col(c).cast("string").alias(c) for c in columns))


def inferred(feed: str, columns: list[str]) -> str:
    """SQL that reads every cell of a feed and names the first type that all non-blank cells of a column fit."""
    cells = " UNION ALL ".join(f"SELECT {i} AS ordinal, '{name}' AS name, trim({name}) AS cell FROM feed" for i, name in enumerate(columns))
    return f"""
    WITH feed AS ({feed}), cells AS ({cells}),
    fits AS (SELECT ordinal, name, unnest([0, 1, 2, 3]) AS kind, unnest([
            regexp_full_match(cell, '[+-]?[0-9]+'), regexp_full_match(cell, '[+-]?[0-9][0-9,]*([.][0-9]*)?|[0-9][0-9,]*([.][0-9]*)?[+-]'),
            lower(cell) IN ('true', 'false', '1', '0'), TRY_CAST(cell AS DATE) IS NOT NULL]) AS fit FROM cells WHERE cell <> ''),
    sound AS (SELECT ordinal, name, min(kind) AS kind FROM (SELECT ordinal, name, kind FROM fits GROUP BY ALL HAVING bool_and(fit)) GROUP BY ALL)
    SELECT CAST(c.ordinal AS BIGINT) AS ordinal, c.name, coalesce(['Integer', 'Decimal', 'Boolean', 'DateTime'][kind + 1], 'String') AS data_type
    FROM (SELECT DISTINCT ordinal, name FROM cells) c LEFT JOIN sound USING (ordinal, name)"""


TYPED_FEED = """
        SELECT CAST(o_orderkey AS STRING) AS o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS total,
               CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS ordered,
               CASE WHEN o_orderkey % 2 = 0 THEN 'TRUE' WHEN o_orderkey % 3 = 0 THEN '0' ELSE 'false' END AS flag, o_orderpriority,
               CASE WHEN o_orderkey % 2 = 0 THEN ' ' END AS empty,
               CASE WHEN o_orderkey % 2 = 0 THEN '1,000.5-' ELSE '12' END AS mixed,
               CASE WHEN o_orderkey % 1009 = 7 THEN 'n/a' ELSE '12' END AS spoiled_number,
               CASE WHEN o_orderkey % 1009 = 7 THEN 'soon' ELSE '2024-01-05' END AS spoiled_date,
               CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '0' END AS bits
        FROM {orders}"""
TYPED_COLUMNS = ["o_orderkey", "total", "ordered", "flag", "o_orderpriority", "empty", "mixed", "spoiled_number", "spoiled_date", "bits"]


@query("b2_infer_types", inferred(TYPED_FEED, TYPED_COLUMNS))
def b2(t):
    """Every type, blanks, and columns that a few cells spoil."""
    return schema.infer_types(t.sql(TYPED_FEED)).withColumn("ordinal", F.col("ordinal").cast("bigint"))


EXPECTED_SCHEMA = """
    SELECT p_partkey AS dataset_id, CASE WHEN p_partkey % 6 = 0 THEN p_name || ' code' ELSE ' ' || lower(p_name) END AS name FROM {part}
    UNION ALL SELECT p_partkey, 'note' FROM {part} WHERE p_size % 9 = 0"""


@query("b3_schema_diff", f"""
    WITH mine AS (SELECT dataset_id, name, upper(trim(name)) AS folded FROM {{columns}}),
    theirs AS (SELECT dataset_id, name, upper(trim(name)) AS folded FROM ({EXPECTED_SCHEMA}))
    SELECT dataset_id, name, 'Additional' AS difference FROM mine ANTI JOIN theirs USING (dataset_id, folded)
    UNION ALL SELECT dataset_id, name, 'Missing' FROM theirs ANTI JOIN mine USING (dataset_id, folded)""")
def b3(t):
    """Registered columns of every dataset against the expected ones, ignoring case and outer blanks."""
    return schema.schema_diff(t("columns").select("dataset_id", "name"), t.sql(EXPECTED_SCHEMA), ["dataset_id"])


@query("c7_rarer_dates", """
    SELECT o_orderkey AS _row_number, strftime(CASE o_orderkey % 5 WHEN 2 THEN date_trunc('month', o_orderdate) ELSE date_trunc('day', o_orderdate)
               + to_hours(CASE o_orderkey % 5 WHEN 1 THEN 10 WHEN 3 THEN 8 WHEN 4 THEN 10 ELSE 0 END) END, '%Y-%m-%d %H:%M') AS value
    FROM {orders}""")
def c7_rarer(t):
    """Two-digit years, zones without seconds or after a blank, a month alone, weekday and GMT."""
    feed = t.sql("""SELECT o_orderkey AS _row_number, CASE o_orderkey % 5
            WHEN 0 THEN date_format(o_orderdate, 'M/d/yy') WHEN 1 THEN date_format(o_orderdate, "yyyy-MM-dd'T10:00Z'")
            WHEN 2 THEN date_format(o_orderdate, 'yyyy-MM') WHEN 3 THEN date_format(o_orderdate, "yyyy-MM-dd '10:00:00 +02:00'")
            ELSE date_format(o_orderdate, "E, dd MMM yyyy '10:00:00 GMT'") END AS ordered FROM {orders}""")
    rule = Rule("DateFormat", 0, {"format": "yyyy-MM-dd HH:mm"})
    judged = evaluate(feed, [FieldMapping("ordered", "result", False, None, (rule,))], {})
    return judged.select("_row_number", F.col("result")["value"].alias("value"))


@query("b4_key_column_audit", """
    WITH h AS (SELECT p_partkey AS dataset_id, unnest([p_name, ' ' || p_brand, p_type]) AS header FROM {part}),
    k AS (SELECT p_partkey AS dataset_id, unnest([upper(p_name), CASE WHEN p_partkey % 3 = 0 THEN p_type || ' code' ELSE p_brand END, CASE WHEN p_partkey % 5 = 0 THEN 'Batch' ELSE p_type END]) AS key_name FROM {part}),
    bad AS (SELECT DISTINCT dataset_id, trim(key_name) AS key_name FROM k WHERE NOT EXISTS (
        SELECT 1 FROM h WHERE h.dataset_id = k.dataset_id AND upper(trim(h.header)) = upper(trim(k.key_name))))
    SELECT b.dataset_id, 'Unknown key column(s): ' || string_agg(b.key_name, ', ' ORDER BY b.key_name) || '. Available columns: ' ||
           any_value(a.names) || '.' AS message
    FROM bad b JOIN (SELECT dataset_id, string_agg(DISTINCT trim(header), ', ' ORDER BY trim(header)) AS names FROM h GROUP BY dataset_id) a
    ON a.dataset_id = b.dataset_id GROUP BY b.dataset_id""")
def b4(t):
    part = t("part")
    headers = part.select(F.col("p_partkey").alias("dataset_id"), F.explode(F.array("p_name", F.concat(F.lit(" "), "p_brand"), "p_type")).alias("header"))
    keys = t.sql("""SELECT p_partkey AS dataset_id, explode(array(upper(p_name), CASE WHEN p_partkey % 3 = 0 THEN p_type || ' code' ELSE p_brand END,
        CASE WHEN p_partkey % 5 = 0 THEN 'Batch' ELSE p_type END)) AS key_name FROM {part}""")
    return schema.key_column_audit(keys, headers)


CUSTOMER_FEED = """
    SELECT CAST(c_custkey AS STRING) AS c_custkey, c_name, CAST(c_nationkey AS STRING) AS c_nationkey,
           CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) AS balance, c_mktsegment FROM {customer}"""
CUSTOMER_TYPES = inferred(CUSTOMER_FEED, ["c_custkey", "c_name", "c_nationkey", "balance", "c_mktsegment"])


@query("b5_schema_registry", CUSTOMER_TYPES.replace("SELECT CAST(c.ordinal AS BIGINT) AS ordinal, c.name,", """
    SELECT 'customers' AS dataset_id, 'ws' AS workspace_id, upper(c.name) AS normalized_name, true AS is_required, c.name = 'c_custkey' AS is_key,
           CAST(c.ordinal AS BIGINT) AS ordinal, c.name,"""))
def b5(t):
    rows = schema.registry_rows(schema.infer_types(t.sql(CUSTOMER_FEED)), "customers", "ws", [" C_CUSTKEY"])
    return rows.withColumn("ordinal", F.col("ordinal").cast("bigint"))


REGISTRY_SQL = """
    SELECT p_partkey % 100 AS dataset_id, 'c' || CAST(p_partkey AS STRING) AS name, 'C' || CAST(p_partkey AS STRING) AS normalized_name,
           p_partkey % 3 = 0 AS is_key FROM {part}"""
KEY_SQL = """
    SELECT s_suppkey AS dataset_id, ' C' || CAST(s_suppkey AS STRING) || ' ' AS key_name FROM {supplier} WHERE s_acctbal > 1000
    UNION ALL SELECT s_suppkey, 'c' || CAST(s_suppkey + 1 AS STRING) FROM {supplier} WHERE s_acctbal > 8000"""


@query("b6_set_key_columns", f"""
    WITH r AS ({REGISTRY_SQL}), k AS (SELECT dataset_id, upper(trim(key_name)) AS normalized_name FROM ({KEY_SQL})),
    refused AS (SELECT DISTINCT dataset_id FROM k WHERE (dataset_id, normalized_name) NOT IN (SELECT dataset_id, normalized_name FROM r)),
    ok AS (SELECT * FROM k WHERE dataset_id NOT IN (SELECT dataset_id FROM refused))
    SELECT dataset_id, name, CASE WHEN dataset_id IN (SELECT dataset_id FROM ok)
        THEN (dataset_id, normalized_name) IN (SELECT dataset_id, normalized_name FROM ok) ELSE is_key END AS is_key FROM r""")
def b6(t):
    updated, _ = schema.set_key_columns(t.sql(REGISTRY_SQL), t.sql(KEY_SQL))
    return updated.select("dataset_id", "name", "is_key")


@query("b7_conformance", """
    SELECT _row_number, 'balance' AS column_name, balance AS invalid_value FROM {people_parsed}
        WHERE trim(coalesce(balance, '')) <> '' AND (balance_num IS NULL OR balance LIKE '(%')
    UNION ALL SELECT _row_number, 'joined', joined FROM {people_parsed} WHERE joined IS NOT NULL AND joined_ts IS NULL
    UNION ALL SELECT _row_number, 'active', active FROM {people} WHERE active = 'yes'
    UNION ALL SELECT _row_number, 'visits', visits FROM {people_parsed} WHERE visits IS NOT NULL AND visits_int IS NULL""")
def b7(t):
    return schema.conformance_check(t("people"), PEOPLE_COLUMNS).select("_row_number", "column_name", "invalid_value")


@query("b8_typed_projection", """
    SELECT _row_number, CASE WHEN name_blank THEN NULL ELSE name END AS name,
           CASE WHEN balance LIKE '(%' THEN NULL ELSE CAST(balance_num AS DOUBLE) END AS balance, joined_ts AS joined,
           CASE lower(active) WHEN 'true' THEN true WHEN '1' THEN true WHEN 'false' THEN false END AS active, visits_int AS visits
    FROM {people_parsed}""")
def b8(t):
    return schema.typed_projection(t("people"), PEOPLE_COLUMNS).withColumn("balance", F.col("balance").cast("double"))


@query("a11_typed_long", """
    SELECT _row_number, 'balance' AS column_name, balance AS raw_value, CAST(NULL AS BIGINT) AS integer_value,
           CASE WHEN balance LIKE '(%' THEN NULL ELSE CAST(balance_num AS DOUBLE) END AS decimal_value, CAST(NULL AS TIMESTAMP) AS datetime_value FROM {people_parsed}
    UNION ALL SELECT _row_number, 'visits', visits, visits_int, NULL, NULL FROM {people_parsed}
    UNION ALL SELECT _row_number, 'joined', joined, NULL, NULL, joined_ts FROM {people_parsed}""")
def a11(t):
    columns = [c for c in PEOPLE_COLUMNS if c.name in ("balance", "visits", "joined")]
    long = to_typed_long(t("people"), columns, "_row_number")
    return long.select(
        "_row_number", "column_name", "raw_value", "integer_value", F.col("decimal_value").cast("double"), "datetime_value"
    )


@query("a11_typed_long_round_trip", """
    SELECT _row_number, CASE WHEN name_blank THEN NULL ELSE name END AS name, visits_int AS visits, joined_ts AS joined FROM {people_parsed}""")
def a11_back(t):
    columns = [c for c in PEOPLE_COLUMNS if c.name in ("name", "visits", "joined")]
    return from_typed_long(to_typed_long(t("people"), columns, "_row_number"), columns, "_row_number")


LINES = """
    SELECT CAST(l_orderkey AS STRING) AS l_orderkey, CAST(l_linenumber AS STRING) AS l_linenumber,
           CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) AS price, l_returnflag, CAST(CAST(l_shipdate AS DATE) AS STRING) AS shipped
    FROM {lineitem}"""


@query("b2_infer_lineitem_types", inferred(LINES, ["l_orderkey", "l_linenumber", "price", "l_returnflag", "shipped"]))
def b2_lineitem(t):
    return schema.infer_types(t.sql(LINES)).withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query("d11_document_suite", """
    SELECT doc_id AS _row_number, 'text too long' AS description FROM {documents} WHERE length(text) > 4000
    UNION ALL SELECT doc_id, 'text too short' FROM {documents} WHERE length(text) < 40
    UNION ALL SELECT doc_id, 'no letters' FROM {documents} WHERE NOT regexp_matches(text, '[a-zA-Z][a-zA-Z][a-zA-Z]')
    UNION ALL SELECT doc_id, 'unknown language' FROM {documents} WHERE lang NOT IN ('en', 'fr')""")
def d11_documents(t):
    docs = t("documents").select(F.col("doc_id").alias("_row_number"), "text", "lang", "source")
    rules = (
        Rule("MaximumLength", 1, {"value": "4000"}, "text too long"), Rule("MinimumLength", 2, {"value": "40"}, "text too short"),
        Rule("Pattern", 3, {"pattern": "[a-zA-Z]{3}"}, "no letters"),
    )
    languages = (Rule("AllowedValues", 1, {"values": "en|fr"}, "unknown language"),)
    mappings = [FieldMapping("text", "text", validations=rules), FieldMapping("lang", "lang", validations=languages)]
    return error_rows(evaluate(docs, mappings, {}), "_row_number").select("_row_number", "description")
