"""Catalogue and ingest tables shaped from the test tables. Some rows are made faulty on purpose, by key."""

VIEWS = {
    "workspaces": """
        SELECT CAST(r_regionkey AS BIGINT) AS workspace_id, r_name AS workspace_name, r_regionkey <> 4 AS is_active
        FROM {region}""",
    "categories": """
        SELECT CAST(n_nationkey AS BIGINT) AS category_id, n_name AS category_name, n_nationkey % 5 <> 0 AS is_active
        FROM {nation}""",
    "users": """
        SELECT c_custkey AS user_id, c_name AS full_name,
               lower(replace(c_name, '#', '.')) || '@example.com' AS email,
               CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 5 END AS workspace_id,
               c_acctbal >= 0 AS is_active, c_mktsegment AS segment
        FROM {customer}""",
    "user_roles": """
        SELECT c_custkey AS user_id, c_custkey % 120 AS role_id FROM {customer} WHERE c_acctbal > 500
        UNION ALL
        SELECT c_custkey AS user_id, CAST(c_nationkey AS BIGINT) AS role_id FROM {customer} WHERE c_acctbal > 7000""",
    "roles": """
        SELECT s_suppkey AS role_id, s_name AS role_name FROM {supplier}""",
    "permissions": """
        SELECT p_partkey AS permission_id, lower(p_type) || '.' || p_name AS permission_name FROM {part}""",
    "grants": """
        SELECT l_suppkey AS role_id, l_partkey AS permission_id FROM {lineitem}""",
    "datasets": """
        SELECT o_orderkey AS dataset_id,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 18 = 0 THEN ' '
                    WHEN o_orderkey % 19 = 0 THEN 'ds-' || CAST(o_orderkey AS STRING)
                    WHEN o_orderkey % 23 = 0 THEN 'DS-000001'
                    ELSE 'DS-' || lpad(CAST(o_orderkey + 1 AS STRING), 6, '0') END AS code,
               o_orderkey % 5 AS workspace_id,
               'Orders ' || o_orderpriority || ' of ' || CAST(o_custkey AS STRING) AS name,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Status ' || o_orderstatus END AS description,
               o_custkey % 26 AS category_id,
               CASE WHEN o_orderkey % 31 = 0 THEN -1 ELSE o_custkey END AS owner_id,
               'Source ' || CAST(o_orderkey % 7 AS STRING) AS source_name,
               CASE WHEN o_orderkey % 2 = 0 THEN 'SQL Server' ELSE 'File share' END AS source_type,
               '' AS source_description,
               CASE WHEN o_orderkey % 37 = 0 THEN 'Soft Deleted' WHEN o_orderstatus = 'O' THEN 'Active'
                    WHEN o_orderstatus = 'F' THEN 'Archived' ELSE 'Draft' END AS status,
               1 + o_orderkey % 7 AS current_version,
               o_orderkey % 13 = 0 AS is_deleted,
               CASE WHEN o_orderkey % 26 = 0 OR o_orderkey % 41 = 0 THEN o_orderdate + INTERVAL '30' DAY END AS deleted_at,
               CASE WHEN o_orderkey % 26 = 0 THEN o_custkey END AS deleted_by,
               o_orderdate AS created_at,
               CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL '5' DAY ELSE o_orderdate END AS updated_at
        FROM {orders}""",
    "tags": """
        SELECT p_partkey AS tag_id, CAST(p_size % 5 AS BIGINT) AS workspace_id, p_name AS tag_name,
               upper(trim(p_name)) AS normalized_name
        FROM {part}""",
    "dataset_tags": """
        SELECT l_orderkey AS dataset_id, l_partkey AS tag_id FROM {lineitem}""",
    "versions": """
        SELECT l_orderkey AS dataset_id, CAST(l_linenumber AS BIGINT) AS version_number,
               l_linestatus = 'O' AND l_returnflag = 'R' AS is_current,
               CASE WHEN l_returnflag = 'A' THEN 'Active' WHEN l_returnflag = 'N' THEN 'Draft' ELSE 'Soft Deleted' END AS status,
               l_partkey AS code_part
        FROM {lineitem}""",
    "files": """
        SELECT o_orderkey AS file_id, o_orderkey AS dataset_id,
               CASE WHEN o_orderkey % 43 = 0 THEN 98 ELSE o_orderkey % 5 END AS workspace_id,
               CASE WHEN o_orderkey % 47 = 0 THEN ' ' ELSE 'feed-' || CAST(o_orderkey AS STRING) END AS original_name,
               CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE 'stored-' || CAST(o_orderkey AS STRING) END AS stored_name,
               CASE WHEN o_orderkey % 59 = 0 THEN '' ELSE '/landing/' || CAST(o_orderkey AS STRING) END AS path,
               CASE WHEN o_orderkey % 61 = 0 THEN '.txt' WHEN o_orderkey % 2 = 0 THEN '.CSV' ELSE '.xlsx' END AS extension,
               CASE WHEN o_orderkey % 67 = 0 THEN 0 WHEN o_orderkey % 71 = 0 THEN 26214401
                    ELSE CAST(floor(o_totalprice) AS BIGINT) END AS size,
               CASE WHEN o_orderkey % 73 = 0 THEN NULL ELSE o_custkey END AS uploaded_by
        FROM {orders}""",
    "columns": """
        SELECT p_partkey AS column_id, p_partkey AS dataset_id,
               CASE WHEN p_partkey % 43 = 0 THEN 96 ELSE p_partkey % 5 END AS workspace_id,
               CASE WHEN p_partkey % 17 = 0 THEN '  ' ELSE p_name END AS name,
               CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE upper(p_name) END AS normalized_name,
               CASE WHEN p_partkey % 23 = 0 THEN 'Money' WHEN p_size % 5 = 0 THEN 'String' WHEN p_size % 5 = 1 THEN 'Integer'
                    WHEN p_size % 5 = 2 THEN 'Decimal' WHEN p_size % 5 = 3 THEN 'Boolean' ELSE 'DateTime' END AS data_type,
               p_size - 2 AS ordinal
        FROM {part}""",
    "runs": """
        SELECT event_id AS import_id,
               CASE WHEN event_id % 71 = 0 THEN event_id + 1 ELSE event_id END AS dataset_id,
               event_id AS file_id,
               CASE WHEN event_id % 73 = 0 THEN 97 WHEN event_id % 71 = 0 THEN (event_id + 1) % 5
                    ELSE event_id % 5 END AS workspace_id,
               CASE WHEN event_id % 83 = 0 THEN 'Paused' WHEN event_id % 79 = 0 THEN 'Cancelled'
                    WHEN event_type = 'click' THEN 'Queued' WHEN event_type = 'view' THEN 'Processing'
                    WHEN event_type = 'signup' THEN 'Completed' WHEN event_type = 'purchase' THEN 'Completed With Errors'
                    ELSE 'Failed' END AS status,
               CASE WHEN event_id % 89 = 0 THEN 'Delta' WHEN event_id % 3 = 0 THEN 'Full' ELSE 'Append' END AS import_mode,
               CASE WHEN event_id % 97 = 0 THEN 'Merge' WHEN event_id % 4 = 0 THEN 'Skip' WHEN event_id % 4 = 1 THEN 'Reject'
                    ELSE 'Update' END AS duplicate_behavior,
               CASE WHEN event_id % 101 = 0 THEN 'Abort' ELSE 'Skip' END AS invalid_behavior,
               CASE WHEN event_id % 103 = 0 THEN ';;' ELSE ',' END AS delimiter,
               CASE WHEN event_id % 107 = 0 THEN '[broken' ELSE props END AS key_columns_json,
               CASE WHEN event_id % 109 = 0 THEN NULL ELSE 'Sheet1' END AS worksheet,
               CAST(floor(value * 10) AS BIGINT) AS total,
               CAST(floor(value * 8) AS BIGINT) AS success,
               CAST(floor(value * 2) AS BIGINT) AS rejected,
               CASE WHEN event_id % 113 = 0 THEN -1 ELSE CAST(floor(value) AS BIGINT) END AS errors,
               ts AS created_at,
               CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts + INTERVAL '1' MINUTE END AS queued_at,
               CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts + INTERVAL '2' MINUTE END AS started_at,
               CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN ts - INTERVAL '1' DAY
                    ELSE ts + INTERVAL '1' HOUR END AS completed_at,
               event_id % 79 = 0 AND event_id % 2 = 0 OR event_id % 127 = 0 AS cancellation_requested,
               CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 100 END AS config_id,
               user_id
        FROM {events}""",
    "staging": """
        SELECT l_orderkey * 1000 + l_linenumber AS staging_id, l_orderkey AS import_id,
               CASE WHEN l_partkey % 131 = 0 THEN 95 ELSE l_orderkey % 5 END AS workspace_id
        FROM {lineitem}""",
    "records": """
        SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 137 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS dataset_id,
               o_orderkey % 5 AS workspace_id, o_orderkey AS source_import_id
        FROM {orders}""",
    "record_values": """
        SELECT l_orderkey * 1000 + l_linenumber AS value_id, l_orderkey AS record_id,
               CASE WHEN l_partkey % 11 = 0 THEN l_partkey ELSE l_orderkey END AS column_id
        FROM {lineitem}""",
    "import_errors": """
        SELECT event_id AS error_id, user_id AS import_id,
               CASE WHEN event_id % 149 = 0 THEN 94 ELSE user_id % 5 END AS workspace_id,
               event_id % 50 AS row_number, event_type AS column_name, props AS invalid_value, ts AS happened_at
        FROM {events}""",
    "configs": """
        SELECT event_id AS config_id, user_id AS dataset_id, ts AS saved_at, event_type = 'signup' AS is_active, props
        FROM {events}""",
    "audit": """
        SELECT event_id AS audit_id, user_id, user_id % 5 AS workspace_id,
               CASE WHEN event_type = 'click' THEN 'DatasetUpdated' WHEN event_type = 'view' THEN 'Import Completion'
                    WHEN event_type = 'error' THEN 'Import Failure' ELSE 'UserActivated' END AS action,
               CASE WHEN event_type = 'purchase' THEN 'DataImport' WHEN event_type = 'signup' THEN 'Dataset'
                    ELSE 'User' END AS entity_type,
               CAST(event_id AS STRING) AS entity_id, props AS details, ts AS happened_at
        FROM {events}""",
    "tokens": """
        SELECT event_id AS token_id, user_id, ts AS created_at, ts + INTERVAL '7' DAY AS expires_at,
               CASE WHEN event_type = 'error' THEN ts + INTERVAL '1' HOUR END AS revoked_at
        FROM {events}""",
    "requests": """
        SELECT event_id, user_id AS dataset_id, ts,
               CASE WHEN event_type = 'signup' THEN 'activate' WHEN event_type = 'purchase' THEN 'archive'
                    WHEN event_type = 'view' THEN 'restore' ELSE event_type END AS action
        FROM {events}""",
    "people": """
        SELECT c_custkey AS _row_number,
               CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN ''
                    WHEN c_custkey % 10 = 2 THEN '  ' || c_name || ' ' WHEN c_custkey % 10 = 3 THEN chr(9) || lower(c_name)
                    WHEN c_custkey % 10 = 4 THEN ' ' ELSE c_name END AS name,
               CASE WHEN c_custkey % 4 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 4 = 1 THEN ' ' || c_mktsegment
                    WHEN c_custkey % 4 = 2 THEN NULL ELSE c_mktsegment END AS segment,
               CASE WHEN c_custkey % 9 = 0 THEN 'abc' WHEN c_custkey % 9 = 1 THEN NULL
                    WHEN c_custkey % 9 = 2 THEN '(' || CAST(CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS STRING) || ')'
                    WHEN c_custkey % 9 = 3 THEN '1,234.50'
                    WHEN c_custkey % 9 = 4 THEN CAST(CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS STRING) || '-'
                    WHEN c_custkey % 9 = 5 THEN ' +' || CAST(c_custkey AS STRING)
                    WHEN c_custkey % 9 = 6 THEN ''
                    ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) END AS balance,
               CASE WHEN c_custkey % 6 = 0 THEN '2024-0' || CAST(1 + c_custkey % 9 AS STRING) || '-1' || CAST(c_custkey % 10 AS STRING)
                    WHEN c_custkey % 6 = 1 THEN CAST(1 + c_custkey % 12 AS STRING) || '/' || CAST(1 + c_custkey % 28 AS STRING) || '/2023'
                    WHEN c_custkey % 6 = 2 THEN '2024-02-30' WHEN c_custkey % 6 = 3 THEN 'no date'
                    WHEN c_custkey % 6 = 4 THEN NULL ELSE '13/' || CAST(1 + c_custkey % 28 AS STRING) || '/2023' END AS joined,
               CASE WHEN c_custkey % 5 = 0 THEN 'true' WHEN c_custkey % 5 = 1 THEN 'FALSE' WHEN c_custkey % 5 = 2 THEN '1'
                    WHEN c_custkey % 5 = 3 THEN 'yes' ELSE ' ' END AS active,
               CASE WHEN c_custkey % 6 = 0 THEN ' 12 ' WHEN c_custkey % 6 = 1 THEN '+7' WHEN c_custkey % 6 = 2 THEN '12.0'
                    WHEN c_custkey % 6 = 3 THEN 'x' WHEN c_custkey % 6 = 4 THEN NULL ELSE CAST(c_custkey AS STRING) END AS visits
        FROM {customer}""",
    # numbers and dates of `people` by an independent route, for the checking SQL
    "people_parsed": """
        SELECT *,
               CASE WHEN regexp_full_match(visits, '\\s*[+-]?[0-9]+\\s*') THEN TRY_CAST(trim(visits) AS BIGINT) END AS visits_int,
               CASE WHEN balance LIKE '(%' THEN -CAST(replace(replace(balance, '(', ''), ')', '') AS DECIMAL(18,2))
                    WHEN balance LIKE '%-' THEN -CAST(replace(balance, '-', '') AS DECIMAL(18,2))
                    ELSE TRY_CAST(replace(replace(trim(balance), '+', ''), ',', '') AS DECIMAL(18,2)) END AS balance_num,
               CASE WHEN joined LIKE '20%' THEN TRY_CAST(joined AS TIMESTAMP)
                    ELSE try_strptime(joined, '%m/%d/%Y') END AS joined_ts,
               trim(name, ' ' || chr(9)) AS name_trim,
               trim(coalesce(name, ''), ' ' || chr(9)) = '' AS name_blank
        FROM {people}""",
    "order_feed": """
        SELECT o_orderkey AS _row_number, CAST(o_custkey AS STRING) AS customer,
               CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderstatus) WHEN o_orderkey % 50 = 1 THEN 'X' ELSE o_orderstatus END AS status,
               CASE WHEN o_orderkey % 40 = 7 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS total,
               CAST(CAST(o_orderdate AS DATE) AS STRING) AS ordered,
               ' ' || o_orderpriority || ' ' AS priority
        FROM {orders}""",
    "header_lines": """
        SELECT p_partkey AS file,
               CASE WHEN p_partkey % 7 = 0 THEN ' ' || p_name || ',' || upper(p_name) || ',size'
                    WHEN p_partkey % 11 = 0 THEN p_brand || ', ,' || p_type
                    ELSE p_name || ',' || p_brand || ' , ' || p_type END AS line
        FROM {part}""",
}
