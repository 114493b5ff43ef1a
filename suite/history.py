"""Versions, lifecycle, codes, tags, configurations and reference data."""

from pyspark.sql import functions as F

from gatehouse.operators import catalogue as cat
from gatehouse.sources import keyed
from gatehouse.sources.store import read_table
from suite.registry import query

EDITS = """
    SELECT user_id AS dataset_id, event_id, ts,
           CASE WHEN event_type = 'click' OR event_type = 'view' THEN ' Sales ' ELSE 'Sales' END AS name,
           CASE WHEN event_type = 'error' THEN 'broken' WHEN event_type = 'signup' THEN NULL ELSE '' END AS description,
           CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS category_id
    FROM {events}"""
EDIT_SHAPE = {"fields": ["name", "description", "category_id"], "tags": None}
EDIT_CONTENT = "trim(name) || '/' || coalesce(description, '') || '/' || CAST(category_id AS VARCHAR)"

UPDATES = """
    SELECT o_orderkey * 2 AS dataset_id,
           CASE WHEN o_orderkey % 3 = 0 THEN 'Renamed' ELSE ' Orders ' END AS name,
           CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END AS description
    FROM {orders}"""


@query("l1_detect_changes", f"""
    WITH asked AS ({UPDATES}), stored AS (SELECT dataset_id, CASE WHEN dataset_id % 4 = 0 THEN 'Renamed' ELSE 'Orders' END AS name, description FROM {{datasets}})
    SELECT a.dataset_id, a.name, trim(a.name) <> s.name OR a.description <> coalesce(s.description, '') AS changed
    FROM asked a JOIN stored s ON s.dataset_id = a.dataset_id""")
def l1(t):
    stored = t("datasets").select(
        "dataset_id", F.when(F.col("dataset_id") % 4 == 0, "Renamed").otherwise("Orders").alias("name"), "description"
    )
    shape = {"fields": ["name", "description"], "tags": None}
    return cat.detect_changes(stored, t.sql(UPDATES), **shape).select("dataset_id", "name", "changed")


@query("l2_version_edits", f"""
    WITH edits AS ({EDITS}), marked AS (
        SELECT *, {EDIT_CONTENT} AS body, lag({EDIT_CONTENT}) OVER (PARTITION BY dataset_id ORDER BY ts, event_id) AS before FROM edits),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY ts, event_id) AS version_number
                 FROM marked WHERE before IS NULL OR before <> body)
    SELECT dataset_id, event_id, name, version_number,
           version_number = max(version_number) OVER (PARTITION BY dataset_id) AS is_current FROM numbered""")
def l2(t):
    rows = cat.version_edits(t.sql(EDITS), "dataset_id", ["ts", "event_id"], **EDIT_SHAPE)
    return rows.select("dataset_id", "event_id", "name", "version_number", "is_current")


@query("l2_snapshot_versions", """
    WITH stored AS (SELECT o_custkey AS dataset_id, o_orderkey AS edit_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version_number
                    FROM {orders}),
    changes AS (SELECT user_id AS dataset_id, event_id AS edit_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM {events}),
    joined AS (SELECT dataset_id, edit_id, version_number FROM stored
        UNION ALL SELECT c.dataset_id, c.edit_id, c.step + coalesce(m.top, 0) FROM changes c
        LEFT JOIN (SELECT dataset_id, max(version_number) AS top FROM stored GROUP BY dataset_id) m ON m.dataset_id = c.dataset_id)
    SELECT dataset_id, edit_id, version_number, version_number = max(version_number) OVER (PARTITION BY dataset_id) AS is_current FROM joined""")
def l2_snapshots(t):
    stored = t.sql("""SELECT o_custkey AS dataset_id, o_orderkey AS edit_id,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version_number FROM {orders}""")
    newest = stored.groupBy("dataset_id").agg(F.max("version_number").alias("top"))
    stored = stored.join(newest, "dataset_id").select(
        "dataset_id", "edit_id", F.col("version_number").cast("bigint"), (F.col("version_number") == F.col("top")).alias("is_current")
    )
    changes = t("events").select(F.col("user_id").alias("dataset_id"), F.col("event_id").alias("edit_id"))
    return cat.snapshot_versions(stored, changes, "dataset_id", ["edit_id"])


@query("l3_version_history", """
    SELECT dataset_id, version_number, code_part, status FROM {versions} WHERE dataset_id = 42""")
def l3(t):
    return cat.version_history(t("versions"), "dataset_id", 42).select("dataset_id", "version_number", "code_part", "status")


@query("l3_version_at", """
    SELECT v.dataset_id, v.version_number, v.code_part FROM {versions} v WHERE EXISTS (
        SELECT 1 FROM {datasets} d WHERE d.dataset_id = v.dataset_id AND d.current_version = v.version_number)""")
def l3_at(t):
    asked = t("datasets").select("dataset_id", F.col("current_version").alias("version_number"))
    return cat.version_at(t("versions"), asked).select("dataset_id", "version_number", "code_part")


@query("l4_current_version_check", """
    SELECT d.dataset_id,
           CASE WHEN count(v.dataset_id) = 0 THEN 'MISSING VERSION HISTORY'
                WHEN count(*) FILTER (v.is_current) <> 1 THEN 'INVALID CURRENT SNAPSHOT COUNT'
                WHEN max(v.version_number) FILTER (v.is_current) <> d.current_version THEN 'VERSION MISMATCH' ELSE 'OK' END AS validation_status
    FROM {datasets} d LEFT JOIN {versions} v ON v.dataset_id = d.dataset_id GROUP BY d.dataset_id, d.current_version""")
def l4(t):
    return cat.current_version_check(t("datasets"), t("versions")).select("dataset_id", "validation_status")


DELETE_REQUESTS = """
    SELECT event_id * 2 AS dataset_id, CASE WHEN event_type IN ('view', 'click') THEN 'recover' ELSE 'delete' END AS action,
           user_id, ts AS happened_at FROM {events}"""


@query("l5_soft_delete_and_recover", f"""
    WITH asked AS ({DELETE_REQUESTS})
    SELECT d.dataset_id,
           CASE WHEN a.action = 'delete' THEN true WHEN a.action = 'recover' THEN false ELSE d.is_deleted END AS is_deleted,
           CASE WHEN a.action = 'delete' AND NOT d.is_deleted THEN a.happened_at WHEN a.action = 'recover' AND d.is_deleted THEN NULL ELSE d.deleted_at END AS deleted_at,
           CASE WHEN a.action = 'delete' AND NOT d.is_deleted THEN a.user_id WHEN a.action = 'recover' AND d.is_deleted THEN NULL ELSE d.deleted_by END AS deleted_by
    FROM {{datasets}} d LEFT JOIN asked a ON a.dataset_id = d.dataset_id""")
def l5(t):
    state, _ = cat.apply_soft_delete(t("datasets"), t.sql(DELETE_REQUESTS))
    return state.select("dataset_id", "is_deleted", "deleted_at", "deleted_by")


@query("l5_refused_requests", f"""
    WITH asked AS ({DELETE_REQUESTS})
    SELECT a.dataset_id, a.action, CASE WHEN d.dataset_id IS NULL OR a.action = 'delete' THEN 'Dataset was not found.'
           ELSE 'Dataset is not soft deleted.' END AS reason
    FROM asked a LEFT JOIN {{datasets}} d ON d.dataset_id = a.dataset_id
    WHERE d.dataset_id IS NULL OR (a.action = 'delete' AND d.is_deleted) OR (a.action = 'recover' AND NOT d.is_deleted)""")
def l5_refused(t):
    _, refused = cat.apply_soft_delete(t("datasets"), t.sql(DELETE_REQUESTS))
    return refused.select("dataset_id", "action", "reason")


REPEATED_REQUESTS = """
    SELECT event_id % 60 * 13 AS dataset_id, CASE WHEN event_type IN ('view', 'click') THEN 'recover' ELSE 'delete' END AS action,
           event_id AS user_id, ts AS happened_at FROM {events}"""
REPLAY_SQL = f"""
    WITH RECURSIVE line AS (
        SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY happened_at, user_id, action) AS step FROM ({REPEATED_REQUESTS})),
    replay(dataset_id, step, action, user_id, happened_at, accepted, is_deleted, known) AS (
        SELECT l.dataset_id, step, action, user_id, happened_at, d.dataset_id IS NOT NULL AND (action = 'delete') <> d.is_deleted,
               CASE WHEN d.dataset_id IS NULL THEN NULL ELSE action = 'delete' END, d.dataset_id IS NOT NULL
        FROM line l LEFT JOIN {{datasets}} d ON d.dataset_id = l.dataset_id WHERE step = 1
        UNION ALL
        SELECT l.dataset_id, l.step, l.action, l.user_id, l.happened_at, r.known AND (l.action = 'delete') <> r.is_deleted,
               CASE WHEN r.known THEN l.action = 'delete' END, r.known
        FROM replay r JOIN line l ON l.dataset_id = r.dataset_id AND l.step = r.step + 1)"""


@query("l5_repeated_requests", REPLAY_SQL + """
    , final AS (SELECT dataset_id, arg_max(action, step) AS action, max(happened_at) AS at FROM replay WHERE accepted GROUP BY dataset_id)
    SELECT d.dataset_id, coalesce(f.action = 'delete', d.is_deleted) AS is_deleted, coalesce(f.at, d.updated_at) AS updated_at
    FROM {datasets} d LEFT JOIN final f ON f.dataset_id = d.dataset_id""")
def l5_repeated(t):
    """Many requests per dataset: they count in order, and every dataset is there once."""
    state, _ = cat.apply_soft_delete(t("datasets"), t.sql(REPEATED_REQUESTS))
    return state.select("dataset_id", "is_deleted", "updated_at")


@query("l5_repeated_refused", REPLAY_SQL + """
    SELECT dataset_id, user_id, CASE WHEN known AND action = 'recover' THEN 'Dataset is not soft deleted.' ELSE 'Dataset was not found.' END AS reason
    FROM replay WHERE NOT accepted""")
def l5_repeated_refused(t):
    _, refused = cat.apply_soft_delete(t("datasets"), t.sql(REPEATED_REQUESTS))
    return refused.select("dataset_id", "user_id", "reason")


# The checking SQL replays requests one at a time; the operator never does.
LIFECYCLE_SQL = """
    WITH RECURSIVE line AS (SELECT dataset_id, event_id, action, row_number() OVER (PARTITION BY dataset_id ORDER BY ts, event_id) AS step FROM {requests}),
    replay(dataset_id, event_id, step, state_before, accepted, state_after) AS (
        SELECT dataset_id, event_id, step, 'Draft', action = 'activate', CASE WHEN action = 'activate' THEN 'Active' ELSE 'Draft' END
        FROM line WHERE step = 1
        UNION ALL
        SELECT l.dataset_id, l.event_id, l.step, r.state_after,
               (l.action = 'activate' AND r.state_after = 'Draft') OR (l.action = 'archive' AND r.state_after = 'Active')
                   OR (l.action = 'restore' AND r.state_after = 'Archived'),
               CASE WHEN l.action = 'activate' AND r.state_after = 'Draft' THEN 'Active'
                    WHEN l.action = 'archive' AND r.state_after = 'Active' THEN 'Archived'
                    WHEN l.action = 'restore' AND r.state_after = 'Archived' THEN 'Active' ELSE r.state_after END
        FROM replay r JOIN line l ON l.dataset_id = r.dataset_id AND l.step = r.step + 1)"""


@query("l6_lifecycle_requests", LIFECYCLE_SQL + " SELECT dataset_id, event_id, state_before, accepted, state_after FROM replay")
def l6(t):
    judged = cat.lifecycle_requests(t("requests"), "dataset_id", ["ts", "event_id"])
    return judged.select("dataset_id", "event_id", "state_before", "accepted", "state_after")


@query("l6_lifecycle_final_state", LIFECYCLE_SQL + " SELECT dataset_id, arg_max(state_after, step) AS status FROM replay GROUP BY dataset_id")
def l6_final(t):
    final, _ = cat.lifecycle_apply(t("requests"), "dataset_id", ["ts", "event_id"])
    return final


@query("l7_config_versions", """
    SELECT dataset_id, config_id, version, version = max(version) OVER (PARTITION BY dataset_id) AS is_active FROM (
        SELECT dataset_id, config_id, row_number() OVER (PARTITION BY dataset_id ORDER BY saved_at, config_id) AS version FROM {configs})""")
def l7(t):
    saves = t("configs").select("dataset_id", "config_id", "saved_at")
    return cat.config_versions(saves, "dataset_id", ["saved_at", "config_id"]).select("dataset_id", "config_id", "version", "is_active")


CATALOGUE = """
    SELECT o_orderkey % 40 * 5 AS dataset_id, max(CASE WHEN o_orderstatus = 'O' THEN 'Active' ELSE 'Draft' END) AS status,
           max(o_orderkey % 40) % 7 = 0 AS is_deleted
    FROM {orders} GROUP BY o_orderkey % 40"""


@query("l6_requests_against_catalogue", f"""
    WITH RECURSIVE catalogue AS ({CATALOGUE}),
    line AS (SELECT r.dataset_id, event_id, action, status, is_deleted,
        row_number() OVER (PARTITION BY r.dataset_id ORDER BY ts, event_id) AS step
        FROM {{requests}} r LEFT JOIN catalogue c ON c.dataset_id = r.dataset_id),
    rule(action, needed, target) AS (VALUES ('activate', 'Draft', 'Active'), ('archive', 'Active', 'Archived'), ('restore', 'Archived', 'Active')),
    replay(dataset_id, event_id, step, action, before, after) AS (
        SELECT l.dataset_id, event_id, step, l.action, status, CASE WHEN status = needed THEN target ELSE status END
        FROM line l LEFT JOIN rule USING (action) WHERE step = 1 AND NOT is_deleted
        UNION ALL SELECT l.dataset_id, l.event_id, l.step, l.action, r.after, CASE WHEN r.after = needed THEN target ELSE r.after END
        FROM replay r JOIN line l ON l.dataset_id = r.dataset_id AND l.step = r.step + 1 LEFT JOIN rule ON rule.action = l.action)
    SELECT dataset_id, event_id, after, CASE WHEN before <> needed
        THEN 'Invalid status transition. Dataset must be ' || needed || ' before changing to ' || target || '.' END AS reason
    FROM replay LEFT JOIN rule USING (action)
    UNION ALL SELECT dataset_id, event_id, NULL, 'Dataset was not found.' FROM line WHERE is_deleted IS NOT FALSE""")
def l6_catalogue(t):
    """Unknown and soft deleted datasets are refused, as are requests that the state does not allow."""
    judged = cat.lifecycle_checked(t("requests"), t.sql(CATALOGUE), "dataset_id", ["ts", "event_id"])
    return judged.select("dataset_id", "event_id", F.col("state_after").alias("after"), "reason")


@query("l7_saves_on_stored_versions", """
    WITH numbered AS (SELECT dataset_id, config_id, row_number() OVER (PARTITION BY dataset_id ORDER BY config_id % 2, saved_at, config_id) AS version FROM {configs})
    SELECT dataset_id, config_id, version, version = max(version) OVER (PARTITION BY dataset_id) AS is_active FROM numbered""")
def l7_stored(t):
    """Half of the saves are stored versions already; the others continue their numbers."""
    order, saves = ["saved_at", "config_id"], t("configs").select("dataset_id", "config_id", "saved_at")
    stored = cat.config_versions(saves.filter("config_id % 2 = 0"), "dataset_id", order)
    return cat.config_versions(saves.filter("config_id % 2 = 1"), "dataset_id", order, stored).select(
        "dataset_id", "config_id", "version", "is_active")


@query("l8_pin_config", """
    SELECT r.user_id AS dataset_id, r.event_id AS import_id, c.event_id AS pinned_config FROM {events} r
    ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM {events} WHERE event_type = 'signup') c
        ON c.user_id = r.user_id AND r.ts >= c.ts""")
def l8(t):
    runs = t("events").select(F.col("user_id").alias("dataset_id"), F.col("event_id").alias("import_id"), F.col("ts").alias("created_at"))
    configs = t("configs").filter("is_active").select("dataset_id", "config_id", "saved_at")
    return cat.pin_config(runs, configs, "dataset_id", "created_at", "saved_at", "import_id", "config_id").select(
        "dataset_id", "import_id", "pinned_config"
    )


@query("l9_unused_configs", """
    SELECT config_id, dataset_id FROM {configs} WHERE config_id NOT IN (SELECT config_id FROM {runs} WHERE config_id IS NOT NULL)""")
def l9(t):
    used = t("runs").select(F.col("config_id").alias("used"))
    return cat.unused_configs(t("configs"), used, "config_id", "used").select("config_id", "dataset_id")


@query("l10_allocate_codes", """
    WITH numbered AS (SELECT dataset_id, row_number() OVER (ORDER BY created_at, dataset_id) AS position FROM {datasets} WHERE code IS NULL OR trim(code) = ''),
    top AS (SELECT coalesce(max(TRY_CAST(regexp_extract(code, '^(DS|ds)-([0-9]+)$', 2) AS BIGINT)), 0) AS highest FROM {datasets})
    SELECT d.dataset_id, CASE WHEN n.position IS NULL THEN d.code ELSE 'DS-' || lpad(CAST(highest + n.position AS VARCHAR), 6, '0') END AS code
    FROM {datasets} d LEFT JOIN numbered n ON n.dataset_id = d.dataset_id CROSS JOIN top""")
def l10(t):
    return cat.allocate_codes(t("datasets").select("dataset_id", "created_at", "code"), ["created_at", "dataset_id"]).select("dataset_id", "code")


TAG_REQUESTS = """
    SELECT o_orderkey * 2 AS dataset_id, o_orderkey * 2 % 5 AS workspace_id,
           CASE WHEN o_orderkey % 9 = 0 THEN 'red plate, Red Plate ' WHEN o_orderkey % 9 = 1 THEN ' , '
                WHEN o_orderkey % 9 = 2 THEN ' fresh ' || o_orderstatus || ',' || o_orderpriority
                ELSE o_orderpriority || ', hot ring' END AS tag_text
    FROM {orders}"""


def tag_requests(t):
    return t.sql(TAG_REQUESTS).select("dataset_id", "workspace_id", F.split("tag_text", ",").alias("tags"))


def unique_tags(t):
    """One tag row per workspace and name, as the tag rules require."""
    return t("tags").groupBy("workspace_id", "normalized_name").agg(F.min("tag_id").alias("tag_id"), F.min("tag_name").alias("name")).select(
        F.col("tag_id").cast("string"), "workspace_id", "name", "normalized_name"
    )


def old_bridge(t):
    return t("dataset_tags").select("dataset_id", F.col("tag_id").cast("string")).distinct()


TAG_SQL = f"""
    WITH asked AS ({TAG_REQUESTS}), accepted AS (SELECT * FROM asked WHERE tag_text <> 'red plate, Red Plate '),
    wanted AS (SELECT dataset_id, workspace_id, trim(x) AS name, upper(trim(x)) AS normalized_name
               FROM (SELECT dataset_id, workspace_id, unnest(string_split(tag_text, ',')) AS x FROM accepted) WHERE trim(x) <> ''),
    old AS (SELECT workspace_id, normalized_name, min(tag_id) AS tag_id FROM {{tags}} GROUP BY ALL)"""


@query("l11_sync_tags_mapping", TAG_SQL + """
    SELECT b.dataset_id, CAST(b.tag_id AS VARCHAR) AS tag FROM (SELECT DISTINCT dataset_id, tag_id FROM {dataset_tags}) b
    WHERE b.dataset_id NOT IN (SELECT dataset_id FROM accepted)
    UNION ALL SELECT w.dataset_id, coalesce(CAST(o.tag_id AS VARCHAR), 'new:' || w.normalized_name)
    FROM wanted w LEFT JOIN old o ON o.workspace_id = w.workspace_id AND o.normalized_name = w.normalized_name""")
def l11(t):
    tags, bridge, _ = cat.sync_tags(unique_tags(t), old_bridge(t), tag_requests(t))
    names = tags.select(F.col("tag_id").alias("known"), "normalized_name")
    joined = bridge.join(names, bridge["tag_id"] == names["known"], "left")
    fresh = F.length("tag_id") == 64
    return joined.select("dataset_id", F.when(fresh, F.concat(F.lit("new:"), "normalized_name")).otherwise(F.col("tag_id")).alias("tag"))


@query("l11_tag_requests_in_order", """
    WITH asked AS (SELECT l_orderkey AS dataset_id, l_linenumber AS n, 'tag ' || l_suppkey % 9 AS first, 'tag ' || l_partkey % 9 AS second FROM {lineitem}),
    accepted AS (SELECT * FROM asked WHERE first <> second QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY n DESC, first DESC, second DESC) = 1)
    SELECT dataset_id, upper(first) AS tag FROM accepted UNION ALL SELECT dataset_id, upper(second) FROM accepted""")
def l11_order(t):
    """Many requests of a dataset: the last that is not refused, for naming a tag twice, replaces its tags."""
    asked = t.sql("""SELECT l_orderkey AS dataset_id, l_orderkey % 5 AS workspace_id, l_linenumber AS n,
        array(concat('tag ', l_suppkey % 9), concat(' Tag ', l_partkey % 9)) AS tags FROM {lineitem}""")
    none = t.sql("SELECT 'x' AS tag_id, p_partkey % 5 AS workspace_id, 'x' AS name, 'X' AS normalized_name FROM {part}").limit(0)
    old = none.select(F.lit(0).cast("bigint").alias("dataset_id"), "tag_id")
    tags, bridge, _ = cat.sync_tags(none, old, asked, "n")
    return bridge.join(tags.select("tag_id", F.col("normalized_name").alias("tag")), "tag_id").select("dataset_id", "tag")


@query("l11_sync_tags_created", TAG_SQL + """
    SELECT DISTINCT w.workspace_id, w.normalized_name FROM wanted w
    WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.workspace_id = w.workspace_id AND o.normalized_name = w.normalized_name)""")
def l11_created(t):
    tags, _, _ = cat.sync_tags(unique_tags(t), old_bridge(t), tag_requests(t))
    return tags.filter(F.length("tag_id") == 64).select("workspace_id", "normalized_name")


@query("l11_refused_tags", TAG_SQL + """
    SELECT dataset_id, 'Duplicate tags are not allowed.' AS reason FROM asked WHERE tag_text = 'red plate, Red Plate '""")
def l11_refused(t):
    return cat.tag_issues(tag_requests(t)).select("dataset_id", "reason")


@query("l12_upsert_reference", """
    SELECT coalesce(t.id, s.id) AS id, CASE WHEN s.id IS NULL THEN t.name ELSE s.name END AS name,
           CASE WHEN t.id IS NULL THEN s.note ELSE t.note END AS note
    FROM (SELECT p_partkey AS id, p_name AS name, p_brand AS note FROM {part}) t
    FULL JOIN (SELECT p_partkey * 2 AS id, upper(p_name) AS name, 'seed' AS note FROM {part}) s ON s.id = t.id""")
def l12(t):
    target = t.sql("SELECT p_partkey AS id, p_name AS name, p_brand AS note FROM {part}")
    source = t.sql("SELECT p_partkey * 2 AS id, upper(p_name) AS name, 'seed' AS note FROM {part}")
    return cat.upsert_reference(target, source, "id", ["name"])


@query("l12_upsert_reference_by_parts", """
    SELECT coalesce(t.id, s.id) AS id, CASE WHEN s.id IS NULL THEN t.name ELSE s.name END AS name,
           CASE WHEN t.id IS NULL THEN s.note ELSE t.note END AS note
    FROM (SELECT p_partkey AS id, p_name AS name, p_brand AS note FROM {part}) t
    FULL JOIN (SELECT p_partkey * 2 AS id, upper(p_name) AS name, 'seed' AS note FROM {part}) s ON s.id = t.id""")
def l12_parts(t):
    """The reference merge on a keyed table; numbers are keys as well."""
    path = t.scratch("reference")
    keyed.write_keyed(t.sql("SELECT p_partkey AS id, p_name AS name, p_brand AS note FROM {part}"), path, "seed", "id", part_rows=100)
    source = t.sql("SELECT p_partkey * 2 AS id, upper(p_name) AS name, 'seed' AS note FROM {part}")
    keyed.upsert_keyed(source, path, "run-1", "id", identity=("note",))
    return read_table(t.spark, path)


@query("l13_sync_to_required", """
    WITH required AS (SELECT p_partkey % 100 AS role_id, p_partkey AS permission_id FROM {part} UNION SELECT s_suppkey, s_suppkey * 2 FROM {supplier}),
    existing AS (SELECT DISTINCT role_id, permission_id FROM {grants}),
    scoped AS (SELECT e.* FROM existing e WHERE e.permission_id IN (SELECT permission_id FROM {permissions} WHERE permission_name LIKE 'promo.%'))
    SELECT * FROM existing EXCEPT SELECT * FROM (SELECT * FROM scoped EXCEPT SELECT * FROM required)
    UNION SELECT * FROM required""")
def l13(t):
    required = t.sql("SELECT p_partkey % 100 AS role_id, p_partkey AS permission_id FROM {part} UNION SELECT s_suppkey, s_suppkey * 2 FROM {supplier}")
    names = t("permissions").select(F.col("permission_id").alias("known"), "permission_name")
    existing = t("grants").distinct()
    named = existing.join(names, existing["permission_id"] == names["known"], "left")
    scope = F.col("permission_name").startswith("promo.")
    return cat.sync_to_required(named, required, ["role_id", "permission_id"], scope)
