"""Requests of one batch that compete with each other, each checked by SQL that takes them one at a time."""

from gatehouse.operators import admission
from suite.quality_checks import METADATA_REQUESTS
from suite.registry import query

START_RUNS = """
    SELECT event_id AS import_id, user_id AS dataset_id,
           CASE WHEN event_id % 31 = 0 THEN 'Completed' WHEN event_id % 211 = 0 THEN 'Processing' ELSE 'Created' END AS status,
           CASE WHEN event_id % 422 = 0 THEN NULL ELSE ts + INTERVAL '2' DAY END AS ends_at
    FROM {events} WHERE event_id % 53 <> 0"""
START_REQUESTS = """
    SELECT event_id AS request_id, event_id AS import_id, ts AS asked_at,
           CASE WHEN event_id % 997 = 0 THEN NULL WHEN value < 5 THEN ts + INTERVAL '1' HOUR WHEN value < 20 THEN ts + INTERVAL '9' HOUR
                ELSE ts + INTERVAL '1' DAY END AS ends_at
    FROM {events}
    UNION ALL
    SELECT event_id + 1000000000, event_id, ts + INTERVAL '5' HOUR, ts + INTERVAL '7' HOUR FROM {events} WHERE event_id % 2 = 0"""


@query("q13_admitted_starts", f"""
    WITH RECURSIVE runs_before AS ({START_RUNS}), asked AS ({START_REQUESTS}),
    taken AS (SELECT dataset_id, CASE WHEN count(*) = count(ends_at) THEN max(ends_at) ELSE TIMESTAMP 'infinity' END AS until
              FROM runs_before WHERE status IN ('Queued', 'Processing') GROUP BY dataset_id),
    line AS (SELECT a.*, r.dataset_id, r.status, coalesce(t.until, TIMESTAMP '-infinity') AS taken_until,
                    row_number() OVER (PARTITION BY r.dataset_id ORDER BY asked_at, request_id) AS step
             FROM asked a JOIN runs_before r USING (import_id) LEFT JOIN taken t ON t.dataset_id = r.dataset_id),
    replay(dataset_id, step, request_id, accepted, reason, until, started) AS (
        SELECT DISTINCT dataset_id, 0::BIGINT, NULL::BIGINT, false, NULL::VARCHAR, taken_until, []::BIGINT[] FROM line
        UNION ALL
        SELECT dataset_id, step, request_id, reason IS NULL, reason,
               CASE WHEN reason IS NULL THEN coalesce(ends_at, TIMESTAMP 'infinity') ELSE until END,
               CASE WHEN reason IS NULL THEN list_append(started, import_id) ELSE started END
        FROM (SELECT l.*, p.until, p.started,
                CASE WHEN l.status <> 'Created' THEN concat('Import cannot be started from status ', chr(39), l.status, chr(39), '.')
                     WHEN list_contains(p.started, l.import_id) THEN concat('Import cannot be started from status ', chr(39), 'Queued', chr(39), '.')
                     WHEN l.asked_at < p.until THEN 'Another import is already queued or processing for this dataset.' END AS reason
              FROM replay p JOIN line l ON l.dataset_id = p.dataset_id AND l.step = p.step + 1))
    SELECT request_id, accepted, reason FROM replay WHERE step > 0
    UNION ALL SELECT request_id, false, 'Import not found or not accessible.' FROM asked ANTI JOIN runs_before USING (import_id)""")
def q13_admitted(t):
    """Start requests of a whole batch; a dataset has one active run at a time."""
    return admission.admit_starts(t.sql(START_REQUESTS), t.sql(START_RUNS)).select("request_id", "accepted", "reason")


#: The registrations and updates, and for every dataset a later request for the name that its neighbour has or had.
NAME_REQUESTS = METADATA_REQUESTS + """
    UNION ALL
    SELECT o_orderkey + 5, o_orderkey + 1000000000, o_orderkey % 5, 'orders ' || o_orderpriority || ' of ' || CAST(o_custkey AS STRING),
           o_custkey % 27, o_custkey
    FROM {orders}"""


@query("q19_names_within_a_batch", f"""
    WITH RECURSIVE asked AS ({NAME_REQUESTS}),
    broken(request_id, rule, reason) AS (
        SELECT request_id, 0, 'Dataset was not found.' FROM asked WHERE dataset_id IS NOT NULL
            AND dataset_id NOT IN (SELECT dataset_id FROM {{datasets}} WHERE NOT is_deleted)
        UNION ALL SELECT request_id, 1, 'An archived dataset must be restored before metadata can be updated.' FROM asked
            SEMI JOIN (SELECT dataset_id FROM {{datasets}} WHERE status = 'Archived') USING (dataset_id)
        UNION ALL SELECT request_id, 2, 'Dataset name is required.' FROM asked WHERE name SIMILAR TO ' *'
        UNION ALL SELECT request_id, 4, 'An active dataset category is required.' FROM asked
            ANTI JOIN (SELECT category_id FROM {{categories}} WHERE is_active) USING (category_id)
        UNION ALL SELECT request_id, 5, 'Dataset owner must be an active user in the same workspace.' FROM asked
            ANTI JOIN (SELECT user_id AS owner_id, workspace_id FROM {{users}} WHERE is_active) USING (owner_id, workspace_id)),
    other AS (SELECT request_id, min(rule) AS rule, arg_min(reason, rule) AS reason FROM broken GROUP BY request_id),
    entry AS (
        SELECT a.request_id, workspace_id, coalesce(CAST(dataset_id AS VARCHAR), 'request ' || a.request_id) AS holder, upper(trim(name)) AS n,
               rule, reason, row_number() OVER (PARTITION BY workspace_id ORDER BY a.request_id) AS step
        FROM asked a LEFT JOIN other o ON o.request_id = a.request_id),
    wanted AS (SELECT DISTINCT workspace_id, n FROM entry),
    held AS (
        SELECT d.workspace_id, list({{'holder': CAST(dataset_id AS VARCHAR), 'n': upper(trim(name))}}) AS state
        FROM {{datasets}} d JOIN wanted w ON w.workspace_id = d.workspace_id AND w.n = upper(trim(d.name)) WHERE NOT is_deleted GROUP BY d.workspace_id),
    replay(workspace_id, step, request_id, accepted, reason, state) AS (
        SELECT w.workspace_id, 0::BIGINT, NULL::BIGINT, false, NULL::VARCHAR, coalesce(state, []) FROM (SELECT DISTINCT workspace_id FROM entry) w
        LEFT JOIN held h ON h.workspace_id = w.workspace_id
        UNION ALL
        SELECT workspace_id, step, request_id, reason IS NULL, reason,
               CASE WHEN reason IS NULL THEN list_append(list_filter(state, lambda x: x.holder <> holder), {{'holder': holder, 'n': n}}) ELSE state END
        FROM (SELECT e.workspace_id, e.step, e.request_id, e.holder, e.n, r.state,
                CASE WHEN e.rule < 3 THEN e.reason
                     WHEN len(list_filter(r.state, lambda x: x.n = e.n AND x.holder <> e.holder)) > 0 THEN 'Dataset name must be unique within the workspace.'
                     ELSE e.reason END AS reason
              FROM replay r JOIN entry e ON e.workspace_id = r.workspace_id AND e.step = r.step + 1))
    SELECT request_id, accepted, reason FROM replay WHERE step > 0""")
def q19_names(t):
    """Registrations and updates of a whole batch in order, each meeting the names that earlier ones left."""
    outcomes = admission.metadata_outcomes(t.sql(NAME_REQUESTS), t("datasets"), t("categories"), t("users"), ["request_id"])
    return outcomes.select("request_id", "accepted", "reason")
