"""Joins, aggregates, sorting, set operations and filters."""

from pyspark.sql import functions as F

from gatehouse.functions.text import contains_ci
from gatehouse.operators import aggregates as agg, trigrams
from gatehouse.operators import filters, joins, paging, quality, reports
from gatehouse.operators.catalogue import tag_lists
from gatehouse.plans.search import Reader, SearchRequest, catalog_index, catalog_search
from suite.registry import query


@query("f1_star_join", """
    SELECT d.dataset_id, d.code, w.workspace_name, c.category_name, u.full_name AS owner_name, d.status
    FROM {datasets} d JOIN {workspaces} w ON w.workspace_id = d.workspace_id
    JOIN {categories} c ON c.category_id = d.category_id JOIN {users} u ON u.user_id = d.owner_id""")
def f1(t):
    report = reports.catalogue_report(t("datasets"), t("workspaces"), t("categories"), t("users"))
    return report.select("dataset_id", "code", "workspace_name", "category_name", "owner_name", "status")


@query("f2_bridge_join", """
    SELECT d.code, d.name AS dataset_name, t.tag_id, t.tag_name FROM {dataset_tags} b
    JOIN {datasets} d ON d.dataset_id = b.dataset_id JOIN {tags} t ON t.tag_id = b.tag_id""")
def f2(t):
    return reports.dataset_tags(t("dataset_tags"), t("datasets"), t("tags"))


@query("f3_missing_parents", """
    WITH lost AS (
        SELECT dataset_id, 'workspace' AS parent FROM {datasets} ANTI JOIN {workspaces} USING (workspace_id)
        UNION ALL SELECT dataset_id, 'category' FROM {datasets} ANTI JOIN {categories} USING (category_id)
        UNION ALL SELECT dataset_id, 'owner' FROM {datasets} WHERE owner_id NOT IN (SELECT user_id FROM {users}))
    SELECT dataset_id, any_value(code) AS code, max('Missing Workspace') FILTER (parent = 'workspace') AS workspace_issue,
           max('Missing Category') FILTER (parent = 'category') AS category_issue, max('Missing Owner') FILTER (parent = 'owner') AS owner_issue
    FROM lost JOIN {datasets} USING (dataset_id) GROUP BY dataset_id""")
def f3(t):
    return quality.missing_relationships(t("datasets"), t("workspaces"), t("categories"), t("users"))


@query("f4_chained_left_joins", """
    SELECT u.user_id, u.full_name, w.workspace_name, r.role_name FROM {users} u
    LEFT JOIN {workspaces} w ON w.workspace_id = u.workspace_id
    LEFT JOIN {user_roles} ur ON ur.user_id = u.user_id LEFT JOIN {roles} r ON r.role_id = ur.role_id""")
def f4(t):
    rows = reports.users_with_roles(t("users"), t("workspaces"), t("user_roles"), t("roles"))
    return rows.select("user_id", "full_name", "workspace_name", "role_name")


@query("f5_anti_join", """
    SELECT dataset_id, code, current_version FROM {datasets} d
    WHERE NOT EXISTS (SELECT 1 FROM {versions} v WHERE v.dataset_id = d.dataset_id AND v.version_number = 1)""")
def f5(t):
    return quality.without_first_version(t("datasets"), t("versions")).select("dataset_id", "code", "current_version")


@query("f6_semi_join", """
    SELECT tag_id, tag_name FROM {tags} t WHERE EXISTS (SELECT 1 FROM {dataset_tags} b WHERE b.tag_id = t.tag_id)""")
def f6(t):
    bridge = t("dataset_tags").select(F.col("tag_id").alias("linked"))
    return joins.exists_filter(t("tags"), bridge, {"tag_id": "linked"}).select("tag_id", "tag_name")


@query("f7_join_with_inequality", """
    WITH owned AS (SELECT dataset_id, workspace_id, owner_id FROM {datasets} SEMI JOIN (SELECT user_id AS owner_id FROM {users}) USING (owner_id)),
    proper AS (SELECT dataset_id FROM owned SEMI JOIN (SELECT user_id AS owner_id, workspace_id FROM {users} WHERE is_active) USING (owner_id, workspace_id))
    SELECT o.*, (SELECT any_value(workspace_id) FROM {users} WHERE user_id = o.owner_id) AS owner_workspace_id,
           (SELECT bool_and(is_active) FROM {users} WHERE user_id = o.owner_id) AS owner_is_active
    FROM owned o ANTI JOIN proper USING (dataset_id)""")
def f7(t):
    return quality.owner_inconsistent(t("datasets"), t("users"))


CONTRACT = """
    SELECT p_partkey AS dataset_id, CASE WHEN p_partkey % 4 = 0 THEN p_name || ' code' ELSE p_name END AS name, p_type AS wanted_for FROM {part}"""


@query("f8_contract_completeness", f"""
    SELECT x.dataset_id, x.name, x.wanted_for, CASE WHEN count(c.column_id) > 0 THEN 'Available' ELSE 'Missing' END AS status
    FROM ({CONTRACT}) x LEFT JOIN {{columns}} c ON c.dataset_id = x.dataset_id AND c.name = x.name GROUP BY ALL""")
def f8(t):
    """Columns that a contract expects of each dataset, looked up in the column registry."""
    return joins.completeness(t.sql(CONTRACT), t("columns"), ["dataset_id", "name"])


@query("f9_inherit_parent_value", """
    SELECT v.dataset_id, v.version_number, d.code FROM {versions} v
    LEFT JOIN {datasets} d ON d.dataset_id = v.dataset_id""")
def f9(t):
    blank = t("versions").select("dataset_id", "version_number", F.lit(" ").alias("code"))
    parents = t("datasets").select(F.col("dataset_id").alias("parent_id"), F.col("code").alias("parent_code"))
    return joins.inherit(blank, parents, {"dataset_id": "parent_id"}, "code", "parent_code")


# --- aggregates ------------------------------------------------------------------------------------------


@query("g1_duplicate_finder", """
    SELECT workspace_id, normalized_name, count(*) AS duplicate_count FROM {tags}
    GROUP BY ALL HAVING count(*) > 1""")
def g1(t):
    return agg.duplicates(t("tags"), ["workspace_id", "normalized_name"])


@query("g2_conditional_sums", """
    SELECT workspace_id, count(*) AS dataset_count,
           CAST(sum(CASE WHEN status = 'Active' AND NOT is_deleted THEN 1 ELSE 0 END) AS BIGINT) AS active_count,
           CAST(sum(CASE WHEN status = 'Archived' AND NOT is_deleted THEN 1 ELSE 0 END) AS BIGINT) AS archived_count,
           CAST(sum(CASE WHEN is_deleted THEN 1 ELSE 0 END) AS BIGINT) AS soft_deleted_count
    FROM {datasets} GROUP BY workspace_id""")
def g2(t):
    return reports.tenant_summary(t("datasets"))


# By lists of version numbers, from the sound case to the worst.
CURRENT_VERSION_SQL = """
    WITH history AS (SELECT dataset_id, list(version_number) FILTER (is_current) AS marked FROM {versions} GROUP BY dataset_id)
    SELECT dataset_id, current_version, CAST(len(coalesce(marked, [])) AS BIGINT) AS current_snapshot_count,
           list_max(marked) AS current_snapshot_version,
           CASE WHEN marked = [current_version] THEN 'OK' WHEN len(marked) = 1 THEN 'VERSION MISMATCH'
                WHEN dataset_id IN (SELECT dataset_id FROM history) THEN 'INVALID CURRENT SNAPSHOT COUNT'
                ELSE 'MISSING VERSION HISTORY' END AS validation_status
    FROM {datasets} LEFT JOIN history USING (dataset_id)"""


@query("g4_group_with_sums", """
    SELECT status, import_mode, duplicate_behavior, count(*) AS import_count,
           CAST(sum(total) AS BIGINT) AS total_records, CAST(sum(success) AS BIGINT) AS success_records,
           CAST(sum(rejected) AS BIGINT) AS rejected_records, CAST(sum(errors) AS BIGINT) AS error_count
    FROM {runs} GROUP BY ALL""")
def g4(t):
    return reports.runs_by_outcome(t("runs"))


@query("g5_outer_join_count", """
    SELECT r.role_id, r.role_name, count(g.permission_id) AS permission_count
    FROM {roles} r LEFT JOIN {grants} g ON g.role_id = r.role_id GROUP BY ALL""")
def g5(t):
    return reports.permissions_per_role(t("roles"), t("grants"))


@query("g6_one_row_summary", """
    SELECT (SELECT count(*) FROM {categories} WHERE is_active) AS active_category_count,
           (SELECT count(*) FROM {datasets}) AS total_dataset_count,
           (SELECT count(*) FROM {datasets} WHERE NOT is_deleted) AS available_dataset_count,
           (SELECT count(*) FROM {datasets} WHERE NOT is_deleted AND status = 'Draft') AS draft_dataset_count,
           (SELECT count(*) FROM {datasets} WHERE NOT is_deleted AND status = 'Active') AS active_dataset_count,
           (SELECT count(*) FROM {datasets} WHERE NOT is_deleted AND status = 'Archived') AS archived_dataset_count,
           (SELECT count(*) FROM {datasets} WHERE is_deleted) AS soft_deleted_dataset_count,
           (SELECT count(*) FROM {versions}) AS dataset_version_count,
           (SELECT count(*) FROM {tags}) AS tag_count,
           (SELECT count(*) FROM {dataset_tags}) AS dataset_tag_mapping_count""")
def g6(t):
    return reports.catalogue_summary(t("categories"), t("datasets"), t("versions"), t("tags"), t("dataset_tags"))


@query("g7_joined_text", """
    SELECT workspace_id, string_agg(status, ', ' ORDER BY status) AS statuses
    FROM (SELECT DISTINCT workspace_id, status FROM {datasets}) GROUP BY workspace_id""")
def g7(t):
    return agg.joined_text(t("datasets"), ["workspace_id"], "status", "statuses")


@query("g8_next_version", """
    SELECT dataset_id, CAST(coalesce(max(version_number), 0) + 1 AS BIGINT) AS next_version FROM {versions} GROUP BY dataset_id""")
def g8(t):
    return agg.next_version(t("versions"), ["dataset_id"], "version_number")


@query("g9_sorted_tag_lists", """
    SELECT dataset_id, string_agg(tag_name, '|' ORDER BY tag_name) AS tags
    FROM (SELECT DISTINCT b.dataset_id, t.tag_name FROM {dataset_tags} b JOIN {tags} t ON t.tag_id = b.tag_id)
    GROUP BY dataset_id""")
def g9(t):
    named = joins.lookup_join(
        t("dataset_tags"), t("tags").select(F.col("tag_id").alias("known"), "tag_name"), {"tag_id": "known"}, "inner"
    )
    return tag_lists(named, "dataset_id", "tag_name").select("dataset_id", F.array_join("tags", "|").alias("tags"))


@query("g10_filtered_total", """
    SELECT count(*) AS total FROM {runs} WHERE status = 'Failed' AND import_mode = 'Append'""")
def g10(t):
    wanted = filters.optional_filters(t("runs"), {"status": "Failed", "import_mode": "Append", "dataset_id": None})
    return wanted.agg(F.count("*").alias("total"))


@query("g11_count_per_tenant", "SELECT workspace_id, count(*) AS row_count FROM {import_errors} GROUP BY workspace_id")
def g11(t):
    return t("import_errors").groupBy("workspace_id").agg(F.count("*").alias("row_count"))


# --- sorting, paging, set operations ---------------------------------------------------------------------

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")


@query("h1_custom_rank", """
    SELECT o_orderkey, o_orderpriority,
           CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 99 END AS priority_rank
    FROM {orders}""")
def h1(t):
    rank = paging.rank_by_list(F.col("o_orderpriority"), PRIORITIES)
    return t("orders").select("o_orderkey", "o_orderpriority", rank.alias("priority_rank")).orderBy("priority_rank", "o_orderkey")


@query("h2_whitelisted_sort", """
    SELECT dataset_id, name, updated_at FROM {datasets} ORDER BY name ASC, dataset_id LIMIT 100""")
def h2(t):
    rows = t("datasets").select("dataset_id", "name", "updated_at")
    return paging.page_rows(rows, paging.requested_order(" Name", "ASC", "dataset_id"), 1, 1000)


@query("h3_page_with_total", """
    SELECT dataset_id, name, updated_at, (SELECT count(*) FROM {datasets} WHERE NOT is_deleted) AS total
    FROM {datasets} WHERE NOT is_deleted ORDER BY updated_at DESC, dataset_id LIMIT 20 OFFSET 40""")
def h3(t):
    live = t("datasets").filter("NOT is_deleted").select("dataset_id", "name", "updated_at")
    rows, total = paging.page(live, paging.requested_order("unknown", "asc", "dataset_id"), 3, 20)
    return rows.withColumn("total", F.lit(total).cast("bigint"))


DEEP = """
    SELECT l_orderkey, l_linenumber, l_shipdate, l_returnflag, (SELECT count(*) FROM {lineitem}) AS total
    FROM {lineitem} ORDER BY l_shipdate DESC, l_returnflag, l_orderkey, l_linenumber LIMIT 100 OFFSET """
DEEP_ORDER = [("l_shipdate", False), ("l_returnflag", True), ("l_orderkey", True), ("l_linenumber", True)]


@query("h3_deep_page", DEEP + "(SELECT count(*) // 200 * 100 FROM {lineitem})")
def h3_deep(t):
    """A page in the middle of all lines; the rows before it are counted, not sorted."""
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag")
    rows, total = paging.page(lines, DEEP_ORDER, t("lineitem").count() // 200 + 1, 100)
    return rows.withColumn("total", F.lit(total).cast("bigint"))


@query("h3_page_after", DEEP + "100")
def h3_after(t):
    """The second page by the last row of the first."""
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag")
    last = paging.page_rows(lines, DEEP_ORDER, 1, 100).collect()[-1]
    rows = paging.page_after(lines, DEEP_ORDER, [last[name] for name, _ in DEEP_ORDER], 100)
    return rows.withColumn("total", F.lit(lines.count()))


@query("h4_latest_n", """
    SELECT error_id, import_id, row_number, happened_at FROM {import_errors} ORDER BY happened_at DESC, row_number, error_id LIMIT 200""")
def h4(t):
    return reports.latest_errors(t("import_errors")).select("error_id", "import_id", "row_number", "happened_at")


@query("h5_latest_valid_status", """
    SELECT d.dataset_id, coalesce(s.status, 'Draft') AS status FROM {datasets} d LEFT JOIN (
        SELECT dataset_id, arg_max(status, rank_key) AS status FROM (
            SELECT dataset_id, status, version_number * 1000000000 + code_part AS rank_key FROM {versions}
            WHERE status IN ('Draft', 'Active', 'Archived')) GROUP BY dataset_id) s ON s.dataset_id = d.dataset_id""")
def h5(t):
    history = t("versions").withColumn("rank_key", F.struct("version_number", "code_part"))
    parents = t("datasets").select("dataset_id")
    return agg.latest_valid(parents, history, "dataset_id", "rank_key", "status", filters.DATASET_STATUSES, "Draft")


@query("h6_tagged_union", """
    SELECT 'customer' AS entity_type, CAST(c_custkey AS VARCHAR) AS entity_id, 'negative balance' AS issue FROM {customer} WHERE c_acctbal < 0
    UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 'negative balance' FROM {supplier} WHERE s_acctbal < 0
    UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), 'large' FROM {part} WHERE p_size > 40""")
def h6(t):
    def branch(df, entity, key, issue):
        return df.select(F.lit(entity).alias("entity_type"), F.col(key).cast("string").alias("entity_id"), F.lit(issue).alias("issue"))

    return agg.tagged_union([
        branch(t("customer").filter("c_acctbal < 0"), "customer", "c_custkey", "negative balance"),
        branch(t("supplier").filter("s_acctbal < 0"), "supplier", "s_suppkey", "negative balance"),
        branch(t("part").filter("p_size > 40"), "part", "p_partkey", "large"),
    ])


@query("h7_set_difference", """
    SELECT tag_id AS id, 'unused' AS side FROM (SELECT tag_id FROM {tags} EXCEPT SELECT tag_id FROM {dataset_tags})
    UNION ALL SELECT tag_id, 'unknown' FROM (SELECT tag_id FROM {dataset_tags} EXCEPT SELECT tag_id FROM {tags})""")
def h7(t):
    known, used = t("tags").select("tag_id"), t("dataset_tags").select("tag_id").distinct()
    return agg.tagged_union([
        known.subtract(used).select(F.col("tag_id").alias("id"), F.lit("unused").alias("side")),
        used.subtract(known).select(F.col("tag_id").alias("id"), F.lit("unknown").alias("side")),
    ])


@query("h8_distinct", """
    SELECT DISTINCT d.dataset_id, t.tag_name FROM {datasets} d JOIN {dataset_tags} b ON b.dataset_id = d.dataset_id
    JOIN {tags} t ON t.tag_id = b.tag_id WHERE NOT d.is_deleted""")
def h8(t):
    d = t("datasets").filter("NOT is_deleted").select(F.col("dataset_id").alias("known"))
    names = t("tags").select(F.col("tag_id").alias("known_tag"), "tag_name")
    joined = joins.bridge_join(t("dataset_tags"), d, {"dataset_id": "known"}, names, {"tag_id": "known_tag"})
    return joined.select("dataset_id", "tag_name").distinct()


# --- filters ---------------------------------------------------------------------------------------------


@query("j1_optional_filters", """
    SELECT dataset_id, status, workspace_id FROM {datasets} WHERE status = 'Active' AND workspace_id = 3""")
def j1(t):
    wanted = {"status": "Active", "workspace_id": 3, "owner_id": None, "category_id": None}
    return filters.optional_filters(t("datasets"), wanted).select("dataset_id", "status", "workspace_id")


@query("j2_keyword_search", """
    SELECT d.dataset_id, d.name FROM {datasets} d WHERE contains(lower(coalesce(d.code, '')), 'red')
       OR contains(lower(d.name), 'red') OR contains(lower(coalesce(d.description, '')), 'red') OR contains(lower(d.source_name), 'red')
       OR EXISTS (SELECT 1 FROM {dataset_tags} b JOIN {tags} t ON t.tag_id = b.tag_id
                  WHERE b.dataset_id = d.dataset_id AND contains(lower(t.tag_name), 'red'))""")
def j2(t):
    fields = ["code", "name", "description", "source_name"]
    return filters.keyword_match(
        t("datasets"), " RED ", fields, "dataset_id", t("dataset_tags"), t("tags")
    ).select("dataset_id", "name")


KEYWORD_SQL = """
    SELECT d.dataset_id, d.name FROM {datasets} d WHERE contains(lower(coalesce(d.code, '')), 'KEY')
       OR contains(lower(d.name), 'KEY') OR contains(lower(coalesce(d.description, '')), 'KEY') OR contains(lower(d.source_name), 'KEY')
       OR EXISTS (SELECT 1 FROM {dataset_tags} b JOIN {tags} t ON t.tag_id = b.tag_id
                  WHERE b.dataset_id = d.dataset_id AND contains(lower(t.tag_name), 'KEY'))"""
KEYWORD_TEXTS = ["code", "name", "description", "source_name"]


def searched(t, keyword):
    """A search by indexes that were written before."""
    index = trigrams.gram_index(t("datasets"), "dataset_id", KEYWORD_TEXTS)
    tag_index = trigrams.gram_index(t("tags"), "tag_id", ["tag_name"])
    stored = []
    for name, frame in (("grams", index), ("tag-grams", tag_index)):
        path = t.scratch(name)
        frame.repartition("gram").sortWithinPartitions("gram").write.parquet(path)
        stored.append(t.spark.read.parquet(path))
    return trigrams.indexed_match(
        t("datasets"), stored[0], keyword, KEYWORD_TEXTS, "dataset_id", t("dataset_tags"), t("tags"), stored[1]).select("dataset_id", "name")


@query("j2_keyword_by_index", KEYWORD_SQL.replace("KEY", "urgent of 1"))
def j2_index(t):
    """The rarest grams first, then the text itself."""
    return searched(t, " URGENT of 1")


@query("j2_short_keyword_by_index", KEYWORD_SQL.replace("KEY", "9"))
def j2_short(t):
    """A keyword without a gram searches all rows."""
    return searched(t, "9 ")


@query("j2_index_of_changed_rows", """
    SELECT dataset_id, CASE WHEN dataset_id % 4 = 0 THEN upper('renamed ' || name) ELSE name END AS name FROM {datasets}
    WHERE dataset_id % 7 <> 0 AND (dataset_id % 4 = 0 OR contains(lower(name), 'renamed')) AND contains(lower(name), '-high')""")
def j2_changed(t):
    """An index that is kept up: a quarter of the datasets is renamed, a seventh removed."""
    names = t("datasets").select("dataset_id", "name")
    index = trigrams.gram_index(names, "dataset_id", ["name"])
    changed = names.filter("dataset_id % 4 = 0 AND dataset_id % 7 <> 0").withColumn("name", F.upper(F.concat(F.lit("renamed "), "name")))
    removed = names.filter("dataset_id % 7 = 0")
    now = names.join(removed, "dataset_id", "left_anti").join(changed, "dataset_id", "left_anti").unionByName(changed)
    kept = trigrams.updated_index(index, changed, "dataset_id", ["name"], removed)
    found = trigrams.indexed_match(now, kept, "renamed", ["name"], "dataset_id")
    return found.join(trigrams.indexed_match(now, kept, "-high", ["name"], "dataset_id").select("dataset_id"), "dataset_id", "left_semi")


@query("j3_contains_and_prefix", """
    SELECT p_partkey, p_name FROM {part} WHERE contains(lower(p_name), 'ring') OR p_name LIKE 'small%'""")
def j3(t):
    hit = contains_ci(F.col("p_name"), "RING") | F.col("p_name").startswith("small")
    return t("part").filter(hit).select("p_partkey", "p_name")


@query("j4_code_pattern", """
    SELECT dataset_id, code FROM {datasets} WHERE NOT regexp_full_match(code, 'DS-[0-9][0-9][0-9][0-9][0-9][0-9]')""")
def j4(t):
    return quality.malformed_codes(t("datasets")).select("dataset_id", "code")


@query("j5_allowed_set", """
    SELECT dataset_id, status FROM {datasets} WHERE status NOT IN ('Draft', 'Active', 'Archived')""")
def j5(t):
    return quality.unknown_status(t("datasets")).select("dataset_id", "status")


@query("j6_inclusive_date_range", """
    SELECT dataset_id, created_at FROM {datasets}
    WHERE created_at >= TIMESTAMP '1997-01-01 00:00:00' AND created_at <= TIMESTAMP '1998-06-30 00:00:00'""")
def j6(t):
    rows = filters.date_range(t("datasets"), "created_at", "1997-01-01 00:00:00", "1998-06-30 00:00:00")
    return rows.select("dataset_id", "created_at")


@query("j7_exact_tag", """
    SELECT d.dataset_id FROM {datasets} d WHERE EXISTS (SELECT 1 FROM {dataset_tags} b JOIN {tags} t ON t.tag_id = b.tag_id
        WHERE b.dataset_id = d.dataset_id AND t.normalized_name = 'RED PLATE')""")
def j7(t):
    return filters.with_tag(t("datasets"), "  red Plate ", "dataset_id", t("dataset_tags"), t("tags")).select("dataset_id")


@query("j8_visible_rows", "SELECT dataset_id FROM {datasets} WHERE NOT is_deleted AND status = 'Active'")
def j8(t):
    return filters.visible(t("datasets")).select("dataset_id")


@query("j9_tenant_isolation", """
    SELECT 'datasets' AS table_name, dataset_id AS id FROM {datasets} WHERE workspace_id = 2
    UNION ALL SELECT 'tags', tag_id FROM {tags} WHERE workspace_id = 2
    UNION ALL SELECT 'runs', import_id FROM {runs} WHERE workspace_id = 2
    UNION ALL SELECT 'audit', audit_id FROM {audit} WHERE workspace_id = 2""")
def j9(t):
    keys = {"datasets": "dataset_id", "tags": "tag_id", "runs": "import_id", "audit": "audit_id"}
    return agg.tagged_union([
        filters.for_workspace(t(name), 2).select(F.lit(name).alias("table_name"), F.col(key).alias("id"))
        for name, key in keys.items()
    ])


@query("j10_tenant_stamp", """
    WITH writes AS (SELECT o_orderkey * 2 AS dataset_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey * 2 % 5 END AS workspace_id FROM {orders})
    SELECT w.dataset_id, CASE WHEN d.dataset_id IS NULL OR (d.workspace_id = 2 AND w.workspace_id = 2) THEN 2 ELSE w.workspace_id END AS workspace_id,
           CASE WHEN d.dataset_id IS NULL OR (d.workspace_id = 2 AND w.workspace_id = 2) THEN 'accepted'
                ELSE 'A record cannot be moved to another workspace.' END AS outcome
    FROM writes w LEFT JOIN {datasets} d ON d.dataset_id = w.dataset_id""")
def j10(t):
    writes = t.sql("""SELECT o_orderkey * 2 AS dataset_id,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey * 2 % 5 END AS workspace_id FROM {orders}""")
    accepted, refused = filters.stamp_workspace(writes, t("datasets"), "dataset_id", 2)
    return accepted.select("dataset_id", F.col("workspace_id").cast("bigint"), F.lit("accepted").alias("outcome")).unionByName(
        refused.withColumnRenamed("reason", "outcome")
    )


@query("j11_first_issue", """
    SELECT p_partkey, CASE WHEN p_size > 45 THEN 'too large' WHEN p_retailprice > 1000 THEN 'too dear'
        WHEN p_type = 'PROMO' THEN 'promotion' END AS validation_issue
    FROM {part} WHERE p_size > 45 OR p_retailprice > 1000 OR p_type = 'PROMO'""")
def j11(t):
    rules = [
        (F.col("p_size") > 45, "too large"), (F.col("p_retailprice") > 1000, "too dear"),
        (F.col("p_type") == "PROMO", "promotion"),
    ]
    return filters.first_issue(t("part"), rules).select("p_partkey", "validation_issue")


J12_SQL = """
    WITH hits AS (
        SELECT d.dataset_id, d.name, w.workspace_name, c.category_name, u.full_name AS owner_name, d.created_at
        FROM {datasets} d JOIN {workspaces} w ON w.workspace_id = d.workspace_id
        JOIN {categories} c ON c.category_id = d.category_id JOIN {users} u ON u.user_id = d.owner_id
        WHERE d.workspace_id = 1 AND NOT d.is_deleted AND d.status = 'Active'
          AND d.created_at >= TIMESTAMP '1995-01-01 00:00:00'
          AND (contains(lower(coalesce(d.code, '')), 'ring') OR contains(lower(d.name), 'ring')
            OR contains(lower(coalesce(d.description, '')), 'ring') OR contains(lower(c.category_name), 'ring')
            OR contains(lower(d.source_name), 'ring') OR contains(lower(d.source_type), 'ring') OR contains(lower(u.full_name), 'ring')
            OR EXISTS (SELECT 1 FROM {dataset_tags} b JOIN {tags} t ON t.tag_id = b.tag_id
                       WHERE b.dataset_id = d.dataset_id AND contains(lower(t.tag_name), 'ring'))))
    SELECT *, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY created_at, dataset_id LIMIT 25 OFFSET 25"""


def found_page(t, **more):
    tables = {n: t(n) for n in ("datasets", "workspaces", "categories", "users", "dataset_tags", "tags")}
    request = SearchRequest(
        workspace_id=1, keyword="Ring", status="active", created_from="1995-01-01 00:00:00",
        sort_by="createdDate", direction="asc", page=2, size=25,
    )
    rows, total = catalog_search(tables | more, request, Reader(workspace_id=1, sees_all_statuses=True))
    return rows.select(
        "dataset_id", "name", "workspace_name", "category_name", "owner_name", "created_at",
        F.lit(total.first()["total"]).alias("total"),
    )


@query("j12_catalog_search", J12_SQL)
def j12(t):
    return found_page(t)


@query("j12_search_by_index", J12_SQL)
def j12_index(t):
    """The keyword is looked up in indexes that were written before."""
    tables = {n: t(n) for n in ("datasets", "workspaces", "categories", "users", "tags")}
    stored = {}
    for name, index in catalog_index(tables).items():
        path = t.scratch(name)
        # Some grams are in every row; the rows of one are dealt to several files.
        share = F.pmod(F.xxhash64(index.columns[1]), F.lit(16))
        index.repartition("gram", share).sortWithinPartitions("gram").write.parquet(path)
        stored[name] = t.spark.read.parquet(path)
    return found_page(t, **stored)
