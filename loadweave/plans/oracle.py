"""The SQL twins of the registered queries, as DuckDB reads them."""

from __future__ import annotations

from loadweave import fixed_values as fv

_NOW_US = "epoch_us(TIMESTAMP '2026-01-01')"

_REQUESTS = """
    SELECT o_orderkey AS id, c_name AS company_name, o_orderpriority AS contact_name,
           CAST(o_custkey AS VARCHAR) AS mobile, c_mktsegment AS industry,
           o_orderstatus AS status, o_orderdate AS created_at
    FROM orders JOIN customer ON o_custkey = c_custkey
"""

_FILES = """
    SELECT event_id AS id, user_id AS request_id, event_type AS file_type,
           event_type || '.json' AS original_name, CAST(strlen(props) AS BIGINT) AS file_size,
           event_id || '_' || event_type || '.json' AS stored_name,
           'uploads/' || user_id || '/' || user_id || '_' || event_type || '_'
               || event_type || '.json' AS file_path
    FROM events
"""

# files with their position in the request, from 0
_PLACED = f"""
    SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY id) - 1 AS place FROM ({_FILES})
"""

_LABELLED = "SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"

_CUSTOMERS = "SELECT c_custkey AS id, c_name AS company_name, c_mktsegment AS status FROM customer"

# one form submission per document, before any check
_SUBMISSIONS = f"""
    SELECT lpad(CAST(doc_id AS VARCHAR), 15, '0') AS submission_id, source AS company_name,
           CASE WHEN quality IS NOT NULL THEN lang END AS contact_name,
           '0' || doc_id AS mobile,
           CASE WHEN toxic = 1 THEN 'a@b.example' END AS email,
           CASE WHEN toxic = 0 THEN '' END AS industry,
           text AS goal, lang || '.csv' AS leaf, CAST(strlen(text) AS BIGINT) AS size,
           quality, toxic, n_chars
    FROM ({_LABELLED})
"""


def _slots(source: str) -> str:
    return f"""
    SELECT submission_id, 0 AS position, 'orders' AS file_type,
           CASE WHEN quality = 1 THEN leaf END AS filename,
           CASE WHEN quality = 1 THEN size ELSE -1 END AS size FROM {source}
    UNION ALL
    SELECT submission_id, 1, 'fleet', CASE WHEN quality = 0 THEN '' END,
           CASE WHEN quality = 0 THEN size ELSE -1 END FROM {source}
    UNION ALL
    SELECT submission_id, 2, 'drivers', CASE WHEN toxic = 1 THEN 'in/' || leaf END,
           CASE WHEN toxic = 1 THEN size ELSE -1 END FROM {source}
    UNION ALL
    SELECT submission_id, 3, 'gps', CASE WHEN n_chars > 500 THEN leaf END,
           CASE WHEN n_chars > 500 THEN size ELSE -1 END FROM {source}
    UNION ALL
    SELECT submission_id, 4 + k, 'other', leaf, size
    FROM {source}, (VALUES (0), (1)) AS twice(k) WHERE toxic = 1
    """


def _uuid_like(seed: str) -> str:
    h = f"sha256({seed})"
    return (
        f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4)"
        f" || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)"
    )


def _form_files(submissions: str, order: str) -> str:
    """The file rows of submissions whose requests are numbered in some order."""
    return f"""
        WITH s AS (
            SELECT *, row_number() OVER (ORDER BY {order}) AS request_id FROM {submissions}
        ),
        slots AS (
            SELECT request_id, p.position, p.file_type, p.size AS file_size,
                   regexp_extract(filename, '([^/]*)$', 1) AS original_name
            FROM ({_slots('s')}) p JOIN s ON p.submission_id = s.submission_id
            WHERE COALESCE(filename, '') <> ''
        )
        SELECT row_number() OVER (ORDER BY request_id, position) AS id, request_id, file_type,
               original_name,
               {_uuid_like("'run|' || request_id || '|' || position || '|' || original_name")}
                   || '_' || original_name AS stored_name,
               'uploads/' || request_id || '/' || request_id || '_' || file_type || '_'
                   || original_name AS file_path,
               'text/csv' AS content_type, file_size, {_NOW_US} AS created_us, {_NOW_US} AS updated_us
        FROM slots
    """


_PAGE_NAMES = r"""
    SELECT page_id,
           regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/\\]*)$', 1) AS name
    FROM pages
"""

_SUFFIX = r"regexp_extract(name, '^.+(\.[^.]+)$', 1)"

_ORDERS_IN = """
    SELECT c_nationkey AS zone, o_orderkey AS order_id, o_orderdate AS order_ts,
           COALESCE(load, 0) AS load
    FROM orders JOIN customer ON o_custkey = c_custkey
    LEFT JOIN (SELECT l_orderkey, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS load
               FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
"""

_FLEET = """
    SELECT s_nationkey AS zone, s_suppkey AS vehicle_id,
           CAST(12000 + 1000 * (s_suppkey % 5) AS BIGINT) AS capacity
    FROM supplier
"""

_ALLOCATION = f"""
    queue AS (
        SELECT *, SUM(load) OVER (PARTITION BY zone ORDER BY order_ts, order_id
                                  ROWS UNBOUNDED PRECEDING) AS hi
        FROM ({_ORDERS_IN})
    ),
    fleet AS ({_FLEET}),
    spans AS (
        SELECT *, SUM(capacity) OVER (PARTITION BY zone ORDER BY vehicle_id
                                      ROWS UNBOUNDED PRECEDING) AS vhi
        FROM fleet
    ),
    zone_capacity AS (SELECT zone, SUM(capacity) AS total FROM fleet GROUP BY zone),
    allocation AS (
        SELECT q.order_id, q.zone, q.order_ts, q.load, s.vehicle_id,
               CASE WHEN q.load = 0 THEN 'zero_load'
                    WHEN z.total IS NULL THEN 'no_fleet'
                    WHEN q.hi - q.load >= z.total THEN 'fleet_full'
                    WHEN s.vehicle_id IS NULL THEN 'straddles_vehicles' END AS reason
        FROM queue q
        LEFT JOIN zone_capacity z ON q.zone = z.zone
        LEFT JOIN spans s ON q.zone = s.zone AND q.load > 0
             AND s.vhi - s.capacity <= q.hi - q.load AND q.hi <= s.vhi
    ),
    per_vehicle AS (
        SELECT f.zone, f.vehicle_id, f.capacity, COUNT(a.order_id) AS orders,
               CAST(COALESCE(SUM(a.load), 0) AS BIGINT) AS load
        FROM fleet f LEFT JOIN allocation a ON a.vehicle_id = f.vehicle_id
        GROUP BY f.zone, f.vehicle_id, f.capacity
    )
"""

_OUTCOME = """
    CAST(COALESCE(SUM(CASE WHEN vehicle_id IS NOT NULL THEN orders END), 0) AS BIGINT) AS allocated,
    CAST(COALESCE(SUM(CASE WHEN vehicle_id IS NULL THEN orders END), 0) AS BIGINT) AS remaining,
    COUNT(CASE WHEN vehicle_id IS NOT NULL AND orders > 0 THEN 1 END) AS vehicles_used,
    COUNT(vehicle_id) AS vehicles_total,
    CAST(COALESCE(
        SUM(CASE WHEN vehicle_id IS NOT NULL AND orders > 0 THEN load * 10000 // capacity END)
        // NULLIF(COUNT(CASE WHEN vehicle_id IS NOT NULL AND orders > 0 THEN 1 END), 0), 0
    ) AS BIGINT) AS efficiency_bp
"""

_WITH_LEFT_OVER = """
    (SELECT zone, vehicle_id, capacity, orders, load FROM per_vehicle
     UNION ALL
     SELECT zone, NULL, NULL, COUNT(*), 0 FROM allocation WHERE reason IS NOT NULL GROUP BY zone)
"""

_RECONCILED = f"""
    WITH disk AS (
        SELECT 'uploads/' || doc_id || '/' || doc_id || '_other_' || lang || '.txt' AS path,
               CAST(strlen(text) AS BIGINT) AS disk_bytes
        FROM documents
    ),
    catalogue AS (
        SELECT 'uploads/' || doc_id || '/' || doc_id || '_other_' || lang || '.txt' AS path,
               n_chars AS row_bytes
        FROM ({_LABELLED}) WHERE quality IS NOT NULL
        UNION ALL
        SELECT CASE WHEN strlen(html) < 1000 THEN 'archive/' || page_id || '/page.html'
                    ELSE 'uploads/' || page_id || '/' || page_id || '_gps_page.html' END,
               CAST(strlen(html) AS BIGINT)
        FROM pages
    ),
    reconciled AS (
        SELECT COALESCE(d.path, c.path) AS path,
               CASE WHEN COALESCE(d.path, c.path) NOT LIKE 'uploads/%' THEN 'unrecognised_path'
                    WHEN c.path IS NULL THEN 'bytes_without_row'
                    WHEN d.path IS NULL THEN 'row_without_bytes'
                    WHEN disk_bytes = row_bytes THEN 'ok' ELSE 'size_mismatch' END AS class,
               disk_bytes, row_bytes,
               CAST(CASE WHEN c.path IS NULL THEN 0 ELSE 1 END AS BIGINT) AS rows
        FROM disk d FULL OUTER JOIN catalogue c ON d.path = c.path
    )
"""

_LATEST = """
    SELECT user_id AS id, event_type AS status, 'status-' || lower(event_type) AS css_class
    FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
"""

_KPIS = """
    SELECT (SELECT COUNT(*) FROM nation) AS projects,
           (SELECT COUNT(DISTINCT o_custkey) FROM orders) AS companies,
           (SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'O') AS orders,
           (SELECT COUNT(*) FROM supplier) AS vehicles
"""

_REASONS_3 = "concat_ws(',', CASE WHEN {0} THEN '{1}' END, CASE WHEN {2} THEN '{3}' END)"


def all_sql() -> dict[str, str]:
    scenario = (
        f"CASE lang WHEN 'en' THEN '{fv.SCENARIOS[0]}' WHEN 'de' THEN '{fv.SCENARIOS[1]}'"
        f" WHEN 'fr' THEN '{fv.SCENARIOS[2]}' ELSE lang END"
    )
    sql = {}

    # requests: lists, lookups, keys
    sql["request_list"] = f"SELECT * FROM ({_REQUESTS}) ORDER BY id DESC"
    sql["request_page"] = f"SELECT * FROM ({_REQUESTS}) WHERE id < 1200 ORDER BY id DESC LIMIT 50"
    sql["request_lookup"] = f"SELECT * FROM ({_REQUESTS}) WHERE id = 7 LIMIT 1"
    sql["request_lookup_many"] = (
        f"SELECT * FROM ({_REQUESTS}) WHERE id IN (SELECT s_suppkey FROM supplier)"
    )
    sql["admin_view"] = (
        f"SELECT id, company_name AS company, status FROM ({_REQUESTS}) ORDER BY id DESC"
    )
    sql["key_assign"] = """
        SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, o_orderdate, o_orderkey
        FROM orders
    """

    # intake
    sql["request_intake"] = f"""
        SELECT row_number() OVER (ORDER BY submission_id) AS id, company_name, contact_name, mobile,
               COALESCE(email, '') AS email, COALESCE(industry, '') AS industry,
               md5(goal) AS goal_md5, 'SUBMITTED' AS status,
               {_NOW_US} AS created_us, {_NOW_US} AS updated_us
        FROM ({_SUBMISSIONS}) WHERE contact_name IS NOT NULL
    """
    sql["rejected_submissions"] = f"""
        SELECT submission_id, 'contact_name:required' AS reasons
        FROM ({_SUBMISSIONS}) WHERE contact_name IS NULL
    """
    sql["slot_unpivot"] = f"WITH s AS ({_SUBMISSIONS}) {_slots('s')}"
    sql["slot_filter"] = f"""
        WITH s AS ({_SUBMISSIONS}) SELECT * FROM ({_slots('s')}) WHERE COALESCE(filename, '') <> ''
    """
    sql["request_file_append"] = _form_files(f"({_SUBMISSIONS}) WHERE contact_name IS NOT NULL", "submission_id")
    kinds = "(['orders', 'fleet', 'drivers', 'gps', 'other'])[CAST(doc_id % 5 + 1 AS INTEGER)]"
    sql["file_manifest"] = f"""
        SELECT 'file:/mnt/uploads/' || doc_id || '/' ||
               CASE WHEN lang IN ('en', 'de') THEN doc_id || '_' || {kinds} || '_' || lang || ' 1%.txt'
                    WHEN lang = 'fr' THEN md5(text) || '.txt' ELSE 'notes.txt' END AS path,
               CAST(strlen(text) AS BIGINT) AS size, doc_id AS request_id,
               CASE WHEN lang IN ('en', 'de') THEN 'form' WHEN lang = 'fr' THEN 'upload'
                    ELSE 'unknown' END AS layout,
               CASE WHEN lang IN ('en', 'de') THEN {kinds} END AS file_type,
               CASE WHEN lang IN ('en', 'de') THEN lang || ' 1%.txt' END AS original_name
        FROM documents
    """
    sql["upload_receipt"] = f"""
        SELECT request_id, place // 1000 AS page,
               '{{"success":true,"files":[' || string_agg(
                   '{{"id":' || id || ',"original_name":"' || original_name || '","stored_name":"'
                   || stored_name || '","file_type":"' || file_type || '"}}', ',' ORDER BY id)
               || ']}}' AS receipt
        FROM ({_PLACED}) GROUP BY request_id, place // 1000
    """
    sql["colliding_paths"] = f"""
        SELECT file_path, COUNT(*) AS writers, MAX(id) AS kept_id
        FROM ({_FILES}) GROUP BY file_path HAVING COUNT(*) > 1
    """
    sql["path_collisions"] = f"""
        SELECT id, file_path, writers, kept_id FROM (
            SELECT id, file_path, COUNT(*) OVER p AS writers, MAX(id) OVER p AS kept_id
            FROM ({_FILES}) WINDOW p AS (PARTITION BY file_path)
        ) WHERE id < kept_id
    """
    sql["project_intake"] = f"""
        SELECT 'P' || doc_id AS name, source AS company, {scenario} AS scenario,
               CAST(CASE WHEN lang <> 'es' AND toxic = 0 THEN quality ELSE -1 END AS INTEGER) AS fleet_size,
               md5(text) AS description_md5,
               {_REASONS_3.format("lang = 'es'", "scenario:domain", "toxic = 1", "fleet_size:type")} AS reasons
        FROM ({_LABELLED})
    """

    # names and values
    seed = _uuid_like("'run|' || page_id")
    sql["stored_name"] = f"""
        SELECT page_id, {seed} || '_' || name AS form_name,
               replace({seed}, '-', '') || {_SUFFIX} AS upload_name
        FROM ({_PAGE_NAMES})
    """
    sql["file_suffix"] = f"SELECT page_id, name, {_SUFFIX} AS suffix FROM ({_PAGE_NAMES})"
    sql["landing_path"] = f"""
        SELECT id, file_path AS form_path,
               'uploads/' || request_id || '/' || stored_name AS upload_path
        FROM ({_FILES})
    """
    sql["size_bytes"] = (
        "SELECT doc_id, n_chars, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents"
    )
    sql["defaults"] = f"""
        SELECT doc_id, CASE WHEN toxic = 1 THEN lang ELSE '' END AS email,
               CASE WHEN quality = 1 THEN source ELSE '' END AS industry, '' AS goal,
               CASE WHEN quality IS NOT NULL THEN 'CHECKED' ELSE 'SUBMITTED' END AS status,
               CASE WHEN quality = 0 THEN n_chars ELSE 0 END AS file_size
        FROM ({_LABELLED})
    """
    sql["status_css"] = (
        "SELECT o_orderkey, 'status-' || lower(o_orderstatus) AS css_class FROM orders"
    )

    # requests and files
    sql["request_with_files"] = f"""
        SELECT r.*, COALESCE(files, 0) AS files, CAST(COALESCE(bytes, 0) AS BIGINT) AS bytes
        FROM ({_CUSTOMERS}) r
        LEFT JOIN (SELECT request_id, COUNT(*) AS files, SUM(file_size) AS bytes
                   FROM ({_FILES}) GROUP BY request_id) f ON f.request_id = r.id
    """
    sql["request_file_lists"] = f"""
        WITH pages AS (
            SELECT request_id, place // 1000 AS page, '[' || string_agg(
                '{{"id":' || id || ',"file_type":"' || file_type || '","original_name":"'
                || original_name || '","file_size":' || file_size || '}}', ',' ORDER BY id) || ']' AS files
            FROM ({_PLACED}) GROUP BY request_id, place // 1000
        )
        SELECT c.id AS request_id, company_name, status, COALESCE(page, 0) AS page,
               COALESCE(files, '[]') AS files
        FROM ({_CUSTOMERS}) c LEFT JOIN pages p ON p.request_id = c.id
    """
    sql["fk_orphans"] = f"""
        SELECT id, request_id, file_type FROM ({_FILES})
        WHERE request_id NOT IN (SELECT s_suppkey FROM supplier)
    """
    sql["cascade_delete"] = f"""
        SELECT 'request_kept' AS part, id FROM ({_CUSTOMERS})
        WHERE id NOT IN (SELECT s_suppkey FROM supplier)
        UNION ALL
        SELECT CASE WHEN s_suppkey IS NULL THEN 'file_kept' ELSE 'file_removed' END, id
        FROM ({_FILES}) LEFT JOIN supplier ON s_suppkey = request_id
    """

    sql["stored_cascade"] = f"""
        SELECT 'request' AS part, id, status AS kind FROM ({_CUSTOMERS})
        WHERE id NOT IN (SELECT s_suppkey FROM supplier)
        UNION ALL
        SELECT 'file', id, file_type FROM ({_FILES}) WHERE request_id NOT IN (SELECT s_suppkey FROM supplier)
    """
    sql["bucketed_request_files"] = sql["request_with_files"]

    # quality
    sql["domain_check"] = f"""
        SELECT file_type AS value, COUNT(*) AS rows FROM ({_FILES})
        WHERE file_type NOT IN ('click', 'purchase', 'view') GROUP BY file_type
    """
    sql["unique_check"] = """
        SELECT l_orderkey, l_linenumber, COUNT(*) AS rows FROM lineitem
        GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1
    """
    sql["required_check"] = f"""
        SELECT doc_id, concat_ws(',',
            CASE WHEN text IS NULL OR text = '' THEN 'text:required' END,
            CASE WHEN quality IS NULL THEN 'quality:required' END,
            CASE WHEN toxic IS NULL THEN 'toxic:required' END) AS reasons
        FROM ({_LABELLED})
    """
    sql["length_check"] = """
        SELECT doc_id, 'text' AS "column", CAST(length(text) AS INTEGER) AS chars, 500 AS max_chars
        FROM documents WHERE length(text) > 500
        UNION ALL
        SELECT doc_id, 'source', CAST(length(source) AS INTEGER), 4
        FROM documents WHERE length(source) > 4
    """
    sql["type_check"] = f"""
        SELECT page_id, 'name' AS "column", name AS value, 'int' AS wanted
        FROM ({_PAGE_NAMES}) WHERE name <> '' AND NOT regexp_matches(name, '^[0-9]+$')
    """

    def profile(column, over="0", duplicates="0", text=True):
        empties = f"SUM(CASE WHEN {column} = '' THEN 1 ELSE 0 END)" if text else "0"
        return f"""
        SELECT '{column}' AS "column", COUNT(*) AS rows, COUNT(*) - COUNT({column}) AS nulls,
               CAST({empties} AS BIGINT) AS empties, CAST({over} AS BIGINT) AS over_length,
               CAST({duplicates} AS BIGINT) AS duplicates FROM d
        """

    def longer(column, limit):
        return f"SUM(CASE WHEN length({column}) > {limit} THEN 1 ELSE 0 END)"

    def surplus(column):
        return f"COUNT({column}) - COUNT(DISTINCT {column})"

    lines = [
        profile("doc_id", duplicates=surplus("doc_id"), text=False),
        profile("text", duplicates=surplus("text")),
        profile("lang"),
        profile("source", longer("source", 4)),
        profile("quality", text=False),
        profile("toxic", text=False),
    ]
    sql["quality_profile"] = f"WITH d AS ({_LABELLED}) " + " UNION ALL ".join(lines)
    sql["storage_reconcile"] = f"""{_RECONCILED}
        SELECT path, class, COALESCE(disk_bytes, -1) AS disk_bytes,
               COALESCE(row_bytes, -1) AS row_bytes, rows
        FROM reconciled
    """
    sql["reconcile_by_digest"] = sql["storage_reconcile"]
    counts = {
        "rows": "COUNT(*) + 2 * COUNT(CASE WHEN toxic = 1 THEN 1 END) + COUNT(CASE WHEN toxic = 0 THEN 1 END)"
        " + COUNT(CASE WHEN quality = 0 THEN 1 END) + COUNT(CASE WHEN lang = 'de' THEN 1 END)",
        "submission_id:required": "COUNT(CASE WHEN toxic = 1 THEN 1 END) + COUNT(CASE WHEN lang = 'de' THEN 1 END)",
        "contact_name:required": "COUNT(*) - COUNT(quality) + COUNT(CASE WHEN lang = 'de' THEN 1 END)",
        "mobile:required": "COUNT(CASE WHEN toxic = 1 THEN 1 END) + COUNT(CASE WHEN lang = 'de' THEN 1 END)",
        "line:unreadable": "COUNT(CASE WHEN lang = 'de' THEN 1 END)",
    }
    counts["rejected"] = (
        "COUNT(*) - COUNT(quality) + 2 * COUNT(CASE WHEN toxic = 1 THEN 1 END) + COUNT(CASE WHEN lang = 'de' THEN 1 END)"
    )
    written = {"valid": f"({counts['rows']}) - ({counts['rejected']})", "rejected": counts["rejected"]}
    lines = {f"seen {k}": n for k, n in counts.items()} | {f"written {k}": n for k, n in written.items()}
    sql["checked_in_one_pass"] = " UNION ALL ".join(
        f"SELECT '{part}' AS part, {n} AS rows FROM ({_LABELLED})" for part, n in lines.items()
    )
    sql["reconcile_summary"] = f"""{_RECONCILED}
        SELECT class, COUNT(*) AS paths, CAST(COALESCE(SUM(disk_bytes), 0) AS BIGINT) AS disk_bytes,
               CAST(COALESCE(SUM(row_bytes), 0) AS BIGINT) AS row_bytes
        FROM reconciled GROUP BY class
    """

    # change
    sql["audit_upsert"] = f"""
        WITH snapshot AS (
            SELECT s_suppkey AS id, CASE WHEN s_acctbal < 5000 THEN 'view' ELSE 'click' END AS status,
                   created_at
            FROM supplier JOIN (SELECT l_suppkey, MIN(l_shipdate) AS created_at
                                FROM lineitem GROUP BY l_suppkey) ON l_suppkey = s_suppkey
        ),
        changes AS (SELECT id, status FROM ({_LATEST}))
        SELECT COALESCE(s.id, c.id) AS id, COALESCE(c.status, s.status) AS status,
               COALESCE(s.created_at, TIMESTAMP '2026-01-01') AS created_at,
               CASE WHEN s.id IS NOT NULL AND (c.id IS NULL OR c.status = s.status)
                    THEN s.created_at ELSE TIMESTAMP '2026-01-01' END AS updated_at
        FROM snapshot s FULL OUTER JOIN changes c ON s.id = c.id
    """
    early = "SELECT o_orderkey AS id, NULLIF(o_orderstatus, 'P') AS status, o_orderdate FROM orders"
    sql["evolve_up"] = f"""
        SELECT id, status, epoch_us(o_orderdate) AS created_us,
               CASE WHEN status IS NULL THEN -1 ELSE {_NOW_US} END AS updated_us,
               CASE WHEN status IS NULL THEN 'status:required' ELSE '' END AS reasons
        FROM ({early})
    """
    sql["catalogue_evolution"] = f"""
        SELECT 'request' AS part, id, status, {_NOW_US} AS updated_us FROM ({early})
        UNION ALL
        SELECT 'request', CAST(n_nationkey + 5000000 AS BIGINT), n_name, (1800000000 + n_nationkey)::BIGINT * 1000000 FROM nation
        UNION ALL
        SELECT 'file', event_id, event_type, epoch_us(ts) FROM events
    """
    sql["mobile_lookup"] = (
        f"SELECT id, company_name, mobile, status, created_at FROM ({_REQUESTS}) WHERE mobile = '7'"
    )
    sql["evolve_down"] = (
        f"SELECT id, status, o_orderdate AS created_at FROM ({early}) WHERE status IS NOT NULL"
    )
    found = "COUNT(*) AS rows, CAST(SUM(id) AS BIGINT) AS id_sum, MIN(id) AS first_id, MAX(id) AS last_id"
    sql["layout"] = f"""
        SELECT 'requests' AS "table", status AS part, {found} FROM ({_REQUESTS}) GROUP BY status
        UNION ALL SELECT 'files', file_type, {found} FROM ({_FILES}) GROUP BY file_type
        UNION ALL SELECT 'bucketed', '', {found} FROM ({_CUSTOMERS})
    """

    # reports
    sql["kpi_counts"] = _KPIS
    sql["kpi_fallback"] = f"""
        SELECT CAST({fv.KPI_FALLBACK["projects"]} AS BIGINT) AS projects, companies, orders,
               CAST({fv.KPI_FALLBACK["vehicles"]} AS BIGINT) AS vehicles
        FROM ({_KPIS})
    """
    per_type = ", ".join(
        f"COUNT(CASE WHEN file_type = '{t}' THEN 1 END) AS {t}_files,"
        f" CAST(COALESCE(SUM(CASE WHEN file_type = '{t}' THEN file_size END), 0) AS BIGINT) AS {t}_bytes"
        for t in ("click", "error", "purchase", "signup", "view")
    )
    sql["intake_stats"] = f"""
        SELECT request_id, COUNT(*) AS files, CAST(SUM(file_size) AS BIGINT) AS bytes, {per_type}
        FROM ({_FILES}) GROUP BY request_id
    """
    sql["company_dim"] = f"""
        WITH known AS (
            SELECT s_suppkey AS id, 'Customer#' || substr(s_name, 10, 9) AS name, s_name AS code FROM supplier
            UNION ALL SELECT n_nationkey + 5000000, n_name, NULL FROM nation
        ),
        new AS (SELECT DISTINCT trim(c_name) AS name FROM customer
                WHERE trim(c_name) NOT IN (SELECT name FROM known))
        SELECT id, name, code, epoch_us(TIMESTAMP '2024-01-01') AS created_us,
               epoch_us(TIMESTAMP '2024-01-01') AS updated_us FROM known
        UNION ALL
        SELECT (SELECT MAX(id) FROM known) + row_number() OVER (ORDER BY name), name, NULL,
               {_NOW_US}, {_NOW_US} FROM new
    """
    sql["latest_status"] = _LATEST

    # allocation
    sql["allocate_orders"] = f"""WITH {_ALLOCATION}
        SELECT order_id, zone, order_ts, load, COALESCE(vehicle_id, -1) AS vehicle_id, reason
        FROM allocation
    """
    sql["manual_review"] = f"""WITH {_ALLOCATION}
        SELECT order_id, zone, load, reason FROM allocation WHERE reason IS NOT NULL
    """
    sql["unassigned_orders"] = """
        SELECT o_orderkey AS order_id, o_orderdate AS order_ts FROM orders
        WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    """
    sql["vehicle_load"] = f"""WITH {_ALLOCATION}
        SELECT zone, vehicle_id, capacity, orders, load, load * 10000 // capacity AS fill_bp
        FROM per_vehicle
    """
    sql["run_summary"] = f"WITH {_ALLOCATION} SELECT {_OUTCOME} FROM {_WITH_LEFT_OVER}"
    sql["run_summary_by_zone"] = f"""WITH {_ALLOCATION}
        SELECT COALESCE(zone, -1) AS zone, CAST(GROUPING(zone) AS INTEGER) AS is_total, {_OUTCOME}
        FROM {_WITH_LEFT_OVER} GROUP BY ROLLUP (zone)
    """
    def digest(kind, *columns):
        values = " || '|' || ".join(f"COALESCE(CAST({c} AS VARCHAR), '-')" for c in columns)
        return f"CAST('0x' || substr(sha256('{kind}|' || {values}), 1, 15) AS BIGINT)"

    ts = "strftime(order_ts, '%Y-%m-%d %H:%M:%S')"
    sql["run_log"] = f"""WITH {_ALLOCATION}, summary AS (SELECT {_OUTCOME} FROM {_WITH_LEFT_OVER}),
        inputs AS (
            SELECT {digest("order", "zone", "order_id", ts, "load")} AS h FROM ({_ORDERS_IN})
            UNION ALL SELECT {digest("vehicle", "zone", "vehicle_id", "capacity")} FROM ({_FLEET})
        ),
        digest AS (SELECT SUM(h::HUGEINT) AS digest, COUNT(*) AS input_rows FROM inputs)
        SELECT 'run-' || substr(sha256('queue=order_ts|' || digest || '|' || input_rows), 1, 16) AS run_id,
               'success' AS status,
               allocated || ' orders allocated, ' || remaining || ' left for review, '
                   || vehicles_used || ' of ' || vehicles_total || ' vehicles used' AS message,
               'queue=order_ts' AS params, allocated, remaining, vehicles_used, vehicles_total,
               efficiency_bp, {_NOW_US} AS run_us
        FROM summary, digest
    """

    # streams, as their batch twins
    sql["latest_status_stream"] = _LATEST
    outcome = f"""
        SELECT 'request' AS part, row_number() OVER (ORDER BY submission_id) AS id, md5(goal) AS text,
               '' AS reasons
        FROM ({_SUBMISSIONS}) WHERE contact_name IS NOT NULL
        UNION ALL SELECT 'file', id, file_path, '' FROM ({sql["request_file_append"]})
        UNION ALL
        SELECT 'reject', CAST(submission_id AS BIGINT), '', 'contact_name:required'
        FROM ({_SUBMISSIONS}) WHERE contact_name IS NULL
    """
    sql["submission_stream"] = outcome
    # copies leave no trace; rows without id and half lines come back one by one
    sql["intake_outcome"] = f"""{outcome}
        UNION ALL
        SELECT 'reject', -1, '', 'submission_id:required' FROM ({_LABELLED}) WHERE toxic = 1
        UNION ALL
        SELECT 'reject', -1,
               md5(substr('{{"submission_id":"' || lpad(CAST(doc_id AS VARCHAR), 15, '0'), 1, 30)),
               'line:unreadable,submission_id:required,company_name:required,'
                   || 'contact_name:required,mobile:required'
        FROM documents WHERE lang = 'de'
    """
    # low ones are taken when they come back, so after all others
    later = f"({_SUBMISSIONS}) WHERE contact_name IS NOT NULL"
    turn = "CASE WHEN quality = 0 THEN 1 ELSE 0 END, submission_id"
    sql["resubmission_stream"] = f"""
        SELECT 'request' AS part, row_number() OVER (ORDER BY {turn}) AS id, md5(goal) AS text, '' AS reasons
        FROM {later}
        UNION ALL SELECT 'file', id, file_path, '' FROM ({_form_files(later, turn)})
        UNION ALL
        SELECT 'reject', CAST(submission_id AS BIGINT), '',
               CASE WHEN contact_name IS NULL THEN 'contact_name:required' ELSE 'mobile:required' END
        FROM ({_SUBMISSIONS}) WHERE contact_name IS NULL OR quality = 0
        UNION ALL
        SELECT 'reject', CAST(submission_id AS BIGINT), '', 'submission_id:unequal_copy'
        FROM ({_SUBMISSIONS}) WHERE quality = 1 AND toxic = 0
    """
    sql["waiting_files_stream"] = """
        WITH requests AS (
            SELECT s_suppkey AS id, TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 28 AS INTEGER)) AS came
            FROM supplier
        ),
        seen AS (SELECT least((SELECT max(ts) FROM events), (SELECT max(came) FROM requests)) AS watermark)
        SELECT event_id AS id, user_id AS request_id, event_type AS file_type, r.id IS NOT NULL AS known
        FROM events LEFT JOIN requests r ON r.id = user_id AND r.came <= ts + INTERVAL 3 DAY, seen
        WHERE r.id IS NOT NULL OR ts + INTERVAL 3 DAY < watermark
    """
    sql["intake_stream"] = """
        SELECT event_id AS id, user_id AS request_id, event_type AS file_type,
               user_id IN (SELECT s_suppkey FROM supplier) AS known FROM events
    """
    sql["kpi_stream"] = _KPIS

    kind_of = (
        "CASE event_type WHEN 'click' THEN 'orders' WHEN 'error' THEN 'fleet' WHEN 'purchase' THEN 'drivers'"
        " WHEN 'signup' THEN 'gps' ELSE event_type END"
    )
    call = "user_id || '-' || strftime(ts, '%Y%m%d')"
    unique = f"""sha256('["' || upload_id || '","' || position || '","same.json"]')"""
    sql["upload_intake"] = f"""
        WITH files AS (
            SELECT {call} AS upload_id, user_id AS request_id, event_id AS position, {kind_of} AS file_type,
                   row_number() OVER (ORDER BY {call}, event_id) AS id,
                   user_id IN (SELECT s_suppkey FROM supplier) AS known
            FROM events
        ),
        stored AS (
            SELECT *, substr({unique}, 1, 32) || '.json' AS stored_name FROM files
        ),
        placed AS (
            SELECT *, (row_number() OVER (PARTITION BY upload_id ORDER BY id) - 1) // 1000 AS page
            FROM stored WHERE file_type <> 'view' AND known
        )
        SELECT CASE WHEN file_type = 'view' THEN 'reject' WHEN known THEN 'file' ELSE 'orphan' END AS part,
               upload_id, id, 'uploads/' || request_id || '/' || stored_name AS text, {_NOW_US} AS updated_us
        FROM stored
        UNION ALL
        SELECT 'receipt', upload_id, page, md5('{{"success":true,"files":[' || string_agg(
                   '{{"id":' || id || ',"original_name":"same.json","stored_name":"' || stored_name
                   || '","file_type":"' || file_type || '"}}', ',' ORDER BY id) || ']}}'), -1
        FROM placed GROUP BY upload_id, page
    """
    sql["disk_manifest"] = """
        SELECT 'uploads/' || s_suppkey || '/' || s_suppkey || '_fleet_s ' || s_name || '.txt' AS path,
               CAST(CASE WHEN s_acctbal >= 0 THEN strlen(s_name) ELSE 0 END AS BIGINT) AS size,
               s_suppkey AS request_id, 'form' AS layout, 'fleet' AS file_type,
               's ' || s_name || '.txt' AS original_name
        FROM supplier
    """
    # the stream's source does not report files without content
    sql["manifest_stream"] = f"SELECT * FROM ({sql['disk_manifest']}) WHERE size > 0"
    return sql
