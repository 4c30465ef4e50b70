"""The role views as SQL, and the frame every oracle statement is put in."""

from __future__ import annotations

from wardlight.plans import roles as R


def _case(expr: str, mapping: dict) -> str:
    whens = " ".join(
        f"WHEN {repr(k) if isinstance(k, str) else k} THEN {repr(v) if isinstance(v, str) else v}"
        for k, v in mapping.items()
    )
    return f"CASE {expr} {whens} END"


def _hours(a: str, b: str) -> str:
    return f"round(date_sub('minute', {a}, {b}) / 60.0, 2)"


_LINE_STATUS = _case("l_returnflag || l_linestatus", R.LINE_STATUS)
_RESOLVED = f"CASE WHEN {_LINE_STATUS} IN ('resolved','closed') AND l_shipdate > o_orderdate THEN l_shipdate END"
_PRIORITY = "least(CAST(substr(o_orderpriority, 1, 1) AS INTEGER), 4)"
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"
_TOD = """CASE WHEN hour(ts) BETWEEN 4 AND 7 THEN 'dawn' WHEN hour(ts) BETWEEN 8 AND 11 THEN 'morning'
  WHEN hour(ts) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour(ts) BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END"""

VIEWS = {
    "pri": f"SELECT * FROM (VALUES {R.sql_rows(R.PRIORITIES)}) v(priority_id, priority_name, priority_level, sla_hours, color_code)",
    "dept": f"SELECT * FROM (VALUES {R.sql_rows(R.DEPARTMENTS)}) v(dept_id, dept_name, dept_code, head_name, is_active)",
    "cat": f"SELECT * FROM (VALUES {R.sql_rows(R.CATEGORIES)}) v(cat_id, cat_name, dept_id, default_priority_id, icon_class, is_active)",
    "types": f"SELECT * FROM (VALUES {R.sql_rows(R.CRIME_TYPES)}) v(crime_type_id, type_name, type_code, severity, icon, color_hex, is_active)",
    "loc": """SELECT n_nationkey AS location_id, 'W' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS ward_number,
      n_name AS area_name, r_name AS zone,
      CASE WHEN n_nationkey <> 24 THEN CAST(18.40 AS DOUBLE) + n_nationkey * CAST(0.01 AS DOUBLE) END AS latitude,
      CASE WHEN n_nationkey <> 24 THEN CAST(73.70 AS DOUBLE) + n_nationkey * CAST(0.01 AS DOUBLE) END AS longitude
      FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "usr": """SELECT c_custkey AS user_id, c_name AS full_name,
      CASE WHEN c_custkey % 23 <> 0 THEN 'user' || c_custkey || '@example.org' END AS email,
      CASE WHEN c_custkey = 1 THEN 'admin' WHEN c_custkey % 50 = 0 THEN 'officer' ELSE 'citizen' END AS role,
      CASE WHEN c_custkey % 50 = 0 THEN c_custkey % 5 + 1 END AS dept_id,
      c_nationkey AS location_id, c_custkey % 3 = 0 AS opt_in FROM customer""",
    "lines": f"""SELECT o_custkey AS user_id, c_nationkey AS location_id, {_case("p_type", R.CAT_IDS)} AS cat_id,
      {_case(_case("p_type", R.CAT_IDS), R.DEPT_OF)} AS dept_id, {_PRIORITY} AS priority_id, {_LINE_STATUS} AS status,
      o_orderdate AS submitted_at, {_RESOLVED} AS resolved_at, {_hours("o_orderdate", _RESOLVED)} AS resolution_hours,
      0 AS is_hotspot_flag
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN part ON l_partkey = p_partkey""",
    "req": f"""SELECT request_id, code, user_id, cat_id, location_id, {_case("cat_id", R.DEPT_OF)} AS dept_id, priority_id, title,
      status, assigned_to, submitted_at, CAST(NULL AS TIMESTAMP) AS assigned_at, resolved_at,
      {_hours("submitted_at", "resolved_at")} AS resolution_hours, 0 AS is_hotspot_flag FROM (
      SELECT o_orderkey AS request_id, format('REQ-{{}}-{{:05d}}', year(o_orderdate), o_orderkey) AS code,
      o_custkey AS user_id, {_case("c_mktsegment", R.CAT_IDS)} AS cat_id, c_nationkey AS location_id,
      {_PRIORITY} AS priority_id, c_mktsegment || ' request ' || o_orderkey AS title,
      {_case("o_orderstatus", R.ORDER_STATUS)} AS status,
      CASE WHEN o_orderstatus <> 'P' THEN o_custkey - o_custkey % 50 END AS assigned_to,
      o_orderdate AS submitted_at,
      CASE WHEN o_orderstatus = 'F' THEN first_ship END AS resolved_at
      FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (
        SELECT o_orderkey AS k, min(l_shipdate) AS first_ship FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        WHERE l_shipdate > o_orderdate GROUP BY o_orderkey) s ON s.k = o_orderkey) x""",
    "inc": f"""SELECT event_id AS incident_id, format('CRM-2024-{{:05d}}', event_id) AS incident_code, user_id,
      {_case("event_type", R.TYPE_IDS)} AS crime_type_id, CAST(user_id % 25 AS INTEGER) AS location_id,
      CAST(ts AS DATE) AS incident_date, CAST(hour(ts) AS INTEGER) AS incident_hour, {_TOD} AS time_of_day,
      CAST(18.40 AS DOUBLE) + CAST(user_id % 25 AS INTEGER) * CAST(0.01 AS DOUBLE) + ({_K} % 10) * CAST(0.001 AS DOUBLE) AS latitude,
      CAST(73.70 AS DOUBLE) + CAST(user_id % 25 AS INTEGER) * CAST(0.01 AS DOUBLE) AS longitude,
      {_K} % 4 AS victim_count, {_case(f"{_K} % 5", R.INCIDENT_STATUS)} AS status, 0 AS is_hotspot_flag, {_K} AS k,
      ts AS created_at FROM events""",
    "sev": "SELECT user_id AS request_id, event_id, event_type AS new_status, ts AS event_at FROM events",
    "prefs": """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 THEN 'alt' || c_custkey || '@example.org' END AS preferred_email,
      CAST(c_custkey % 24 AS INTEGER) AS preferred_hour, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 1 END AS quiet_hours_enabled,
      CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 22 END AS quiet_start_hour,
      CASE WHEN c_custkey % 5 = 0 THEN 5 ELSE 7 END AS quiet_end_hour,
      CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END AS opted_out FROM customer WHERE c_custkey % 3 <> 0""",
    "fb": """SELECT request_id, user_id, CASE WHEN resolution_hours <= 4380 THEN 5 WHEN resolution_hours <= 8760 THEN 4
      WHEN resolution_hours <= 17520 THEN 3 ELSE 2 END AS rating,
      CASE WHEN resolution_hours <= 4380 THEN 'Issue resolved quickly. Very satisfied!'
           WHEN resolution_hours <= 8760 THEN 'Good response time. Thank you.'
           WHEN resolution_hours <= 17520 THEN 'Took some time but resolved. Okay experience.'
           ELSE 'Took too long to resolve. Needs improvement.' END AS comment,
      CASE WHEN resolution_hours <= 17520 THEN 1 ELSE 0 END AS is_satisfied
      FROM req WHERE status IN ('resolved','closed') AND resolved_at IS NOT NULL""",
}
NEEDS = {"fb": ["req"]}

R_NOW = f"TIMESTAMP '{R.REQ_AS_OF}'"
I_NOW = f"TIMESTAMP '{R.INC_AS_OF}'"
I_TODAY = f"DATE '{R.INC_AS_OF[:10]}'"


def with_views(names: str, body: str) -> str:
    """`WITH <role views> <body>`; views a named view reads are added before it."""
    order: list[str] = []
    for name in names.split():
        for need in [*NEEDS.get(name, []), name]:
            if need not in order:
                order.append(need)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = body.strip().replace("{R_NOW}", R_NOW).replace("{I_NOW}", I_NOW).replace("{I_TODAY}", I_TODAY)
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
