"""Q01-Q18, Q33-Q42 and Q46: request analytics over the order and line roles."""

from __future__ import annotations

from wardlight.operators import requests as Q
from wardlight.plans.registry import query
from wardlight.plans.roles import REQ_AS_OF
from wardlight.plans.sql import with_views
from wardlight.sources.tables import derive_feedback

# Feedback hour limits scaled to the role data, as the SLA hours are.
FEEDBACK_LIMITS = (4380, 8760, 17520)


@query(
    "q01_location_summary",
    with_views(
        "loc lines",
        """SELECT l.location_id, l.ward_number, l.area_name, l.zone, l.latitude, l.longitude,
        count(r.status) AS total_requests, count(*) FILTER (r.status = 'pending') AS pending,
        count(*) FILTER (r.status = 'in_progress') AS in_progress,
        count(*) FILTER (r.status IN ('resolved','closed')) AS resolved,
        count(*) FILTER (r.submitted_at >= {R_NOW} - INTERVAL 30 DAY) AS last_30_days,
        round(count(*) FILTER (r.submitted_at >= {R_NOW} - INTERVAL 30 DAY) / 30.0, 1) AS daily_avg_30d,
        CASE WHEN count(*) FILTER (r.submitted_at >= {R_NOW} - INTERVAL 30 DAY) >= 15 THEN 1 ELSE 0 END AS is_hotspot
        FROM loc l LEFT JOIN lines r ON l.location_id = r.location_id GROUP BY ALL""",
    ),
)
def q01(r):
    return Q.location_summary(r.lines(location=True), r.loc, REQ_AS_OF)


@query(
    "q02_category_summary",
    with_views(
        "cat dept lines",
        """SELECT c.cat_id, c.cat_name, c.icon_class, d.dept_name, count(r.status) AS total,
        count(*) FILTER (r.status = 'pending') AS pending,
        count(*) FILTER (r.status IN ('resolved','closed')) AS resolved,
        round(avg(r.resolution_hours), 2) AS avg_resolution_hrs,
        round(count(r.status) * 100.0 / (SELECT count(*) FROM lines), 1) AS pct_of_total
        FROM cat c LEFT JOIN lines r ON c.cat_id = r.cat_id JOIN dept d ON c.dept_id = d.dept_id
        GROUP BY c.cat_id, c.cat_name, c.icon_class, d.dept_name""",
    ),
)
def q02(r):
    return Q.category_summary(r.lines(category=True), r.cat, r.dept)


MONTHLY = """SELECT strftime(submitted_at, '%Y-%m') AS month, strftime(submitted_at, '%b %Y') AS month_label,
        count(*) AS total_submitted, count(*) FILTER (status IN ('resolved','closed')) AS resolved,
        count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (priority_id = 1) AS critical,
        count(*) FILTER (priority_id = 2) AS high, round(avg(resolution_hours), 2) AS avg_resolution_hrs,
        round(count(*) FILTER (status IN ('resolved','closed')) * 100.0 / count(*), 1) AS resolution_rate_pct
        FROM lines GROUP BY 1, 2"""


@query("q03_monthly_trend", with_views("lines", MONTHLY))
def q03(r):
    return Q.monthly_trend(r.lines())


@query(
    "q04_monthly_trend_last12",
    with_views(
        "lines",
        f"""SELECT month, month_label, total_submitted AS total, resolved, pending, critical,
        round(avg_resolution_hrs, 1) AS avg_hrs FROM ({MONTHLY}) ORDER BY month DESC LIMIT 12""",
    ),
)
def q04(r):
    return Q.monthly_trend_last(r.lines(), 12)


@query(
    "q05_department_performance",
    with_views(
        "dept pri lines",
        """SELECT d.dept_id, d.dept_name, d.dept_code, d.head_name, count(r.status) AS total_assigned,
        count(*) FILTER (r.status IN ('resolved','closed')) AS resolved,
        count(*) FILTER (r.status = 'pending') AS pending,
        count(*) FILTER (r.status = 'in_progress') AS in_progress,
        round(avg(r.resolution_hours) FILTER (r.status IN ('resolved','closed')), 1) AS avg_resolution_hrs,
        count(*) FILTER (r.status IN ('resolved','closed') AND r.resolution_hours <= p.sla_hours) AS within_sla,
        round(count(*) FILTER (r.status IN ('resolved','closed')) * 100.0 / nullif(count(r.status), 0), 1) AS resolution_rate_pct,
        round(count(*) FILTER (r.status IN ('resolved','closed') AND r.resolution_hours <= p.sla_hours) * 100.0
          / nullif(count(*) FILTER (r.status IN ('resolved','closed')), 0), 1) AS sla_compliance_pct
        FROM dept d LEFT JOIN lines r ON d.dept_id = r.dept_id LEFT JOIN pri p ON r.priority_id = p.priority_id
        GROUP BY d.dept_id, d.dept_name, d.dept_code, d.head_name""",
    ),
)
def q05(r):
    return Q.department_performance(r.lines(category=True), r.dept, r.pri)


@query(
    "q06_sla_compliance",
    with_views(
        "pri lines",
        """SELECT p.priority_id, p.priority_name, p.priority_level, p.sla_hours AS sla_target_hours,
        count(*) AS total_requests, round(avg(resolution_hours), 2) AS avg_actual_hours,
        CAST(min(resolution_hours) AS DOUBLE) AS min_hours, CAST(max(resolution_hours) AS DOUBLE) AS max_hours,
        count(*) FILTER (resolution_hours <= p.sla_hours) AS within_sla,
        count(*) FILTER (resolution_hours > p.sla_hours) AS breached_sla,
        round(count(*) FILTER (resolution_hours <= p.sla_hours) * 100.0 / nullif(count(*), 0), 1) AS sla_compliance_pct
        FROM pri p JOIN lines r ON p.priority_id = r.priority_id
        WHERE r.status IN ('resolved','closed') AND r.resolution_hours IS NOT NULL GROUP BY ALL""",
    ),
)
def q06(r):
    return Q.sla_compliance(r.lines(), r.pri)


@query(
    "q07_urgent_backlog",
    with_views(
        "req pri cat loc dept",
        """SELECT r.request_id, r.code, r.title, r.status, p.priority_level, p.priority_name, p.color_code, c.cat_name,
        l.area_name, l.ward_number, d.dept_name, date_sub('hour', r.submitted_at, {R_NOW}) AS age_hours, p.sla_hours,
        CASE WHEN date_sub('hour', r.submitted_at, {R_NOW}) > p.sla_hours THEN 'BREACHED' ELSE 'WITHIN SLA' END AS sla_status,
        date_sub('hour', r.submitted_at, {R_NOW}) - p.sla_hours AS hours_overdue, r.submitted_at
        FROM req r JOIN pri p ON r.priority_id = p.priority_id JOIN cat c ON r.cat_id = c.cat_id
        JOIN loc l ON r.location_id = l.location_id JOIN dept d ON r.dept_id = d.dept_id
        WHERE r.status IN ('pending','assigned','in_progress') AND r.priority_id IN (1, 2)
        ORDER BY p.priority_level, age_hours DESC, r.request_id LIMIT 50""",
    ),
)
def q07(r):
    return Q.urgent_backlog(r.requests(resolved=False), r.cat, r.loc, r.dept, r.pri, REQ_AS_OF, 50)


@query(
    "q08_hotspots",
    with_views(
        "lines loc cat",
        """SELECT l.location_id, l.ward_number, l.area_name, l.zone, l.latitude, l.longitude, count(*) AS total_30d,
        string_agg(DISTINCT c.cat_name, ', ' ORDER BY c.cat_name) AS top_categories,
        count(*) FILTER (r.priority_id IN (1, 2)) AS high_priority_count,
        count(*) FILTER (r.status = 'pending') AS unresolved_count, 'HOTSPOT' AS zone_status
        FROM lines r JOIN loc l ON r.location_id = l.location_id JOIN cat c ON r.cat_id = c.cat_id
        WHERE r.submitted_at >= {R_NOW} - INTERVAL 30 DAY
        GROUP BY l.location_id, l.ward_number, l.area_name, l.zone, l.latitude, l.longitude HAVING count(*) >= 30""",
    ),
)
def q08(r):
    return Q.hotspots(r.lines(category=True, location=True), r.loc, r.cat, REQ_AS_OF, 30, 30)


@query(
    "q09_kpi_summary",
    with_views(
        "lines",
        """SELECT count(*) AS total_requests, count(*) FILTER (status = 'pending') AS total_pending,
        count(*) FILTER (status = 'in_progress') AS total_in_progress,
        count(*) FILTER (status IN ('resolved','closed')) AS total_resolved,
        count(*) FILTER (priority_id = 1) AS total_critical, count(*) FILTER (is_hotspot_flag = 1) AS total_hotspot,
        round(avg(resolution_hours), 1) AS avg_resolution_hrs,
        count(*) FILTER (submitted_at >= {R_NOW} - INTERVAL 24 HOUR) AS new_today,
        count(*) FILTER (submitted_at >= {R_NOW} - INTERVAL 7 DAY) AS new_this_week,
        round(count(*) FILTER (status IN ('resolved','closed')) * 100.0 / count(*), 1) AS overall_resolution_pct
        FROM lines""",
    ),
)
def q09(r):
    return Q.kpi_summary(r.lines(), REQ_AS_OF)


@query(
    "q10_user_tracker",
    with_views(
        "req pri cat loc dept fb",
        """SELECT r.request_id, r.user_id, r.code, r.title, r.status, c.cat_name, l.area_name, p.priority_name, p.color_code,
        r.submitted_at, r.resolved_at, CAST(r.resolution_hours AS DOUBLE) AS resolution_hours, d.dept_name,
        date_sub('hour', r.submitted_at, {R_NOW}) AS age_hours, f.rating, f.comment AS feedback_comment
        FROM req r JOIN pri p ON r.priority_id = p.priority_id JOIN cat c ON r.cat_id = c.cat_id
        JOIN loc l ON r.location_id = l.location_id JOIN dept d ON r.dept_id = d.dept_id
        LEFT JOIN fb f ON r.request_id = f.request_id""",
    ),
)
def q10(r):
    req = r.requests()
    return Q.user_tracker(req, r.cat, r.loc, r.dept, r.pri, derive_feedback(req, FEEDBACK_LIMITS), REQ_AS_OF)


@query(
    "q11_weekly_resolution",
    with_views(
        "lines",
        """SELECT CAST(yearweek(submitted_at) AS INTEGER) AS year_week, strftime(min(submitted_at), 'Week of %d %b') AS week_label,
        count(*) AS submitted, count(*) FILTER (status IN ('resolved','closed')) AS resolved,
        round(count(*) FILTER (status IN ('resolved','closed')) * 100.0 / count(*), 1) AS resolution_rate_pct
        FROM lines WHERE submitted_at >= {R_NOW} - INTERVAL 84 DAY GROUP BY 1""",
    ),
)
def q11(r):
    return Q.weekly_resolution(r.lines(), REQ_AS_OF, 12)


@query(
    "q12_recurring_issues",
    with_views(
        "lines cat loc dept",
        """SELECT c.cat_id, l.location_id, c.cat_name, l.area_name, l.ward_number, d.dept_name, count(*) AS occurrence_count,
        count(*) FILTER (r.status = 'pending') AS still_pending, round(avg(r.resolution_hours), 1) AS avg_resolution_hrs
        FROM lines r JOIN cat c ON r.cat_id = c.cat_id JOIN loc l ON r.location_id = l.location_id
        JOIN dept d ON r.dept_id = d.dept_id WHERE r.submitted_at >= {R_NOW} - INTERVAL 90 DAY
        GROUP BY c.cat_id, l.location_id, c.cat_name, l.area_name, l.ward_number, d.dept_name HAVING count(*) >= 3
        ORDER BY occurrence_count DESC, c.cat_id, l.location_id, d.dept_name LIMIT 20""",
    ),
)
def q12(r):
    return Q.recurring_issues(r.lines(category=True, location=True), r.cat, r.loc, r.dept, REQ_AS_OF)


@query(
    "q13_satisfaction",
    with_views(
        "req fb dept",
        """SELECT d.dept_id, d.dept_name, count(*) AS total_feedback, round(avg(f.rating), 2) AS avg_rating,
        count(*) FILTER (f.rating >= 4) AS satisfied, count(*) FILTER (f.rating <= 2) AS dissatisfied,
        round(count(*) FILTER (f.rating >= 4) * 100.0 / nullif(count(*), 0), 1) AS satisfaction_pct
        FROM dept d JOIN req r ON d.dept_id = r.dept_id JOIN fb f ON r.request_id = f.request_id
        GROUP BY d.dept_id, d.dept_name""",
    ),
)
def q13(r):
    req = r.requests()
    return Q.satisfaction(req, r.dept, derive_feedback(req, FEEDBACK_LIMITS))


DETAIL = """SELECT r.request_id, r.code, r.title, r.status, r.submitted_at, r.resolved_at,
        CAST(r.resolution_hours AS DOUBLE) AS resolution_hours, r.is_hotspot_flag, u.full_name AS citizen_name,
        c.cat_name AS category, c.icon_class, l.area_name, l.ward_number, l.zone, d.dept_name AS department, d.dept_code,
        p.priority_name, p.priority_level, p.color_code AS priority_color, p.sla_hours,
        CASE WHEN r.status NOT IN ('resolved','closed') AND date_sub('hour', r.submitted_at, {R_NOW}) > p.sla_hours
          THEN 1 ELSE 0 END AS is_sla_breached, date_sub('hour', r.submitted_at, {R_NOW}) AS age_hours
        FROM req r JOIN usr u ON r.user_id = u.user_id JOIN cat c ON r.cat_id = c.cat_id
        JOIN loc l ON r.location_id = l.location_id JOIN dept d ON r.dept_id = d.dept_id
        JOIN pri p ON r.priority_id = p.priority_id"""


@query("q14_request_detail", with_views("req usr cat loc dept pri", DETAIL))
def q14(r):
    return Q.request_detail(r.requests(), r.usr, r.cat, r.loc, r.dept, r.pri, REQ_AS_OF)


@query(
    "q15_location_hotspot_view",
    with_views(
        "loc lines",
        """SELECT l.location_id, l.ward_number, l.area_name, l.zone, l.latitude, l.longitude,
        count(r.status) AS total_requests, count(*) FILTER (r.status = 'pending') AS pending_count,
        count(*) FILTER (r.status = 'resolved') AS resolved_count, round(avg(r.resolution_hours), 2) AS avg_resolution_hours,
        count(*) FILTER (r.submitted_at >= {R_NOW} - INTERVAL 30 DAY) AS requests_last_30d,
        CASE WHEN count(*) FILTER (r.submitted_at >= {R_NOW} - INTERVAL 30 DAY) >= 15 THEN 1 ELSE 0 END AS is_hotspot
        FROM loc l LEFT JOIN lines r ON l.location_id = r.location_id GROUP BY ALL""",
    ),
)
def q15(r):
    return Q.location_hotspot_view(r.lines(location=True), r.loc, REQ_AS_OF)


@query(
    "q16_department_view",
    with_views(
        "dept lines",
        """SELECT d.dept_id, d.dept_name, d.dept_code, count(r.status) AS total_assigned,
        count(*) FILTER (r.status IN ('resolved','closed')) AS resolved_count,
        count(*) FILTER (r.status = 'pending') AS pending_count,
        count(*) FILTER (r.status = 'in_progress') AS in_progress_count,
        round(avg(r.resolution_hours) FILTER (r.status IN ('resolved','closed')), 2) AS avg_resolution_hours,
        round(count(*) FILTER (r.status IN ('resolved','closed')) * 100.0 / nullif(count(r.status), 0), 1) AS resolution_rate_pct
        FROM dept d LEFT JOIN lines r ON d.dept_id = r.dept_id GROUP BY d.dept_id, d.dept_name, d.dept_code""",
    ),
)
def q16(r):
    return Q.department_view(r.lines(category=True), r.dept)


@query(
    "q17_monthly_view",
    with_views(
        "lines",
        """SELECT strftime(submitted_at, '%Y-%m') AS month, count(*) AS total_requests,
        count(*) FILTER (status IN ('resolved','closed')) AS resolved, count(*) FILTER (status = 'pending') AS pending,
        round(avg(resolution_hours), 2) AS avg_resolution_hours FROM lines GROUP BY 1""",
    ),
)
def q17(r):
    return Q.monthly_view(r.lines())


@query(
    "q18_request_page",
    with_views(
        "req usr cat loc dept pri",
        f"""SELECT x.*, CAST((SELECT count(*) FROM req WHERE status = 'pending' AND contains(lower(title), 'build')) AS BIGINT) AS total,
        2 AS page, CAST(ceil((SELECT count(*) FROM req WHERE status = 'pending' AND contains(lower(title), 'build')) / 20.0) AS BIGINT) AS pages
        FROM ({DETAIL} WHERE r.status = 'pending' AND contains(lower(r.title), 'build')) x
        ORDER BY submitted_at DESC, request_id LIMIT 20 OFFSET 20""",
    ),
)
def q18(r):
    return Q.request_page(
        r.requests(resolved=False), r.usr, r.cat, r.loc, r.dept, r.pri, REQ_AS_OF, 2, 20,
        complete=r.with_resolution, status="pending", search="Build",
    )


@query(
    "q33_category_counts",
    with_views("lines cat", "SELECT c.cat_id, c.cat_name, count(*) AS total FROM cat c JOIN lines r ON c.cat_id = r.cat_id GROUP BY ALL"),
)
def q33a(r):
    return Q.category_counts(r.lines(category=True), r.cat)


@query(
    "q33_priority_resolution",
    with_views(
        "lines pri",
        """SELECT p.priority_id, p.priority_name, p.priority_level, count(*) AS total, round(avg(r.resolution_hours), 2) AS avg_hours
        FROM pri p JOIN lines r ON p.priority_id = r.priority_id GROUP BY ALL""",
    ),
)
def q33b(r):
    return Q.priority_resolution(r.lines(), r.pri)


@query(
    "q34_overview",
    with_views(
        "req",
        """SELECT count(*) AS total_requests, count(*) FILTER (resolved_at >= DATE '2001-08-02') AS resolved_today,
        (SELECT count(*) FROM customer) AS total_users, (SELECT count(*) FROM events) AS total_incidents FROM req""",
    ),
)
def q34(r):
    return Q.overview(r.requests(), REQ_AS_OF, r.usr, r.incidents())


_CMP = "round(({0}_current - {0}_previous) * 100.0 / nullif({0}_previous, 0), 1) AS {0}_change_pct"


@query(
    "q36_kpi_compare",
    with_views(
        "lines",
        f"""SELECT *, {_CMP.format('total')}, {_CMP.format('pending')}, {_CMP.format('resolved')}, {_CMP.format('avg_hours')}
        FROM (SELECT
        {", ".join(
            f'''count(*) FILTER ({c}) AS total_{t}, count(*) FILTER ({c} AND status = 'pending') AS pending_{t},
            count(*) FILTER ({c} AND status IN ('resolved','closed')) AS resolved_{t},
            round(avg(resolution_hours) FILTER ({c}), 1) AS avg_hours_{t}'''
            for t, c in (
                ("current", "submitted_at >= TIMESTAMP '2001-08-01' AND submitted_at <= {R_NOW}"),
                ("previous", "submitted_at >= TIMESTAMP '2001-07-01' AND submitted_at < TIMESTAMP '2001-08-01'"),
            )
        )},
        {" || ',' || ".join(
            f"count(*) FILTER (CAST(submitted_at AS DATE) = DATE '2001-08-02' - {b})" for b in range(6, -1, -1)
        )} AS daily_7d
        FROM lines)""",
    ),
)
def q36(r):
    return Q.kpi_compare(r.lines(), REQ_AS_OF)


@query(
    "q37_rolling_trend",
    with_views(
        "lines pri",
        """WITH daily AS (SELECT CAST(submitted_at AS DATE) AS day, count(*) AS n,
          round(count(*) FILTER (status IN ('resolved','closed') AND resolution_hours <= sla_hours) * 100.0
            / nullif(count(*) FILTER (status IN ('resolved','closed') AND resolution_hours IS NOT NULL), 0), 1) AS sla_pct
          FROM lines r JOIN pri p ON r.priority_id = p.priority_id GROUP BY 1)
        SELECT day, n, sla_pct, CAST(sum(n) OVER w AS BIGINT) AS rolling_n, round(sum(n) OVER w / 30.0, 4) AS rolling_avg_n
        FROM daily WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)""",
    ),
)
def q37(r):
    return Q.rolling_trend(r.lines(), r.pri)


@query(
    "q38_top_n_other",
    with_views(
        "lines",
        """SELECT CASE WHEN rn <= 5 THEN CAST(location_id AS VARCHAR) ELSE 'Others' END AS location_id, CAST(sum(n) AS BIGINT) AS total
        FROM (SELECT location_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, location_id) AS rn
          FROM lines GROUP BY location_id) GROUP BY 1""",
    ),
)
def q38(r):
    return Q.top_n_other(r.lines(location=True), "location_id", 5)


@query(
    "q39_priority_status_matrix",
    with_views(
        "lines pri",
        "SELECT p.priority_id, p.priority_name, "
        + ", ".join(f"count(*) FILTER (r.status = '{s}') AS {s}" for s in Q.STATUSES)
        + " FROM pri p LEFT JOIN lines r ON p.priority_id = r.priority_id GROUP BY ALL",
    ),
)
def q39(r):
    return Q.priority_status_matrix(r.lines(), r.pri)


@query(
    "q40_dept_week_heat",
    with_views(
        "lines dept",
        """SELECT d.dept_id, d.dept_name, CAST(yearweek(r.submitted_at) AS INTEGER) AS year_week, count(*) AS n,
        round(avg(r.resolution_hours), 2) AS avg_hours FROM lines r JOIN dept d ON r.dept_id = d.dept_id GROUP BY ALL""",
    ),
)
def q40(r):
    return Q.dept_week_heat(r.lines(category=True), r.dept)


@query(
    "q41_officer_category_avg",
    with_views(
        "req",
        """SELECT assigned_to, cat_id, count(*) AS n, round(avg(resolution_hours), 2) AS avg_hours FROM req
        WHERE status IN ('resolved','closed') AND assigned_to IS NOT NULL AND resolution_hours IS NOT NULL GROUP BY ALL""",
    ),
)
def q41(r):
    return Q.officer_category_avg(r.requests())


@query(
    "q42_sla_at_risk",
    with_views(
        "req pri",
        """SELECT request_id, r.priority_id, status, submitted_at, sla_hours,
        round((epoch_us(submitted_at) + CAST(sla_hours AS BIGINT) * 3600000000 - epoch_us({R_NOW})) / 3600000000.0, 2) AS hours_left
        FROM req r JOIN pri p ON r.priority_id = p.priority_id WHERE status NOT IN ('resolved','closed')
        AND {R_NOW} <= submitted_at + to_hours(sla_hours) AND submitted_at + to_hours(sla_hours) <= {R_NOW} + INTERVAL 168 HOUR""",
    ),
)
def q42(r):
    return Q.sla_at_risk(r.requests(resolved=False), r.pri, REQ_AS_OF, 168)


@query(
    "q46_wow_trend",
    with_views(
        "lines",
        """WITH b AS (SELECT date_trunc('week', {R_NOW}) AS monday,
          CAST(date_sub('day', DATE '1970-01-05', CAST(date_trunc('week', {R_NOW}) AS DATE)) // 7 AS BIGINT) AS week_no),
        seen AS (SELECT cat_id, location_id, CAST(date_sub('day', DATE '1970-01-05', CAST(submitted_at AS DATE)) // 7 AS BIGINT) AS week_no
          FROM lines, b WHERE submitted_at >= monday - INTERVAL 56 DAY AND submitted_at < monday),
        weekly AS (SELECT p.cat_id, p.location_id, b.week_no - i AS week_no, count(s.week_no) AS n
          FROM (SELECT DISTINCT cat_id, location_id FROM seen) p, b, (SELECT unnest(range(1, 9)) AS i)
          LEFT JOIN seen s ON s.cat_id = p.cat_id AND s.location_id = p.location_id AND s.week_no = b.week_no - i GROUP BY ALL)
        SELECT a.cat_id, a.location_id, a.week_no, a.n, b.n AS previous_n, round((a.n - b.n) * 100.0 / nullif(b.n, 0), 1) AS pct_change
        FROM weekly a LEFT JOIN weekly b ON a.cat_id = b.cat_id AND a.location_id = b.location_id AND a.week_no = b.week_no + 1""",
    ),
)
def q46(r):
    return Q.wow_trend(r.lines(category=True, location=True), REQ_AS_OF, 8)
