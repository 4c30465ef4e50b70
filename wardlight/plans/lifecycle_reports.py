"""L01-L12, W01-W07, Q43-Q49 and D01-D07 over the role tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.operators import community as C
from wardlight.operators import lifecycle as L
from wardlight.operators import quality as D
from wardlight.operators import requests as Q
from wardlight.operators import windows as W
from wardlight.operators.similar import similar_requests
from wardlight.plans.registry import query
from wardlight.plans.request_reports import FEEDBACK_LIMITS
from wardlight.plans.roles import REQ_AS_OF
from wardlight.plans.sql import with_views
from wardlight.sources.tables import derive_feedback, derive_history

# -- priorities, routing, hotspots --------------------------------------------------

FREQ = """freq AS (SELECT r.*, default_priority_id AS base_priority,
          count(*) OVER (PARTITION BY r.cat_id, r.location_id ORDER BY submitted_at
            RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) - 1 AS frequency_30d
          FROM req r JOIN cat c ON r.cat_id = c.cat_id),
        assigned AS (SELECT request_id, code, base_priority, frequency_30d, CASE WHEN frequency_30d >= 10 THEN 1
          WHEN frequency_30d >= 5 THEN greatest(1, base_priority - 1) WHEN frequency_30d >= 2 THEN base_priority
          ELSE least(4, base_priority + 1) END AS priority_id FROM freq)"""


@query(
    "l01_assign_priority",
    with_views("req cat", f"WITH {FREQ} SELECT request_id, base_priority, frequency_30d, priority_id FROM assigned"),
)
def l01(r):
    out = L.assign_priority(r.requests(resolved=False), r.cat)
    return out.select("request_id", "base_priority", "frequency_30d", "priority_id")


@query(
    "l01_assign_priority_as_of",
    with_views(
        "req cat",
        """WITH f AS (SELECT r.request_id, c.default_priority_id AS base_priority,
          (SELECT count(*) FROM req o WHERE o.cat_id = r.cat_id AND o.location_id = r.location_id
            AND o.submitted_at >= {R_NOW} - INTERVAL 30 DAY AND o.request_id <> r.request_id) AS frequency_30d
          FROM req r JOIN cat c ON r.cat_id = c.cat_id)
        SELECT *, CASE WHEN frequency_30d >= 10 THEN 1 WHEN frequency_30d >= 5 THEN greatest(1, base_priority - 1)
          WHEN frequency_30d >= 2 THEN base_priority ELSE least(4, base_priority + 1) END AS priority_id FROM f""",
    ),
)
def l01_as_of(r):
    out = L.assign_priority(r.requests(resolved=False), r.cat, REQ_AS_OF)
    return out.select("request_id", "base_priority", "frequency_30d", "priority_id")


def _with_urgency(req):
    """Urgency by id, so that every level occurs."""
    levels = F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")])
    return req.withColumn("urgency_level", F.get(levels, (F.col("request_id") % 4).cast("int")))


URG = "CASE request_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END"


@query(
    "l02_boost_priority",
    with_views(
        "req",
        f"""SELECT request_id, {URG} AS urgency_level,
        CASE {URG} WHEN 'critical' THEN 1 WHEN 'high' THEN least(priority_id, 2) ELSE priority_id END AS priority_id,
        CASE WHEN {URG} IN ('critical','high') THEN 1 ELSE 0 END AS auto_priority_boosted FROM req""",
    ),
)
def l02(r):
    out = L.boost_priority(_with_urgency(r.requests(resolved=False)))
    return out.select("request_id", "urgency_level", "priority_id", "auto_priority_boosted")


@query(
    "l03_sentiment_priority",
    with_views(
        "req cat",
        f"""SELECT request_id, default_priority_id AS base_priority, s AS sentiment_priority, least(default_priority_id, s) AS priority_id,
        CASE WHEN s < default_priority_id THEN 1 ELSE 0 END AS auto_priority_boosted
        FROM (SELECT *, CASE {URG} WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END AS s,
          CASE WHEN request_id % 17 = 0 THEN NULL WHEN request_id % 19 = 0 THEN 99 ELSE cat_id END AS filed FROM req) r
        LEFT JOIN cat c ON filed = c.cat_id""",
    ),
)
def l03(r):
    """Some requests have no category, or one that is not in the table."""
    key = F.col("request_id")
    filed = F.when(key % 17 == 0, F.lit(None)).when(key % 19 == 0, 99).otherwise(F.col("cat_id"))
    out = L.sentiment_priority(_with_urgency(r.requests(resolved=False).withColumn("cat_id", filed)), r.cat)
    return out.select("request_id", "base_priority", "sentiment_priority", "priority_id", "auto_priority_boosted")


@query(
    "l04_route_department",
    with_views("req cat", "SELECT request_id, r.cat_id, c.dept_id FROM req r LEFT JOIN cat c ON r.cat_id = c.cat_id"),
)
def l04(r):
    return L.route_department(r.requests(resolved=False).drop("dept_id"), r.cat).select("request_id", "cat_id", "dept_id")


HOT = """hot AS (SELECT location_id, count(*) AS n FROM req WHERE submitted_at >= {R_NOW} - INTERVAL 30 DAY
          AND status NOT IN ('closed','rejected') GROUP BY 1 HAVING count(*) >= 7)"""


@query(
    "l05_flag_hotspots",
    with_views(
        "req",
        f"""WITH {HOT} SELECT request_id, r.location_id, CASE WHEN h.n IS NOT NULL AND submitted_at >= {{R_NOW}} - INTERVAL 30 DAY
        AND status NOT IN ('closed','rejected') THEN 1 ELSE is_hotspot_flag END AS is_hotspot_flag
        FROM req r LEFT JOIN hot h ON r.location_id = h.location_id""",
    ),
)
def l05(r):
    flagged, _ = L.flag_hotspots(r.requests(resolved=False), REQ_AS_OF, 30, 7)
    return flagged.select("request_id", "location_id", "is_hotspot_flag")


HOT_LOG = """SELECT 'hotspot_detected' AS log_type, 'location' AS entity_type, CAST(location_id AS BIGINT) AS entity_id,
        'Hotspot detected: ' || n || ' complaints in 30 days' AS message,
        '{"complaint_count":' || n || ',"window_days":30}' AS meta_json FROM hot"""


@query("l05_hotspot_log", with_views("req", f"WITH {HOT} {HOT_LOG}"))
def l05_log(r):
    return L.flag_hotspots(r.requests(resolved=False), REQ_AS_OF, 30, 7)[1]


# -- status changes ----------------------------------------------------------------

# What an event type means as a status command; 'view' is no valid status.
COMMANDS = {"signup": "assigned", "click": "in_progress", "purchase": "resolved", "error": "closed", "view": "opened"}
COMMAND_SQL = """CASE event_type WHEN 'signup' THEN 'assigned' WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'resolved'
          WHEN 'error' THEN 'closed' ELSE 'opened' END"""


def _commands(r):
    from wardlight.functions.columns import map_value

    return r.t["events"].select(
        (F.col("event_id") % 1500).alias("request_id"),
        "event_id",
        map_value("event_type", COMMANDS).alias("new_status"),
        F.col("user_id").alias("actor_id"),
        F.when(F.col("event_id") % 2 == 0, F.col("user_id") + 1).alias("assigned_to"),
        F.col("ts").alias("event_at"),
    )


EVENTS_SQL = f"""cmd AS (SELECT event_id % 1500 AS request_id, event_id, {COMMAND_SQL} AS new_status, user_id AS actor_id,
          CASE WHEN event_id % 2 = 0 THEN user_id + 1 END AS assigned_to, ts AS event_at FROM events),
        folded AS (SELECT request_id, arg_max(new_status, event_id) AS s, max(event_at) FILTER (new_status = 'resolved') AS ra,
          max(event_at) FILTER (new_status = 'closed') AS ca, max(event_at) FILTER (new_status = 'assigned') AS aa,
          arg_max(coalesce(assigned_to, actor_id), event_id) FILTER (new_status = 'assigned') AS o
          FROM cmd WHERE new_status <> 'opened' GROUP BY 1),
        after AS (SELECT r.request_id, user_id, coalesce(s, status) AS status, coalesce(ra, resolved_at) AS resolved_at,
          coalesce(aa, assigned_at) AS assigned_at, coalesce(o, r.assigned_to) AS assigned_to, ca AS closed_at
          FROM req r LEFT JOIN folded f ON r.request_id = f.request_id)"""


@query(
    "l06_status_audit",
    with_views(
        "req",
        f"""WITH {EVENTS_SQL} SELECT a.request_id, coalesce(a.assigned_to, a.user_id) AS updated_by, r.status AS old_status,
        a.status AS new_status, 'Status changed from ' || r.status || ' to ' || a.status AS remarks
        FROM after a JOIN req r ON a.request_id = r.request_id WHERE a.status <> r.status""",
    ),
)
def l06(r):
    before = r.requests(resolved=False)
    after, _ = L.apply_status_events(before, _commands(r))
    return L.status_audit(before, after)


@query(
    "l07_apply_status_events",
    with_views(
        "req",
        f"WITH {EVENTS_SQL} SELECT request_id, status, assigned_to, assigned_at, resolved_at, closed_at FROM after",
    ),
)
def l07(r):
    out, _ = L.apply_status_events(r.requests(), _commands(r))
    return out.select("request_id", "status", "assigned_to", "assigned_at", "resolved_at", "closed_at")


@query(
    "l07_rejected_events",
    with_views(
        "req",
        f"""WITH {EVENTS_SQL.split(',' + chr(10) + '        folded')[0]} SELECT event_id, new_status,
        CASE WHEN new_status = 'opened' THEN 'invalid status' ELSE 'unknown request' END AS reject_reason FROM cmd
        WHERE new_status = 'opened' OR request_id NOT IN (SELECT request_id FROM req)""",
    ),
)
def l07_rejects(r):
    rejected = L.apply_status_events(r.requests(resolved=False), _commands(r))[1]
    return rejected.select("event_id", "new_status", "reject_reason")


BREACH = """SELECT 'sla_breached' AS log_type, 'complaint' AS entity_type, request_id AS entity_id,
        'SLA breached for complaint ' || code AS message,
        '{"sla_hours":' || sla_hours || ',"elapsed_hours":' || date_sub('hour', submitted_at, {R_NOW}) || '}' AS meta_json
        FROM req r JOIN pri p ON r.priority_id = p.priority_id
        WHERE status NOT IN ('resolved','closed') AND date_sub('hour', submitted_at, {R_NOW}) > sla_hours"""


@query("l08_sla_breaches", with_views("req pri", BREACH))
def l08(r):
    return L.sla_breaches(r.requests(resolved=False), r.pri, REQ_AS_OF)


@query(
    "l09_ingest_feedback",
    """SELECT request_id, rating, CASE WHEN rating >= 3 THEN 1 ELSE 0 END AS is_satisfied FROM (
      SELECT event_id % 2000 AS request_id, arg_max(rating, event_id) AS rating FROM (
        SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 3 ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 7 END AS rating
        FROM events) WHERE rating BETWEEN 1 AND 5 GROUP BY 1)""",
)
def l09(r):
    k = F.from_json("props", "k INT")["k"]
    raw = r.t["events"].select(
        (F.col("event_id") % 2000).alias("request_id"),
        F.col("event_id").alias("feedback_id"),
        F.when(F.col("event_id") % 11 != 0, (k % 7).cast("string")).alias("rating"),
        F.col("ts").alias("submitted_at"),
    )
    return L.ingest_feedback(raw)[0].select("request_id", "rating", "is_satisfied")


@query(
    "l10_rating_from_hours",
    with_views(
        "req",
        """SELECT request_id, CAST(resolution_hours AS DOUBLE) AS resolution_hours, CASE WHEN resolution_hours <= 4380 THEN 5
        WHEN resolution_hours <= 8760 THEN 4 WHEN resolution_hours <= 17520 THEN 3 WHEN resolution_hours IS NOT NULL THEN 2 END AS rating FROM req""",
    ),
)
def l10(r):
    return L.rating_from_hours(r.requests(), FEEDBACK_LIMITS).select("request_id", "resolution_hours", "rating")


PRIORITY_LOG = """SELECT 'priority_assigned' AS log_type, 'complaint' AS entity_type, request_id AS entity_id,
        'Auto priority assigned: level ' || priority_id AS message, '{"base_priority":' || base_priority || ',"frequency_30d":'
        || frequency_30d || ',"final_priority":' || priority_id || '}' AS meta_json FROM assigned"""


@query(
    "l11_analytics_log",
    with_views("req cat pri", f"WITH {FREQ}, {HOT} {PRIORITY_LOG} UNION ALL {HOT_LOG} UNION ALL {BREACH}"),
)
def l11(r):
    req = r.requests(resolved=False)
    assigned = L.priority_log(L.assign_priority(req, r.cat))
    return L.analytics_log(assigned, L.flag_hotspots(req, REQ_AS_OF, 30, 7)[1], L.sla_breaches(req, r.pri, REQ_AS_OF))


@query(
    "l12_ai_log",
    """SELECT 'ai_categorized' AS log_type, 'complaint' AS entity_type, o_orderkey AS entity_id,
      'AI suggested: ' || o_orderpriority || ' (' || printf('%.2f', CAST(o_orderkey % 101 AS DOUBLE)) || '%)' AS message, CAST(NULL AS VARCHAR) AS meta_json
      FROM orders WHERE o_orderstatus <> 'P'""",
)
def l12(r):
    suggested = r.t["orders"].select(
        F.col("o_orderkey").alias("request_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("ai_suggested_category"),
        ((F.col("o_orderkey") % 101) / 100).alias("ai_confidence_score"),
    )
    return L.ai_log(suggested)


# -- ordered computations ------------------------------------------------------------


@query(
    "w01_assign_codes",
    """SELECT o_orderkey AS request_id, format('CMP-{}-{:05d}', year(o_orderdate), row_number() OVER (ORDER BY o_orderdate, o_orderkey)) AS code
      FROM orders""",
)
def w01(r):
    rows = r.t["orders"].select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("submitted_at"))
    return W.assign_codes(rows, "CMP", "submitted_at", "request_id").select("request_id", "code")


@query(
    "w02_latest_per_key",
    "SELECT user_id, event_id, event_type, value, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def w02(r):
    rows = r.t["events"].select("user_id", "event_id", "event_type", "value", "ts")
    return W.latest_per_key(rows, ["user_id"], ["ts", "event_id"])


TRANSITIONS = """SELECT * FROM (SELECT request_id, event_id, new_status, event_at,
        lag(new_status) OVER (PARTITION BY request_id ORDER BY event_at, event_id) AS old_status FROM sev) WHERE old_status <> new_status"""


@query("w03_status_transitions", with_views("sev", TRANSITIONS))
def w03(r):
    return W.status_transitions(r.status_events())


@query(
    "w04_pct_change",
    """WITH d AS (SELECT event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day_no, count(*) AS n FROM events GROUP BY ALL)
      SELECT a.event_type, a.day_no, a.n, b.n AS previous_n, round((a.n - b.n) * 100.0 / nullif(b.n, 0), 1) AS pct_change
      FROM d a LEFT JOIN d b ON a.event_type = b.event_type AND a.day_no = b.day_no + 1""",
)
def w04(r):
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    daily = r.t["events"].groupBy("event_type", day.alias("day_no")).agg(F.count(F.lit(1)).alias("n"))
    return W.pct_change(daily, ["event_type"], "day_no", "n")


@query(
    "w05_rolling",
    with_views(
        "inc",
        """WITH d AS (SELECT CASE WHEN location_id % 6 <> 0 THEN location_id END AS location_id,
          CASE WHEN incident_id % 90 <> 0 THEN incident_date END AS incident_date, count(*) AS n FROM inc GROUP BY ALL)
        SELECT location_id, incident_date, n, CASE WHEN incident_date IS NOT NULL THEN CAST(sum(n) OVER w AS BIGINT) END AS rolling_n,
        CASE WHEN incident_date IS NOT NULL THEN round(sum(n) OVER w / 7.0, 6) END AS rolling_avg_n
        FROM d WINDOW w AS (PARTITION BY location_id ORDER BY incident_date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""",
    ),
)
def w05(r):
    from wardlight.functions.measures import daily_counts

    place = F.when(F.col("location_id") % 6 != 0, F.col("location_id"))
    day = F.when(F.col("incident_id") % 90 != 0, F.col("incident_date"))
    incidents = r.incidents().withColumns({"location_id": place, "incident_date": day})
    out = W.rolling(daily_counts(incidents), 7, "incident_date", "n", ("location_id",))
    return out.withColumn("rolling_avg_n", F.round("rolling_avg_n", 6))


@query(
    "w06_ranked",
    """SELECT c_nationkey, c_custkey, n, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY n DESC) AS INTEGER) AS rank
      FROM (SELECT c_nationkey, c_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
      QUALIFY rank() OVER (PARTITION BY c_nationkey ORDER BY n DESC) <= 5""",
)
def w06(r):
    counts = r.t["orders"].groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    named = counts.join(r.t["customer"].select("c_custkey", "c_nationkey"), "c_custkey")
    return W.ranked(named, ["c_nationkey"], [F.col("n").desc()], 5)


@query(
    "w06_ranked_all",
    """WITH v AS (SELECT CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 'hot' ELSE event_type END AS kind, event_id, CAST(ts AS DATE) AS day,
        CASE WHEN event_id % 40 <> 0 THEN round(value) END AS score FROM events)
      SELECT event_id, kind, rank() OVER (PARTITION BY kind ORDER BY score DESC NULLS LAST, day ASC NULLS FIRST) AS rank,
        dense_rank() OVER (PARTITION BY kind ORDER BY score DESC NULLS LAST) AS dense FROM v""",
)
def w06_all(r):
    """Ranks of all events; a third of them lie in one part."""
    kind = F.when(F.col("user_id") % 5 == 0, F.lit(None)).when(F.col("user_id") % 3 == 0, "hot").otherwise(F.col("event_type"))
    score = F.when(F.col("event_id") % 40 != 0, F.round("value"))
    rows = r.t["events"].select("event_id", kind.alias("kind"), F.col("ts").cast("date").alias("day"), score.alias("score"))
    ranks = W.ranked_all(rows, ["kind"], [("score", "desc"), ("day", "asc")])
    return W.ranked_all(ranks, ["kind"], [("score", "desc")], True, "dense").select("event_id", "kind", "rank", "dense")


HISTORY = """hist AS (SELECT request_id, coalesce(assigned_to, 1) AS updated_by, * FROM (
          SELECT request_id, assigned_to, 'pending' AS old_status, 'assigned' AS new_status, 'Complaint assigned to field officer' AS remarks,
            submitted_at + INTERVAL 2 HOUR AS updated_at FROM req WHERE status NOT IN ('pending','rejected')
          UNION ALL SELECT request_id, assigned_to, 'assigned', 'in_progress', 'Officer visited site, work in progress',
            submitted_at + INTERVAL 6 HOUR FROM req WHERE status IN ('in_progress','resolved','closed')
          UNION ALL SELECT request_id, assigned_to, 'in_progress', 'resolved', 'Issue resolved and verified by officer', resolved_at
            FROM req WHERE status IN ('resolved','closed') AND resolved_at IS NOT NULL))"""


def history(req):
    """History rows with an id that orders the legs of a request."""
    legs = derive_history(req)
    step = F.array_position(F.array(F.lit("assigned"), F.lit("in_progress"), F.lit("resolved")), F.col("new_status"))
    return legs.withColumn("update_id", F.col("request_id") * 4 + step)


@query(
    "w07_timeline",
    with_views(
        "req",
        f"""WITH {HISTORY},
        filed AS (SELECT * REPLACE (CASE WHEN request_id % 50 <> 0 THEN request_id END AS request_id), request_id * 4
          + CASE new_status WHEN 'assigned' THEN 1 WHEN 'in_progress' THEN 2 ELSE 3 END AS update_id FROM hist),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY updated_at DESC, update_id DESC) AS back FROM filed),
        steps AS (SELECT * FROM (VALUES (1, 'Submitted'), (2, 'Assigned'), (3, 'In Progress'), (4, 'Resolved')) v(n, step))
        SELECT request_id, CASE new_status WHEN 'assigned' THEN 'Assigned' WHEN 'in_progress' THEN 'In Progress' ELSE 'Resolved' END AS step,
          updated_at AS at, CASE WHEN back = 1 THEN 0 ELSE 1 END AS done, CASE WHEN back = 1 THEN 1 ELSE 0 END AS is_current FROM ranked
        UNION ALL SELECT request_id, step, CASE n WHEN 1 THEN submitted_at WHEN 4 THEN resolved_at END,
          CAST(CASE n WHEN 1 THEN status <> 'pending' WHEN 2 THEN status IN ('assigned','in_progress','resolved','closed')
            WHEN 3 THEN status IN ('in_progress','resolved','closed') ELSE status IN ('resolved','closed') END AS INTEGER),
          CAST(CASE n WHEN 1 THEN FALSE WHEN 2 THEN status = 'assigned' WHEN 3 THEN status = 'in_progress' ELSE status = 'resolved' END AS INTEGER)
        FROM req, steps WHERE status IN ('pending','rejected') OR request_id % 50 = 0""",
    ),
)
def w07(r):
    """The history of every fiftieth request has lost its request id."""
    req = r.requests()
    filed = F.when(F.col("request_id") % 50 != 0, F.col("request_id"))
    return W.timeline(history(req).withColumn("request_id", filed), req)


# -- duplicates and community --------------------------------------------------------


@query(
    "q43_duplicate_requests",
    r"""WITH k AS (SELECT doc_id, lang, array_to_string(list_sort(list_distinct(list_filter(
          regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''))), ' ') AS words FROM documents),
        g AS (SELECT lang, words, min(doc_id) AS original_id, count(*) AS copies FROM k GROUP BY ALL HAVING count(*) > 1)
        SELECT doc_id, lang, original_id, copies FROM k JOIN g USING (lang, words) WHERE doc_id <> original_id""",
)
def q43(r):
    return C.duplicate_requests(r.docs, "doc_id", "text", ["lang"])


@query(
    "q43_similar_requests",
    r"""WITH RECURSIVE k AS (SELECT doc_id, lang, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS words
          FROM documents),
        s AS (SELECT *, len(words) AS n FROM k WHERE len(words) > 0),
        e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.lang IS NOT DISTINCT FROM b.lang AND a.doc_id <> b.doc_id
          AND b.n * 100 >= a.n * 80 AND a.n * 100 >= b.n * 80
          WHERE len(list_intersect(a.words, b.words)) * 100 >= (a.n + b.n - len(list_intersect(a.words, b.words))) * 80),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
        g AS (SELECT x, min(y) AS group_id, count(*) AS members FROM reach GROUP BY x HAVING count(*) > 1)
        SELECT doc_id, lang, group_id, members FROM g JOIN s ON s.doc_id = g.x""",
)
def q43_similar(r):
    return similar_requests(r.docs, "doc_id", "text", ["lang"])


@query(
    "q44_badges",
    with_views(
        "req",
        """WITH m AS (SELECT user_id, date_trunc('month', submitted_at) AS m, count(*) AS n FROM req GROUP BY ALL),
        a AS (SELECT user_id, count(*) AS total, count(*) FILTER (cat_id = 11) AS in_category, count(*) AS in_ward,
          count(*) FILTER (status IN ('resolved','closed') AND resolution_hours < 4380) AS quick_fixes FROM req GROUP BY 1)
        SELECT *, concat_ws(', ', CASE WHEN total >= 1 THEN 'first_reporter' END, CASE WHEN in_category >= 5 THEN 'category_hunter' END,
          CASE WHEN in_ward >= 3 THEN 'ward_warrior' END, CASE WHEN quick_fixes >= 5 THEN 'quick_fix' END,
          CASE WHEN best_month >= 10 THEN 'community_champion' END, CASE WHEN total >= 50 THEN 'super_helper' END) AS badges
        FROM (SELECT a.*, (SELECT max(n) FROM m WHERE m.user_id = a.user_id) AS best_month FROM a)""",
    ),
)
def q44(r):
    return C.badges(r.requests(), r.usr, 11, 4380)


@query(
    "q45_leaderboard",
    with_views(
        "req usr",
        """SELECT u.user_id, u.location_id, split_part(full_name, ' ', 1) AS first_name, reports, last_report,
        CAST(rank() OVER (PARTITION BY u.location_id ORDER BY reports DESC) AS INTEGER) AS rank
        FROM (SELECT user_id, count(*) AS reports, max(submitted_at) AS last_report FROM req
          WHERE submitted_at >= TIMESTAMP '2001-07-01' AND submitted_at < TIMESTAMP '2001-08-01' GROUP BY 1) c
        JOIN usr u ON c.user_id = u.user_id WHERE opt_in
        QUALIFY rank() OVER (PARTITION BY u.location_id ORDER BY reports DESC) <= 3""",
    ),
)
def q45(r):
    return C.leaderboard(r.requests(resolved=False), r.usr, "2001-07", 3)


@query(
    "q47_user_digest",
    with_views(
        "req",
        """SELECT *, format('Your {} complaints: {} fixed, {} assigned, {} pending', total, fixed, assigned, pending) AS summary FROM (
        SELECT user_id, count(*) AS total, count(*) FILTER (status IN ('resolved','closed')) AS fixed,
        count(*) FILTER (status IN ('assigned','in_progress')) AS assigned, count(*) FILTER (status = 'pending') AS pending,
        count(*) FILTER (submitted_at >= {R_NOW} - INTERVAL 7 DAY) AS reported_this_week,
        count(*) FILTER (resolved_at >= {R_NOW} - INTERVAL 7 DAY) AS fixed_this_week FROM req GROUP BY 1)""",
    ),
)
def q47(r):
    return C.user_digest(r.requests(), REQ_AS_OF)


@query(
    "q48_impact_counters",
    with_views("req cat", "SELECT c.cat_id, c.cat_name, count(*) AS fixed FROM req r JOIN cat c ON r.cat_id = c.cat_id WHERE status IN ('resolved','closed') GROUP BY ALL"),
)
def q48a(r):
    return C.impact_counters(r.requests(resolved=False), r.cat)


@query(
    "q48_area_activity",
    with_views(
        "req usr",
        """WITH act AS (SELECT DISTINCT user_id FROM req WHERE submitted_at >= {R_NOW} - INTERVAL 7 DAY AND submitted_at <= {R_NOW})
        SELECT u.user_id, u.location_id, (SELECT count(*) FROM act a JOIN usr v ON a.user_id = v.user_id
          WHERE v.location_id = u.location_id AND v.user_id <> u.user_id) AS neighbours_active FROM usr u""",
    ),
)
def q48b(r):
    return C.area_activity(r.requests(resolved=False), r.usr, REQ_AS_OF)


@query(
    "q49_slow_report",
    "SELECT event_type AS operation, round(avg(value), 4) AS avg_ms, count(*) AS n FROM events GROUP BY 1 HAVING avg(value) > 19.5",
)
def q49(r):
    log = r.t["events"].select(F.col("event_type").alias("operation"), F.col("value").alias("duration_ms"))
    return C.slow_report(log, 19.5)


# -- data quality --------------------------------------------------------------------


@query("d01_check_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def d01(r):
    return D.check_unique(r.t["lineitem"], ["l_orderkey", "l_linenumber"])


@query(
    "d02_check_fk",
    "SELECT doc_id, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1",
)
def d02(r):
    return D.check_fk(r.t["documents"], "doc_id", r.t["labels"], "doc_id")


@query("d03_check_domain", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click','view','purchase')")
def d03(r):
    return D.check_domain(r.t["events"], "event_type", ["click", "view", "purchase"]).select("event_id", "event_type")


@query("d04_check_range", "SELECT event_id, value FROM events WHERE value IS NULL OR value < 1 OR value > 50")
def d04(r):
    return D.check_range(r.t["events"], "value", 1, 50).select("event_id", "value")


@query("d05_check_required", "SELECT doc_id, lang FROM documents WHERE text IS NULL OR length(trim(text, ' ')) < 200")
def d05(r):
    return D.check_required(r.t["documents"], "text", 200).select("doc_id", "lang")


@query(
    "d06_check_lifecycle",
    with_views(
        "lines",
        """SELECT problem, count(*) AS n FROM (SELECT CASE WHEN status IN ('resolved','closed') AND resolved_at IS NULL THEN 'done without resolved_at'
        WHEN resolved_at < submitted_at THEN 'resolved before submitted'
        WHEN resolved_at IS NOT NULL AND status NOT IN ('resolved','closed') THEN 'resolved_at on open request' END AS problem FROM lines)
        WHERE problem IS NOT NULL GROUP BY 1""",
    ),
)
def d06(r):
    return D.check_lifecycle(r.lines()).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d07_cascade_delete",
    "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'",
)
def d07(r):
    removed = r.t["orders"].filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return D.cascade_delete(r.t["lineitem"].select("l_orderkey", "l_linenumber", "l_shipdate"), removed, "l_orderkey")


@query(
    "d07_set_null",
    "SELECT o_orderkey, CASE WHEN c_acctbal >= 0 THEN o_custkey END AS o_custkey FROM orders JOIN customer ON o_custkey = c_custkey",
)
def d07b(r):
    removed = r.t["customer"].filter("c_acctbal < 0")
    return D.set_null_on_delete(r.t["orders"].select("o_orderkey", "o_custkey"), removed, "o_custkey", "c_custkey")


@query(
    "j11_request_documents",
    with_views("req fb", "SELECT r.request_id, r.status, f.rating FROM req r LEFT JOIN fb f ON r.request_id = f.request_id"),
)
def j11(r):
    req = r.requests()
    docs = Q.request_documents(req, derive_feedback(req, FEEDBACK_LIMITS))
    return docs.select("request_id", "status", F.col("feedback.rating").alias("rating"))


@query(
    "j11_request_history",
    with_views(
        "req",
        f"""WITH {HISTORY} SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY updated_at) AS position, new_status, updated_at FROM hist""",
    ),
)
def j11_history(r):
    changes = Q.request_history(history(r.requests()))
    return changes.select("request_id", F.col("position").cast("long").alias("position"), "new_status", "updated_at")
