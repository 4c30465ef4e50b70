"""N01-N11: notification planning for all requests and status events."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.functions.columns import map_value
from wardlight.operators import notify as N
from wardlight.plans.registry import query
from wardlight.plans.sql import with_views

NOW = "2024-01-31 22:30:00"
S_NOW = f"TIMESTAMP '{NOW}'"
# Event types as status commands; views are no news.
NEWS = {"signup": "submitted", "click": "assigned", "purchase": "in_progress", "error": "resolved", "view": "viewed"}
CONTEXT = {
    "user_name": "citizen_name",
    "complaint_code": "code",
    "category": "category",
    "location": "location",
    "priority": "priority",
    "eta_hours": "eta_hours",
    "officer_name": "officer_name",
}

EV = """ev AS (SELECT event_id, event_id % 15000 AS request_id, ts, CASE event_type WHEN 'signup' THEN 'submitted' WHEN 'click' THEN 'assigned'
          WHEN 'purchase' THEN 'in_progress' WHEN 'error' THEN 'resolved' ELSE 'viewed' END AS new_status FROM events),
        n1 AS (SELECT *, CASE new_status WHEN 'submitted' THEN 'complaint_received' WHEN 'assigned' THEN 'complaint_assigned'
          WHEN 'in_progress' THEN 'complaint_in_progress' WHEN 'resolved' THEN 'complaint_resolved' END AS template_key FROM ev
          WHERE new_status <> 'viewed'),
        n2 AS (SELECT n1.*, r.code, r.status, r.user_id, u.full_name AS citizen_name, coalesce(o.full_name, 'Assigned Officer') AS officer_name,
          c.cat_name AS category, l.area_name AS location, p.priority_name AS priority, CAST(r.priority_id = 1 AS INTEGER) AS is_critical,
          CASE WHEN r.priority_id = 1 THEN 24 ELSE 72 END AS eta_hours
          FROM n1 JOIN req r ON r.request_id = n1.request_id JOIN usr u ON r.user_id = u.user_id LEFT JOIN usr o ON r.assigned_to = o.user_id
          JOIN cat c ON r.cat_id = c.cat_id JOIN loc l ON r.location_id = l.location_id JOIN pri p ON r.priority_id = p.priority_id)"""
S_AT = """s0 AS (SELECT n2.*, coalesce(preferred_hour, 9) AS ph, coalesce(quiet_hours_enabled, 1) AS qe, coalesce(quiet_start_hour, 22) AS qs,
          coalesce(quiet_end_hour, 7) AS qn, hour(ts) AS h FROM n2 LEFT JOIN prefs f ON f.user_id = n2.user_id),
        s1 AS (SELECT *, CASE WHEN is_critical = 1 THEN ts WHEN qe = 1 AND (CASE WHEN qs <= qn THEN h >= qs AND h < qn ELSE h >= qs OR h < qn END)
          THEN date_trunc('day', ts) + to_hours(qn) + CASE WHEN date_trunc('day', ts) + to_hours(qn) <= ts THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END
          ELSE date_trunc('day', ts) + to_hours(ph) + CASE WHEN date_trunc('day', ts) + to_hours(ph) <= ts THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END
          END AS scheduled_at FROM s0),
        q0 AS (SELECT user_id, request_id, template_key, CASE WHEN is_critical = 1 THEN 'critical' ELSE 'normal' END AS priority, scheduled_at,
          request_id || ':' || template_key || ':' || status || ':' || strftime(scheduled_at, '%Y%m%d%H') AS idempotency_key, event_id AS queue_id FROM s1)"""
VIEWS = "req usr cat loc pri prefs"


def news(r):
    rows = r.t["events"].select(
        "event_id", (F.col("event_id") % 15000).alias("request_id"), "ts", map_value("event_type", NEWS).alias("new_status")
    )
    return N.notifications_for(rows)


def context(r):
    return N.notification_context(news(r), r.requests(resolved=False), r.usr, r.cat, r.loc, r.pri)


def scheduled(r):
    return N.schedule(context(r), r.preferences(), F.col("ts"))


def queue(r):
    """Queue rows with the event id as queue id."""
    rows = scheduled(r)
    key = F.concat_ws(
        ":", F.col("request_id").cast("string"), "template_key", "status", F.date_format("scheduled_at", "yyyyMMddHH")
    )
    return rows.select(
        "user_id",
        "request_id",
        "template_key",
        F.when(F.col("is_critical") == 1, "critical").otherwise("normal").alias("priority"),
        F.lit("queued").alias("status"),
        "scheduled_at",
        key.alias("idempotency_key"),
        F.col("event_id").alias("queue_id"),
    )


@query("n01_notifications_for", with_views("pri", f"WITH {EV.split('n2 AS')[0].rstrip().rstrip(',')} SELECT event_id, request_id, new_status, template_key FROM n1"))
def n01(r):
    return news(r).select("event_id", "request_id", "new_status", "template_key")


@query(
    "n02_notification_context",
    with_views(
        VIEWS,
        f"WITH {EV} SELECT event_id, template_key, code, citizen_name, officer_name, category, location, priority, is_critical, eta_hours FROM n2",
    ),
)
def n02(r):
    return context(r).select(
        "event_id", "template_key", "code", "citizen_name", "officer_name", "category", "location", "priority", "is_critical", "eta_hours"
    )


@query("n03_schedule", with_views(VIEWS, f"WITH {EV}, {S_AT} SELECT event_id, is_critical, scheduled_at FROM s1"))
def n03(r):
    return scheduled(r).select("event_id", "is_critical", "scheduled_at")


@query(
    "n04_dedupe_queue",
    with_views(VIEWS, f"WITH {EV}, {S_AT} SELECT idempotency_key, max(scheduled_at) AS scheduled_at FROM q0 GROUP BY 1"),
)
def n04(r):
    return N.dedupe_queue(N.enqueue(scheduled(r))).select("idempotency_key", "scheduled_at")


@query(
    "n05_due_batch",
    with_views(
        VIEWS,
        f"""WITH {EV}, {S_AT} SELECT queue_id, priority, scheduled_at FROM q0 WHERE scheduled_at <= {S_NOW}
        ORDER BY priority = 'critical' DESC, scheduled_at, queue_id LIMIT 10""",
    ),
)
def n05(r):
    return N.due_batch(queue(r), NOW, 10).select("queue_id", "priority", "scheduled_at")


RECIPIENT = """rec AS (SELECT q0.*, CASE WHEN coalesce(opted_out, 0) = 1 AND template_key <> 'complaint_received' THEN 'cancelled'
          WHEN coalesce(preferred_email, email) IS NULL THEN 'failed' ELSE 'processing' END AS status,
          CASE WHEN coalesce(opted_out, 0) = 1 AND template_key <> 'complaint_received' THEN 'User opted out'
          WHEN coalesce(preferred_email, email) IS NULL THEN 'No recipient email' END AS last_error,
          CASE WHEN NOT (coalesce(opted_out, 0) = 1 AND template_key <> 'complaint_received') THEN coalesce(preferred_email, email) END AS recipient
          FROM q0 LEFT JOIN usr u ON u.user_id = q0.user_id LEFT JOIN prefs f ON f.user_id = q0.user_id)"""


@query(
    "n06_resolve_recipients",
    with_views(VIEWS, f"WITH {EV}, {S_AT}, {RECIPIENT} SELECT queue_id, status, recipient, last_error FROM rec"),
)
def n06(r):
    return N.resolve_recipients(queue(r), r.preferences(), r.usr).select("queue_id", "status", "recipient", "last_error")


@query(
    "n07_render",
    with_views(
        VIEWS,
        f"""WITH {EV} SELECT event_id, CASE template_key WHEN 'complaint_received' THEN 'Complaint Received - ' || code
          WHEN 'complaint_assigned' THEN 'Officer ' || officer_name || ' has ' || code
          WHEN 'complaint_in_progress' THEN 'Work started on your complaint - ' || code ELSE 'Complaint resolved - ' || code END AS subject,
        CASE template_key WHEN 'complaint_received' THEN '<p>Hello ' || citizen_name || ',</p><p>Your complaint <strong>' || code
            || '</strong> has been received.</p><p>Category: ' || category || ', location: ' || location || ', priority: ' || priority
            || ', estimated resolution: ' || eta_hours || ' hours</p><p><a href="">Track Complaint</a></p>'
          WHEN 'complaint_assigned' THEN 'Dear ' || citizen_name || ''
          WHEN 'complaint_in_progress' THEN '<p>Hello ' || citizen_name || ', work has started for complaint ' || code || '.</p>'
          ELSE '<p>Hello ' || citizen_name || ', complaint ' || code || ' is marked resolved. Please verify and share feedback.</p>' END AS html FROM n2""",
    ),
)
def n07(r):
    own = [
        ("complaint_assigned", "Officer {{officer_name}} has {{ complaint_code }}", "Dear {{user_name}}{{nothing}}", 1),
        ("complaint_resolved", "old text", "old text", 0),
    ]
    templates = r.values(own, "template_key, subject_template, html_template, is_active")
    return N.render(context(r), templates, CONTEXT).select("event_id", "subject", "html")


OUTCOMES = """res AS (SELECT event_id AS queue_id, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 'mail "box" \\ full' || chr(10) || 'x' END AS error,
          event_id % 6 AS attempts, 5 AS max_attempts, user_id FROM events)"""


def _outcomes(r):
    q = r.t["events"].select(
        F.col("event_id").alias("queue_id"),
        "user_id",
        F.col("event_id").alias("request_id"),
        F.lit("complaint_received").alias("template_key"),
        (F.col("event_id") % 6).alias("attempts"),
        F.lit(5).alias("max_attempts"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.org")).alias("recipient"),
        F.concat(F.lit("About "), F.col("event_id").cast("string")).alias("subject"),
    )
    failed = F.col("event_type") == "error"
    results = r.t["events"].select(
        F.col("event_id").alias("queue_id"), (~failed).alias("ok"), F.when(failed, F.lit('mail "box" \\ full\nx')).alias("error")
    )
    return N.apply_outcomes(q, results, NOW)


@query(
    "n08_apply_outcomes",
    f"""WITH {OUTCOMES} SELECT queue_id, CASE WHEN ok THEN 'sent' WHEN attempts + 1 >= max_attempts THEN 'failed' ELSE 'queued' END AS status,
      attempts + 1 AS attempts, CASE WHEN ok THEN {S_NOW} END AS sent_at, error AS last_error FROM res""",
)
def n08(r):
    return _outcomes(r)[0].select("queue_id", "status", "attempts", "sent_at", "last_error")


@query(
    "n08_delivery_log",
    f"""WITH {OUTCOMES} SELECT queue_id, CASE WHEN ok THEN 'sent' ELSE 'failed' END AS delivery_status, {S_NOW} AS event_at,
      'u' || user_id || '@example.org' AS recipient, 'About ' || queue_id AS subject,
      CASE WHEN NOT ok THEN '{{"error":"mail \\"box\\" \\\\ full\\nx"}}' END AS metadata_json FROM res""",
)
def n08_log(r):
    return _outcomes(r)[1].select("queue_id", "delivery_status", "event_at", "recipient", "subject", "metadata_json")


@query(
    "n09_cap_frequency",
    """WITH n AS (SELECT user_id, event_id AS queue_id, ts, CASE WHEN event_type = 'error' THEN 'critical' ELSE 'normal' END AS priority FROM events),
      k AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, queue_id) AS rn FROM n WHERE priority <> 'critical')
      SELECT queue_id, CASE WHEN rn <= 2 THEN 'immediate' ELSE 'digest' END AS delivery,
        CASE WHEN rn <= 2 THEN ts ELSE date_trunc('day', ts) + INTERVAL 32 HOUR END AS send_at FROM k
      UNION ALL SELECT queue_id, 'immediate', ts FROM n WHERE priority = 'critical'""",
)
def n09(r):
    rows = r.t["events"].select(
        "user_id",
        F.col("event_id").alias("queue_id"),
        F.col("ts").alias("scheduled_at"),
        F.when(F.col("event_type") == "error", "critical").otherwise("normal").alias("priority"),
    )
    return N.cap_frequency(rows).select("queue_id", "delivery", "send_at")


@query(
    "n10_choose_channels",
    """WITH n AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium'
        ELSE 'low' END AS level FROM events),
      c AS (SELECT * FROM (VALUES ('critical','push'),('critical','sms'),('high','push'),('high','email'),('medium','push'),('low','email_digest')) v(level, channel))
      SELECT event_id, channel FROM n JOIN c ON n.level = c.level
      WHERE NOT (channel = 'sms' AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))
        AND NOT (channel = 'email' AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 8000))""",
)
def n10(r):
    levels = {"error": "critical", "purchase": "high", "signup": "medium", "click": "low"}
    rows = r.t["events"].select("user_id", "event_id", map_value("event_type", levels).alias("level"))
    off = F.when(F.col("c_acctbal") < 0, "sms").when(F.col("c_acctbal") > 8000, "email")
    disabled = r.t["customer"].select(F.col("c_custkey").alias("user_id"), off.alias("channel")).filter("channel IS NOT NULL")
    return N.choose_channels(rows, disabled).select("event_id", "channel")


@query(
    "n11_peak_hour",
    """WITH h AS (SELECT user_id, hour(ts) AS h, count(*) AS n FROM events GROUP BY ALL)
      SELECT user_id, CAST(h AS INTEGER) AS peak_hour, n AS opens, CAST(sum(n) OVER (PARTITION BY user_id) AS BIGINT) AS total FROM h
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, h) = 1""",
)
def n11(r):
    return N.peak_hour(r.t["events"].select("user_id", F.col("ts").alias("opened_at")))
