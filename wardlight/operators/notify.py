"""Notification planning as table work: who gets which message when, and what came of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.functions.columns import as_of_ts, cut_template, fill_cut, map_value
from wardlight.functions.measures import n_rows
from wardlight.operators.joins import with_actor_names
from wardlight.operators.windows import flag_first, join_null_safe
from wardlight.sources.tables import insert_ignore, latest_per_key

# Template per new status; a submission gives `complaint_received`.
STATUS_TEMPLATE = {
    "submitted": "complaint_received",
    "assigned": "complaint_assigned",
    "in_progress": "complaint_in_progress",
    "resolved": "complaint_resolved",
}

# Default subject and body per template.
DEFAULT_TEMPLATES = {
    "complaint_received": (
        "Complaint Received - {{complaint_code}}",
        "<p>Hello {{user_name}},</p><p>Your complaint <strong>{{complaint_code}}</strong> has been received.</p>"
        "<p>Category: {{category}}, location: {{location}}, priority: {{priority}}, "
        "estimated resolution: {{eta_hours}} hours</p><p><a href=\"{{tracking_url}}\">Track Complaint</a></p>",
    ),
    "complaint_assigned": (
        "Your complaint is now being handled - {{complaint_code}}",
        "<p>Hello {{user_name}}, complaint {{complaint_code}} is now assigned to {{officer_name}}.</p>",
    ),
    "complaint_in_progress": (
        "Work started on your complaint - {{complaint_code}}",
        "<p>Hello {{user_name}}, work has started for complaint {{complaint_code}}.</p>",
    ),
    "complaint_resolved": (
        "Complaint resolved - {{complaint_code}}",
        "<p>Hello {{user_name}}, complaint {{complaint_code}} is marked resolved. Please verify and share feedback.</p>",
    ),
    "reminder_pending_48h": (
        "Status reminder - {{complaint_code}}",
        "<p>Hello {{user_name}}, we have not forgotten your complaint {{complaint_code}}.</p>",
    ),
    "reminder_feedback": (
        "How did we do? - {{complaint_code}}",
        "<p>Hello {{user_name}}, please rate your resolution experience for {{complaint_code}}.</p>",
    ),
}
# Preference defaults, estimated hours and retry limit.
PREFERENCE_DEFAULTS = {"preferred_hour": 9, "quiet_hours_enabled": 1, "quiet_start_hour": 22, "quiet_end_hour": 7}
ETA_CRITICAL, ETA_OTHER = 24, 72
MAX_ATTEMPTS = 5


def notifications_for(events: DataFrame) -> DataFrame:
    """Status events that a citizen hears of, with their template."""
    return events.withColumn("template_key", map_value("new_status", STATUS_TEMPLATE)).filter(
        F.col("template_key").isNotNull()
    )


def notification_context(n: DataFrame, r: DataFrame, usr, cat, loc, pri) -> DataFrame:
    """Notifications with what their templates need."""
    facts = r.select("request_id", "code", "status", "priority_id", "user_id", "assigned_to", "cat_id", "location_id")
    joined = with_actor_names(n.join(facts, "request_id"), usr)
    named = (
        joined.join(cat.select("cat_id", F.col("cat_name").alias("category")), "cat_id")
        .join(loc.select("location_id", F.col("area_name").alias("location")), "location_id")
        .join(pri.select("priority_id", F.col("priority_name").alias("priority")), "priority_id")
    )
    critical = F.col("priority_id") == 1
    return named.withColumns(
        {
            "is_critical": critical.cast("int"),
            "eta_hours": F.when(critical, ETA_CRITICAL).otherwise(ETA_OTHER),
        }
    )


def _at_hour(now: Column, hour: Column) -> Column:
    """The next moment after `now` at a full hour of the day."""
    midnight = F.date_trunc("day", now).cast("timestamp_ntz")
    at = midnight + F.make_dt_interval(F.lit(0), hour)
    return F.when(at <= now, at + F.expr("INTERVAL 1 DAY")).otherwise(at)


def in_quiet_hours(hour: Column, start: Column, end: Column) -> Column:
    """Whether an hour lies in [start, end), for windows that wrap midnight and ones that do not."""
    inside = (hour >= start) & (hour < end)
    wrapped = (hour >= start) | (hour < end)
    return F.when(start <= end, inside).otherwise(wrapped)


def schedule(n: DataFrame, prefs: DataFrame, now, force: Column | None = None) -> DataFrame:
    """Send time: at once when forced or critical, else at the next preferred hour; a
    notification made in quiet hours waits for their end. NULL preferences take defaults."""
    moment = now if isinstance(now, Column) else as_of_ts(now)
    wanted = prefs.select("user_id", *PREFERENCE_DEFAULTS)
    out = n.join(wanted, "user_id", "left")
    preferred, enabled, start, end = (F.coalesce(c, F.lit(d)) for c, d in PREFERENCE_DEFAULTS.items())
    at_once = F.col("is_critical") == 1
    if force is not None:
        at_once = at_once | force
    quiet = (enabled == 1) & in_quiet_hours(F.hour(moment), start, end)
    send_at = F.when(at_once, moment).when(quiet, _at_hour(moment, end)).otherwise(_at_hour(moment, preferred))
    return out.withColumn("scheduled_at", send_at.cast("timestamp_ntz")).drop(*PREFERENCE_DEFAULTS)


def enqueue(n: DataFrame) -> DataFrame:
    """Queue rows for scheduled notifications."""
    key = F.concat_ws(
        ":",
        F.col("request_id").cast("string"),
        "template_key",
        F.coalesce("status", F.lit("pending")),
        F.date_format("scheduled_at", "yyyyMMddHH"),
    )
    payload = F.to_json(F.struct("template_key", "eta_hours"))
    return n.select(
        "user_id",
        "request_id",
        "template_key",
        F.when(F.col("is_critical") == 1, "critical").otherwise("normal").alias("priority"),
        F.lit("queued").alias("status"),
        "scheduled_at",
        payload.alias("payload_json"),
        key.alias("idempotency_key"),
    )


def dedupe_queue(q: DataFrame, order: list | None = None) -> DataFrame:
    """One queue row per idempotency key, the one with the newest schedule, then the largest by all columns."""
    first = order or ["scheduled_at"]
    return latest_per_key(q, ["idempotency_key"], [*first, *(c for c in q.columns if c not in first)])


def due_batch(q: DataFrame, now, n: int = 10, id_col: str = "queue_id") -> DataFrame:
    """The next n queued rows whose time has come: critical first, then oldest."""
    due = q.filter((F.col("status") == "queued") & (F.col("scheduled_at") <= as_of_ts(now)))
    return flag_first(due, F.col("priority") == "critical", "scheduled_at", id_col).limit(n)


def resolve_recipients(q: DataFrame, prefs: DataFrame, usr: DataFrame) -> DataFrame:
    """Recipient per queue row: preferred address, else the account's. Opted-out users only
    get the receipt; rows without an address fail."""
    wanted = prefs.select("user_id", "preferred_email", "opted_out")
    out = q.join(usr.select("user_id", "email"), "user_id", "left").join(wanted, "user_id", "left")
    refused = (F.coalesce("opted_out", F.lit(0)) == 1) & (F.col("template_key") != "complaint_received")
    recipient = F.coalesce(F.nullif("preferred_email", F.lit("")), F.nullif("email", F.lit("")))
    return out.withColumns(
        {
            "recipient": F.when(~refused, recipient),
            "status": F.when(refused, "cancelled").when(recipient.isNull(), "failed").otherwise("processing"),
            "last_error": F.when(refused, "User opted out").when(recipient.isNull(), "No recipient email"),
        }
    ).drop("preferred_email", "opted_out", "email")


def default_templates(spark) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("template_key"),
                F.lit(s).alias("subject_template"),
                F.lit(h).alias("html_template"),
                F.lit(1).alias("is_active"),
            )
            for k, (s, h) in DEFAULT_TEMPLATES.items()
        ]
    )
    return spark.range(1).select(F.inline(rows))


def ensure_templates(templates: DataFrame) -> DataFrame:
    """The template table with every missing default added."""
    return insert_ignore(templates, default_templates(templates.sparkSession), ["template_key"])


def render(q: DataFrame, templates: DataFrame, context: dict, spark=None) -> DataFrame:
    """Subject and body per queue row from its active template, else the default of its key,
    else the receipt. Templates are cut at their marks before the join, not once per message."""
    spark = spark or q.sparkSession
    cuts = cut_template("subject_template"), cut_template("html_template")
    found = F.col("subject_template").isNotNull().alias("_found")
    active = templates.filter("is_active = 1").select("template_key", found, cuts[0].alias("_subject"), cuts[1].alias("_html"))
    base = default_templates(spark).select("template_key", cuts[0].alias("_ds"), cuts[1].alias("_dh"))
    receipt_subject, receipt_html = (cut_template(F.lit(t)) for t in DEFAULT_TEMPLATES["complaint_received"])
    joined = q.join(active, "template_key", "left").join(base, "template_key", "left")
    subject = F.when(F.col("_found"), F.col("_subject")).otherwise(F.coalesce("_ds", receipt_subject))
    html = F.when(F.col("_found"), F.col("_html")).otherwise(F.coalesce("_dh", receipt_html))
    return joined.withColumns({"subject": fill_cut(subject, context), "html": fill_cut(html, context)}).drop(
        "_found", "_subject", "_html", "_ds", "_dh"
    )


def apply_outcomes(q: DataFrame, results: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Fold delivery results into the queue and give the delivery log.

    Sent rows are done; failed ones go back to the queue until `attempts + 1` reaches the
    limit. Results have one row per queue id; rows without a result stay as they are. Errors
    are kept whole, in the log as JSON. The log has the recipient and subject that `q` names.
    """
    moment = as_of_ts(now)
    given = results.select("queue_id", "ok", "error", F.lit(True).alias("_tried"))
    every = q.join(given, "queue_id", "left")
    joined = every.filter("_tried")
    last_try = (F.coalesce("attempts", F.lit(0)) + 1) >= F.coalesce("max_attempts", F.lit(MAX_ATTEMPTS))
    error = F.coalesce(F.nullif("error", F.lit("")), F.lit("send_failed"))
    tried = F.col("_tried").isNotNull()

    def new(column, value):
        return F.when(tried, value).otherwise(F.col(column) if column in q.columns else F.lit(None))

    state = every.withColumns(
        {
            "status": new("status", F.when(F.col("ok"), "sent").when(last_try, "failed").otherwise("queued")),
            "attempts": new("attempts", F.coalesce("attempts", F.lit(0)) + 1),
            "sent_at": new("sent_at", F.when(F.col("ok"), moment)),
            "last_error": new("last_error", F.when(~F.col("ok"), error)),
        }
    )
    given_error = F.col("error").isNotNull() & (F.col("error") != "")
    log = joined.select(
        "queue_id",
        "user_id",
        "request_id",
        "template_key",
        *(F.col(c) if c in q.columns else F.lit(None).cast("string").alias(c) for c in ("recipient", "subject")),
        F.when(F.col("ok"), "sent").otherwise("failed").alias("delivery_status"),
        moment.alias("event_at"),
        F.when(~F.col("ok") & given_error, F.to_json(F.struct("error"))).alias("metadata_json"),
    )
    return state.drop("ok", "error", "_tried"), log


def cap_frequency(n: DataFrame, per_day: int = 2, digest_hour: int = 8, id_col: str = "queue_id") -> DataFrame:
    """At most `per_day` non-critical notifications per user and day; the others go to the
    next digest. Critical ones are exempt; those without a time go out at once, unscheduled.

    The cut-off of a user's day is its per_day-th notification. Finding it keeps at most
    `per_day` rows per group from each partition, and rows are then compared with it, so a
    user with very many notifications is never gathered in one task.
    """
    day = F.to_date("scheduled_at")
    order = F.struct("scheduled_at", id_col)
    critical = F.col("priority").eqNullSafe("critical")
    plain = n.filter(~critical).withColumn("_day", day)
    w = W.partitionBy("user_id", "_day").orderBy("scheduled_at", id_col)
    firsts = plain.select("user_id", "_day", "scheduled_at", id_col, F.row_number().over(w).alias("_rn"))
    cut = firsts.filter(F.col("_rn") <= per_day).groupBy("user_id", "_day").agg(F.max(order).alias("_cut"))
    timed = F.col("scheduled_at").isNotNull()
    kept = join_null_safe(plain, cut, ["user_id", "_day"]).withColumn("_late", timed & (order > F.col("_cut")))
    digest_at = F.date_add("_day", 1).cast("timestamp_ntz") + F.expr(f"INTERVAL {digest_hour} HOUR")
    capped = kept.withColumns(
        {
            "delivery": F.when(F.col("_late"), "digest").otherwise("immediate"),
            "send_at": F.when(F.col("_late"), digest_at).otherwise(F.col("scheduled_at")),
        }
    ).drop("_day", "_cut", "_late")
    exempt = n.filter(critical).withColumns(
        {"delivery": F.lit("immediate"), "send_at": F.col("scheduled_at")}
    )
    return capped.unionByName(exempt)


# Channels per notification priority.
CHANNELS = {
    "critical": ["push", "sms"],
    "high": ["push", "email"],
    "medium": ["push"],
    "low": ["email_digest"],
}


def choose_channels(n: DataFrame, disabled: DataFrame, level: str = "level") -> DataFrame:
    """One row per notification and channel of its priority, without channels the user turned off.

    An unknown or missing priority is sent like a low one.
    """
    choice = None
    for name, channels in CHANNELS.items():
        arr = F.array(*[F.lit(c) for c in channels])
        cond = F.col(level) == name
        choice = F.when(cond, arr) if choice is None else choice.when(cond, arr)
    rows = n.withColumn("channel", F.explode(choice.otherwise(F.array(*[F.lit(c) for c in CHANNELS["low"]]))))
    return rows.join(disabled.select("user_id", "channel"), ["user_id", "channel"], "left_anti")


def peak_hour(log: DataFrame, ts: str = "opened_at") -> DataFrame:
    """The hour of the day at which a user is most active, the earliest of equals."""
    hours = log.groupBy("user_id", F.hour(ts).alias("hour")).agg(n_rows().alias("n"))
    best = F.max_by("hour", F.struct(F.col("n"), -F.col("hour")))
    return hours.groupBy("user_id").agg(best.alias("peak_hour"), F.max("n").alias("opens"), F.sum("n").alias("total"))
