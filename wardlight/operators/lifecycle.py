"""Request lifecycle: priorities, routing, hotspots, status events, feedback and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.columns import ago, map_value, to_meta
from wardlight.functions.measures import DONE, n_rows
from wardlight.operators.joins import age_hours
from wardlight.operators.requests import STATUSES
from wardlight.operators.windows import trailing_count
from wardlight.session import settle
from wardlight.sources.tables import RATING_REST, RATING_STEPS, by_hours, latest_per_key, split_rejects

# Priority level of each urgency.
URGENCY_PRIORITY = {"critical": 1, "high": 2, "medium": 3, "low": 4}


def frequency_priority(base: Column, freq: Column) -> Column:
    """10 or more recent twins: 1; 5 or more: one up; 2 or more: as is; fewer: one down."""
    return (
        F.when(freq >= 10, 1)
        .when(freq >= 5, F.greatest(F.lit(1), base - 1))
        .when(freq >= 2, base)
        .otherwise(F.least(F.lit(4), base + 1))
    )


def assign_priority(r: DataFrame, cat: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """Priority from the category default and the number of twins (same category and location).

    Without `as_of` a request's twins are those of the 30 days up to its own submission;
    with it, those of the 30 days before `as_of`, the request itself left out. A request of
    an unknown category stays, without a priority.
    """
    keys = ["cat_id", "location_id"]
    if as_of is None:
        counted = trailing_count(r, keys, "submitted_at", days, "frequency_30d")
    else:
        start = ago(as_of, days, "DAY")
        recent = r.filter(F.col("submitted_at") >= start).groupBy(*keys).agg(n_rows().alias("_n"))
        own = (F.col("submitted_at") >= start).cast("long")
        counted = r.join(settle(recent, "recent-twins"), keys, "left").withColumn("frequency_30d", F.coalesce("_n", F.lit(0)) - own).drop("_n")
    base = cat.select("cat_id", F.col("default_priority_id").alias("base_priority"))
    ranked = frequency_priority(F.col("base_priority"), F.col("frequency_30d"))
    return counted.join(base, "cat_id", "left").withColumn("priority_id", F.when(F.col("base_priority").isNotNull(), ranked))


def boost_priority(r: DataFrame) -> DataFrame:
    """Critical texts become priority 1, high ones at least 2; both are flagged as boosted."""
    urgency = F.col("urgency_level")
    raised = F.when(urgency == "critical", 1).when(urgency == "high", F.least("priority_id", F.lit(2)))
    return r.withColumns(
        {
            "priority_id": raised.otherwise(F.col("priority_id")),
            "auto_priority_boosted": F.when(urgency.isin("critical", "high"), 1).otherwise(0),
        }
    )


def sentiment_priority(r: DataFrame, cat: DataFrame) -> DataFrame:
    """The more urgent of the category default and the text's urgency; of an unknown category, the text's alone."""
    base = cat.select("cat_id", F.col("default_priority_id").alias("base_priority"))
    felt = map_value("urgency_level", URGENCY_PRIORITY, 4)
    return (
        r.join(base, "cat_id", "left")
        .withColumn("sentiment_priority", felt)
        .withColumns(
            {
                "priority_id": F.least("base_priority", "sentiment_priority"),
                "auto_priority_boosted": F.when(F.col("sentiment_priority") < F.col("base_priority"), 1).otherwise(0),
            }
        )
    )


def route_department(r: DataFrame, cat: DataFrame) -> DataFrame:
    routed = cat.select("cat_id", F.col("dept_id").alias("_dept"))
    return r.join(routed, "cat_id", "left").withColumn("dept_id", F.col("_dept")).drop("_dept")


def flag_hotspots(
    r: DataFrame, as_of, days: int = 30, threshold: int = 15, exclude_status=("closed", "rejected")
) -> tuple[DataFrame, DataFrame]:
    """Flag recent live requests of hotspot locations; the log has one row per location."""
    live = (F.col("submitted_at") >= ago(as_of, days, "DAY")) & ~F.col("status").isin(*exclude_status)
    hot = r.filter(live).groupBy("location_id").agg(n_rows().alias("request_count")).filter(
        F.col("request_count") >= threshold
    )
    hot = settle(hot, "hotspots")
    marked = r.join(hot.select("location_id", F.lit(1).alias("_hot")), "location_id", "left")
    flag = F.when(live & (F.col("_hot") == 1), 1).otherwise(F.col("is_hotspot_flag"))
    flagged = marked.withColumn("is_hotspot_flag", flag).drop("_hot")
    log = hot.select(
        F.lit("hotspot_detected").alias("log_type"),
        F.lit("location").alias("entity_type"),
        F.col("location_id").cast("long").alias("entity_id"),
        F.concat(
            F.lit("Hotspot detected: "), F.col("request_count").cast("string"), F.lit(f" complaints in {days} days")
        ).alias("message"),
        to_meta(complaint_count="request_count", window_days=F.lit(days)).alias("meta_json"),
    )
    return flagged, log


def status_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """One audit row per request whose status differs between two snapshots."""
    old = before.select("request_id", F.col("status").alias("old_status"))
    new = after.select(
        "request_id", F.col("status").alias("new_status"), F.coalesce("assigned_to", "user_id").alias("updated_by")
    )
    changed = old.join(new, "request_id").filter(F.col("old_status") != F.col("new_status"))
    remark = F.concat(F.lit("Status changed from "), F.col("old_status"), F.lit(" to "), F.col("new_status"))
    return changed.select("request_id", "updated_by", "old_status", "new_status", remark.alias("remarks"))


def apply_status_events(r: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold status events into the requests.

    The newest valid event sets the status; resolved, closed and assigned events also set
    their time, and assigned ones the officer (the acting user by default). Each request's
    events become one row by combinable aggregates. Returns (requests, rejected events);
    events of requests that do not exist are rejected, too.
    """
    reason = F.when(~F.col("new_status").isin(*STATUSES) | F.col("new_status").isNull(), "invalid status")
    named, rejected = split_rejects(events, reason)
    known = r.select("request_id")
    valid = named.join(known, "request_id", "left_semi")
    unknown = named.join(known, "request_id", "left_anti").withColumn("reject_reason", F.lit("unknown request"))
    rejected = rejected.unionByName(unknown.select(*rejected.columns))
    order = F.struct("event_at", "event_id")
    status = F.col("new_status")

    def last_at(name):
        return F.max(F.when(status == name, F.col("event_at")))

    officer = F.coalesce(F.col("assigned_to"), F.col("actor_id"))
    last = valid.groupBy("request_id").agg(
        F.max_by("new_status", order).alias("_status"),
        last_at("resolved").alias("_resolved"),
        last_at("closed").alias("_closed"),
        last_at("assigned").alias("_assigned"),
        F.max_by(officer, F.when(status == "assigned", order)).alias("_officer"),
    )
    joined = r.join(last, "request_id", "left")
    updates = {
        "status": F.coalesce("_status", "status"),
        "resolved_at": F.coalesce("_resolved", "resolved_at"),
        "assigned_at": F.coalesce("_assigned", "assigned_at"),
        "assigned_to": F.coalesce("_officer", "assigned_to"),
        "closed_at": F.coalesce("_closed", "closed_at") if "closed_at" in r.columns else F.col("_closed"),
    }
    return joined.withColumns(updates).drop("_status", "_resolved", "_closed", "_assigned", "_officer"), rejected


def sla_breaches(r: DataFrame, pri: DataFrame, as_of, closed_statuses=DONE) -> DataFrame:
    """Log rows for unfinished requests older than their SLA."""
    open_ones = r.filter(~F.col("status").isin(*closed_statuses)).join(pri.select("priority_id", "sla_hours"), "priority_id")
    late = open_ones.withColumn("elapsed_hours", age_hours(as_of)).filter(F.col("elapsed_hours") > F.col("sla_hours"))
    return late.select(
        F.lit("sla_breached").alias("log_type"),
        F.lit("complaint").alias("entity_type"),
        F.col("request_id").alias("entity_id"),
        F.concat(F.lit("SLA breached for complaint "), F.col("code")).alias("message"),
        to_meta(sla_hours="sla_hours", elapsed_hours="elapsed_hours").alias("meta_json"),
    )


def priority_log(assigned: DataFrame) -> DataFrame:
    """Log rows of `assign_priority`."""
    return assigned.select(
        F.lit("priority_assigned").alias("log_type"),
        F.lit("complaint").alias("entity_type"),
        F.col("request_id").alias("entity_id"),
        F.concat(F.lit("Auto priority assigned: level "), F.col("priority_id").cast("string")).alias("message"),
        to_meta(base_priority="base_priority", frequency_30d="frequency_30d", final_priority="priority_id").alias(
            "meta_json"
        ),
    )


def analytics_log(*logs: DataFrame) -> DataFrame:
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out


def ai_log(r: DataFrame) -> DataFrame:
    """Log rows for requests that carry a suggested category."""
    share = F.format_string("%.2f", F.col("ai_confidence_score").cast("double") * 100)
    text = F.concat(F.lit("AI suggested: "), F.col("ai_suggested_category"), F.lit(" ("), share, F.lit("%)"))
    return r.filter(F.col("ai_suggested_category").isNotNull()).select(
        F.lit("ai_categorized").alias("log_type"),
        F.lit("complaint").alias("entity_type"),
        F.col("request_id").alias("entity_id"),
        text.alias("message"),
        F.lit(None).cast("string").alias("meta_json"),
    )


def ingest_feedback(fb: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validated feedback, newest per request. Ratings default to 3; 3 and more is satisfied."""
    rated = fb.withColumn("rating", F.coalesce(F.expr("try_cast(rating AS int)"), F.lit(3)))
    ok, bad = split_rejects(rated, F.when(~F.col("rating").between(1, 5), "rating must be 1-5"))
    newest = latest_per_key(ok, ["request_id"], ["submitted_at", "feedback_id"])
    return newest.withColumn("is_satisfied", F.when(F.col("rating") >= 3, 1).otherwise(0)), bad


def rating_from_hours(r: DataFrame, limits: tuple = (24, 48, 72)) -> DataFrame:
    steps = [(limit, rating, text) for limit, (_, rating, text) in zip(limits, RATING_STEPS)]
    rating = by_hours(F.col("resolution_hours"), steps, RATING_REST, 1)
    return r.withColumn("rating", F.when(F.col("resolution_hours").isNotNull(), rating))
