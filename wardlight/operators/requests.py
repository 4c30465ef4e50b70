"""Request analytics: dashboard reports, worklists, views and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.functions.columns import ago, as_of_ts, iso_yearweek, micros, month_label, pct_change_of, week_label
from wardlight.functions.measures import DONE, OPEN, avg_where, count_where, is_done, n_rows, pct, pct_of_total, stat, status_is
from wardlight.operators.filters import filter_requests, trailing
from wardlight.operators.joins import age_hours, category_join, dim_left_agg, enrich_requests, is_breached
from wardlight.operators.windows import dense_periods, ordered_position, page, pct_change, rolling

LOC_COLS = ["location_id", "ward_number", "area_name", "zone", "latitude", "longitude"]


def location_summary(r: DataFrame, loc: DataFrame, as_of, hotspot_threshold: int = 15) -> DataFrame:
    recent = F.col("submitted_at") >= ago(as_of, 30, "DAY")
    counts = {
        "total_requests": n_rows(),
        "pending": count_where(status_is("pending")),
        "in_progress": count_where(status_is("in_progress")),
        "resolved": count_where(is_done()),
        "last_30_days": count_where(recent),
    }
    out = dim_left_agg(loc.select(*LOC_COLS), r, "location_id", counts, list(counts))
    return out.withColumns(
        {
            "daily_avg_30d": F.round(F.col("last_30_days") / F.lit(30.0), 1),
            "is_hotspot": F.when(F.col("last_30_days") >= hotspot_threshold, 1).otherwise(0),
        }
    ).orderBy(F.col("total_requests").desc(), "location_id")


def category_summary(r: DataFrame, cat: DataFrame, dept: DataFrame) -> DataFrame:
    aggs = {
        "total": n_rows(),
        "pending": count_where(status_is("pending")),
        "resolved": count_where(is_done()),
        "avg_resolution_hrs": stat("resolution_hours", "avg", 2),
    }
    base = category_join(cat.select("cat_id", "cat_name", "icon_class", "dept_id"), r, dept, aggs, ("total", "pending", "resolved"))
    return pct_of_total(base, "total").drop("dept_id").orderBy(F.col("total").desc(), "cat_id")


def _by_month(r: DataFrame, aggs: dict) -> DataFrame:
    """Group by the truncated date and format the label once per month, not per row."""
    grouped = r.groupBy(F.trunc("submitted_at", "MM").alias("_m")).agg(*[a.alias(n) for n, a in aggs.items()])
    return grouped.withColumn("month", F.date_format("_m", "yyyy-MM")).withColumn("month_label", month_label("_m")).drop("_m")


def monthly_trend(r: DataFrame) -> DataFrame:
    aggs = {
        "total_submitted": n_rows(),
        "resolved": count_where(is_done()),
        "pending": count_where(status_is("pending")),
        "critical": count_where(F.col("priority_id") == 1),
        "high": count_where(F.col("priority_id") == 2),
        "avg_resolution_hrs": stat("resolution_hours", "avg", 2),
    }
    return _by_month(r, aggs).withColumn("resolution_rate_pct", pct("resolved", "total_submitted")).orderBy("month")


def monthly_trend_last(r: DataFrame, months: int = 12) -> DataFrame:
    newest = monthly_trend(r).select(
        "month",
        "month_label",
        F.col("total_submitted").alias("total"),
        "resolved",
        "pending",
        "critical",
        F.round("avg_resolution_hrs", 1).alias("avg_hrs"),
    )
    return newest.orderBy(F.col("month").desc()).limit(months).orderBy("month")


def department_performance(r: DataFrame, dept: DataFrame, pri: DataFrame) -> DataFrame:
    in_time = is_done() & (F.col("resolution_hours") <= F.col("sla_hours"))
    aggs = {
        "total_assigned": n_rows(),
        "resolved": count_where(is_done()),
        "pending": count_where(status_is("pending")),
        "in_progress": count_where(status_is("in_progress")),
        "avg_resolution_hrs": F.round(avg_where(is_done(), "resolution_hours"), 1),
        "within_sla": count_where(in_time),
    }
    zero = ("total_assigned", "resolved", "pending", "in_progress", "within_sla")
    rated = r.join(pri.select("priority_id", "sla_hours"), "priority_id", "left")
    out = dim_left_agg(dept.select("dept_id", "dept_name", "dept_code", "head_name"), rated, "dept_id", aggs, zero)
    return out.withColumns(
        {
            "resolution_rate_pct": pct("resolved", "total_assigned"),
            "sla_compliance_pct": pct("within_sla", "resolved"),
        }
    ).orderBy(F.col("resolution_rate_pct").desc(), "dept_id")


def sla_compliance(r: DataFrame, pri: DataFrame) -> DataFrame:
    """Counts per (priority, SLA) come from one aggregate; the dimension is joined to it after."""
    closed = r.filter(is_done() & F.col("resolution_hours").isNotNull())
    sla = pri.select("priority_id", "sla_hours")
    hours = F.col("resolution_hours")
    summary = (
        closed.join(sla, "priority_id")
        .groupBy("priority_id")
        .agg(
            n_rows().alias("total_requests"),
            stat(hours, "avg", 2).alias("avg_actual_hours"),
            stat(hours, "min", 2).alias("min_hours"),
            stat(hours, "max", 2).alias("max_hours"),
            count_where(hours <= F.col("sla_hours")).alias("within_sla"),
            count_where(hours > F.col("sla_hours")).alias("breached_sla"),
        )
    )
    return (
        pri.select("priority_id", "priority_name", "priority_level", F.col("sla_hours").alias("sla_target_hours"))
        .join(summary, "priority_id")
        .withColumn("sla_compliance_pct", pct("within_sla", "total_requests"))
        .orderBy("priority_level")
    )


def urgent_backlog(r, cat, loc, dept, pri, as_of, k: int = 50, ok_text: str = "WITHIN SLA", id_col="request_id") -> DataFrame:
    """Open priority 1 and 2 requests, most urgent and oldest first."""
    waiting = r.filter(status_is(*OPEN) & F.col("priority_id").isin(1, 2))
    age = age_hours(as_of)
    out = enrich_requests(waiting, cat, loc, dept, pri).select(
        id_col,
        "code",
        "title",
        "status",
        "priority_level",
        "priority_name",
        "color_code",
        "cat_name",
        "area_name",
        "ward_number",
        "dept_name",
        age.alias("age_hours"),
        "sla_hours",
        F.when(age > F.col("sla_hours"), "BREACHED").otherwise(ok_text).alias("sla_status"),
        (age - F.col("sla_hours")).alias("hours_overdue"),
        "submitted_at",
    )
    return out.orderBy("priority_level", F.col("age_hours").desc(), id_col).limit(k)


def hotspots(r, loc, cat, as_of, days: int = 30, threshold: int = 15, exclude_status=()) -> DataFrame:
    """Locations with at least `threshold` recent requests.

    One pass counts per (location, category); the location totals and the list of category
    names both come from that small table.
    """
    recent = trailing(r, "submitted_at", as_of, f"{days} days")
    if exclude_status:
        recent = recent.filter(~F.col("status").isin(*exclude_status))
    cells = recent.groupBy("location_id", "cat_id").agg(
        n_rows().alias("n"),
        count_where(F.col("priority_id").isin(1, 2)).alias("high"),
        count_where(status_is("pending")).alias("open"),
    )
    named = cells.join(cat.select("cat_id", "cat_name"), "cat_id")
    totals = named.groupBy("location_id").agg(
        F.sum("n").alias("total_30d"),
        F.array_join(F.sort_array(F.collect_set("cat_name")), ", ").alias("top_categories"),
        F.sum("high").alias("high_priority_count"),
        F.sum("open").alias("unresolved_count"),
    )
    return (
        loc.select(*LOC_COLS)
        .join(totals.filter(F.col("total_30d") >= threshold), "location_id")
        .withColumn("zone_status", F.lit("HOTSPOT"))
        .orderBy(F.col("total_30d").desc(), "location_id")
    )


def kpi_summary(r: DataFrame, as_of) -> DataFrame:
    submitted = F.col("submitted_at")
    return r.agg(
        n_rows().alias("total_requests"),
        count_where(status_is("pending")).alias("total_pending"),
        count_where(status_is("in_progress")).alias("total_in_progress"),
        count_where(is_done()).alias("total_resolved"),
        count_where(F.col("priority_id") == 1).alias("total_critical"),
        count_where(F.col("is_hotspot_flag") == 1).alias("total_hotspot"),
        stat("resolution_hours", "avg", 1).alias("avg_resolution_hrs"),
        count_where(submitted >= ago(as_of, 24, "HOUR")).alias("new_today"),
        count_where(submitted >= ago(as_of, 7, "DAY")).alias("new_this_week"),
    ).withColumn("overall_resolution_pct", pct("total_resolved", "total_requests"))


def user_tracker(r, cat, loc, dept, pri, fb, as_of, user_id=None) -> DataFrame:
    """Each request with its feedback. Sorted newest first for one user; whole-table runs stay unsorted."""
    rows = r if user_id is None else r.filter(F.col("user_id") == user_id)
    rated = fb.select("request_id", "rating", F.col("comment").alias("feedback_comment"))
    out = (
        enrich_requests(rows, cat, loc, dept, pri)
        .join(rated, "request_id", "left")
        .select(
            "request_id",
            "user_id",
            "code",
            "title",
            "status",
            "cat_name",
            "area_name",
            "priority_name",
            "color_code",
            "submitted_at",
            "resolved_at",
            "resolution_hours",
            "dept_name",
            age_hours(as_of).alias("age_hours"),
            "rating",
            "feedback_comment",
        )
    )
    return out if user_id is None else out.orderBy(F.col("submitted_at").desc(), "request_id")


def weekly_resolution(r: DataFrame, as_of, weeks: int = 12) -> DataFrame:
    """Resolution rate per ISO week; grouped by the Monday, labelled after."""
    recent = trailing(r, "submitted_at", as_of, f"{weeks} weeks")
    per_week = recent.groupBy(F.date_trunc("week", "submitted_at").alias("_week")).agg(
        F.min("submitted_at").alias("_first"), n_rows().alias("submitted"), count_where(is_done()).alias("resolved")
    )
    return per_week.select(
        iso_yearweek("_week").alias("year_week"),
        week_label("_first").alias("week_label"),
        "submitted",
        "resolved",
        pct("resolved", "submitted").alias("resolution_rate_pct"),
    ).orderBy("year_week")


def recurring_issues(r, cat, loc, dept, as_of, days: int = 90, min_count: int = 3, k: int = 20) -> DataFrame:
    recent = trailing(r, "submitted_at", as_of, f"{days} days")
    cells = (
        recent.groupBy("cat_id", "location_id", "dept_id")
        .agg(
            n_rows().alias("occurrence_count"),
            count_where(status_is("pending")).alias("still_pending"),
            stat("resolution_hours", "avg", 1).alias("avg_resolution_hrs"),
        )
        .filter(F.col("occurrence_count") >= min_count)
    )
    named = enrich_requests(cells, cat, loc, dept)
    return named.select(
        "cat_id",
        "location_id",
        "cat_name",
        "area_name",
        "ward_number",
        "dept_name",
        "occurrence_count",
        "still_pending",
        "avg_resolution_hrs",
    ).orderBy(F.col("occurrence_count").desc(), "cat_id", "location_id", "dept_name").limit(k)


def satisfaction(r: DataFrame, dept: DataFrame, fb: DataFrame) -> DataFrame:
    """Feedback per department. Feedback has one row per request, so the join does not fan out."""
    rated = r.select("request_id", "dept_id").join(fb.select("request_id", "rating"), "request_id")
    summary = rated.groupBy("dept_id").agg(
        n_rows().alias("total_feedback"),
        stat("rating", "avg", 2).alias("avg_rating"),
        count_where(F.col("rating") >= 4).alias("satisfied"),
        count_where(F.col("rating") <= 2).alias("dissatisfied"),
    )
    return (
        dept.select("dept_id", "dept_name")
        .join(summary, "dept_id")
        .withColumn("satisfaction_pct", pct("satisfied", "total_feedback"))
        .orderBy(F.col("avg_rating").desc(), "dept_id")
    )


def request_detail(r, usr, cat, loc, dept, pri, as_of, closed_statuses=DONE) -> DataFrame:
    out = enrich_requests(r, cat, loc, dept, pri, usr)
    return out.select(
        "request_id",
        "code",
        "title",
        "status",
        "submitted_at",
        "resolved_at",
        "resolution_hours",
        "is_hotspot_flag",
        "citizen_name",
        F.col("cat_name").alias("category"),
        "icon_class",
        "area_name",
        "ward_number",
        "zone",
        F.col("dept_name").alias("department"),
        "dept_code",
        "priority_name",
        "priority_level",
        F.col("color_code").alias("priority_color"),
        "sla_hours",
        is_breached(as_of, closed_statuses).alias("is_sla_breached"),
        age_hours(as_of).alias("age_hours"),
    )


def location_hotspot_view(r: DataFrame, loc: DataFrame, as_of, threshold: int = 15) -> DataFrame:
    recent = F.col("submitted_at") >= ago(as_of, 30, "DAY")
    aggs = {
        "total_requests": n_rows(),
        "pending_count": count_where(status_is("pending")),
        "resolved_count": count_where(status_is("resolved")),
        "avg_resolution_hours": stat("resolution_hours", "avg", 2),
        "requests_last_30d": count_where(recent),
    }
    zero = [n for n in aggs if not n.startswith("avg")]
    out = dim_left_agg(loc.select(*LOC_COLS), r, "location_id", aggs, zero)
    return out.withColumn("is_hotspot", F.when(F.col("requests_last_30d") >= threshold, 1).otherwise(0))


def department_view(r: DataFrame, dept: DataFrame) -> DataFrame:
    aggs = {
        "total_assigned": n_rows(),
        "resolved_count": count_where(is_done()),
        "pending_count": count_where(status_is("pending")),
        "in_progress_count": count_where(status_is("in_progress")),
        "avg_resolution_hours": F.round(avg_where(is_done(), "resolution_hours"), 2),
    }
    zero = [n for n in aggs if not n.startswith("avg")]
    out = dim_left_agg(dept.select("dept_id", "dept_name", "dept_code"), r, "dept_id", aggs, zero)
    return out.withColumn("resolution_rate_pct", pct("resolved_count", "total_assigned"))


def monthly_view(r: DataFrame) -> DataFrame:
    aggs = {
        "total_requests": n_rows(),
        "resolved": count_where(is_done()),
        "pending": count_where(status_is("pending")),
        "avg_resolution_hours": stat("resolution_hours", "avg", 2),
    }
    return _by_month(r, aggs).drop("month_label").orderBy("month")


def request_page(
    r, usr, cat, loc, dept, pri, as_of, page_no: int = 1, limit: int = 20, complete=None, **filters
) -> DataFrame:
    """One page, newest first, with the filtered total and page count on each row.

    The page is cut from the fact before any dimension is joined, so only `limit` rows meet
    the dimensions. Requests always have their dimension rows (D02 checks it). `complete`
    adds what is costly to derive to the rows of the page only.
    """
    chosen = filter_requests(r, **filters)
    total = chosen.agg(n_rows().alias("total"))
    rows = page(chosen, [F.col("submitted_at").desc(), F.col("request_id")], page_no, limit)
    rows = complete(rows) if complete else rows
    out = request_detail(rows, usr, cat, loc, dept, pri, as_of)
    return (
        out.withColumn("total", total.scalar())
        .withColumn("page", F.lit(page_no))
        .withColumn("pages", F.ceil(F.col("total") / limit))
        .orderBy(F.col("submitted_at").desc(), "request_id")
    )


def category_counts(r: DataFrame, cat: DataFrame) -> DataFrame:
    counts = r.groupBy("cat_id").agg(n_rows().alias("total"))
    return cat.select("cat_id", "cat_name").join(counts, "cat_id").orderBy(F.col("total").desc(), "cat_id")


def priority_resolution(r: DataFrame, pri: DataFrame) -> DataFrame:
    sums = r.groupBy("priority_id").agg(n_rows().alias("total"), stat("resolution_hours", "avg", 2).alias("avg_hours"))
    return pri.select("priority_id", "priority_name", "priority_level").join(sums, "priority_id").orderBy("priority_level")


def overview(r: DataFrame, as_of, users: DataFrame | None = None, incidents: DataFrame | None = None) -> DataFrame:
    """Table totals and requests resolved since midnight of `as_of`."""
    today = as_of_ts(as_of).cast("date").cast("timestamp_ntz")
    out = r.agg(n_rows().alias("total_requests"), count_where(F.col("resolved_at") >= today).alias("resolved_today"))
    for name, df in (("total_users", users), ("total_incidents", incidents)):
        if df is not None:
            out = out.withColumn(name, df.agg(n_rows()).scalar())
    return out


def kpi_compare(r: DataFrame, as_of) -> DataFrame:
    """This month against last month with percent change, and daily counts of the last 7 days."""
    now = as_of_ts(as_of)
    this = F.trunc(now, "MM").cast("timestamp_ntz")
    last = F.add_months(F.trunc(now, "MM"), -1).cast("timestamp_ntz")
    week = F.date_sub(now.cast("date"), 6).cast("timestamp_ntz")
    submitted = F.col("submitted_at")
    scan = r.filter((submitted >= F.least(last, week)) & (submitted <= now))
    current, previous = submitted >= this, (submitted >= last) & (submitted < this)
    aggs = []
    for tag, cond in (("current", current), ("previous", previous)):
        aggs += [
            count_where(cond).alias(f"total_{tag}"),
            count_where(cond & status_is("pending")).alias(f"pending_{tag}"),
            count_where(cond & is_done()).alias(f"resolved_{tag}"),
            F.round(avg_where(cond, "resolution_hours"), 1).alias(f"avg_hours_{tag}"),
        ]
    for back in range(6, -1, -1):
        on_day = submitted.cast("date") == F.date_sub(now.cast("date"), back)
        aggs.append(count_where(on_day).alias(f"_d{back}"))
    out = scan.agg(*aggs)
    for name in ("total", "pending", "resolved", "avg_hours"):
        out = out.withColumn(f"{name}_change_pct", pct_change_of(f"{name}_current", f"{name}_previous"))
    days = [F.col(f"_d{b}") for b in range(6, -1, -1)]
    spark_line = F.array_join(F.array(*[d.cast("string") for d in days]), ",")
    return out.withColumn("daily_7d", spark_line).drop(*[f"_d{b}" for b in range(7)])


def rolling_trend(r: DataFrame, pri: DataFrame, days: int = 30) -> DataFrame:
    """Per submission day: count, rolling sum and mean over `days`, and SLA share of the resolved."""
    rated = r.join(pri.select("priority_id", "sla_hours"), "priority_id")
    hours = F.col("resolution_hours")
    daily = rated.groupBy(F.col("submitted_at").cast("date").alias("day")).agg(
        n_rows().alias("n"),
        count_where(is_done() & hours.isNotNull()).alias("n_timed"),
        count_where(is_done() & (hours <= F.col("sla_hours"))).alias("n_in_time"),
    )
    daily = daily.withColumn("sla_pct", pct("n_in_time", "n_timed")).drop("n_timed", "n_in_time")
    out = rolling(daily, days)
    return out.withColumn("rolling_avg_n", F.round("rolling_avg_n", 4)).orderBy("day")


def top_n_other(df: DataFrame, key: str, n: int = 5, count_col: str = "total") -> DataFrame:
    """The n most frequent keys and one 'Others' row.

    The top n of the per-key counts is a `TakeOrderedAndProject`; counts of all other keys
    are found by a left join to those n rows.
    """
    counts = df.groupBy(key).agg(n_rows().alias(count_col))
    best = counts.orderBy(F.col(count_col).desc(), key).limit(n).select(F.col(key), F.lit(1).alias("_top"))
    label = F.when(F.col("_top") == 1, F.col(key).cast("string")).otherwise("Others")
    return counts.join(best, key, "left").groupBy(label.alias(key)).agg(F.sum(count_col).alias(count_col))


# The request statuses.
STATUSES = ["pending", "assigned", "in_progress", "resolved", "closed", "rejected"]


def priority_status_matrix(r: DataFrame, pri: DataFrame) -> DataFrame:
    aggs = {s: count_where(status_is(s)) for s in STATUSES}
    return dim_left_agg(pri.select("priority_id", "priority_name"), r, "priority_id", aggs, STATUSES)


def dept_week_heat(r: DataFrame, dept: DataFrame) -> DataFrame:
    cells = r.groupBy("dept_id", F.date_trunc("week", "submitted_at").alias("_week")).agg(
        n_rows().alias("n"), stat("resolution_hours", "avg", 2).alias("avg_hours")
    )
    named = cells.join(dept.select("dept_id", "dept_name"), "dept_id")
    return named.select("dept_id", "dept_name", iso_yearweek("_week").alias("year_week"), "n", "avg_hours")


def officer_category_avg(r: DataFrame) -> DataFrame:
    handled = r.filter(is_done() & F.col("assigned_to").isNotNull() & F.col("resolution_hours").isNotNull())
    return handled.groupBy("assigned_to", "cat_id").agg(
        n_rows().alias("n"), stat("resolution_hours", "avg", 2).alias("avg_hours")
    )


def sla_at_risk(r: DataFrame, pri: DataFrame, as_of, hours: int = 3, closed_statuses=DONE) -> DataFrame:
    """Unfinished requests whose SLA ends within the next `hours`, still in time at `as_of`."""
    open_ones = r.filter(~F.col("status").isin(*closed_statuses)).join(pri.select("priority_id", "sla_hours"), "priority_id")
    left_micros = micros("submitted_at") + F.col("sla_hours") * 3_600_000_000 - micros(as_of_ts(as_of))
    timed = open_ones.withColumn("hours_left", F.round(left_micros / 3_600_000_000, 2))
    chosen = timed.filter(left_micros.between(0, hours * 3_600_000_000))
    return chosen.select("request_id", "priority_id", "status", "submitted_at", "sla_hours", "hours_left")


def wow_trend(r: DataFrame, as_of, weeks: int = 8) -> DataFrame:
    """Week-over-week change per category and location over the last `weeks` full weeks.

    Weeks start on Mondays; the open week of `as_of` is left out. A pair that occurs in any of
    the weeks has a row for each of them, so a quiet week counts 0 and shows -100 %.
    """

    def monday(c):
        return F.date_trunc("week", c).cast("date")

    def number(day):
        return F.floor(F.datediff(day, F.lit("1970-01-05").cast("date")) / 7)

    end = monday(as_of_ts(as_of))
    at = F.col("submitted_at")
    recent = r.filter((at >= F.date_sub(end, 7 * weeks).cast("timestamp_ntz")) & (at < end.cast("timestamp_ntz")))
    weekly = recent.groupBy("cat_id", "location_id", number(monday(at)).alias("week_no")).agg(n_rows().alias("n"))
    pair, last = ["cat_id", "location_id"], number(end) - 1
    return pct_change(dense_periods(weekly, pair, "week_no", "n", last - (weeks - 1), last), pair, "week_no", "n")


# -- one-to-many assembly ---------------------------------------------------------


def request_documents(r: DataFrame, fb: DataFrame) -> DataFrame:
    """One row per request with its feedback as a nested column; `request_history` has its history."""
    feedback = fb.select("request_id", F.struct("rating", "comment", "is_satisfied").alias("feedback"))
    return r.join(feedback, "request_id", "left")


def request_history(su: DataFrame) -> DataFrame:
    """The history of every request, one row per change, keyed by (request_id, position)."""
    placed = ordered_position(su, ["request_id"], "updated_at", "update_id", "position")
    return placed.select("request_id", "position", "old_status", "new_status", "remarks", "updated_by", "updated_at")


def documents_of(r: DataFrame, su: DataFrame, fb: DataFrame, request_ids: list[int]) -> DataFrame:
    """Some named requests with feedback and whole history nested into one row each."""
    named = F.col("request_id").isin(request_ids)
    entry = F.struct("position", "old_status", "new_status", "remarks", "updated_by", "updated_at")
    history = request_history(su.filter(named)).groupBy("request_id").agg(F.sort_array(F.collect_list(entry)).alias("status_history"))
    return request_documents(r.filter(named), fb).join(history, "request_id", "left")
