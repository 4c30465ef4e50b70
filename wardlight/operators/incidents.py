"""Incident analytics, combined map feeds, safety scores and risk calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.columns import as_event_time, as_of_ts, clamp, map_value
from wardlight.functions.measures import count_where, n_rows, stat, status_is
from wardlight.operators.filters import filter_incidents, is_night, like_const, trailing
from wardlight.operators.joins import enrich_incidents, left_join_aggs, location_counts

PLACE = ["location_id", "area_name", "ward_number", "zone", "latitude", "longitude"]


def since_date(as_of, days: int) -> Column:
    return F.date_sub(as_of_ts(as_of).cast("date"), days)


def recent_incidents(i: DataFrame, as_of, days: int = 30) -> DataFrame:
    return i.filter(F.col("incident_date") >= since_date(as_of, days))


def incident_list(i, types, loc, as_of, days: int = 90, severity=None, newest_first: bool = True, **filters) -> DataFrame:
    rows = filter_incidents(i, as_of, days, **filters)
    out = enrich_incidents(rows, types, loc)
    if severity is not None:
        out = out.filter(F.col("severity") == severity)
    if not newest_first:
        return out
    return out.orderBy(F.col("incident_date").desc(), F.col("incident_hour").desc(), "incident_id")


MAP_SHAPE = [
    "incident_type",
    "id",
    "code",
    "title",
    "sub_type",
    "icon",
    "color",
    "severity",
    "lat",
    "lng",
    "area_name",
    "ward_number",
    "zone",
    "status",
    "event_time",
    "is_hotspot_flag",
]


def map_feed(r, i, cat, types, loc, pri, as_of_r=None, as_of_i=None, days: int | None = 90) -> DataFrame:
    """Requests and incidents in one shape. With `days` None the whole history is returned."""
    requests = r if days is None else trailing(r, "submitted_at", as_of_r, f"{days} days")
    crimes = i if days is None else recent_incidents(i, as_of_i, days)
    named = (
        requests.join(cat.select("cat_id", "cat_name", "icon_class"), "cat_id")
        .join(loc.select(*PLACE).filter(F.col("latitude").isNotNull()), "location_id")
        .join(pri.select("priority_id", "color_code", "priority_name"), "priority_id")
    )
    left = named.select(
        F.lit("complaint").alias("incident_type"),
        F.col("request_id").alias("id"),
        "code",
        F.col("cat_name").alias("title"),
        F.col("cat_name").alias("sub_type"),
        F.col("icon_class").alias("icon"),
        F.col("color_code").alias("color"),
        F.col("priority_name").alias("severity"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lng"),
        "area_name",
        "ward_number",
        "zone",
        "status",
        F.col("submitted_at").alias("event_time"),
        "is_hotspot_flag",
    )
    right = enrich_incidents(crimes, types, loc).select(
        F.lit("crime").alias("incident_type"),
        F.col("incident_id").alias("id"),
        F.col("incident_code").alias("code"),
        F.col("type_name").alias("title"),
        F.col("type_code").alias("sub_type"),
        "icon",
        F.col("color_hex").alias("color"),
        "severity",
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lng"),
        "area_name",
        "ward_number",
        "zone",
        "status",
        as_event_time("incident_date").alias("event_time"),
        "is_hotspot_flag",
    )
    return left.unionByName(right)


# Heat weights by incident severity and by request priority.
SEVERITY_WEIGHT = {"critical": 1.0, "high": 0.75, "moderate": 0.5}
PRIORITY_WEIGHT = {1: 0.8, 2: 0.6, 3: 0.35}


def heat_points(r, i, types, loc, as_of_r, as_of_i, days: int = 30) -> DataFrame:
    crimes = recent_incidents(i, as_of_i, days).join(types.select("crime_type_id", "severity"), "crime_type_id")
    asks = trailing(r, "submitted_at", as_of_r, f"{days} days").join(
        loc.selectExpr("location_id", "latitude AS lat", "longitude AS lng").filter("lat IS NOT NULL"), "location_id"
    )
    hot = crimes.select(
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lng"),
        map_value("severity", SEVERITY_WEIGHT, 0.25).alias("weight"),
    )
    return hot.unionByName(asks.select("lat", "lng", map_value("priority_id", PRIORITY_WEIGHT, 0.15).alias("weight")))


def hotspot_zones(r, i, types, loc, as_of_r, as_of_i, crime_steps=(10, 6, 3), request_steps=(15, 10, 5)) -> DataFrame:
    """Combined zones; each fact is reduced to one row per location before the joins."""
    crimes = (
        recent_incidents(i, as_of_i)
        .join(types.select("crime_type_id", "severity"), "crime_type_id")
        .groupBy("location_id")
        .agg(n_rows().alias("crime_count_30d"), count_where(F.col("severity") == "critical").alias("critical_crimes"))
    )
    asks = trailing(r, "submitted_at", as_of_r, "30 days").groupBy("location_id").agg(n_rows().alias("request_count_30d"))
    counts = ("crime_count_30d", "critical_crimes", "request_count_30d")
    out = left_join_aggs(loc.select(*PLACE), [crimes, asks], "location_id", counts)
    level = None
    for name, crime_min, request_min in zip(("critical", "high", "moderate"), crime_steps, request_steps):
        cond = (F.col("crime_count_30d") >= crime_min) | (F.col("request_count_30d") >= request_min)
        level = F.when(cond, name) if level is None else level.when(cond, name)
    out = out.withColumns(
        {
            "total_incidents": F.col("crime_count_30d") + F.col("request_count_30d"),
            "hotspot_level": level.otherwise("normal"),
        }
    )
    return out.filter(F.col("total_incidents") > 0).orderBy(F.col("total_incidents").desc(), "location_id")


# Points lost per incident, severe incident and request.
SAFETY_WEIGHTS = (4.0, 3.0, 0.5)
# Risk points per incident, night incident and lighting request.
RISK_WEIGHTS = (4.0, 3.0, 2.0)


def safety_level(crimes: Column, requests: Column, weights=SAFETY_WEIGHTS) -> Column:
    """Risk level of a location. Only the first step looks at requests; none looks at severity."""
    base = F.greatest(F.lit(0.0), F.lit(100.0) - crimes * weights[0])
    with_requests = F.greatest(F.lit(0.0), F.lit(100.0) - crimes * weights[0] - requests * weights[2])
    return (
        F.when(with_requests >= 80, "very_low")
        .when(base >= 60, "low")
        .when(base >= 40, "moderate")
        .when(base >= 20, "high")
        .otherwise("critical")
    )


def safety_scores(r, i, types, loc, as_of_r, as_of_i, weights=SAFETY_WEIGHTS) -> DataFrame:
    """clamp(100 - 4 crimes - 3 severe - 0.5 requests, 0, 100) per location, over 30 days."""
    counts = location_counts(r, i, types, loc.select("location_id"), as_of_r, as_of_i)
    crimes, severe, asks = (F.col(c) for c in ("crime_count_30d", "critical_crimes_30d", "request_count_30d"))
    raw = F.lit(100.0) - crimes * weights[0] - severe * weights[1] - asks * weights[2]
    return counts.withColumns({"safety_score": clamp(raw, 0.0, 100.0), "risk_level": safety_level(crimes, asks, weights)})


def safety_ranking(scores: DataFrame, loc: DataFrame) -> DataFrame:
    return scores.join(loc.select(*PLACE), "location_id").orderBy(F.col("safety_score").desc(), "location_id")


def safety_by_zone(scores: DataFrame, loc: DataFrame) -> DataFrame:
    zones = scores.join(loc.select("location_id", "zone"), "location_id")
    return zones.groupBy("zone").agg(stat("safety_score", "avg", 1).alias("avg_safety")).orderBy(F.col("avg_safety").desc(), "zone")


def location_risk(r, i, cat, loc, as_of_r, as_of_i, k: int = 20, issue: str = "Street Light", weights=RISK_WEIGHTS) -> DataFrame:
    """min(100, 4 crimes + 3 night crimes + 2 lighting requests) per placed location, top k.

    Crimes and night crimes come from the same aggregate, so the incidents are read once.
    """
    crimes = (
        recent_incidents(i, as_of_i)
        .groupBy("location_id")
        .agg(n_rows().alias("crime_count_30d"), count_where(is_night()).alias("night_crime_count"))
    )
    lights = (
        trailing(r, "submitted_at", as_of_r, "30 days")
        .join(cat.filter(like_const("cat_name", issue)).select("cat_id"), "cat_id", "left_semi")
        .groupBy("location_id")
        .agg(n_rows().alias("street_light_issues"))
    )
    counts = ("crime_count_30d", "night_crime_count", "street_light_issues")
    placed = loc.select(*PLACE).filter("latitude IS NOT NULL AND longitude IS NOT NULL")
    out = left_join_aggs(placed, [crimes, lights], "location_id", counts)
    score = F.col("crime_count_30d") * weights[0] + F.col("night_crime_count") * weights[1]
    score = score + F.col("street_light_issues") * weights[2]
    out = out.withColumn("risk_score", F.round(F.least(F.lit(100.0), score), 2))
    return out.orderBy(F.col("risk_score").desc(), "location_id").limit(k)


def risk_level(score) -> Column:
    """Level of a 0..100 risk score."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 75, "critical").when(s >= 55, "high").when(s >= 30, "medium").otherwise("low")


def risk_calendar(risk: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Each location once per coming day, with its level and the factors behind it."""
    today = as_of_ts(as_of).cast("date")
    ahead = F.explode(F.sequence(F.date_add(today, 1), F.date_add(today, max(days, 1))))
    factors = F.struct("crime_count_30d", "night_crime_count", "street_light_issues")
    return (
        risk.withColumns({"risk_level": risk_level("risk_score"), "contributing_factors": factors})
        .withColumn("predicted_date", ahead)
    )


def incident_summary(i: DataFrame, types: DataFrame) -> DataFrame:
    joined = i.join(types.select("crime_type_id", "severity"), "crime_type_id")
    return joined.agg(
        n_rows().alias("total_crimes"),
        count_where(F.col("severity") == "critical").alias("critical"),
        count_where(F.col("severity") == "high").alias("high"),
        count_where(status_is("fir_filed", "chargesheet")).alias("fir_filed"),
        count_where(status_is("resolved")).alias("resolved"),
        F.coalesce(F.sum(F.col("victim_count").cast("long")), F.lit(0)).alias("total_victims"),
        stat("victim_count", "avg", 4).alias("avg_victims_per_incident"),
    )


def incidents_by_type(i: DataFrame, types: DataFrame) -> DataFrame:
    counts = i.groupBy("crime_type_id").agg(n_rows().alias("total"), count_where(status_is("resolved")).alias("resolved"))
    kinds = types.select("crime_type_id", "type_name", "severity", "color_hex")
    return kinds.join(counts, "crime_type_id").orderBy(F.col("total").desc(), "crime_type_id")


def incidents_by_time(i: DataFrame) -> DataFrame:
    known = i.filter(F.col("time_of_day") != "unknown")
    return known.groupBy("time_of_day").agg(n_rows().alias("incidents")).orderBy(F.col("incidents").desc(), "time_of_day")


def incidents_by_location(i, types, loc, as_of, k: int = 10) -> DataFrame:
    serious = types.select("crime_type_id", F.col("severity").isin("critical", "high").alias("_serious"))
    counts = (
        recent_incidents(i, as_of)
        .join(serious, "crime_type_id")
        .groupBy("location_id")
        .agg(n_rows().alias("total"), count_where(F.col("_serious")).alias("serious"))
    )
    named = loc.select("location_id", "area_name", "ward_number").join(counts, "location_id")
    return named.orderBy(F.col("total").desc(), "location_id").limit(k)


def incident_hotspots(i: DataFrame, loc: DataFrame, as_of, threshold: int = 5, days: int = 30) -> DataFrame:
    counts = recent_incidents(i, as_of, days).groupBy("location_id").agg(n_rows().alias("crime_count"))
    hot = counts.filter(F.col("crime_count") >= threshold)
    return loc.select("location_id", "area_name", "ward_number").join(hot, "location_id").orderBy(
        F.col("crime_count").desc(), "location_id"
    )


def prediction_feed(pred: DataFrame, i: DataFrame, loc: DataFrame, as_of, days: int = 7, level: str | None = None) -> DataFrame:
    """Stored predictions of the coming days with the recent incidents of their location.

    The incident count depends on the location only, so it is aggregated once per location
    instead of joining every incident to every prediction.
    """
    today = as_of_ts(as_of).cast("date")
    chosen = pred.filter(F.col("predicted_date").between(today, F.date_add(today, days)))
    if level is not None:
        chosen = chosen.filter(F.col("risk_level") == level)
    counts = recent_incidents(i, as_of).groupBy("location_id").agg(n_rows().alias("recent_crimes_30d"))
    out = chosen.join(loc.select(*PLACE), "location_id").join(counts, "location_id", "left")
    out = out.withColumn("recent_crimes_30d", F.coalesce("recent_crimes_30d", F.lit(0)))
    return out.orderBy(F.col("risk_score").desc(), "predicted_date", "location_id")
