"""Q19-Q32 and Q35: incident analytics over the event role."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.operators import incidents as I
from wardlight.plans.registry import query
from wardlight.plans.roles import INC_AS_OF, REQ_AS_OF
from wardlight.plans.sql import with_views

KIND = "type_name, type_code, severity, icon, color_hex"


@query(
    "q19_incident_list",
    with_views(
        "inc types loc",
        f"""SELECT i.incident_id, i.incident_code, i.latitude, i.longitude, i.incident_date, i.incident_hour, i.time_of_day,
        i.victim_count, i.status, i.is_hotspot_flag, {KIND}, l.area_name, l.ward_number, l.zone
        FROM inc i JOIN types t ON i.crime_type_id = t.crime_type_id JOIN loc l ON i.location_id = l.location_id
        WHERE i.incident_date >= {{I_TODAY}} - 20 AND i.status = 'fir_filed' AND t.severity = 'high'""",
    ),
)
def q19(r):
    out = I.incident_list(r.incidents(), r.types, r.loc, INC_AS_OF, 20, severity="high", status="fir_filed")
    return out.select(
        "incident_id", "incident_code", "latitude", "longitude", "incident_date", "incident_hour", "time_of_day",
        "victim_count", "status", "is_hotspot_flag", *KIND.split(", "), "area_name", "ward_number", "zone",
    )


@query(
    "q20_map_feed",
    with_views(
        "req inc cat types loc pri",
        """SELECT 'complaint' AS incident_type, request_id AS id, code, cat_name AS title, cat_name AS sub_type, icon_class AS icon,
        color_code AS color, priority_name AS severity, l.latitude AS lat, l.longitude AS lng, area_name, ward_number, zone,
        status, submitted_at AS event_time, is_hotspot_flag
        FROM req r JOIN cat c ON r.cat_id = c.cat_id JOIN loc l ON r.location_id = l.location_id
        JOIN pri p ON r.priority_id = p.priority_id
        WHERE l.latitude IS NOT NULL AND submitted_at >= {R_NOW} - INTERVAL 90 DAY
        UNION ALL SELECT 'crime', incident_id, incident_code, type_name, type_code, icon, color_hex, severity, i.latitude, i.longitude,
        area_name, ward_number, zone, status, CAST(incident_date AS TIMESTAMP), is_hotspot_flag
        FROM inc i JOIN types t ON i.crime_type_id = t.crime_type_id JOIN loc l ON i.location_id = l.location_id
        WHERE incident_date >= {I_TODAY} - 90""",
    ),
)
def q20(r):
    return I.map_feed(r.requests(resolved=False), r.incidents(), r.cat, r.types, r.loc, r.pri, REQ_AS_OF, INC_AS_OF, 90)


@query(
    "q21_heat_points",
    with_views(
        "lines inc types loc",
        """SELECT lat, lng, CAST(weight AS DOUBLE) AS weight FROM (
        SELECT i.latitude AS lat, i.longitude AS lng,
          CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'moderate' THEN 0.5 ELSE 0.25 END AS weight
        FROM inc i JOIN types t ON i.crime_type_id = t.crime_type_id WHERE incident_date >= {I_TODAY} - 30
        UNION ALL SELECT l.latitude, l.longitude,
          CASE priority_id WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 WHEN 3 THEN 0.35 ELSE 0.15 END
        FROM lines r JOIN loc l ON r.location_id = l.location_id
        WHERE submitted_at >= {R_NOW} - INTERVAL 30 DAY AND l.latitude IS NOT NULL)""",
    ),
)
def q21(r):
    return I.heat_points(r.lines(location=True), r.incidents(), r.types, r.loc, REQ_AS_OF, INC_AS_OF)


COUNTS = """crimes AS (SELECT location_id, count(*) AS n, count(*) FILTER (severity = 'critical') AS crit,
          count(*) FILTER (severity IN ('critical','high')) AS severe
          FROM {inc} i JOIN types t ON i.crime_type_id = t.crime_type_id WHERE incident_date >= {{I_TODAY}} - 30 GROUP BY 1),
        asks AS (SELECT location_id, count(*) AS n FROM {req} WHERE submitted_at >= {{R_NOW}} - INTERVAL 30 DAY GROUP BY 1)"""


@query(
    "q22_hotspot_zones",
    with_views(
        "lines inc types loc",
        "WITH " + COUNTS.format(inc="inc", req="lines").replace("{{", "{").replace("}}", "}") + """
        SELECT *, CASE WHEN crime_count_30d >= 425 OR request_count_30d >= 45 THEN 'critical'
          WHEN crime_count_30d >= 400 OR request_count_30d >= 35 THEN 'high'
          WHEN crime_count_30d >= 380 OR request_count_30d >= 25 THEN 'moderate' ELSE 'normal' END AS hotspot_level
        FROM (SELECT l.location_id, area_name, ward_number, zone, latitude, longitude, coalesce(c.n, 0) AS crime_count_30d,
          coalesce(a.n, 0) AS request_count_30d, coalesce(c.crit, 0) AS critical_crimes,
          coalesce(c.n, 0) + coalesce(a.n, 0) AS total_incidents
          FROM loc l LEFT JOIN crimes c ON l.location_id = c.location_id LEFT JOIN asks a ON l.location_id = a.location_id)
        WHERE total_incidents > 0""",
    ),
)
def q22(r):
    steps = {"crime_steps": (425, 400, 380), "request_steps": (45, 35, 25)}
    return I.hotspot_zones(r.lines(location=True), r.incidents(), r.types, r.loc, REQ_AS_OF, INC_AS_OF, **steps)


# Weights scaled to the density of the role data, so that scores fall inside 0..100.
SCALED_SAFETY = (0.125, 0.125, 0.5)
SCALED_RISK = (0.0625, 0.25, 2.0)


def scores_sql(weights=SCALED_SAFETY) -> str:
    crime, severe, request = (f"CAST({w} AS DOUBLE)" for w in weights)
    return COUNTS.format(inc="inc", req="req").replace("{{", "{").replace("}}", "}") + f""",
        scores AS (SELECT location_id, crime_count_30d, critical_crimes_30d, request_count_30d,
          greatest(0, least(100, 100 - crime_count_30d * {crime} - critical_crimes_30d * {severe} - request_count_30d * {request})) AS safety_score,
          CASE WHEN greatest(0, 100 - crime_count_30d * {crime} - request_count_30d * {request}) >= 80 THEN 'very_low'
            WHEN greatest(0, 100 - crime_count_30d * {crime}) >= 60 THEN 'low' WHEN greatest(0, 100 - crime_count_30d * {crime}) >= 40 THEN 'moderate'
            WHEN greatest(0, 100 - crime_count_30d * {crime}) >= 20 THEN 'high' ELSE 'critical' END AS risk_level
          FROM (SELECT l.location_id, coalesce(c.n, 0) AS crime_count_30d, coalesce(c.severe, 0) AS critical_crimes_30d,
            coalesce(a.n, 0) AS request_count_30d
            FROM loc l LEFT JOIN crimes c ON l.location_id = c.location_id LEFT JOIN asks a ON l.location_id = a.location_id))"""


def scores(r, weights=SCALED_SAFETY):
    req = r.requests(resolved=False)
    return I.safety_scores(req, r.incidents(), r.types, r.loc, REQ_AS_OF, INC_AS_OF, weights)


@query(
    "q23_safety_scores",
    with_views("req inc types loc", "WITH " + scores_sql(I.SAFETY_WEIGHTS) + " SELECT * FROM scores"),
)
def q23(r):
    return scores(r, I.SAFETY_WEIGHTS)


@query("q23_safety_scores_scaled", with_views("req inc types loc", "WITH " + scores_sql() + " SELECT * FROM scores"))
def q23_scaled(r):
    return scores(r)


RISK = """crimes AS (SELECT location_id, count(*) AS n,
          count(*) FILTER (time_of_day = 'night' OR (incident_hour IS NOT NULL AND incident_hour >= 20)) AS night
          FROM inc WHERE incident_date >= {I_TODAY} - 30 GROUP BY 1),
        lights AS (SELECT location_id, count(*) AS n FROM req r JOIN cat c ON r.cat_id = c.cat_id
          WHERE submitted_at >= {R_NOW} - INTERVAL 30 DAY AND cat_name ILIKE '%build%' GROUP BY 1),
        risk AS (SELECT *, round(least(100, crime_count_30d * CAST(0.0625 AS DOUBLE) + night_crime_count * CAST(0.25 AS DOUBLE) + street_light_issues * CAST(2 AS DOUBLE)), 2) AS risk_score
          FROM (SELECT l.location_id, area_name, ward_number, zone, latitude, longitude, coalesce(c.n, 0) AS crime_count_30d,
            coalesce(c.night, 0) AS night_crime_count, coalesce(g.n, 0) AS street_light_issues
            FROM loc l LEFT JOIN crimes c ON l.location_id = c.location_id LEFT JOIN lights g ON l.location_id = g.location_id
            WHERE latitude IS NOT NULL AND longitude IS NOT NULL)
          ORDER BY risk_score DESC, location_id LIMIT 20)"""


def risk(r):
    req = r.requests(resolved=False)
    return I.location_risk(req, r.incidents(), r.cat, r.loc, REQ_AS_OF, INC_AS_OF, 20, "Build", SCALED_RISK)


@query("q24_location_risk", with_views("req inc cat loc", f"WITH {RISK} SELECT * FROM risk"))
def q24(r):
    return risk(r)


CALENDAR = """calendar AS (SELECT risk.*, CAST({I_TODAY} + CAST(d AS INTEGER) AS DATE) AS predicted_date,
          CASE WHEN risk_score >= 75 THEN 'critical' WHEN risk_score >= 55 THEN 'high'
            WHEN risk_score >= 30 THEN 'medium' ELSE 'low' END AS risk_level
          FROM risk, range(1, 8) t(d))"""


@query(
    "q25_risk_calendar",
    with_views(
        "req inc cat loc",
        f"""WITH {RISK}, {CALENDAR} SELECT *, '{{"crime_count_30d":' || crime_count_30d || ',"night_crime_count":' || night_crime_count
        || ',"street_light_issues":' || street_light_issues || '}}' AS contributing_factors FROM calendar""",
    ),
)
def q25(r):
    out = I.risk_calendar(risk(r), INC_AS_OF, 7)
    return out.withColumn("contributing_factors", F.to_json("contributing_factors"))


@query(
    "q26_safety_ranking",
    with_views(
        "req inc types loc",
        "WITH " + scores_sql() + """ SELECT s.*, area_name, ward_number, zone, latitude, longitude
        FROM scores s JOIN loc l ON s.location_id = l.location_id""",
    ),
)
def q26(r):
    return I.safety_ranking(scores(r), r.loc)


@query(
    "q27_incident_summary",
    with_views(
        "inc types",
        """SELECT count(*) AS total_crimes, count(*) FILTER (severity = 'critical') AS critical,
        count(*) FILTER (severity = 'high') AS high, count(*) FILTER (status IN ('fir_filed','chargesheet')) AS fir_filed,
        count(*) FILTER (status = 'resolved') AS resolved, CAST(sum(victim_count) AS BIGINT) AS total_victims,
        round(avg(victim_count), 4) AS avg_victims_per_incident FROM inc i JOIN types t ON i.crime_type_id = t.crime_type_id""",
    ),
)
def q27(r):
    return I.incident_summary(r.incidents(), r.types)


@query(
    "q28_incidents_by_type",
    with_views(
        "inc types",
        """SELECT t.crime_type_id, type_name, severity, color_hex, count(*) AS total, count(*) FILTER (status = 'resolved') AS resolved
        FROM inc i JOIN types t ON i.crime_type_id = t.crime_type_id GROUP BY ALL""",
    ),
)
def q28(r):
    return I.incidents_by_type(r.incidents(), r.types)


@query(
    "q29_incidents_by_time",
    with_views("inc", "SELECT time_of_day, count(*) AS incidents FROM inc WHERE time_of_day <> 'unknown' GROUP BY 1"),
)
def q29(r):
    return I.incidents_by_time(r.incidents())


@query(
    "q30_incidents_by_location",
    with_views(
        "inc types loc",
        """SELECT l.location_id, area_name, ward_number, count(*) AS total, count(*) FILTER (severity IN ('critical','high')) AS serious
        FROM inc i JOIN loc l ON i.location_id = l.location_id JOIN types t ON i.crime_type_id = t.crime_type_id
        WHERE incident_date >= {I_TODAY} - 30 GROUP BY ALL ORDER BY total DESC, l.location_id LIMIT 10""",
    ),
)
def q30(r):
    return I.incidents_by_location(r.incidents(), r.types, r.loc, INC_AS_OF, 10)


@query(
    "q31_incident_hotspots",
    with_views(
        "inc loc",
        """SELECT l.location_id, area_name, ward_number, count(*) AS crime_count FROM inc i JOIN loc l ON i.location_id = l.location_id
        WHERE incident_date >= {I_TODAY} - 30 GROUP BY ALL HAVING count(*) >= 400""",
    ),
)
def q31(r):
    return I.incident_hotspots(r.incidents(), r.loc, INC_AS_OF, 400)


@query(
    "q32_safety_by_zone",
    with_views(
        "req inc types loc",
        "WITH " + scores_sql() + """ SELECT zone, round(avg(safety_score), 1) AS avg_safety
        FROM scores s JOIN loc l ON s.location_id = l.location_id GROUP BY 1""",
    ),
)
def q32(r):
    return I.safety_by_zone(scores(r), r.loc)


@query(
    "q35_prediction_feed",
    with_views(
        "req inc cat loc",
        f"""WITH {RISK}, {CALENDAR} SELECT c.location_id, c.predicted_date, c.risk_score, c.risk_level, c.area_name, c.ward_number,
        c.zone, c.latitude, c.longitude, (SELECT count(*) FROM inc i WHERE i.location_id = c.location_id
          AND incident_date >= {{I_TODAY}} - 30) AS recent_crimes_30d
        FROM calendar c WHERE predicted_date BETWEEN {{I_TODAY}} AND {{I_TODAY}} + 5 AND risk_level = 'high'""",
    ),
)
def q35(r):
    stored = I.risk_calendar(risk(r), INC_AS_OF, 7).select("location_id", "predicted_date", "risk_score", "risk_level")
    return I.prediction_feed(stored, r.incidents(), r.loc, INC_AS_OF, 5, "high")
