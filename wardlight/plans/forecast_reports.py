"""M01-M08 and G01-G04 over the role tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.operators import geo as G
from wardlight.operators import predict as M
from wardlight.plans.registry import query
from wardlight.plans.roles import INC_AS_OF, REQ_AS_OF
from wardlight.plans.sql import with_views
from wardlight.session import materialize, scratch_dir

ETA_SQL = """cat_h AS (SELECT cat_id, avg(date_sub('hour', submitted_at, resolved_at)) AS h FROM req WHERE resolved_at IS NOT NULL GROUP BY 1),
        loc_h AS (SELECT location_id, avg(date_sub('hour', submitted_at, resolved_at)) AS h FROM req WHERE resolved_at IS NOT NULL GROUP BY 1),
        load AS (SELECT dept_id, count(*) AS n FROM req WHERE status IN ('pending','assigned','in_progress') GROUP BY 1),
        p AS (SELECT r.*, greatest(2.0, (coalesce(nullif(c.h, 0), 24) * CAST(0.6 AS DOUBLE) + coalesce(nullif(l.h, 0), 30) * CAST(0.4 AS DOUBLE))
          * CAST(CASE priority_id WHEN 1 THEN 0.45 WHEN 2 THEN 0.7 WHEN 3 THEN 1.0 ELSE 1.25 END AS DOUBLE)
          + least(18.0, coalesce(n, 0) * CAST(0.35 AS DOUBLE))) AS v
          FROM req r LEFT JOIN cat_h c ON r.cat_id = c.cat_id LEFT JOIN loc_h l ON r.location_id = l.location_id
          LEFT JOIN load d ON r.dept_id = d.dept_id)"""


@query(
    "m01_predict_eta",
    with_views(
        "req",
        f"""WITH {ETA_SQL} SELECT request_id, round(v, 1) AS predicted_hours, round(greatest(1.0, v - greatest(2.0, v * 0.2)), 1) AS range_low,
        round(v + greatest(2.0, v * 0.2), 1) AS range_high, 0.72::DOUBLE AS confidence FROM p""",
    ),
)
def m01(r):
    req = r.requests()
    return M.predict_eta(req, req).select("request_id", "predicted_hours", "range_low", "range_high", "confidence")


@query(
    "m02_resolution_features",
    with_views(
        "lines",
        """SELECT cat_id, location_id, priority_id, dept_id, CAST(dayofweek(submitted_at) + 1 AS INTEGER) AS day_of_week,
        CAST(month(submitted_at) AS INTEGER) AS month_of_year, CAST(hour(submitted_at) AS INTEGER) AS hour_of_day,
        date_sub('hour', submitted_at, resolved_at) AS resolution_hours FROM lines
        WHERE resolved_at IS NOT NULL AND status IN ('resolved','closed') AND date_sub('hour', submitted_at, resolved_at) > 0""",
    ),
)
def m02(r):
    return M.resolution_features(r.lines(category=True, location=True))


ETA_COLUMNS = "cat_id, location_id, priority_id, dept_id, day_of_week, month_of_year, hour_of_day, resolution_hours"
_BUCKET = f"CAST('0x' || substr(md5(concat_ws('|', '42', {ETA_COLUMNS})), 1, 8) AS BIGINT) % 1000"


@query(
    "m03_train_eta",
    with_views(
        "lines",
        f"""WITH f AS (SELECT cat_id, location_id, priority_id, dept_id, CAST(dayofweek(submitted_at) + 1 AS INTEGER) AS day_of_week,
          CAST(month(submitted_at) AS INTEGER) AS month_of_year, CAST(hour(submitted_at) AS INTEGER) AS hour_of_day,
          date_sub('hour', submitted_at, resolved_at) AS resolution_hours FROM lines
          WHERE resolved_at IS NOT NULL AND status IN ('resolved','closed') AND date_sub('hour', submitted_at, resolved_at) > 0),
        s AS (SELECT *, {_BUCKET} AS bucket FROM f)
        SELECT count(*) FILTER (bucket >= 200) AS train_rows, count(*) FILTER (bucket < 200) AS test_rows,
          count(*) FILTER (bucket < 200) AS predicted_in_range, count(*) FILTER (bucket < 200) AS same_after_load, TRUE AS varied FROM s""",
    ),
)
def m03(r):
    """Rows of both parts, and test rows whose prediction by the saved model is the fitted one's.

    A forest's prediction is a mean of training values, so all lie within them; it must not be one
    constant.
    """
    features = materialize(M.resolution_features(r.lines(category=True, location=True)).select(*ETA_COLUMNS.split(", ")), "features")
    model, path = M.EtaModel.train(features), scratch_dir(r.spark, "eta-model")
    model.save(path)
    train, test = M.split_by_hash(features)
    known = train.agg(F.count("*").alias("train_rows"), F.min("resolution_hours").alias("low"), F.max("resolution_hours").alias("high"))
    both = M.EtaModel.load(r.spark, path).predict(model.predict(M.dealt(test, M.PREDICTED_A_TASK), "fitted"), "loaded")
    low, high = (known.select(c).scalar() for c in ("low", "high"))
    return both.agg(
        F.count("*").alias("test_rows"),
        F.count_if(F.col("fitted").between(low - 1e-6, high + 1e-6)).alias("predicted_in_range"),
        F.count_if(F.abs(F.col("fitted") - F.col("loaded")) < 1e-9).alias("same_after_load"),
        (F.max("fitted") - F.min("fitted") > 1).alias("varied"),
    ).withColumn("train_rows", known.select("train_rows").scalar())


@query("m03_backtest")
def m03_backtest(r):
    """Errors per month of the last quarter of requests; a forest's numbers have no SQL."""
    return M.backtest_eta(r.requests(), "2000-06-01", 3, 20, 8)


@query(
    "m04_history_features",
    with_views(
        "req",
        """WITH f AS (SELECT *, date_sub('hour', submitted_at, resolved_at) AS h FROM req
          WHERE resolved_at IS NOT NULL AND date_sub('hour', submitted_at, resolved_at) > 0 AND status IN ('resolved','closed'))
        SELECT cat_id, location_id, priority_id, dept_id, h AS resolution_hours, round(avg(h) OVER (PARTITION BY cat_id), 4) AS category_avg,
        round(avg(h) OVER (PARTITION BY location_id), 4) AS location_avg,
        (SELECT count(*) FROM req w WHERE w.dept_id = f.dept_id AND w.status NOT IN ('resolved','closed')
          AND w.submitted_at >= {R_NOW} - INTERVAL 7 DAY) AS dept_load FROM f""".replace(
            "*, date_sub", "* REPLACE (CASE WHEN request_id % 9 <> 0 THEN cat_id END AS cat_id, CASE WHEN request_id % 8 <> 0 THEN location_id END AS location_id), date_sub"
        ),
    ),
)
def m04(r):
    """Some requests have no category or no location."""
    gone = {c: F.when(F.col("request_id") % n != 0, F.col(c)) for c, n in (("cat_id", 9), ("location_id", 8))}
    out = M.history_features(r.requests().withColumns(gone), REQ_AS_OF)
    return out.select(
        "cat_id",
        "location_id",
        "priority_id",
        "dept_id",
        "resolution_hours",
        F.round("category_avg", 4).alias("category_avg"),
        F.round("location_avg", 4).alias("location_avg"),
        "dept_load",
    )


@query(
    "m04_train_best",
    with_views(
        "req",
        """SELECT priority_id, count(*) AS predicted, round(avg(date_sub('hour', submitted_at, resolved_at)), 4) AS avg_actual,
          count(*) AS range_holds, TRUE AS varied, TRUE AS mean_is_near FROM req WHERE resolved_at IS NOT NULL AND date_sub('hour', submitted_at, resolved_at) > 0 AND status IN ('resolved','closed') GROUP BY 1""",
    ),
)
def m04_best(r):
    """Predictions of the better model by priority: how many, how many lie inside their range, and
    whether they differ and come near the actual mean (within a quarter)."""
    features = M.history_features(r.requests(), REQ_AS_OF)
    model, _, mae = M.train_eta_best(features)
    out = M.predict_range(model, features, mae)
    return out.groupBy("priority_id").agg(
        F.count("predicted_hours").alias("predicted"),
        F.round(F.avg("resolution_hours"), 4).alias("avg_actual"),
        F.count_if(F.col("predicted_hours").between(F.col("range_low"), F.col("range_high"))).alias("range_holds"),
        (F.max("prediction") - F.min("prediction") > 1).alias("varied"),
        (F.abs(F.avg("prediction") / F.avg("resolution_hours") - 1) < 0.25).alias("mean_is_near"),
    )


@query("m04_candidates")
def m04_candidates(r):
    """Hold-out errors of both learners and which one wins; their numbers have no SQL."""
    return M.compare_eta(M.history_features(r.requests(), REQ_AS_OF))[0]


@query(
    "m05_eta_error_report",
    with_views(
        "req",
        f"""WITH {ETA_SQL} SELECT cat_id, count(*) AS n, round(avg(abs(round(v, 1) - resolution_hours)), 3) AS mae,
        round(sqrt(avg((round(v, 1) - resolution_hours) ** 2)), 3) AS rmse FROM p WHERE resolution_hours IS NOT NULL GROUP BY 1""",
    ),
)
def m05(r):
    req = r.requests()
    report = M.eta_error_report(M.eta_error_log(M.predict_eta(req, req)), ("cat_id",))
    return report.select("cat_id", "n", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"))


FACTORS = """asks AS (SELECT location_id, count(*) FILTER (contains(lower(cat_name), 'build') AND submitted_at >= {R_NOW} - INTERVAL 30 DAY) AS lights,
          count(*) FILTER (contains(lower(cat_name), 'auto') OR contains(lower(cat_name), 'house')) AS wet
          FROM req r JOIN cat c ON r.cat_id = c.cat_id WHERE submitted_at >= {R_NOW} - INTERVAL 90 DAY GROUP BY 1),
        crimes AS (SELECT location_id, count(*) AS n, count(*) FILTER (incident_date >= {I_TODAY} - 30) AS recent,
          count(*) FILTER (time_of_day = 'night') AS night FROM inc WHERE incident_date >= {I_TODAY} - 90 GROUP BY 1),
        factors AS (SELECT *, street_light_factor * 0.3::DOUBLE + sewage_factor * 0.2::DOUBLE + recent_crime_factor * 0.4::DOUBLE
          + night_time_risk * 0.1::DOUBLE AS combined_risk FROM (
          SELECT c.location_id, least(1.0::DOUBLE, coalesce(lights, 0) / 5.0) AS street_light_factor,
          CASE WHEN coalesce(wet, 0) > 2 THEN 0.3::DOUBLE ELSE 0::DOUBLE END AS sewage_factor,
          least(1.0::DOUBLE, recent / 10.0) AS recent_crime_factor, night / greatest(1, n)::DOUBLE * 0.7::DOUBLE AS night_time_risk
          FROM crimes c LEFT JOIN asks a ON a.location_id = c.location_id))"""


def factors(r):
    req, inc = r.requests(resolved=False), r.incidents("forecast")
    return M.risk_factors(req, inc, r.cat, REQ_AS_OF, INC_AS_OF, 90, "Build", ("Auto", "House"))


def _forecast_view(body):
    sql = with_views("req inc cat", body)
    schema_tod = """WHEN hour(ts) BETWEEN 4 AND 7 THEN 'dawn' WHEN hour(ts) BETWEEN 8 AND 11 THEN 'morning'
  WHEN hour(ts) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour(ts) BETWEEN 17 AND 20 THEN 'evening'"""
    forecast_tod = """WHEN hour(ts) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 17 THEN 'afternoon'
  WHEN hour(ts) BETWEEN 18 AND 20 THEN 'evening'"""
    return sql.replace(schema_tod, forecast_tod)


@query(
    "m06_risk_factors",
    _forecast_view(
        f"""WITH {FACTORS} SELECT location_id, street_light_factor, sewage_factor, recent_crime_factor,
        round(night_time_risk, 6) AS night_time_risk, round(combined_risk, 6) AS combined_risk FROM factors"""
    ),
)
def m06(r):
    out = factors(r)
    return out.withColumns({c: F.round(c, 6) for c in ("night_time_risk", "combined_risk")})


FORECAST = """first AS (SELECT location_id, min(incident_date) AS f, count(*) AS n FROM inc WHERE incident_date >= {I_TODAY} - 90 GROUP BY 1 HAVING count(*) >= 10),
        days AS (SELECT location_id, CAST(unnest(generate_series(f, {I_TODAY}, INTERVAL 1 DAY)) AS DATE) AS d FROM first),
        daily AS (SELECT d.location_id, d.d, (SELECT count(*) FROM inc i WHERE i.location_id = d.location_id AND i.incident_date = d.d) AS n FROM days d),
        weekday AS (SELECT location_id, dayofweek(d) AS w, avg(n) AS expected FROM daily GROUP BY ALL),
        forecast AS (SELECT f.location_id, CAST({I_TODAY} + CAST(k AS INTEGER) AS DATE) AS predicted_date, expected
          FROM first f, range(1, 8) t(k) JOIN weekday w ON w.location_id = f.location_id
            AND w.w = dayofweek({I_TODAY} + CAST(k AS INTEGER))),
        blended AS (SELECT f.location_id, predicted_date, expected, combined_risk,
          round(least(1.0, greatest(0.0, expected / 5.0)) * 0.6::DOUBLE + combined_risk * 0.4::DOUBLE, 6) AS risk_score
          FROM forecast f JOIN factors x ON x.location_id = f.location_id),
        pred AS (SELECT location_id, predicted_date, round(expected, 6) AS expected, risk_score, CASE WHEN risk_score > 0.75 THEN 'critical' WHEN risk_score > 0.5 THEN 'high'
          WHEN risk_score > 0.25 THEN 'medium' ELSE 'low' END AS risk_level FROM blended)"""


def predictions(r):
    return M.blend_risk(M.forecast_incidents(r.incidents("forecast"), INC_AS_OF, 7), factors(r))


@query("m07_forecast_incidents", _forecast_view(f"WITH {FACTORS}, {FORECAST} SELECT * FROM pred"))
def m07(r):
    out = predictions(r)
    return out.select("location_id", "predicted_date", F.round("expected", 6).alias("expected"), "risk_score", "risk_level")


@query(
    "m08_publish_predictions",
    _forecast_view(
        f"""WITH {FACTORS}, {FORECAST} SELECT location_id, predicted_date, risk_score, 'new' AS source FROM pred
        UNION ALL SELECT i.location_id, i.incident_date + 2, 0.5, 'old' FROM (SELECT DISTINCT location_id, incident_date FROM inc) i
        WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p.location_id = i.location_id AND p.predicted_date = i.incident_date + 2)"""
    ),
)
def m08(r):
    stored = r.incidents().select("location_id", F.date_add("incident_date", 2).alias("predicted_date")).distinct()
    old = stored.select("*", F.lit(0.5).alias("risk_score"), F.lit("old").alias("source"), F.lit(0).alias("created_at"))
    new = predictions(r).select(
        "location_id", "predicted_date", "risk_score", "risk_level", F.lit("new").alias("source"), F.lit(1).alias("created_at")
    )
    return M.publish_predictions(new, old, r.loc)[0].select("location_id", "predicted_date", "risk_score", "source")


@query(
    "m08_critical_alerts",
    _forecast_view(
        f"""WITH {FACTORS}, {FORECAST} SELECT p.location_id, predicted_date, 'Crime Risk Alert: NATION_' || p.location_id AS title,
        'Predicted high crime risk in W' || lpad(CAST(p.location_id + 1 AS VARCHAR), 2, '0') AS message, 'crime_prediction' AS alert_type,
        'high' AS severity, risk_score FROM pred p WHERE risk_level = 'critical'"""
    ),
)
def m08_alerts(r):
    new = predictions(r).withColumn("created_at", F.lit(1))
    return M.publish_predictions(new, new, r.loc)[1]


# -- geo -----------------------------------------------------------------------------------

PHOTOS = """photo AS (SELECT event_id AS photo_id, event_id % 1500 AS request_id, ts AS uploaded_at,
          CASE WHEN event_id % 3 <> 0 THEN 18.40::DOUBLE + 0.01::DOUBLE * (event_id % 25) + 0.001::DOUBLE * (event_id % 7) END AS lat,
          73.70::DOUBLE + 0.01::DOUBLE * (event_id % 25) AS lng FROM events)"""


def photos(r):
    key = F.col("event_id")
    lat = F.lit(18.40) + F.lit(0.01) * (key % 25) + F.lit(0.001) * (key % 7)
    return r.t["events"].select(
        key.alias("photo_id"),
        (key % 1500).alias("request_id"),
        F.col("ts").alias("uploaded_at"),
        F.when(key % 3 != 0, lat).alias("photo_lat"),
        (F.lit(73.70) + F.lit(0.01) * (key % 25)).alias("photo_lng"),
    )


@query(
    "g01_gps_verified",
    f"""WITH {PHOTOS} SELECT photo_id, coalesce(lat, 18.5::DOUBLE) AS photo_gps_lat, lng AS photo_gps_lng,
      CASE WHEN photo_id % 5 <> 0 THEN CAST(sqrt((coalesce(lat, 18.5::DOUBLE) - 18.5215::DOUBLE) ** 2 + (lng - 73.8215::DOUBLE) ** 2) < 0.01 AS INTEGER) END AS gps_verified
      FROM photo""",
)
def g01(r):
    rows = photos(r).withColumns(
        {
            "meta_lat": F.lit(18.5),
            "meta_lng": F.lit(0.0),
            "request_lat": F.when(F.col("photo_id") % 5 != 0, F.lit(18.5215)),
            "request_lng": F.lit(73.8215),
        }
    )
    return G.gps_verified(rows).select("photo_id", "photo_gps_lat", "photo_gps_lng", "gps_verified")


@query(
    "g02_gps_check",
    with_views(
        "req loc",
        f"""WITH {PHOTOS}, newest AS (SELECT * FROM photo QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY uploaded_at DESC, photo_id DESC) = 1),
        d AS (SELECT photo_id, n.request_id, l.location_id, sin(radians(latitude - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(latitude))
          * sin(radians(longitude - lng) / 2) ** 2 AS h FROM newest n JOIN req r ON n.request_id = r.request_id JOIN loc l ON r.location_id = l.location_id),
        m AS (SELECT photo_id, request_id, location_id, round(2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)), 3) AS distance_m FROM d)
        SELECT *, CAST(distance_m <= 500 AS INTEGER) AS is_match, CASE WHEN distance_m > 500 THEN 'gps_mismatch' END AS flag_reason,
        CASE WHEN distance_m > 500 THEN 'high' END AS flag_severity FROM m""",
    ),
)
def g02(r):
    return G.gps_check(photos(r), r.requests(resolved=False), r.loc)


@query(
    "g03_dms_to_degrees",
    """SELECT event_id, round((event_id % 90 + (event_id % 60) / 60.0 + value / 3600.0) * CASE WHEN event_type IN ('click','view') THEN -1 ELSE 1 END, 7) AS degrees
      FROM events""",
)
def g03(r):
    ref = F.when(F.col("event_type") == "click", "S").when(F.col("event_type") == "view", "W").otherwise("N")
    rows = r.t["events"].withColumns({"d": F.col("event_id") % 90, "m": F.col("event_id") % 60, "ref": ref})
    return rows.select("event_id", G.dms_to_degrees("d", "m", "value", "ref").alias("degrees"))


@query(
    "g04_grid_aggregate",
    with_views(
        "inc",
        f"""WITH c AS (SELECT CAST(floor(latitude / {100.0 / G.METRES_PER_DEGREE}::DOUBLE) AS BIGINT) AS cell_y,
          CAST(floor(longitude / {100.0 / G.METRES_PER_DEGREE}::DOUBLE) AS BIGINT) AS cell_x, count(*) AS n FROM inc
          WHERE latitude BETWEEN 18.4 AND 18.6 AND longitude BETWEEN 73.7 AND 73.9
          AND incident_date < {{I_NOW}} - INTERVAL 10 DAY GROUP BY ALL)
        SELECT *, round((cell_y + 0.5) * {100.0 / G.METRES_PER_DEGREE}::DOUBLE, 7) AS cell_lat,
        round((cell_x + 0.5) * {100.0 / G.METRES_PER_DEGREE}::DOUBLE, 7) AS cell_lng FROM c""",
    ),
)
def g04(r):
    points = r.incidents().select(
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lng"),
        F.col("incident_date").cast("timestamp_ntz").alias("event_time"),
    )
    return G.grid_aggregate(points, 100.0, (18.4, 73.7, 18.6, 73.9), INC_AS_OF, 10)


def _levels(count: int) -> str:
    """Each level by a group of its own over all points."""
    step = 100.0 / G.METRES_PER_DEGREE
    cell = lambda c, k: f"CAST(floor(floor({c} / {step}::DOUBLE) / {2**k}) AS BIGINT)"
    return " UNION ALL ".join(
        f"""SELECT {k} AS level, {cell("latitude", k)} AS cell_y, {cell("longitude", k)} AS cell_x, count(*) AS n FROM inc
        WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY ALL"""
        for k in range(count)
    )


def _pins(r):
    return r.incidents().select(F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))


@query("g04_grid_pyramid", with_views("inc", f"SELECT level, cell_y, cell_x, CAST(n AS BIGINT) AS n FROM ({_levels(6)})"))
def g04_pyramid(r):
    return G.grid_pyramid(_pins(r), 6).select("level", "cell_y", "cell_x", "n")


@query(
    "g04_grid_view",
    with_views(
        "inc",
        f"""WITH p AS ({_levels(6)}), c AS (SELECT *, {100.0 / G.METRES_PER_DEGREE}::DOUBLE * 8 AS side FROM p WHERE level = 3)
        SELECT cell_y, cell_x, CAST(n AS BIGINT) AS n, round((cell_y + 0.5) * side, 7) AS cell_lat, round((cell_x + 0.5) * side, 7) AS cell_lng FROM c
        WHERE round((cell_y + 0.5) * side, 7) BETWEEN 18.45 AND 18.6 AND round((cell_x + 0.5) * side, 7) BETWEEN 73.7 AND 73.9""",
    ),
)
def g04_view(r):
    return G.grid_view(G.grid_pyramid(_pins(r), 6), 14, (18.45, 73.7, 18.6, 73.9)).drop("level")
