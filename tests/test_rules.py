"""Boundary cases of every scoring and lifecycle rule, on hand-written rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardlight.functions import columns as X
from wardlight.functions import measures as M
from wardlight.operators import community as C
from wardlight.operators import filters as P
from wardlight.operators import geo as G
from wardlight.operators import incidents as I
from wardlight.operators import joins as J
from wardlight.operators import lifecycle as L
from wardlight.operators import notify as N
from wardlight.operators import predict as PR
from wardlight.operators import quality as D
from wardlight.operators import requests as Q
from wardlight.operators import text as T
from wardlight.operators import windows as W
from wardlight.sources import tables as S

AS_OF = "2024-07-01 00:00:00"


def ts(text):
    return dt.datetime.fromisoformat(text)


def table(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def pri(spark):
    return spark.sql(
        "SELECT * FROM VALUES (1,'Critical',1,4,'#a'),(2,'High',2,24,'#b'),(3,'Medium',3,72,'#c'),(4,'Low',4,168,'#d') "
        "AS v(priority_id, priority_name, priority_level, sla_hours, color_code)"
    )


@pytest.fixture(scope="module")
def cat(spark):
    return spark.sql(
        "SELECT * FROM VALUES (1,'Water Supply Issue',1,1,'fa-tint',true),(2,'Street Light Not Working',1,4,'fa-bulb',true),"
        "(3,'Other',2,4,'fa-q',true),(4,'Garbage Not Collected',2,3,'fa-bin',false) "
        "AS v(cat_id, cat_name, dept_id, default_priority_id, icon_class, is_active)"
    )


@pytest.fixture(scope="module")
def dept(spark):
    return spark.sql(
        "SELECT * FROM VALUES (1,'Works & Roads','W','h1',true),(2,'Clean','C','h2',true),(3,'Empty','E','h3',false) "
        "AS v(dept_id, dept_name, dept_code, head_name, is_active)"
    )


# -- priorities ----------------------------------------------------------------------


@pytest.mark.parametrize(
    "base, freq, want",
    [(1, 0, 2), (4, 0, 4), (3, 1, 4), (3, 2, 3), (3, 4, 3), (3, 5, 2), (1, 5, 1), (3, 9, 2), (3, 10, 1), (4, 10, 1)],
)
def test_frequency_priority(spark, base, freq, want):
    row = spark.range(1).select(L.frequency_priority(F.lit(base), F.lit(freq)).alias("p")).first()
    assert row["p"] == want


def test_assign_priority_counts_the_closed_30_day_window_and_peers(frame, cat):
    rows = [
        (1, 1, 7, "2024-05-01 00:00:00"),
        (2, 1, 7, "2024-05-31 00:00:00"),  # exactly 30 days after 1: counts it
        (3, 1, 7, "2024-05-31 00:00:00"),  # same instant as 2: peers count each other
        (4, 1, 7, "2024-05-31 00:00:01"),  # 1 is out by a second
        (5, 2, 7, "2024-05-31 00:00:01"),  # other category
    ]
    r = frame("request_id BIGINT, cat_id INT, location_id INT, submitted_at TIMESTAMP_NTZ", rows)
    out = L.assign_priority(r, cat)
    assert table(out, "request_id", "frequency_30d", "priority_id") == [(1, 0, 2), (2, 2, 1), (3, 2, 1), (4, 2, 1), (5, 0, 4)]


def test_assign_priority_as_of_leaves_out_the_request_itself(frame, cat):
    rows = [(1, 1, 7, "2024-06-01 00:00:00"), (2, 1, 7, "2024-05-31 23:59:59"), (3, 1, 7, "2024-06-20 00:00:00")]
    r = frame("request_id BIGINT, cat_id INT, location_id INT, submitted_at TIMESTAMP_NTZ", rows)
    out = L.assign_priority(r, cat, AS_OF)
    assert table(out, "request_id", "frequency_30d") == [(1, 1), (2, 2), (3, 1)]


def test_boost_and_sentiment_priority(frame, cat):
    rows = [(1, 2, 4, "critical"), (2, 2, 4, "high"), (3, 2, 1, "high"), (4, 2, 4, "medium"), (5, 1, 1, None)]
    r = frame("request_id BIGINT, cat_id INT, priority_id INT, urgency_level STRING", rows)
    assert table(L.boost_priority(r), "request_id", "priority_id", "auto_priority_boosted") == [
        (1, 1, 1), (2, 2, 1), (3, 1, 1), (4, 4, 0), (5, 1, 0),
    ]
    assert table(L.sentiment_priority(r, cat), "request_id", "priority_id", "auto_priority_boosted") == [
        (1, 1, 1), (2, 2, 1), (3, 2, 1), (4, 3, 1), (5, 1, 0),
    ]


# -- reports -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def hot(frame):
    rows = []
    for n in range(17):  # location 1: 15 live, 1 closed, 1 too old; location 2: 14 live
        status = "closed" if n == 15 else "pending"
        at = "2024-05-31 23:59:59" if n == 16 else "2024-06-01 00:00:00"
        rows.append((n, 1, 1, status, at, 0, 2))
    rows += [(100 + n, 1, 2, "pending", "2024-06-30 12:00:00", 0, 3) for n in range(14)]
    return frame(
        "request_id BIGINT, cat_id INT, location_id INT, status STRING, submitted_at TIMESTAMP_NTZ, is_hotspot_flag INT, priority_id INT",
        rows,
    )


def test_flag_hotspots(hot):
    flagged, log = L.flag_hotspots(hot, AS_OF)
    assert flagged.filter("is_hotspot_flag = 1").count() == 15
    assert flagged.filter("is_hotspot_flag = 1 AND (status = 'closed' OR location_id = 2)").count() == 0
    row = log.collect()
    assert [(r.entity_id, r.meta_json) for r in row] == [(1, '{"complaint_count":15,"window_days":30}')]


def test_hotspots_report_keeps_closed_ones(spark, hot, cat):
    loc = spark.sql("SELECT * FROM VALUES (1,'W1','A','N',1.0,2.0),(2,'W2','B','S',1.0,2.0) AS v(location_id, ward_number, area_name, zone, latitude, longitude)")
    out = Q.hotspots(hot, loc, cat, AS_OF).collect()
    assert [(r.location_id, r.total_30d, r.top_categories, r.high_priority_count) for r in out] == [(1, 16, "Water Supply Issue", 16)]


def test_sla_edges_and_empty_department(frame, dept, pri):
    rows = [
        (1, 1, "resolved", 4.0, 1), (2, 1, "resolved", 4.01, 1), (3, 1, "closed", 3.99, 1), (4, 1, "closed", None, 1),
        (5, 2, "pending", None, 2),
    ]
    r = frame("request_id BIGINT, dept_id INT, status STRING, resolution_hours DOUBLE, priority_id INT", rows)
    out = {x.dept_id: x for x in Q.department_performance(r, dept, pri).collect()}
    assert (out[1].total_assigned, out[1].resolved, out[1].within_sla, out[1].sla_compliance_pct) == (4, 4, 2, 50.0)
    assert (out[2].resolution_rate_pct, out[2].sla_compliance_pct) == (0.0, None)
    assert (out[3].total_assigned, out[3].within_sla, out[3].resolution_rate_pct) == (0, 0, None)
    level = Q.sla_compliance(r, pri).collect()
    assert [(x.priority_id, x.total_requests, x.within_sla, x.breached_sla) for x in level] == [(1, 3, 2, 1)]


def test_age_truncates_and_breach_needs_more_than_the_sla(frame, pri):
    rows = [(1, "2024-06-30 22:00:01", 1, "pending"), (2, "2024-06-30 22:00:00", 1, "pending"),
            (3, "2024-06-30 20:00:00", 1, "pending"), (4, "2024-06-30 19:00:00", 1, "pending"), (5, "2024-06-30 19:00:00", 1, "closed")]
    r = frame("request_id BIGINT, submitted_at TIMESTAMP_NTZ, priority_id INT, status STRING", rows).withColumn("code", F.lit("C"))
    aged = r.join(pri, "priority_id").select("request_id", J.age_hours(AS_OF).alias("age"), J.is_breached(AS_OF).alias("late"))
    assert table(aged, "request_id", "age", "late") == [(1, 1, 0), (2, 2, 0), (3, 4, 0), (4, 5, 1), (5, 5, 0)]
    assert [x.entity_id for x in L.sla_breaches(r, pri, AS_OF).collect()] == [4]


def test_iso_week_edges(frame):
    days = frame("d TIMESTAMP_NTZ", [("2024-12-29 23:59:59",), ("2024-12-30 00:00:00",), ("2027-01-01 00:00:00",)])
    assert [r[0] for r in days.select(X.iso_yearweek("d")).collect()] == [202452, 202501, 202653]


def test_weekly_label_uses_the_first_request(frame):
    rows = [(1, "2024-06-26 10:00:00", "resolved"), (2, "2024-06-30 10:00:00", "pending")]
    r = frame("request_id BIGINT, submitted_at TIMESTAMP_NTZ, status STRING", rows)
    out = Q.weekly_resolution(r, AS_OF).collect()
    assert [(x.year_week, x.week_label, x.submitted, x.resolution_rate_pct) for x in out] == [(202426, "Week of 26 Jun", 2, 50.0)]


def test_kpi_on_an_empty_table_is_zero_not_null(frame):
    r = frame("status STRING, priority_id INT, is_hotspot_flag INT, submitted_at TIMESTAMP_NTZ, resolution_hours DOUBLE", [])
    row = Q.kpi_summary(r, AS_OF).first()
    assert (row.total_requests, row.total_pending, row.avg_resolution_hrs, row.overall_resolution_pct) == (0, 0, None, None)


def test_top_n_other_keeps_the_total(frame):
    rows = [(k,) for k in "aaabbcddddeeeeef" + "g"]
    out = dict(tuple(r) for r in Q.top_n_other(frame("k STRING", rows), "k", 3).collect())
    assert out == {"e": 5, "d": 4, "a": 3, "Others": 5}


# -- incidents -----------------------------------------------------------------------


def _zone_inputs(spark, crimes, asks):
    """Location n has crimes[n] incidents and asks[n] requests."""
    places = range(1, len(crimes) + 1)
    loc = spark.createDataFrame([(p, "a", "w", "z", 1.0, 2.0) for p in places], "location_id INT, area_name STRING, ward_number STRING, zone STRING, latitude DOUBLE, longitude DOUBLE")
    inc = spark.createDataFrame([(p, 1, "night", None) for p, n in zip(places, crimes) for _ in range(n)], "location_id INT, crime_type_id INT, time_of_day STRING, incident_hour INT")
    req = spark.createDataFrame([(p, 2) for p, n in zip(places, asks) for _ in range(n)], "location_id INT, cat_id INT")
    inc = inc.withColumn("incident_date", F.lit("2024-06-15").cast("date"))
    req = req.withColumn("submitted_at", F.lit("2024-06-15 00:00:00").cast("timestamp_ntz"))
    types = spark.sql("SELECT 1 AS crime_type_id, 'moderate' AS severity")
    return loc, inc, req, types


def test_hotspot_zone_levels(spark):
    loc, inc, req, types = _zone_inputs(spark, [2, 3, 5, 6, 9, 10, 0, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 4, 5, 9, 10, 14, 15, 0])
    out = {r.location_id: r.hotspot_level for r in I.hotspot_zones(req, inc, types, loc, AS_OF, AS_OF).collect()}
    assert out == {1: "normal", 2: "moderate", 3: "moderate", 4: "high", 5: "high", 6: "critical", 7: "normal", 8: "moderate",
                   9: "moderate", 10: "high", 11: "high", 12: "critical"}


def test_safety_score_and_level_disagree(spark):
    loc, inc, req, types = _zone_inputs(spark, [0, 30, 5, 10], [0, 0, 1, 80])
    out = {r.location_id: (r.safety_score, r.risk_level) for r in I.safety_scores(req, inc, types, loc, AS_OF, AS_OF).collect()}
    assert out == {1: (100.0, "very_low"), 2: (0.0, "critical"), 3: (79.5, "low"), 4: (20.0, "low")}


def test_location_risk_caps_at_100(spark, cat):
    loc, inc, req, types = _zone_inputs(spark, [1, 20], [3, 0])
    out = {r.location_id: (r.risk_score, r.street_light_issues) for r in I.location_risk(req, inc, cat, loc, AS_OF, AS_OF).collect()}
    assert out == {1: (13.0, 3), 2: (100.0, 0)}


def test_risk_levels(spark):
    scores = spark.createDataFrame([(x,) for x in (29.99, 30.0, 54.99, 55.0, 74.99, 75.0, 100.0)], "s DOUBLE")
    assert [r[0] for r in scores.select(I.risk_level("s")).collect()] == ["low", "medium", "medium", "high", "high", "critical", "critical"]


@pytest.mark.parametrize(
    "preset, want",
    [
        ("schema", ["night", "night", "dawn", "dawn", "morning", "afternoon", "evening", "evening", "night", "unknown"]),
        ("api", ["night", "night", "night", "morning", "morning", "afternoon", "evening", "evening", "night", "unknown"]),
        ("forecast", ["night", "night", "night", "night", "morning", "afternoon", "afternoon", "evening", "night", "unknown"]),
    ],
)
def test_time_of_day(spark, preset, want):
    hours = spark.createDataFrame([(h,) for h in (0, 3, 4, 5, 8, 12, 17, 20, 21, None)], "h INT")
    assert [r[0] for r in hours.select(X.time_of_day("h", preset)).collect()] == want


# -- text ----------------------------------------------------------------------------


def _urgency(spark, text, compound=None):
    docs = spark.createDataFrame([(1, text, compound)], "doc_id BIGINT, text STRING, compound DOUBLE")
    return T.score_urgency(docs, compound="compound").first()


def test_urgency_levels(spark):
    assert _urgency(spark, "URGENT help").urgency_level == "critical"
    assert _urgency(spark, "leakage in the cellar").keywords_found == ["leak"]
    assert _urgency(spark, "leakage in the cellar").urgency_level == "high"
    assert _urgency(spark, "a problem here").urgency_level == "low"
    assert _urgency(spark, "a problem here!!!!!!!!!").anger_level == 3.5
    assert _urgency(spark, "a problem here!!!!!!!!!").urgency_level == "medium"
    empty = _urgency(spark, "")
    assert (empty.urgency_level, empty.anger_level, empty.keywords_found, empty.confidence) == ("low", 0.0, [], 0.55)
    assert _urgency(spark, None).priority_recommendation == 4
    assert _urgency(spark, "calm", -1.0).urgency_level == "critical"
    assert _urgency(spark, "calm", -0.75).urgency_level == "high"
    assert _urgency(spark, "broken, critical, severe", -0.9).emotional_intensity == 1.0


def test_suggest_categories(spark, cat):
    docs = spark.createDataFrame(
        [(1, "No water, low WATER pressure"), (2, "abc"), (3, "street light and dark road"), (4, "nothing known")],
        "doc_id BIGINT, text STRING",
    )
    out = T.suggest_categories(docs, cat).orderBy("doc_id", "rank").collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.cat_name, r.confidence))
    total = 3 + 9 * 0.1
    assert got[1] == [("Water Supply Issue", round(3 / total, 4)), ("Other", round(0.1 / total, 4)), ("Street Light Not Working", round(0.1 / total, 4))]
    assert 2 not in got
    assert got[3][0][0] == "Street Light Not Working"
    assert got[4][0] == ("Other", 0.1)


def test_normalize_label_precedence(spark):
    hints = spark.createDataFrame([(x,) for x in ("dark road light", "Light out", "traffic light", "", None, "Dump in the park")], "h STRING")
    assert [r[0] for r in hints.select(T.normalize_label("h")).collect()] == [
        "Pothole / Road Damage", "Street Light Not Working", "Street Light Not Working", "Other", "Other", "Park / Green Area Damage",
    ]


def test_polarity(spark):
    docs = spark.createDataFrame([(1, "bad, BAD day"), (2, "plain")], "doc_id BIGINT, text STRING")
    lex = spark.createDataFrame([("bad", -2.5)], "token STRING, value DOUBLE")
    out = dict(tuple(r) for r in T.polarity(docs, lex).select("doc_id", "compound").collect())
    assert out == {1: round(-5 / (25 + 15) ** 0.5, 4), 2: 0.0}


# -- estimates, geo --------------------------------------------------------------------


def test_eta_defaults_cap_and_floor(frame):
    schema = "request_id BIGINT, cat_id INT, location_id INT, dept_id INT, priority_id INT, status STRING, submitted_at TIMESTAMP_NTZ, resolved_at TIMESTAMP_NTZ"
    new = frame(schema, [(1, 1, 1, 1, 3, "pending", AS_OF, None), (2, 1, 1, 2, 3, "pending", AS_OF, None), (3, 9, 9, 3, 1, "pending", AS_OF, None)])
    hist = [(10 + n, 5, 5, 1, 3, "assigned", AS_OF, None) for n in range(51)] + [(100 + n, 5, 5, 2, 3, "pending", AS_OF, None) for n in range(52)]
    hist += [(500, 9, 9, 4, 1, "resolved", "2024-01-01 00:00:00", "2024-01-01 01:59:00")]
    out = {r.request_id: (r.predicted_hours, r.range_low, r.range_high) for r in PR.predict_eta(new, frame(schema, hist)).collect()}
    base = 24 * 0.6 + 30 * 0.4
    assert out[1] == (pytest.approx(base + 51 * 0.35, abs=0.06), pytest.approx((base + 17.85) * 0.8, abs=0.06), pytest.approx((base + 17.85) * 1.2, abs=0.06))
    assert out[2][0] == pytest.approx(base + 18, abs=0.06)
    assert out[3] == (2.0, 1.0, 4.0)  # one truncated hour at the highest priority


def test_geo_limits(spark):
    rows = [(1, 18.0, 73.0, None, None, 18.0, 73.0099), (2, 18.0, 73.0, None, None, 18.0, 73.02), (3, None, None, 18.0, 73.0, 18.0, 73.0),
            (4, None, None, None, None, 18.0, 73.0), (5, 19.0, 73.0, 18.0, 73.0, 18.0, 73.0)]
    df = spark.createDataFrame(rows, "id INT, photo_lat DOUBLE, photo_lng DOUBLE, meta_lat DOUBLE, meta_lng DOUBLE, request_lat DOUBLE, request_lng DOUBLE")
    assert table(G.gps_verified(df), "id", "gps_verified") == [(1, 1), (2, 0), (3, 1), (4, None), (5, 0)]
    dms = spark.createDataFrame([(18.0, 30.0, 36.0, "N"), (73.0, 30.0, 0.0, "W"), (1.0, 0.0, 0.0, "S")], "d DOUBLE, m DOUBLE, s DOUBLE, r STRING")
    assert [r[0] for r in dms.select(G.dms_to_degrees("d", "m", "s", "r")).collect()] == [18.51, -73.5, -1.0]


def test_gps_check_uses_the_newest_photo_and_500_m(spark, frame):
    metre = 1 / 111_194.93
    photos = frame("photo_id BIGINT, request_id BIGINT, uploaded_at TIMESTAMP_NTZ, photo_lat DOUBLE, photo_lng DOUBLE",
                   [(1, 1, "2024-01-01 00:00:00", 10.0, 10.0), (2, 1, "2024-01-02 00:00:00", 18 + 499 * metre, 73.0), (3, 2, "2024-01-01 00:00:00", 18 + 501 * metre, 73.0)])
    r = spark.sql("SELECT * FROM VALUES (1L, 1), (2L, 1) AS v(request_id, location_id)")
    loc = spark.sql("SELECT 1 AS location_id, 18.0D AS latitude, 73.0D AS longitude")
    assert table(G.gps_check(photos, r, loc), "photo_id", "is_match", "flag_reason") == [(2, 1, None), (3, 0, "gps_mismatch")]


# -- notifications -----------------------------------------------------------------------


def test_schedule(frame):
    moments = ["2024-06-01 21:59:00", "2024-06-01 22:00:00", "2024-06-02 06:59:00", "2024-06-02 07:00:00"]
    n = frame("id INT, user_id BIGINT, is_critical INT, at TIMESTAMP_NTZ",
              [(k, 1, 0, m) for k, m in enumerate(moments)] + [(10, 2, 0, moments[1]), (11, 3, 0, "2024-06-02 03:00:00"), (12, 3, 0, moments[1]), (13, 1, 1, moments[1]), (14, 9, 0, moments[1])])
    prefs = frame("user_id BIGINT, preferred_hour INT, quiet_hours_enabled INT, quiet_start_hour INT, quiet_end_hour INT",
                  [(1, 0, 1, 22, 7), (2, 0, 0, 22, 7), (3, 20, 1, 1, 5)])
    out = {r.id: r.scheduled_at for r in N.schedule(n, prefs, F.col("at")).collect()}
    assert out == {
        0: ts("2024-06-02 00:00:00"), 1: ts("2024-06-02 07:00:00"), 2: ts("2024-06-02 07:00:00"), 3: ts("2024-06-03 00:00:00"),
        10: ts("2024-06-02 00:00:00"), 11: ts("2024-06-02 05:00:00"), 12: ts("2024-06-02 20:00:00"), 13: ts("2024-06-01 22:00:00"),
        14: ts("2024-06-02 07:00:00"),
    }


def test_retry_limit(frame):
    q = frame("queue_id BIGINT, user_id BIGINT, request_id BIGINT, template_key STRING, attempts INT, max_attempts INT",
              [(1, 1, 1, "t", 3, 5), (2, 1, 1, "t", 4, 5), (3, 1, 1, "t", 4, 5)])
    res = frame("queue_id BIGINT, ok BOOLEAN, error STRING", [(1, False, None), (2, False, "x"), (3, True, None)])
    state, log = N.apply_outcomes(q, res, AS_OF)
    assert table(state, "queue_id", "status", "attempts", "last_error") == [(1, "queued", 4, "send_failed"), (2, "failed", 5, "x"), (3, "sent", 5, None)]
    assert log.count() == 3


def test_templates(spark, frame):
    q = frame("queue_id BIGINT, template_key STRING, name STRING", [(1, "complaint_assigned", "{{secret}} $1"), (2, "no_such_key", None)])
    own = spark.sql("SELECT 'complaint_assigned' AS template_key, 'Hi {{ name }}!' AS subject_template, '' AS html_template, 1 AS is_active")
    out = {r.queue_id: r.subject for r in N.render(q, own, {"name": "name"}).collect()}
    assert out == {1: "Hi {{secret}} $1!", 2: "Complaint Received - "}
    kept = N.ensure_templates(own)
    assert kept.count() == len(N.DEFAULT_TEMPLATES)
    assert kept.filter("subject_template = 'Hi {{ name }}!'").count() == 1


# -- tables --------------------------------------------------------------------------------


def test_upsert_is_idempotent_and_newest_wins(frame):
    base = frame("k INT, v STRING, at INT", [(1, "a", 0), (2, "b", 0)])
    delta = frame("k INT, v STRING, at INT", [(2, "old", 1), (2, "new", 2), (3, "c", 1)])
    once = S.upsert(base, delta, ["k"], "at")
    assert table(once, "k", "v") == [(1, "a"), (2, "new"), (3, "c")]
    assert table(S.upsert(once, delta, ["k"], "at"), "k", "v") == table(once, "k", "v")


def test_jdbc_options_and_schema_tools(spark):
    opts = S.jdbc_options("jdbc:x", "complaints", "complaint_id", 1, 100, 8)
    assert (opts["numPartitions"], opts["partitionColumn"], opts["upperBound"]) == ("8", "complaint_id", "100")
    with pytest.raises(ValueError):
        S.jdbc_options("jdbc:x", "t", "c", 5, 1, 8)
    assert S.has_columns(spark.range(1), "id") and not S.has_columns(spark.range(1), "id", "x")
    assert not S.table_exists(spark, "no_such_table")


def test_csv_quotes_are_escaped(spark, tmp_path):
    row = ("C-1", 'He said "hi", twice', "cat", "area", "dept", "High", "pending", 5)
    names = ["code", "title", "category", "area_name", "department", "priority_name", "status", "age_hours"]
    S.export_csv(spark.createDataFrame([row], names), str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).first()
    assert (back["Title"], back["Age(h)"]) == (row[1], "5")


def test_search_treats_wildcards_as_text(frame):
    r = frame("title STRING, code STRING", [("100% broken", "A_1"), ("1000 broken", "AB1")])
    assert [x.title for x in P.search_requests(r, "100%").collect()] == ["100% broken"]
    assert [x.code for x in P.search_requests(r, "a_").collect()] == ["A_1"]


def test_lifecycle_events(frame):
    r = frame("request_id BIGINT, user_id BIGINT, status STRING, assigned_to BIGINT, assigned_at TIMESTAMP_NTZ, resolved_at TIMESTAMP_NTZ",
              [(1, 5, "pending", None, None, None), (2, 5, "pending", None, None, None)])
    ev = frame("request_id BIGINT, event_id BIGINT, new_status STRING, actor_id BIGINT, assigned_to BIGINT, event_at TIMESTAMP_NTZ",
               [(1, 2, "resolved", 9, None, "2024-01-02 00:00:00"), (1, 1, "assigned", 9, None, "2024-01-01 00:00:00"), (1, 3, "done", 9, None, "2024-01-03 00:00:00")])
    out, bad = L.apply_status_events(r, ev)
    assert table(out, "request_id", "status", "assigned_to", "resolved_at") == [(1, "resolved", 9, ts("2024-01-02")), (2, "pending", None, None)]
    assert [x.event_id for x in bad.collect()] == [3]
    assert [(x.old_status, x.new_status, x.updated_by) for x in L.status_audit(r, out).collect()] == [("pending", "resolved", 9)]


def test_quality_checks(frame):
    df = frame("k INT, s STRING, rating INT", [(1, "a", 0), (1, "  ", 5), (2, None, None)])
    assert table(D.check_unique(df, ["k"]), "k", "n") == [(1, 2)]
    assert D.check_domain(df, "s", ["a"]).count() == 2
    assert D.check_range(df, "rating", 1, 5).count() == 2
    assert D.check_required(df, "s").count() == 2


def test_percent_and_round_guards(spark):
    row = spark.range(1).select(M.pct(F.lit(1), F.lit(0)).alias("none"), M.pct(F.lit(1), F.lit(8)).alias("half_up")).first()
    assert (row.none, row.half_up) == (None, 12.5)


def test_duplicates_link_to_the_first(spark):
    rows = [(5, "w", "Broken lamp!"), (2, "w", "lamp, BROKEN"), (9, "x", "broken lamp"), (7, "w", "broken lamp lamp")]
    out = C.duplicate_requests(spark.createDataFrame(rows, "id BIGINT, ward STRING, text STRING"), "id", "text", ["ward"])
    assert table(out, "id", "original_id", "copies") == [(5, 2, 3), (7, 2, 3)]


def test_codes_do_not_truncate(frame):
    df = frame("n BIGINT", [(7,), (123456,)])
    assert [r[0] for r in df.select(X.code("CMP", F.lit(2024), "n")).collect()] == ["CMP-2024-00007", "CMP-2024-123456"]


def test_timeline_without_history(frame):
    r = frame("request_id BIGINT, status STRING, submitted_at TIMESTAMP_NTZ, assigned_at TIMESTAMP_NTZ, resolved_at TIMESTAMP_NTZ",
              [(1, "in_progress", AS_OF, None, None)])
    su = frame("request_id BIGINT, update_id BIGINT, new_status STRING, updated_at TIMESTAMP_NTZ", [])
    assert table(W.timeline(su, r), "step", "done", "is_current") == [("Assigned", 1, 0), ("In Progress", 1, 1), ("Resolved", 0, 0), ("Submitted", 1, 0)]
