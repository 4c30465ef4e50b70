"""Rows in = rows out + rejects, with NULL keys, unknown keys and long values."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from wardlight.operators import lifecycle as L
from wardlight.operators import notify as N
from wardlight.operators import text as T
from wardlight.operators import windows as W

AT = "2024-01-01 10:00:00"


@pytest.fixture
def timed(frame):
    rows = [(1, 7, AT, "a"), (2, 7, "2024-01-02 10:00:00", "b"), (3, None, AT, "c"), (4, None, "2024-01-03 10:00:00", "d"), (5, 7, None, "e")]
    return frame("id BIGINT, key BIGINT, at TIMESTAMP_NTZ, status STRING", rows)


def test_trailing_count_keeps_rows_without_key_or_time(timed):
    got = {r.id: r.n for r in W.trailing_count(timed, ["key"], "at", 30, "n").collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0}


def test_chunked_lag_and_position_keep_rows(timed):
    lag = {r.id: r.before for r in W.chunked_lag(timed, ["key"], "at", "id", "status", "before").collect()}
    assert lag == {5: None, 1: "e", 2: "a", 3: None, 4: "c"}
    place = {r.id: r.position for r in W.ordered_position(timed, ["key"], "at", "id").collect()}
    assert place == {5: 1, 1: 2, 2: 3, 3: 1, 4: 2}


def test_priority_of_unknown_category_stays(spark):
    r = spark.sql("SELECT * FROM VALUES (1, 1, 1, TIMESTAMP_NTZ '2024-01-01 10:00:00'), (2, 99, 1, TIMESTAMP_NTZ '2024-01-01 10:00:00'), (3, CAST(NULL AS INT), 1, NULL) v(request_id, cat_id, location_id, submitted_at)")
    cat = spark.sql("SELECT 1 AS cat_id, 3 AS default_priority_id")
    got = {x.request_id: x.priority_id for x in L.assign_priority(r, cat).collect()}
    assert got == {1: 4, 2: None, 3: None}


def test_events_of_unknown_requests_are_rejected(spark):
    r = spark.sql("SELECT 1 AS request_id, 'pending' AS status, TIMESTAMP_NTZ '2024-01-01 10:00:00' AS resolved_at, TIMESTAMP_NTZ '2024-01-01 10:00:00' AS assigned_at, 5 AS assigned_to")
    events = spark.sql(
        "SELECT id AS event_id, request_id, s AS new_status, TIMESTAMP_NTZ '2024-01-02 10:00:00' AS event_at, 1 AS actor_id, CAST(NULL AS INT) AS assigned_to "
        "FROM VALUES (1, 1, 'resolved'), (2, 9, 'resolved'), (3, CAST(NULL AS INT), 'closed'), (4, 1, 'nonsense') v(id, request_id, s)"
    )
    after, rejected = L.apply_status_events(r, events)
    assert [x.status for x in after.collect()] == ["resolved"]
    assert {x.event_id: x.reject_reason for x in rejected.collect()} == {2: "unknown request", 3: "unknown request", 4: "invalid status"}


def test_outcomes_keep_untried_rows_and_whole_errors(spark):
    q = spark.sql(
        "SELECT id AS queue_id, 1 AS user_id, 1 AS request_id, 'k' AS template_key, 'queued' AS status, 1 AS attempts, 5 AS max_attempts, "
        "CAST(NULL AS TIMESTAMP_NTZ) AS sent_at, CAST(NULL AS STRING) AS last_error FROM VALUES (1), (2), (3) v(id)"
    )
    results = spark.sql("SELECT * FROM VALUES (1, true, ''), (2, false, repeat('e', 2000)) v(queue_id, ok, error)")
    state, log = N.apply_outcomes(q, results, "2024-01-01 10:00:00")
    got = {x.queue_id: (x.status, x.attempts, x.last_error and len(x.last_error)) for x in state.collect()}
    assert got == {1: ("sent", 2, None), 2: ("queued", 2, 2000), 3: ("queued", 1, None)}
    assert Counter(x.queue_id for x in log.collect()) == {1: 1, 2: 1}


def test_frequency_cap_keeps_rows_without_values(frame):
    rows = [(1, 7, AT, "low"), (2, 7, AT, "low"), (3, 7, AT, "low"), (4, None, AT, "low"), (5, 7, None, "low"), (6, 7, AT, None), (7, 7, AT, "critical")]
    n = frame("queue_id BIGINT, user_id BIGINT, scheduled_at TIMESTAMP_NTZ, priority STRING", rows)
    got = {r.queue_id: r.delivery for r in N.cap_frequency(n).collect()}
    assert len(got) == 7 and got[7] == got[4] == got[5] == "immediate"
    assert Counter(got[i] for i in (1, 2, 3, 6)) == {"immediate": 2, "digest": 2}


def test_unknown_level_gets_a_channel(spark):
    n = spark.sql("SELECT * FROM VALUES (1, 'critical'), (2, 'odd'), (3, NULL) v(user_id, level)")
    off = spark.createDataFrame([], "user_id int, channel string")
    assert Counter(r.user_id for r in N.choose_channels(n, off).collect()) == {1: 2, 2: 1, 3: 1}


def test_missing_text_is_scored(spark):
    docs = spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'a'), (3, NULL) v(doc_id, text)")
    got = T.score_distinct(docs, lambda d: d.withColumn("size", F.length("text"))).collect()
    assert {r.doc_id: r.size for r in got} == {1: 1, 2: 1, 3: None}


def test_inactive_other_is_not_suggested(spark):
    cat = spark.sql("SELECT * FROM VALUES (1, 'Roads', 'i', true), (2, 'Other', 'i', false) v(cat_id, cat_name, icon_class, is_active)")
    got = T.label_categories(cat, ["x", "y"], {"x": "Roads"}).collect()
    assert [(r.label, r.cat_id) for r in got] == [("x", 1)]


def test_urgency_decides_without_a_category(frame):
    r = frame("request_id BIGINT, cat_id INT, urgency_level STRING", [(1, 1, "low"), (2, None, "high"), (3, 99, "critical"), (4, None, None)])
    cat = frame("cat_id INT, default_priority_id INT", [(1, 3)])
    out = {x.request_id: (x.priority_id, x.auto_priority_boosted) for x in L.sentiment_priority(r, cat).collect()}
    assert out == {1: (3, 0), 2: (2, 0), 3: (1, 0), 4: (4, 0)}


def test_rolling_keeps_missing_keys_and_days(frame):
    daily = frame("loc INT, day DATE, n BIGINT", [(None, "2024-01-01", 2), (None, "2024-01-02", 3), (1, "2024-01-02", 5), (1, None, 7)])
    out = {(x.loc, str(x.day)): x.rolling_n for x in W.rolling(daily, 3, keys=("loc",)).collect()}
    assert out == {(None, "2024-01-01"): 2, (None, "2024-01-02"): 5, (1, "2024-01-02"): 5, (1, "None"): None}


def test_timeline_keeps_history_without_a_request(frame):
    su = frame("request_id BIGINT, update_id BIGINT, new_status STRING, updated_at TIMESTAMP_NTZ",
               [(None, 1, "assigned", "2024-01-01 00:00:00"), (None, 2, "resolved", "2024-01-02 00:00:00"), (5, 3, "assigned", "2024-01-01 00:00:00")])
    r = frame("request_id BIGINT, status STRING, submitted_at TIMESTAMP_NTZ, assigned_at TIMESTAMP_NTZ, resolved_at TIMESTAMP_NTZ",
              [(5, "assigned", None, None, None)])
    out = sorted((str(x.request_id), x.step, x.is_current) for x in W.timeline(su, r).collect())
    assert out == [("5", "Assigned", 1), ("None", "Assigned", 0), ("None", "Resolved", 1)]
