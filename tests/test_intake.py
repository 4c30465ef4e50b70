"""Submissions: codes, twins inside a batch, retries."""

import datetime as dt

import pytest

from wardlight.operators.intake import Intake, earlier_twins, submit_requests
from wardlight.sources.store import Files

NOW = "2024-03-10 00:00:00"
CAT = "cat_id int, cat_name string, dept_id int, default_priority_id int, is_active boolean"
RAW = "raw_id long, user_id long, cat_id string, location_id string, title string, description string, submitted_at timestamp_ntz"
HISTORY = (
    "request_id long, cat_id int, location_id int, dept_id int, priority_id int, status string, submitted_at timestamp_ntz, "
    "resolved_at timestamp_ntz, resolution_hours double"
)


def at(day, hour=0):
    return dt.datetime(2024, 3, 1) + dt.timedelta(days=day, hours=hour)


@pytest.fixture(scope="module")
def cat(spark):
    return spark.createDataFrame([(1, "Water", 7, 3, True), (2, "Roads", 8, 2, True)], CAT)


@pytest.fixture(scope="module")
def prefs(spark):
    return spark.createDataFrame(
        [(1, 9, 1, 22, 7)], "user_id long, preferred_hour int, quiet_hours_enabled int, quiet_start_hour int, quiet_end_hour int"
    )


@pytest.fixture(scope="module")
def history(spark):
    rows = [(k, 1, 5, 7, 3, "resolved", at(-20), at(-19), 24.0) for k in range(3)] + [(9, 1, 5, 7, 3, "pending", at(-40), None, None)]
    return spark.createDataFrame(rows, HISTORY)


def raw_rows():
    rows = [(100 - k, k, "1", "5", "item", f"text {k}", at(9 + k // 20)) for k in range(40)]  # ids against the order of users
    rows += [(200, 1, "9", "5", "t", "d", at(9)), (201, 1, "1", None, "t", "d", at(9)), (202, 1, "2", "5", "t", "fire, urgent", at(9))]
    return rows


def test_twins_come_before_the_row(spark, cat, history):
    batch = spark.createDataFrame(raw_rows(), RAW)
    out, rejected = submit_requests(batch, cat, history, NOW)
    got = {r.raw_id: r for r in out.collect()}
    rows = sorted((r[6], r[0]) for r in raw_rows() if r[2] == "1" and r[3])
    for n, (when, i) in enumerate(rows):
        stored = 3 if at(-20) >= when - dt.timedelta(days=30) else 0
        assert got[i].frequency_30d == n + stored, i
    assert got[rows[0][1]].priority_id == 3
    assert got[rows[-1][1]].priority_id == 1
    assert sorted(r.request_id for r in got.values()) == list(range(1, 42))
    order = sorted(got.values(), key=lambda r: (r.submitted_at, r.raw_id))
    assert [r.code for r in order] == [f"CMP-2024-{n:05}" for n in range(1, 42)]
    assert {r.reject_reason for r in rejected.collect()} == {"invalid category", "missing required field"}


def test_twins_beyond_the_window(spark, history):
    rows = [(k, 1, 5, at(20 * k)) for k in range(5)]
    batch = spark.createDataFrame(rows, "id long, cat_id int, location_id int, submitted_at timestamp_ntz")
    got = dict(earlier_twins(batch, history, "id", 30).select("id", "frequency_30d").collect())
    assert got == {0: 3, 1: 1, 2: 1, 3: 1, 4: 1}


def test_batches_equal_one(spark, cat, prefs, history, tmp_path, monkeypatch):
    raw = spark.createDataFrame(raw_rows(), RAW)
    names = ["raw_id", "request_id", "code", "frequency_30d", "priority_id", "auto_priority_boosted"]
    whole = Intake(spark, str(tmp_path / "one"), cat, prefs, 500)
    whole.submit(raw, history, NOW)
    parts = Intake(spark, str(tmp_path / "two"), cat, prefs, 500)
    early = raw.submitted_at < at(10)
    parts.submit(raw.filter(early), history, NOW, 0)

    publish = Files.publish
    monkeypatch.setattr(Files, "publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        parts.submit(raw.filter(~early), history, NOW, 1)
    monkeypatch.setattr(Files, "publish", publish)
    parts.submit(raw.filter(~early), history, NOW, 1)
    parts.submit(raw.filter(~early), history, NOW, 1)
    assert sorted(parts.requests().select(names).collect()) == sorted(whole.requests().select(names).collect())
    assert min(r.request_id for r in parts.requests().collect()) == 501
    assert parts.rejected().count() == 2
    told = parts.receipts().collect()
    assert len(told) == 41 and {r.template_key for r in told} == {"complaint_received"}
    assert {r.scheduled_at for r in told} == {at(9), at(10)}  # at once, in quiet hours too


def test_nothing_to_submit(spark, cat, prefs, history, tmp_path):
    intake = Intake(spark, str(tmp_path / "none"), cat, prefs)
    assert intake.requests() is None
    intake.submit(spark.createDataFrame([], RAW), history, NOW)
    assert intake.requests().count() == 0 and intake.store.manifest()["notes"]["last_number"] == 0
