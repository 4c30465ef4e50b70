"""Streams fed in several files: batch equality, late rows, restarts and exactly-once keys."""

import datetime as dt

import pytest

from wardlight.operators.windows import status_transitions
from wardlight.sources.store import Files, KeyedTable
from wardlight.streaming import jobs as X
from wardlight.streaming.audit import StatusAudit

EVENT = "request_id long, event_id long, new_status string, event_at timestamp"


def at(minute, day=1):
    return dt.datetime(2024, 1, day, minute // 60, minute % 60)


def put(spark, path, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def plain(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def src(tmp_path):
    return tmp_path / "in"


def audit_run(spark, audit, src, ckpt, files=1):
    stream = X.read_stream(spark, str(src), spark.createDataFrame([], EVENT).schema, files)
    audit.run(stream, str(ckpt)).awaitTermination()


TRANSITION = ["request_id", "event_id", "old_status", "new_status"]


def test_audit_over_restarts(spark, src, tmp_path):
    ckpt, path = tmp_path / "ckpt", str(tmp_path / "audit")
    # out of order inside one file; the last hour waits
    put(spark, src, EVENT, [(1, 2, "assigned", at(2)), (1, 1, "pending", at(1)), (2, 3, "pending", at(1)), (3, 8, "open", at(61))])
    audit_run(spark, StatusAudit(spark, path, buckets=4), src, ckpt)
    audit = StatusAudit(spark, path, buckets=4)
    assert plain(audit.transitions().select(*TRANSITION)) == []
    assert audit.waiting().count() == 2  # 2 and 8; the watermark stands at minute 1
    # an event older than the last one of its request, but inside the hour, takes its place
    put(spark, src, EVENT, [(1, 4, "assigned", at(90)), (1, 5, "resolved", at(30)), (2, 6, "closed", at(100)), (2, 9, "rejected", at(0)), (4, 7, "open", None)])
    audit_run(spark, audit, src, ckpt)
    assert plain(audit.transitions().select(*TRANSITION)) == [(1, 2, "pending", "assigned"), (1, 5, "assigned", "resolved")]
    assert {r.event_id for r in audit.late().collect()} == {9, 7}
    audit.flush()
    done = plain(audit.transitions().select(*TRANSITION))
    assert done == [(1, 2, "pending", "assigned"), (1, 4, "resolved", "assigned"), (1, 5, "assigned", "resolved"), (2, 6, "pending", "closed")]
    assert audit.waiting().count() == 0
    audit_run(spark, audit, src, ckpt)
    audit.flush()
    assert plain(audit.transitions().select(*TRANSITION)) == done


def test_audit_does_not_depend_on_files(spark, tmp_path):
    """One file, and 2,000 files in any order over two micro-batches, with a hot request."""
    n = 6_000
    rows = [(0 if k % 3 else k % 40, k, "abc"[(k * 7 // 5) % 3], dt.datetime(2024, 1, 1) + dt.timedelta(seconds=37 * ((k * 7919) % n))) for k in range(n)]
    df = spark.createDataFrame(rows, EVENT)
    want = plain(status_transitions(df).select(*TRANSITION))
    for name, files in (("one", 1), ("many", 2_000)):
        df.repartition(files).write.parquet(str(tmp_path / name))
        audit = StatusAudit(spark, str(tmp_path / f"{name}-audit"), 3 * 24 * 3600, buckets=4)
        audit_run(spark, audit, tmp_path / name, tmp_path / f"{name}-ckpt", 1_000)
        assert audit.late().count() == 0
        audit.flush()
        assert plain(audit.transitions().select(*TRANSITION)) == want


def test_audit_killed_before_its_manifest(spark, src, tmp_path, monkeypatch):
    put(spark, src, EVENT, [(1, 1, "a", at(0)), (1, 2, "b", at(1)), (1, 3, "a", at(2)), (9, 4, "z", at(200))])
    audit = StatusAudit(spark, str(tmp_path / "audit"), buckets=4)
    events = spark.read.parquet(str(src))
    monkeypatch.setattr(Files, "publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        audit.fold(events, 0)
    monkeypatch.undo()
    assert audit.transitions().count() == 0
    audit.fold(events, 0)
    audit.fold(events, 0)  # delivered again
    assert plain(audit.transitions().select(*TRANSITION)) == [(1, 2, "a", "b"), (1, 3, "b", "a")]


def test_streams_read_their_own_path_only(spark, tmp_path):
    put(spark, tmp_path / "in", "a long", [(1,)])
    put(spark, tmp_path / "in_old", "a long", [(2,)])
    schema = spark.createDataFrame([], "a long").schema
    assert plain(X.run_to_table(X.read_stream(spark, str(tmp_path / "in"), schema), "own")) == [(1,)]


def test_sla_deadline_edges(spark, tmp_path):
    asked, done = tmp_path / "asked", tmp_path / "done"
    sub = "request_id long, submitted_at timestamp, sla_hours int"
    res = "request_id long, resolved_at timestamp"
    put(spark, asked, sub, [(1, at(0), 4), (2, at(0), 4), (3, at(0), 4), (5, at(0, 20), 4), (9, at(0, 25), 4)])
    put(spark, done, res, [(1, at(240)), (2, at(241)), (99, at(0, 22))])
    s = X.read_stream(spark, str(asked), spark.createDataFrame([], sub).schema)
    r = X.read_stream(spark, str(done), spark.createDataFrame([], res).schema)
    out = X.run_to_table(X.stream_sla(s, r, 4), "sla")
    # 1 is answered on the minute; 2 a minute late; 3 never; 5 is overdue; 9 is not due yet
    assert [x.request_id for x in out.orderBy("request_id").collect()] == [2, 3, 5]


def test_hotspots_equal_batch(spark, src):
    schema = "location_id int, at timestamp"
    rows = [(k % 3, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k * 5)) for k in range(100)]
    put(spark, src, schema, rows)
    stream = X.read_stream(spark, str(src), spark.createDataFrame([], schema).schema)
    got = X.run_to_table(X.stream_hotspots(stream, "at", 5, 3), "hot")
    last = rows[-1][1] - dt.timedelta(hours=1)
    want = set()
    day = dt.datetime(2023, 12, 29)
    while day + dt.timedelta(days=3) <= last:
        end = day + dt.timedelta(days=3)
        for loc in range(3):
            n = sum(1 for l, t in rows if l == loc and day <= t < end)
            if n >= 5:
                want.add((end, loc, n))
        day += dt.timedelta(days=1)
    assert {(r.window_end, r.location_id, r.request_count) for r in got.collect()} == want


def test_late_rows_are_dropped_and_keys_enqueued_once(spark, src, tmp_path):
    schema = "idempotency_key string, scheduled_at timestamp"
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")

    def run():
        stream = X.read_stream(spark, str(src), spark.createDataFrame([], schema).schema, 1)
        return X.run_to_table(X.stream_enqueue(stream, delay="1 hour"), "queue", out, ckpt)

    put(spark, src, schema, [("a", at(0, 5)), ("a", at(1, 5)), ("b", at(0, 5))])
    assert plain(run().select("idempotency_key")) == [("a",), ("b",)]
    put(spark, src, schema, [("a", at(2, 5)), ("c", at(3, 5)), ("old", at(0, 1))])
    assert plain(run().select("idempotency_key")) == [("a",), ("b",), ("c",)]


def test_presence_gap(spark, src):
    schema = "user_id long, at timestamp"
    put(spark, src, schema, [(1, at(0)), (1, at(1)), (1, at(4)), (2, at(0)), (3, at(0, 9))])
    stream = X.read_stream(spark, str(src), spark.createDataFrame([], schema).schema)
    out = X.run_to_table(X.stream_presence(stream, "at", "2 minutes"), "presence")
    assert plain(out.select("user_id", "session_start", "heartbeats")) == [(1, at(0), 2), (1, at(4), 1), (2, at(0), 1)]


def test_kpi_in_update_mode(spark, src, tmp_path):
    schema = "status string, at timestamp"
    put(spark, src, schema, [("pending", at(0)), ("resolved", at(5)), ("closed", at(0, 2))])
    stream = X.read_stream(spark, str(src), spark.createDataFrame([], schema).schema)
    query = X.stream_kpi(stream, "at").writeStream.format("memory").queryName("kpi_cards").outputMode("update")
    query = query.option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert plain(spark.table("kpi_cards").select("total", "waiting", "resolved")) == [(1, 0, 1), (2, 1, 1)]


def test_last_write_wins(spark):
    rows = [(1, "f", "x", 1, 1), (1, "f", "y", 2, 2), (1, "f", "z", 2, 1), (2, "f", "w", 0, 1)]
    edits = spark.createDataFrame(rows, "id int, field string, value string, ts int, n int")
    assert plain(X.merge_lww(edits, ["id", "field"], "value", "ts", "n")) == [(1, "f", "y", 2), (2, "f", "w", 0)]


def test_merge_stream_keeps_the_newest_edit(spark, src, tmp_path):
    schema = "id long, field string, value string, ts long"
    kind = spark.createDataFrame([], schema).schema
    table = KeyedTable(spark, str(tmp_path / "fields"), kind, ["id", "field"], ["ts"], 4)

    def run():
        X.stream_merge(X.read_stream(spark, str(src), kind, 1), table, str(tmp_path / "ckpt")).awaitTermination()

    put(spark, src, schema, [(1, "f", "new", 5), (1, "g", "a", 1), (None, "f", "n", 1)])
    run()
    put(spark, src, schema, [(1, "f", "older", 4), (1, "g", "b", 2), (2, "f", "c", 1), (None, "f", "m", 2)])
    run()
    assert sorted((tuple(r) for r in table.read().collect()), key=str) == [(1, "f", "new", 5), (1, "g", "b", 2), (2, "f", "c", 1), (None, "f", "m", 2)]
    version = table.store.manifest()["version"]
    run()
    assert table.store.manifest()["version"] == version


def test_state_partitions_put_back(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    with X.state_partitions(spark, 33):
        assert spark.conf.get(name) == "33"
    assert spark.conf.get(name) == before
    with X.state_partitions(spark, None):
        assert spark.conf.get(name) == before
