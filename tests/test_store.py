"""Versioned tables and the queue worker: half-done changes, repeats and retries."""

import datetime as dt

import pytest

from wardlight.operators import notify as N
from wardlight.sources.store import Files, KeyedTable, Store
from wardlight.streaming import jobs as X
from wardlight.streaming.worker import QUEUE, QueueWorker

ROW = "k long, v string, at long"
NOW = "2024-01-01 12:00:00"


def plain(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


class Killed(Exception):
    pass


def kill_at(monkeypatch, name):
    """The next publication of a file of this folder fails."""
    publish = Files.publish

    def once(self, path, text):
        if f"/{name}/" in path:
            raise Killed
        publish(self, path, text)

    monkeypatch.setattr(Files, "publish", once)


# -- keyed tables -------------------------------------------------------------------


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], ROW).schema, ["k"], ["at"], 16)


def test_upsert_writes_touched_buckets_only(spark, table):
    assert table.read().count() == 0
    table.upsert(spark.range(400).selectExpr("id AS k", "'a' AS v", "0L AS at"))
    before = table.store.manifest()["tables"]["rows"]
    assert len(before) == 16
    table.upsert(spark.createDataFrame([(7, "b", 1), (7, "c", 3), (7, "d", 2)], ROW))
    after = table.store.manifest()["tables"]["rows"]
    assert [b for b in before if before[b] != after[b]] == [b for b in after if after[b] == 1] and sum(v == 1 for v in after.values()) == 1
    rows = dict((k, v) for k, v, _ in plain(table.read()))
    assert len(rows) == 400 and rows[7] == "c" and rows[8] == "a"


def test_failed_upsert_leaves_the_table(spark, table, monkeypatch):
    table.upsert(spark.createDataFrame([(1, "a", 1), (None, "n", 1)], ROW))
    kill_at(monkeypatch, "versions")
    with pytest.raises(Killed):
        table.upsert(spark.createDataFrame([(1, "b", 2), (2, "c", 2)], ROW))
    monkeypatch.undo()
    assert plain(table.read()) == [(1, "a", 1), (None, "n", 1)]
    table.upsert(spark.createDataFrame([(2, "d", 2), (None, "m", 2)], ROW))
    assert plain(table.read()) == [(1, "a", 1), (2, "d", 2), (None, "m", 2)]


def test_batches_fold_once_and_old_folders_go(spark, table):
    for batch in (0, 1, 1, 0, 2, 3, 4):
        table.upsert(spark.createDataFrame([(1, f"b{batch}", batch), (100 + batch, "x", 0)], ROW), batch)
    assert table.store.manifest()["version"] == 4
    assert plain(table.read())[0] == (1, "b4", 4) and table.read().count() == 6
    assert table.store.versions() == [3, 4]
    used = set(table.store.manifest()["tables"]["rows"].values())
    folders = {int(f[2:]) for f in table.store.files.names(f"{table.store.path}/rows")}
    assert used <= folders and min(folders) >= min(used | {3})


def test_buckets_stay_as_first_chosen(spark, table, tmp_path):
    table.upsert(spark.range(50).selectExpr("id AS k", "'a' AS v", "0L AS at"))
    again = KeyedTable(spark, str(tmp_path / "t"), table.schema, ["k"], ["at"], 3)
    assert again.store.buckets == 16
    again.upsert(spark.createDataFrame([(3, "b", 1)], ROW))
    assert again.read().count() == 50
    assert Store(spark, str(tmp_path / "none"), 3).buckets == 3


# -- queue worker -------------------------------------------------------------------


def queue_row(i, minute=0, priority="normal", user=1, request=1, template="complaint_received", **more):
    row = {f.name: None for f in QUEUE} | dict(
        queue_id=i, user_id=user, request_id=request, template_key=template, priority=priority, status="queued",
        scheduled_at=dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=minute), idempotency_key=f"k{i}", attempts=0, max_attempts=3,
    )
    return tuple((row | more).values())


class Server:
    """Records what was sent; queue ids in `down` fail."""

    def __init__(self, spark, down=()):
        self.spark, self.down, self.sent = spark, set(down), []

    def __call__(self, messages):
        rows = [(m.queue_id, m.message_key, m.recipient, m.subject) for m in messages.collect()]
        self.sent += sorted(rows)
        told = [(q, q not in self.down, f'"no"\n\\ {key}' if q in self.down else None) for q, key, *_ in rows if q != 66]
        return self.spark.createDataFrame(told, "queue_id long, ok boolean, error string")


@pytest.fixture
def make_worker(spark, tmp_path):
    usr = spark.createDataFrame([(1, "one@x"), (2, None), (3, "three@x")], "user_id long, email string")
    prefs = spark.createDataFrame([(3, "alt@x", 1)], "user_id long, preferred_email string, opted_out int")
    facts = spark.createDataFrame([(1, "REQ-1"), (2, "REQ-2")], "request_id long, code string")
    templates = spark.createDataFrame([], "template_key string, subject_template string, html_template string, is_active int")

    def make(server, **more):
        return QueueWorker(spark, str(tmp_path / "queue"), server, prefs, usr, templates, facts, {"complaint_code": "code"}, buckets=4, **more)

    return make


def states(worker):
    return {r.queue_id: (r.status, r.attempts, r.last_error) for r in worker.queue().collect()}


def test_worker_outcomes(spark, make_worker):
    server = Server(spark, down={2})
    worker = make_worker(server)
    rows = [queue_row(1), queue_row(2), queue_row(3, minute=1), queue_row(4, user=2), queue_row(5, user=3, template="complaint_assigned"),
            queue_row(6, user=3, request=2), queue_row(7, request=404), queue_row(8, user=None), queue_row(66)]
    worker.step(spark.createDataFrame(rows, QUEUE), NOW)
    first = states(worker)
    assert first[1] == ("sent", 1, None)
    assert first[2] == ("queued", 1, '"no"\n\\ k2:1')
    assert first[3] == ("queued", 0, None)  # scheduled later
    assert first[4] == ("failed", 1, "No recipient email") == first[8]
    assert first[5] == ("cancelled", 1, "User opted out")
    assert first[6] == ("sent", 1, None)
    assert first[7] == ("failed", 1, "Complaint not found")
    assert first[66] == ("queued", 1, "no outcome")
    worker.work_off(NOW)
    last = states(worker)
    assert last[2] == ("failed", 3, '"no"\n\\ k2:3') and last[66] == ("failed", 3, "no outcome")
    assert last[3] == ("queued", 0, None) and len(last) == 9
    assert [s[1] for s in server.sent if s[0] == 2] == ["k2:1", "k2:2", "k2:3"]
    assert ("alt@x", "Complaint Received - REQ-2") in {s[2:] for s in server.sent}
    log = worker.log()
    assert log.count() == len(server.sent) == 8
    told = {(r.queue_id, r.e) for r in log.filter("delivery_status = 'failed'").selectExpr("queue_id", "get_json_object(metadata_json, '$.error') AS e").collect()}
    assert (2, '"no"\n\\ k2:2') in told and (66, "no outcome") in told
    assert {r.user_id for r in worker.last_contact().collect()} == {1, 3}
    worker.poll("2024-01-01 12:01:00")
    assert states(worker)[3] == ("sent", 1, None)


def test_critical_first_within_a_batch_size(spark, make_worker):
    server = Server(spark)
    worker = make_worker(server, batch_size=2)
    worker.step(spark.createDataFrame([queue_row(1, -9), queue_row(2, -8), queue_row(3, -1, "critical"), queue_row(4, -7)], QUEUE), NOW)
    assert {s[0] for s in server.sent} == {3, 1}
    worker.work_off(NOW)
    assert sorted(s[0] for s in server.sent) == [1, 2, 3, 4]


@pytest.mark.parametrize("streamed", [True, False])
def test_killed_between_sending_and_commit(spark, make_worker, monkeypatch, streamed):
    """The outcome of a message is known: a restart folds it and sends nothing again."""
    server = Server(spark, down={2})
    rows = spark.createDataFrame([queue_row(1), queue_row(2)], QUEUE)
    worker = make_worker(server)
    if not streamed:
        worker.step(rows.filter("false"), NOW, 0)
        worker.step(rows.withColumn("scheduled_at", rows.scheduled_at + dt.timedelta(minutes=5)), NOW, 1)
    later, batch = ("2024-01-01 12:10:00", None) if not streamed else (NOW, 0)
    kill_at(monkeypatch, "versions")
    with pytest.raises(Killed):
        worker.step(rows if streamed else None, later, batch)
    monkeypatch.undo()
    assert len(server.sent) == 2
    again = make_worker(server)
    if streamed:
        assert again.poll("2024-01-01 13:00:00") is None  # the stream has to deliver its batch first
        again.step(rows, "2024-01-01 13:00:00", 0)
        assert again.step(rows, NOW, 0) is None
    else:
        again.step(spark.createDataFrame([queue_row(9)], QUEUE), "2024-01-01 12:10:00", 2)  # finishes the poll first
    sent = [s[1] for s in server.sent]
    assert sent[:2] == ["k1:1", "k2:1"] and sent.count("k1:1") == 1 and sent.count("k2:1") == 1
    again.work_off("2024-01-01 14:00:00")
    done = states(again)
    assert done[1] == ("sent", 1, None) and done[2][:2] == ("failed", 3)
    assert again.log().filter("queue_id = 1").first().event_at == dt.datetime.fromisoformat(later)
    assert again.log().count() == len(server.sent) == len(set(s[1] for s in server.sent))


def test_killed_while_sending(spark, make_worker):
    """The outcome is unknown: the same messages go out again with the same keys."""
    server = Server(spark)

    def dies(messages):
        server(messages)
        raise Killed

    rows = spark.createDataFrame([queue_row(1), queue_row(2)], QUEUE)
    with pytest.raises(Killed):
        make_worker(dies).step(rows, NOW, 0)
    make_worker(server).step(rows, NOW, 0)
    assert [s[1] for s in server.sent] == ["k1:1", "k2:1"] * 2


def test_worker_over_a_stream(spark, make_worker, tmp_path):
    server = Server(spark, down={3})
    worker = make_worker(server)
    src = tmp_path / "in"

    def run():
        worker.run(X.read_stream(spark, str(src), QUEUE, 1), str(tmp_path / "ckpt"), lambda: NOW).awaitTermination()

    for i in (1, 2, 3):
        spark.createDataFrame([queue_row(i, minute=5 if i == 2 else 0)], QUEUE).coalesce(1).write.mode("append").parquet(str(src))
    run()
    run()
    assert states(worker)[1] == ("sent", 1, None) and states(worker)[2] == ("queued", 0, None)
    worker.work_off(NOW)
    assert states(worker)[3][:2] == ("failed", 3)
    assert [s[1] for s in server.sent].count("k1:1") == 1


def test_worker_joins_only_rows_that_are_asked_for(spark, make_worker):
    """Facts, users and preferences that no due message names are not joined to the messages."""
    worker = make_worker(Server(spark))
    worker.step(spark.createDataFrame([queue_row(1), queue_row(2, user=None), queue_row(3, user=3, request=2, minute=5)], QUEUE), NOW)
    held = {name: spark.read.parquet(f"{worker.store.path}/asked_{name}/v=0").collect() for name in ("facts", "usr", "prefs")}
    assert [r.request_id for r in held["facts"]] == [1] and [r.user_id for r in held["usr"]] == [1] and held["prefs"] == []
    assert states(worker)[1] == ("sent", 1, None) and states(worker)[2] == ("failed", 1, "No recipient email")


def test_templates_are_cut_once_and_not_per_message(spark):
    templates = spark.createDataFrame(
        [("a", "{{x}}{{ y }}-{{no}}", None, 1), ("b", None, "left out", 1), ("c", "old", "old", 0), ("a", "again {{  x}}", "{{{x}}} {{\tx}}{{y", 1)],
        "template_key string, subject_template string, html_template string, is_active int",
    )
    rows = spark.createDataFrame([("a", "{{y}}", 7), ("b", None, 1), ("complaint_resolved", "v", None), (None, "n", 2)], "template_key string, one string, two int")
    out = N.render(rows, templates, {"x": "one", "y": "two", "complaint_code": "one"})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    messages = plan[: plan.index("Join")]
    assert "zip_with" in messages and "split(" not in messages and "regexp" not in messages
    got = {(r.template_key, r.subject): r.html for r in out.collect()}
    assert got["a", "{{y}}7-"] == "" and got["a", "again {{y}}"] == "} {{y}}{{y"
    receipt = "<p>Hello ,</p><p>Your complaint <strong>%s</strong> has been received.</p>"
    assert got["b", "Complaint Received - "].startswith(receipt % "") and got[None, "Complaint Received - n"].startswith(receipt % "n")
    assert ("complaint_resolved", "Complaint resolved - v") in got and len(got) == 5
