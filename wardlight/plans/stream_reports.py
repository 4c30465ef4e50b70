"""X01-X08: each job reads a given table as a stream until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.plans import notify_reports as NR
from wardlight.plans.lifecycle_reports import TRANSITIONS
from wardlight.plans.registry import query
from wardlight.plans.sql import with_views
from wardlight.session import scratch_dir
from wardlight.sources import schemas
from wardlight.sources.store import KeyedTable
from wardlight.streaming import jobs as X
from wardlight.streaming.audit import StatusAudit
from wardlight.streaming.worker import QueueWorker

MAX_TS = "(SELECT max(ts) FROM events)"


def _in_slices(r, rows, ts: str, slices: int, jitter_min: int, path: str) -> None:
    """Write rows as files in order of time, but up to `jitter_min` minutes out of order."""
    shuffled = F.unix_seconds(F.col(ts).cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(jitter_min * 60))
    first, last = rows.agg(F.min(shuffled), F.max(shuffled)).first()
    place = F.floor((shuffled - first) * slices / max(1, last - first + 1))
    for k in range(slices):
        rows.filter(place == k).coalesce(2).write.mode("append").parquet(path)


@query("x01_status_audit", with_views("sev", f"SELECT request_id, event_id, old_status, new_status, event_at FROM ({TRANSITIONS})"))
def x01(r):
    """Events come in several files and micro-batches, up to an hour out of order."""
    source = scratch_dir(r.spark, "x01-events")
    events = r.status_events()
    _in_slices(r, events, "event_at", 4, 60, source)
    audit = StatusAudit(r.spark, scratch_dir(r.spark, "x01"), 3600, buckets=8)
    stream = X.read_stream(r.spark, source, events.schema, 2)
    audit.run(stream, scratch_dir(r.spark, "x01-checkpoint")).awaitTermination()
    audit.flush()
    return audit.transitions()


SLA_HOURS = "CASE least(CAST(substr(o_orderpriority, 1, 1) AS INT), 4) WHEN 1 THEN 4380 WHEN 2 THEN 8760 WHEN 3 THEN 17520 ELSE 26280 END"


@query(
    "x02_sla_breaches",
    f"""SELECT o_orderkey AS request_id, o_orderdate AS submitted_at, sla_hours, o_orderdate + to_hours(sla_hours) AS deadline
      FROM (SELECT *, {SLA_HOURS} AS sla_hours FROM orders) o
      WHERE o_orderdate + to_hours(sla_hours) < least((SELECT max(l_shipdate) FROM lineitem),
          (SELECT max(o_orderdate + to_hours({SLA_HOURS})) FROM orders)) - INTERVAL 1 HOUR
      AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F' AND l_shipdate > o_orderdate
        AND l_shipdate <= o_orderdate + to_hours(sla_hours))""",
)
def x02(r):
    orders = X.read_stream(r.spark, f"{r.path}/orders.parquet", schemas.RAW["orders"])
    lines = X.read_stream(r.spark, f"{r.path}/lineitem.parquet", schemas.RAW["lineitem"])
    submitted = orders.select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_orderdate").cast("timestamp").alias("submitted_at"),
        F.expr(SLA_HOURS).alias("sla_hours"),
    )
    resolved = lines.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("request_id"), F.col("l_shipdate").cast("timestamp").alias("resolved_at"))
    return X.run_to_table(X.stream_sla(submitted, resolved, 26280), "x02")


@query(
    "x03_hotspots",
    f"""WITH d AS (SELECT CAST(ts AS DATE) AS day, CAST(user_id % 25 AS INTEGER) AS location_id, count(*) AS n FROM events GROUP BY ALL),
      w AS (SELECT CAST(d.day + 1 + CAST(k AS INTEGER) AS TIMESTAMP) AS window_end, location_id, sum(n) AS c FROM d, range(0, 7) t(k) GROUP BY ALL)
      SELECT window_end - INTERVAL 7 DAY AS window_start, window_end, location_id, CAST(c AS BIGINT) AS request_count FROM w
      WHERE c >= 90 AND window_end <= {MAX_TS} - INTERVAL 1 HOUR""",
)
def x03(r):
    events = X.event_stream(r.spark, r.path).select("ts", (F.col("user_id") % 25).cast("int").alias("location_id"))
    return X.run_to_table(X.stream_hotspots(events, "ts", 90, 7), "x03")


@query(
    "x04_kpi",
    f"""SELECT date_trunc('day', ts) AS window_start, count(*) AS total, count(*) FILTER (event_type = 'view') AS waiting,
      count(*) FILTER (event_type IN ('purchase','click')) AS resolved FROM events GROUP BY 1
      HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {MAX_TS} - INTERVAL 1 HOUR""",
)
def x04(r):
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type").isin("purchase", "click"), "resolved")
    events = X.event_stream(r.spark, r.path).select("ts", status.otherwise("assigned").alias("status"))
    return X.run_to_table(X.stream_kpi(events, "ts"), "x04")


QUEUE_SCHEMA = schemas.fields(
    "user_id:long request_id:long template_key:string priority:string status:string scheduled_at:ts idempotency_key:string queue_id:long"
)


# The mail server of x05: every tenth message never arrives, and every third try of the others fails.
FAILS = "queue_id % 10 = 0 OR (queue_id + attempt) % 3 = 0"


def _mail_server(messages):
    error = F.concat(F.lit('421 "busy"\\try '), F.col("attempt").cast("string"), F.lit("\n"))
    return messages.select("queue_id", (~F.expr(FAILS)).alias("ok"), F.when(F.expr(FAILS), error).alias("error"))


@query(
    "x05_notifications",
    with_views(
        NR.VIEWS,
        f"""WITH {NR.EV}, {NR.S_AT}, {NR.RECIPIENT},
        j AS (SELECT *, scheduled_at > {NR.S_NOW} AS later, request_id % 13 = 0 AS gone, queue_id % 10 = 0 AS dead FROM rec),
        k AS (SELECT *, NOT later AND NOT gone AND status = 'processing' AS tried FROM j),
        n AS (SELECT *, CASE WHEN NOT tried THEN 0 WHEN dead THEN 5 WHEN (queue_id + 1) % 3 = 0 THEN 2 ELSE 1 END AS tries FROM k)
        SELECT queue_id, CASE WHEN later THEN 'queued' WHEN gone THEN 'failed' WHEN NOT tried THEN status WHEN dead THEN 'failed' ELSE 'sent' END AS status,
        CAST(CASE WHEN later THEN 0 WHEN tried THEN tries ELSE 1 END AS INTEGER) AS attempts,
        CASE WHEN later THEN NULL WHEN gone THEN 'Complaint not found' WHEN NOT tried THEN last_error WHEN dead THEN '421 "busy"\\try 5' || chr(10) END AS last_error,
        CAST(tries AS BIGINT) AS tries, CAST(CASE WHEN tried AND NOT dead THEN tries - 1 ELSE tries END AS BIGINT) AS failed_tries,
        CASE WHEN tried THEN recipient END AS recipient, CASE WHEN tried THEN
          CASE template_key WHEN 'complaint_received' THEN 'Complaint Received - ' WHEN 'complaint_assigned' THEN 'Your complaint is now being handled - '
          WHEN 'complaint_in_progress' THEN 'Work started on your complaint - ' ELSE 'Complaint resolved - ' END || code END AS subject,
        CASE WHEN failed_tries > 0 THEN '421 "busy"\\try ' || failed_tries || chr(10) END AS told FROM n LEFT JOIN (SELECT request_id AS rid, code FROM req) q ON rid = request_id""",
    ),
)
def x05(r):
    """The queue comes as a stream and is worked off; the last failed try is read from the log's JSON."""
    source = scratch_dir(r.spark, "x05-queue")
    cores = r.spark.sparkContext.defaultParallelism
    NR.queue(r).repartition(3 * cores, "queue_id").write.parquet(source)
    stream = X.read_stream(r.spark, source, QUEUE_SCHEMA, 2 * cores)
    templates = r.values([("none", "", "", 0)], "template_key, subject_template, html_template, is_active")
    facts = r.requests(resolved=False).filter("request_id % 13 <> 0").select("request_id", "code")
    worker = QueueWorker(
        r.spark, scratch_dir(r.spark, "x05"), _mail_server, r.preferences(), r.usr, templates, facts, {"complaint_code": "code"}, buckets=8
    )
    worker.run(stream, scratch_dir(r.spark, "x05-checkpoint"), lambda: NR.NOW).awaitTermination()
    worker.work_off(NR.NOW)
    failed = F.col("delivery_status") == "failed"
    told = F.max(F.get_json_object("metadata_json", "$.error")).alias("told")
    tries = worker.log().groupBy("queue_id").agg(
        F.count("*").alias("tries"), F.count_if(failed).alias("failed_tries"), F.max("recipient").alias("recipient"), F.max("subject").alias("subject"), told
    )
    zero = {"tries": 0, "failed_tries": 0}
    return worker.queue().select("queue_id", "status", "attempts", "last_error").join(tries, "queue_id", "left").fillna(zero)


@query(
    "x06_enqueue_once",
    "SELECT DISTINCT user_id || ':' || event_type || ':' || strftime(ts, '%Y%m%d') AS idempotency_key FROM events",
)
def x06(r):
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyyMMdd"))
    rows = X.event_stream(r.spark, r.path).select(key.alias("idempotency_key"), F.col("ts").alias("scheduled_at"))
    return X.run_to_table(X.stream_enqueue(rows), "x06").select("idempotency_key")


@query(
    "x07_presence",
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS first FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
      SELECT user_id, min(ts) AS session_start, max(ts) AS last_seen, count(*) AS heartbeats FROM s GROUP BY user_id, session
      HAVING max(ts) + INTERVAL 2 HOUR <= {MAX_TS} - INTERVAL 1 HOUR""",
)
def x07(r):
    return X.run_to_table(X.stream_presence(X.event_stream(r.spark, r.path).select("user_id", "ts"), "ts", "2 hours"), "x07", settings=X.MERGE_SESSIONS_EARLY)


@query(
    "x08_merge_lww",
    "SELECT user_id, event_type AS field, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY ALL",
)
def x08(r):
    """Edits come as a stream of files, the newest first, so most of them are late."""
    source = scratch_dir(r.spark, "x08-edits")
    edits = r.t["events"].select("user_id", F.col("event_type").alias("field"), "value", "ts", "event_id")
    middle = edits.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    edits.filter(F.col("event_id") > middle).coalesce(2).write.mode("append").parquet(source)
    edits.filter(F.col("event_id") <= middle).coalesce(2).write.mode("append").parquet(source)
    table = KeyedTable(r.spark, scratch_dir(r.spark, "x08"), edits.schema, ["user_id", "field"], ["ts", "event_id"], buckets=8)
    X.stream_merge(X.read_stream(r.spark, source, edits.schema, 1), table, scratch_dir(r.spark, "x08-checkpoint")).awaitTermination()
    return table.read().drop("event_id")
