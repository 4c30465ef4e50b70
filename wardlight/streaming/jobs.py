"""Continuous versions of the lifecycle rules, as Structured Streaming plans.

Every function takes a streaming DataFrame (a batch one works too) and returns one;
`run_to_table` drives it with exactly-once file output. Event-time columns must be TIMESTAMP, not
TIMESTAMP_NTZ. Jobs that keep tables of their own are in `audit` (X01) and `worker` (X05).
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.functions.measures import count_where, is_done, n_rows, status_is
from wardlight.session import scratch_dir
from wardlight.sources import schemas
from wardlight.sources.store import KeyedTable


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """A file stream; the trigger cap bounds how much one micro-batch takes in.

    The last character is put in brackets, which makes the path a glob that matches this name
    only: a stream needs one to read a single file, and a folder is found just as well.
    """
    path = path.rstrip("/")
    glob = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(glob)


@contextmanager
def session_settings(spark: SparkSession, settings: dict):
    """Start queries with these settings; the session's own are put back at once.

    A started query works on its copy.
    """
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def state_partitions(spark: SparkSession, count: int | None):
    """Start a query with `count` state partitions, or with the session's shuffle partitions.

    A stateful query keeps its partition count for the life of its checkpoint, so choose it
    for the size the state will grow to.
    """
    name = "spark.sql.shuffle.partitions"
    return session_settings(spark, {name: count or spark.conf.get(name)})


#: Sessions are merged where their rows were read, so a busy user's rows are few before the shuffle.
MERGE_SESSIONS_EARLY = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}


def run_to_table(
    stream: DataFrame,
    label: str,
    path: str | None = None,
    checkpoint: str | None = None,
    partitions: int | None = None,
    settings: dict | None = None,
) -> DataFrame:
    """Process all available input, write it append-only with exactly-once files, and read the table.

    Pass the same `path` and `checkpoint` again to go on where the last run stopped.
    `partitions` is the state's partition count at the first start (session value if None),
    `settings` are further settings of the query.
    """
    spark = stream.sparkSession
    path = path or scratch_dir(spark, label)
    checkpoint = checkpoint or scratch_dir(spark, f"{label}-checkpoint")
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    with state_partitions(spark, partitions), session_settings(spark, settings or {}):
        query = writer.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


# -- X02 SLA breaches -------------------------------------------------------------


def stream_sla(submitted: DataFrame, resolved: DataFrame, max_sla_hours: int, delay: str = "1 hour") -> DataFrame:
    """Requests whose SLA ran out unresolved, emitted once the watermark passes the deadline.

    `submitted` has request_id, submitted_at and sla_hours, which are known at submission;
    `resolved` has the request_id and time of each event that resolves a request. A left outer
    stream join keeps a request until its deadline, like a timer that an event cancels, and lets
    only the unanswered ones out, all on the JVM. A resolution at the deadline is in time.
    """
    hours = F.make_dt_interval(F.lit(0), F.col("sla_hours"))
    due = submitted.withColumn("deadline", F.col("submitted_at") + hours).withWatermark("deadline", delay)
    answers = resolved.select(F.col("request_id").alias("_id"), "resolved_at").withWatermark("resolved_at", delay)
    in_time = (
        (F.col("request_id") == F.col("_id"))
        & (F.col("resolved_at") <= F.col("deadline"))
        & (F.col("resolved_at") >= F.col("deadline") - F.expr(f"INTERVAL {int(max_sla_hours)} HOUR"))
        & (F.col("resolved_at") > F.col("submitted_at"))
    )
    unanswered = due.join(answers, in_time, "leftOuter").filter(F.col("_id").isNull())
    return unanswered.select("request_id", "submitted_at", "sla_hours", "deadline")


# -- X03, X04, X07 windows --------------------------------------------------------


def stream_hotspots(r: DataFrame, ts: str, threshold: int = 15, days: int = 30, delay: str = "1 hour") -> DataFrame:
    """Locations with enough requests in a window of `days`, sliding by one day.

    Rows are counted per location and day first; the sliding window then runs over those
    counts, so a row is not copied into every window that covers it.
    """
    daily = (
        r.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("day"), "location_id").agg(n_rows().alias("n"))
    )
    sliding = F.window(F.window_time("day"), f"{days} days", "1 day").alias("w")
    counts = daily.groupBy(sliding, "location_id").agg(F.sum("n").alias("request_count"))
    hot = counts.filter(F.col("request_count") >= threshold)
    return hot.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "location_id", "request_count")


def stream_kpi(r: DataFrame, ts: str, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counters per time window: in update mode a live card, in append mode final values."""
    grouped = r.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"))
    out = grouped.agg(
        n_rows().alias("total"),
        count_where(status_is("pending", "reported")).alias("waiting"),
        count_where(is_done()).alias("resolved"),
    )
    return out.select(F.col("w.start").alias("window_start"), "total", "waiting", "resolved")


def stream_presence(heartbeats: DataFrame, ts: str, gap: str = "2 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions per user: one ends when no heartbeat came for `gap`.

    Started with `MERGE_SESSIONS_EARLY`, every task merges the heartbeats it has read into sessions
    first, so of a user with very many heartbeats only the sessions of each task are shuffled.
    """
    sessions = (
        heartbeats.withWatermark(ts, delay)
        .groupBy("user_id", F.session_window(ts, gap).alias("s"))
        .agg(n_rows().alias("heartbeats"), F.max(ts).alias("last_seen"))
    )
    return sessions.select("user_id", F.col("s.start").alias("session_start"), "last_seen", "heartbeats")


# -- X06 notifications -------------------------------------------------------


def stream_enqueue(queue_rows: DataFrame, ts: str = "scheduled_at", delay: str = "1 day") -> DataFrame:
    """Enqueue each idempotency key once within the watermark."""
    return queue_rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["idempotency_key"])


# -- X08 field merge --------------------------------------------------------------


def merge_lww(edits: DataFrame, keys: list[str], value: str, ts: str, tiebreak: str) -> DataFrame:
    """Last write wins per key: a combinable `max_by`, usable on batches and update-mode streams."""
    order = F.struct(ts, tiebreak)
    return edits.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(ts).alias(ts))


def stream_merge(edits: DataFrame, table: KeyedTable, checkpoint: str, **trigger):
    """Merge a stream of edits into a keyed table as they come; returns the started query.

    The table's order decides, not the time of arrival: an edit older than the stored one loses,
    however late it comes. Micro-batches write only the buckets they touch, and one that is
    delivered again changes nothing.
    """
    writer = edits.writeStream.option("checkpointLocation", checkpoint).foreachBatch(table.upsert)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream with a zoned event time."""
    raw = read_stream(spark, f"{sf_dir}/events.parquet", schemas.RAW["events"])
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))
