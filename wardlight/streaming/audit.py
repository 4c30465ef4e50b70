"""Status changes from a stream whose events come out of order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.operators.windows import chunked_lag
from wardlight.sources import schemas
from wardlight.sources.store import Change, Store
from wardlight.sources.tables import latest_per_key

EVENT = schemas.fields("request_id:long event_id:long new_status:string event_at:ts")
TRANSITION = schemas.fields("request_id:long event_id:long old_status:string new_status:string event_at:ts")


class StatusAudit:
    """Holds events until the watermark passes them, then writes the changes in order.

    The watermark is the latest event time seen, less `delay_s`. Events it has passed are final:
    their changes are found per (request, hour), so a busy request is spread over its hours, and
    the first event of a request is compared with the last status written for it. What waits is
    given up as the watermark moves on; of what is done only each request's last event is kept.

    As long as no event is later than `delay_s`, the changes do not depend on how events are cut
    into files and micro-batches. A later event, or one without a time, cannot be put in its place
    any more; it is written to `late`, never dropped. A batch that is delivered again changes
    nothing.
    """

    def __init__(self, spark: SparkSession, path: str, delay_s: int = 3600, chunk_s: int = 3600, buckets: int = 64):
        self.store, self.delay_s, self.chunk_s = Store(spark, path, buckets), delay_s, chunk_s

    def fold(self, events: DataFrame, batch: int | None = None) -> None:
        """Take in a micro-batch of events(request_id, event_id, new_status, event_at)."""
        change = self.store.change(batch)
        if change is None:
            return
        arrived = change.append("arrived", events.select(*(F.col(f.name).cast(f.dataType) for f in EVENT)))
        at = F.unix_micros(F.col("event_at").cast("timestamp"))
        newest = arrived.agg(F.max(at)).first()[0]
        passed = change.notes.get("passed")
        in_time = F.col("event_at").isNotNull() if passed is None else F.coalesce(at > passed, F.lit(False))
        change.append("late", arrived.filter(~in_time))
        if newest is not None:
            passed = max(newest - self.delay_s * 1_000_000, passed if passed is not None else newest - self.delay_s * 1_000_000)
        waiting = self.store.read("pending", EVENT).unionByName(arrived.filter(in_time))
        self._release(change, waiting, F.lit(False) if passed is None else at <= passed)
        change.notes["passed"] = passed
        change.commit()

    def flush(self) -> None:
        """Treat all events that wait as final, at the end of a bounded input."""
        change = self.store.change()
        pending = self.store.read("pending", EVENT)
        last = pending.agg(F.max(F.unix_micros(F.col("event_at").cast("timestamp")))).first()[0]
        if last is not None:
            self._release(change, pending, F.lit(True))
            change.notes["passed"] = max(last, change.notes["passed"])
            change.commit()

    def _release(self, change: Change, waiting: DataFrame, final) -> None:
        ready = change.append("ready", waiting.filter(final))
        touched = change.touched(ready, ["request_id"])
        before = self.store.read("last", EVENT, touched).join(ready.select("request_id").distinct(), "request_id", "left_semi")
        line = before.withColumn("_old", F.lit(True)).unionByName(ready.withColumn("_old", F.lit(False)))
        lagged = chunked_lag(line, ["request_id"], "event_at", "event_id", "new_status", "old_status", self.chunk_s)
        changes = lagged.filter(~F.col("_old") & (F.col("old_status") != F.col("new_status")))
        change.append("audit", changes.select(*(f.name for f in TRANSITION)))
        order = ["event_at", "event_id"]
        newest = change.append("newest", latest_per_key(ready, ["request_id"], [*order, "new_status"]))
        change.merge("last", newest, ["request_id"], order)
        spread = ["request_id", "event_id"]  # a busy request's events lie in all buckets
        change.replace("pending", waiting.filter(~final), spread, set(range(self.store.buckets)))

    def run(self, events: DataFrame, checkpoint: str, **trigger):
        """Audit a stream of events; returns the started query."""
        writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.fold)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def transitions(self) -> DataFrame:
        """Status changes that are final; a request's first status is none."""
        return self.store.read_log("audit", TRANSITION)

    def late(self) -> DataFrame:
        """Events that came after the watermark, or without a time."""
        return self.store.read_log("late", EVENT)

    def waiting(self) -> DataFrame:
        return self.store.read("pending", EVENT)
