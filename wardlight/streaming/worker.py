"""The queue worker: which messages are due, what became of them, and what waits for another try."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.functions.columns import as_of_ts
from wardlight.operators import notify as N
from wardlight.operators.windows import join_null_safe
from wardlight.sources import schemas
from wardlight.sources.store import Change, Store
from wardlight.sources.tables import align_schema

QUEUE = schemas.fields(
    "queue_id:long user_id:long request_id:long template_key:string priority:string status:string scheduled_at:ts "
    "idempotency_key:string attempts:int max_attempts:int last_error:string sent_at:ts"
)
LOG = schemas.fields(
    "queue_id:long user_id:long request_id:long template_key:string recipient:string subject:string "
    "delivery_status:string event_at:ts metadata_json:string"
)
RESULT = "queue_id long, ok boolean, error string"
NOT_FOUND = "Complaint not found"


class QueueWorker:
    """Works a queue off in steps, each of which is one version of a `Store`.

    A step takes in new rows, picks those whose time has come, hands the messages to `send`, and
    folds the outcomes: `sent` and `cancelled` rows and those that failed `max_attempts` times are
    settled, the others wait for the next step with their attempts counted. Rows scheduled later
    stay queued.

    `send` turns messages (queue_id, message_key, attempt, recipient, subject, html) into outcomes
    (queue_id, ok, error); a message without an outcome counts as failed. Its outcomes are written
    before they are folded. A step that was killed is taken up at the next start: the picked rows
    and written outcomes are used again, so a message whose outcome is known is not sent a second
    time. Only if the run died while it was sending does the same message go out again, with the
    same `message_key`, by which a mail server can tell.

    Queue ids are unique; `stream_enqueue` keeps repeats of an idempotency key out.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        send: Callable[[DataFrame], DataFrame],
        prefs: DataFrame,
        usr: DataFrame,
        templates: DataFrame,
        facts: DataFrame,
        context: dict,
        batch_size: int | None = None,
        buckets: int = 64,
    ):
        """`facts` has one row per request_id with the columns that `context` fills templates from.
        `batch_size` is the most messages of a step, critical ones first (all due ones, if None)."""
        self.store = Store(spark, path, buckets)
        self.send, self.prefs, self.usr, self.templates = send, prefs, usr, templates
        self.facts, self.context, self.batch_size = facts, context, batch_size

    # -- one step -----------------------------------------------------------------

    def _intent(self, version: int) -> str:
        return f"{self.store.path}/intents/{version}.json"

    def _begun(self, version: int) -> dict | None:
        """What a killed step was about to do."""
        known = f"{version}.json" in self.store.files.names(f"{self.store.path}/intents")
        return json.loads(self.store.files.read(self._intent(version))) if known else None

    def _picked(self, change: Change, waiting: DataFrame, now: str) -> DataFrame:
        """Rows to handle now, with recipient, subject and body, or the reason not to send them.

        Of facts, users and preferences only the rows that due messages ask for are joined. They are
        written first, so that Catalyst knows how few they are and need not shuffle the messages.
        """
        if self.batch_size is None:
            due = waiting.filter((F.col("status") == "queued") & (F.col("scheduled_at") <= as_of_ts(now)))
        else:
            due = change.append("due", N.due_batch(waiting, now, self.batch_size))
        asked = change.append("asked", due.select("request_id", "user_id").distinct())

        def of(name: str, table: DataFrame, key: str) -> DataFrame:
            return change.append(f"asked_{name}", table.join(asked, key, "left_semi"))

        known = of("facts", self.facts, "request_id").withColumn("_known", F.lit(True))
        usr = of("usr", self.usr.select("user_id", "email"), "user_id")
        prefs = of("prefs", self.prefs.select("user_id", "preferred_email", "opted_out"), "user_id")
        about = due.join(known, "request_id", "left")
        addressed = N.resolve_recipients(about, prefs, usr)
        missing = F.col("_known").isNull()
        judged = addressed.withColumns(
            {
                "status": F.when(missing, "failed").otherwise(F.col("status")),
                "last_error": F.when(missing, NOT_FOUND).otherwise(F.col("last_error")),
                "attempts": F.col("attempts") + 1,
            }
        )
        rendered = N.render(judged, self.templates, self.context)
        key = F.concat_ws(":", "idempotency_key", F.col("attempts").cast("string"))
        return rendered.select(*(f.name for f in QUEUE), "recipient", "subject", "html", key.alias("message_key"))

    def _outcomes(self, picked: DataFrame) -> DataFrame:
        asked = picked.filter("status = 'processing'")
        messages = asked.select("queue_id", "message_key", F.col("attempts").alias("attempt"), "recipient", "subject", "html")
        told = self.send(messages).select("queue_id", F.col("ok").alias("_ok"), F.col("error").alias("_error"))
        answered = asked.select("queue_id").join(told, "queue_id", "left")
        error = F.when(F.col("_ok").isNull(), "no outcome").otherwise(F.col("_error"))
        return answered.select("queue_id", F.coalesce("_ok", F.lit(False)).alias("ok"), error.alias("error"))

    def step(self, new: DataFrame | None, now, batch: int | None = None) -> int | None:
        """One step; None if streaming batch `batch` is folded already.

        A killed step is finished first, at its own time. If it was a streaming batch, polling
        waits until the stream delivers that batch again.
        """
        change = self.store.change(batch)
        if change is None:
            return None
        begun = self._begun(change.version)
        if begun and begun["batch"] is None and batch is not None:
            self.step(None, begun["now"])
            change, begun = self.store.change(batch), None
        if begun and begun["batch"] != batch:
            return None
        now = begun["now"] if begun else str(now)
        if not begun:
            self.store.files.publish(self._intent(change.version), json.dumps({"batch": batch, "now": now}))

        waiting = self.store.read("open", QUEUE)
        if new is not None:
            arrived = change.append("arrived", align_schema(new, QUEUE, {"attempts": 0, "max_attempts": N.MAX_ATTEMPTS}))
            waiting = waiting.unionByName(arrived)
        picked = change.once("picked", lambda: self._picked(change, waiting, now))
        outcomes = change.once("outcomes", lambda: self._outcomes(picked))

        tried = picked.filter("status = 'processing'").withColumn("attempts", F.col("attempts") - 1)
        state, log = N.apply_outcomes(tried, outcomes, now)
        names = [f.name for f in QUEUE]
        handled = state.select(*names).unionByName(picked.filter("status <> 'processing'").select(*names))
        handled = change.append("handled", handled)
        change.append("settled", handled.filter("status <> 'queued'"))
        change.append("log", log.select(*(f.name for f in LOG)))

        keys = ["queue_id"]
        touched = change.touched(picked, keys) | (change.touched(arrived, keys) if new is not None else set())
        held = self.store.read("open", QUEUE, touched)
        held = held.unionByName(arrived) if new is not None else held
        left = join_null_safe(held, picked.select(*keys), keys, "left_anti").unionByName(handled.filter("status = 'queued'"))
        change.replace("open", left, keys, touched)
        return change.commit()

    # -- running ------------------------------------------------------------------

    def run(self, queue_rows: DataFrame, checkpoint: str, now: Callable[[], object], **trigger):
        """Take in a stream of queue rows, one step per micro-batch; returns the started query."""
        writer = queue_rows.writeStream.option("checkpointLocation", checkpoint)
        folded = writer.foreachBatch(lambda rows, batch: self.step(rows, now(), batch) and None)
        return folded.trigger(**(trigger or {"availableNow": True})).start()

    def poll(self, now) -> int | None:
        """A step without new rows, for what has become due or failed before."""
        return self.step(None, now)

    def work_off(self, now) -> None:
        """Poll until nothing is due; each try counts an attempt, so this ends."""
        while self.open().filter(F.col("scheduled_at") <= as_of_ts(now)).take(1):
            if self.poll(now) is None:
                return

    # -- reading ------------------------------------------------------------------

    def open(self) -> DataFrame:
        """Rows that wait for their time or for another try."""
        return self.store.read("open", QUEUE)

    def queue(self) -> DataFrame:
        """Every row with its state."""
        return self.open().unionByName(self.store.read_log("settled", QUEUE))

    def log(self) -> DataFrame:
        """One row per try."""
        return self.store.read_log("log", LOG)

    def last_contact(self) -> DataFrame:
        """When each user was last sent a message."""
        sent = self.log().filter("delivery_status = 'sent'")
        return sent.groupBy("user_id").agg(F.max("event_at").alias("last_email_sent"))
