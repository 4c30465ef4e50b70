"""New requests from raw rows to stored, prioritised and estimated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.columns import as_of_ts, code, col, year
from wardlight.functions.measures import n_rows
from wardlight.operators.lifecycle import boost_priority, frequency_priority
from wardlight.operators.notify import ETA_CRITICAL, ETA_OTHER, STATUS_TEMPLATE, enqueue, schedule
from wardlight.operators.predict import predict_eta
from wardlight.operators.text import URGENCY_KEYWORDS, score_urgency
from wardlight.operators.windows import ordered_position, trailing_count
from wardlight.session import materialize
from wardlight.sources.store import Store
from wardlight.sources.tables import ingest_requests


def request_text(title="title", description="description") -> Column:
    """Title and description as one text."""
    empty = F.lit("")
    return F.trim(F.concat(F.coalesce(col(title), empty), F.lit(" "), F.coalesce(col(description), empty)))


def earlier_twins(batch: DataFrame, history: DataFrame, id_col: str, days: int, out: str = "frequency_30d") -> DataFrame:
    """Requests of the same category and location in the `days` before each row of a batch.

    Counted are stored requests up to the row's own moment, and rows of the batch that come before
    it by (submitted_at, id). `batch` is read several times and should be a written table.
    """
    keys, ts = ["cat_id", "location_id"], "submitted_at"
    first, last = batch.agg(F.min(ts), F.max(ts)).first()
    start = F.lit(first).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    recent = history.select(*keys, ts).filter((F.col(ts) >= start) & (F.col(ts) <= F.lit(last).cast("timestamp_ntz")))
    own = batch.select(*keys, ts, id_col)
    wanted = own.select(*keys).distinct()
    line = own.unionByName(recent.join(wanted, keys, "left_semi"), allowMissingColumns=True)
    around = trailing_count(line, keys, ts, days, "_around").filter(F.col(id_col).isNotNull()).select(id_col, "_around")
    placed = materialize(ordered_position(own, keys, ts, id_col, "_at"), "positions")
    moments = placed.groupBy(*keys, ts).agg(F.min("_at").alias("_first"), n_rows().alias("_same"))
    after = F.col("_same") - (F.col("_at") - F.col("_first") + 1)  # of the same moment, but later in the batch
    counted = placed.join(moments, [*keys, ts]).select(id_col, after.alias("_after")).join(around, id_col)
    return batch.join(counted.select(id_col, (F.col("_around") - F.col("_after")).alias(out)), id_col)


def submit_requests(
    raw: DataFrame,
    cat: DataFrame,
    history: DataFrame,
    as_of,
    keywords: dict = URGENCY_KEYWORDS,
    days: int = 30,
    id_col: str = "raw_id",
    last_number: int = 0,
    prefix: str = "CMP",
) -> tuple[DataFrame, DataFrame]:
    """Check, number, route, score, prioritise and estimate a batch of new requests.

    `raw` has a unique whole number `id_col` in order of arrival, and may have `submitted_at`;
    without it all rows come at `as_of`. Accepted rows are numbered by (submitted_at, id) after
    `last_number`; the number is the request's id and, with the year, its code. Department and base
    priority come from the category, the frequency from the twins before it, stored or in the same
    batch, the boost from the text. The estimate uses the category's default priority.
    Returns (requests, rejected rows).
    """
    timed = raw if "submitted_at" in raw.columns else raw.withColumn("submitted_at", as_of_ts(as_of))
    ok, rejected = ingest_requests(timed, cat)
    accepted = materialize(ok, "accepted")
    numbered = ordered_position(accepted, [], "submitted_at", id_col, "_seq").withColumn("request_id", F.col("_seq") + last_number)
    coded = numbered.withColumn("code", code(prefix, year("submitted_at"), "request_id")).drop("_seq")
    scored = score_urgency(coded.withColumn("_text", request_text()), keywords, text="_text").drop("_text")
    counted = earlier_twins(materialize(scored, "scored"), history, id_col, days)
    estimated = predict_eta(counted, history)
    assigned = estimated.withColumn("priority_id", frequency_priority(F.col("priority_id"), F.col("frequency_30d")))
    return boost_priority(assigned).withColumn("sentiment_score", F.col("anger_level")), rejected


def receipts(requests: DataFrame, prefs: DataFrame) -> DataFrame:
    """Queue rows that confirm new requests at once; the request's id is the queue id."""
    critical = F.col("priority_id") == 1
    told = requests.select(
        "request_id",
        "user_id",
        "status",
        "submitted_at",
        F.lit(STATUS_TEMPLATE["submitted"]).alias("template_key"),
        F.coalesce(critical, F.lit(False)).cast("int").alias("is_critical"),
        F.when(critical, ETA_CRITICAL).otherwise(ETA_OTHER).alias("eta_hours"),
    )
    queue = enqueue(schedule(told, prefs, F.col("submitted_at"), force=F.lit(True)))
    return queue.withColumn("queue_id", F.col("request_id"))


class Intake:
    """Submissions as one step: requests with codes, their receipts, and rejected rows.

    Each batch is one version of a `Store`. The last number given out is part of the version, so
    batches never share a number, and a batch that failed half-way gives its numbers to the next
    try without anyone having seen them. A streaming batch that is delivered again changes nothing.
    """

    def __init__(self, spark, path: str, cat: DataFrame, prefs: DataFrame, last_number: int = 0, prefix: str = "CMP", keywords: dict = URGENCY_KEYWORDS):
        """`last_number` is the number of requests stored elsewhere before the first batch."""
        self.store, self.cat, self.prefs = Store(spark, path), cat, prefs
        self.last_number, self.prefix, self.keywords = last_number, prefix, keywords

    def submit(self, raw: DataFrame, history: DataFrame, as_of, batch: int | None = None, id_col: str = "raw_id") -> None:
        """Take in a batch; `history` are the requests stored elsewhere, to which earlier batches are added."""
        change = self.store.change(batch)
        if change is None:
            return
        arrived = change.append("arrived", raw)
        last = change.notes.get("last_number", self.last_number)
        known = self.requests()
        past = history if known is None else history.unionByName(known.select(*(c for c in history.columns if c in known.columns)), allowMissingColumns=True)
        ok, rejected = submit_requests(arrived, self.cat, past, as_of, self.keywords, 30, id_col, last, self.prefix)
        requests = change.append("requests", ok)
        change.append("rejected", rejected)
        change.append("receipts", receipts(requests, self.prefs))
        change.notes["last_number"] = last + requests.count()
        change.commit()

    def requests(self) -> DataFrame | None:
        return self._log("requests")

    def receipts(self) -> DataFrame | None:
        return self._log("receipts")

    def rejected(self) -> DataFrame | None:
        return self._log("rejected")

    def _log(self, name: str) -> DataFrame | None:
        """All rows of the batches so far; None before the first."""
        return None if self.store.manifest()["version"] < 0 else self.store.read_log(name)
