"""Ordered computations that stay spread out when one key holds much of the data.

A plain `partitionBy(key)` window sends all rows of a key to one task. The helpers below
cut a key's time line into chunks, work inside (key, chunk), and carry what crosses a chunk
border through a small per-chunk aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.functions.columns import MICROS_PER, code, pct_change_of, seconds, year
from wardlight.session import materialize
from wardlight.sources.tables import latest_per_key  # noqa: F401  (W02 lives with the keyed tables)



def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal or both missing keys, so rows with a NULL key find their own group; keys come once."""
    renamed = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return left.join(renamed, same, how).drop(*(f"_on_{c}" for c in on))


def _chunk(ts: str, width_s: int) -> Column:
    return F.floor(seconds(ts) / width_s)


def _opening_totals(instants: DataFrame, keys: list[str], span: int) -> DataFrame:
    """Per (key, chunk) with rows: the sum over the `span` chunks before it, as `_delta`.

    A chunk's total is added from the next chunk on and taken back `span` chunks later. The
    window holds three rows per chunk of a key.
    """
    totals = instants.groupBy(*keys, "_chunk").agg(F.sum("_n").alias("_total"))
    chunk, total = F.col("_chunk"), F.col("_total")

    def move(at, ask, delta):
        return F.struct(at.alias("_chunk"), F.lit(ask).alias("_ask"), delta.alias("_delta"))

    moves = F.array(move(chunk + 1, 0, total), move(chunk + span + 1, 0, -total), move(chunk, 1, total * 0))
    w = W.partitionBy(*keys).orderBy("_chunk", "_ask").rowsBetween(W.unboundedPreceding, 0)
    summed = totals.select(*keys, F.inline(moves)).withColumn("_delta", F.sum("_delta").over(w))
    return summed.filter("_ask = 1").drop("_ask")


def trailing_count(df: DataFrame, keys: list[str], ts: str, days: int, out: str) -> DataFrame:
    """Rows of the same key in the closed interval [ts - days, ts], minus the row itself.

    Spark evaluates a sliding frame by adding up the whole frame for every row, which is
    quadratic on a busy key. Here every instant adds its count when it comes and takes it
    back `days` later, so a running sum gives the count in one pass. The time line is cut
    into day chunks; a chunk starts from the totals of the `days` chunks before it, so no
    window group holds more than a day of distinct instants and their take-backs. A row
    without a key or a time has no twins and counts 0.
    """
    width = MICROS_PER["DAY"]
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    instants = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"))
    instants = instants.withColumn("_at", at).withColumn("_chunk", F.floor(F.col("_at") / width))

    def event(chunk, when, kind, delta):
        return F.struct(chunk.alias("_chunk"), when.alias("_at"), F.lit(kind).alias("_kind"), delta.alias("_delta"))

    chunk, n = F.col("_chunk"), F.col("_n")
    moves = F.array(event(chunk, F.col("_at"), 1, n), event(chunk + days, F.col("_at") + days * width, 2, -n))
    steps = instants.select(*keys, ts, F.inline(moves))
    opening = _opening_totals(instants, keys, days).withColumns(
        {ts: F.lit(None).cast(df.schema[ts].dataType), "_at": F.lit(-(2**62)), "_kind": F.lit(0)}
    )
    w = W.partitionBy(*keys, "_chunk").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    counted = (
        steps.unionByName(opening)
        .withColumn("_seen", F.sum("_delta").over(w))
        .filter(F.col("_kind") == 1)
        .select(*keys, ts, (F.col("_seen") - 1).alias(out))
    )
    return df.join(counted, [*keys, ts], "left").withColumn(out, F.coalesce(out, F.lit(0)))


def ordered_position(
    df: DataFrame, keys: list[str], ts: str, id_col: str, out: str = "position", chunk_s: int = 3600, id_block: int = 1_000_000
) -> DataFrame:
    """1-based position of each row within its key by (ts, id), without a one-task window.

    Rows are counted per (key, chunk, instant, id block). Running sums of those counts give
    every block its offset; only a block, at most `id_block` ids of one instant, is ranked
    row by row. Ids must be whole numbers and unique. Rows without a time come first.
    """
    block = [*keys, "_chunk", "_instant", "_block"]
    tagged = df.withColumns(
        {
            "_instant": F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(2**62))),
            "_block": F.floor(F.col(id_col) / id_block),
        }
    ).withColumn("_chunk", F.floor(F.col("_instant") / (chunk_s * 1_000_000)))
    fine = tagged.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"))
    chunks = fine.groupBy(*keys, "_chunk").agg(F.sum("_n").alias("_cn"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    chunk_at = chunks.select(*keys, "_chunk", F.coalesce(F.sum("_cn").over(before), F.lit(0)).alias("_at"))
    inside = W.partitionBy(*keys, "_chunk").orderBy("_instant", "_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        fine.withColumn("_off", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .transform(lambda d: join_null_safe(d, chunk_at, [*keys, "_chunk"]))
        .select(*block, (F.col("_at") + F.col("_off")).alias("_off"))
    )
    rank = F.row_number().over(W.partitionBy(*block).orderBy(id_col))
    placed = join_null_safe(tagged, offsets, block).withColumn(out, F.col("_off") + rank)
    return placed.select(*df.columns, out)


def assign_codes(df: DataFrame, prefix: str, ts: str, id_col: str, out: str = "code") -> DataFrame:
    """PREFIX-YYYY-00001 with one global counter by (ts, id); the year is only a label."""
    numbered = ordered_position(df, [], ts, id_col, "_seq")
    return numbered.withColumn(out, code(prefix, year(ts), "_seq")).drop("_seq")


def chunked_lag(
    df: DataFrame, keys: list[str], ts: str, id_col: str, value: str, out: str, chunk_s: int = 3600
) -> DataFrame:
    """The previous row's value within a key by (ts, id).

    `lag` runs inside (key, chunk); the first row of a chunk takes the last value of the
    key's previous chunk, found with a combinable `max_by` per chunk. Rows without a key
    are a group of their own; rows without a time come first in theirs.
    """
    order = F.struct(F.col(ts), F.col(id_col))
    tagged = df.withColumn("_chunk", _chunk(ts, chunk_s))
    last = tagged.groupBy(*keys, "_chunk").agg(F.max_by(value, order).alias("_last"))
    carried = last.select(
        *keys, "_chunk", F.lag("_last").over(W.partitionBy(*keys).orderBy("_chunk")).alias("_carried")
    )
    w = W.partitionBy(*keys, "_chunk").orderBy(ts, id_col)
    inside = join_null_safe(tagged, carried, [*keys, "_chunk"]).withColumns(
        {"_rn": F.row_number().over(w), "_lag": F.lag(value).over(w)}
    )
    return inside.withColumn(out, F.when(F.col("_rn") == 1, F.col("_carried")).otherwise(F.col("_lag"))).select(
        *df.columns, out
    )


def status_transitions(events: DataFrame, chunk_s: int = 3600) -> DataFrame:
    """Real status changes: (request, old, new, when), first status of a request left out."""
    lagged = chunked_lag(events, ["request_id"], "event_at", "event_id", "new_status", "old_status", chunk_s)
    return lagged.filter(F.col("old_status") != F.col("new_status"))


def pct_change(df: DataFrame, keys: list[str], period: str, value: str, out: str = "pct_change") -> DataFrame:
    """Percent change to the previous period, which must be a whole number and dense.

    The previous period is fetched by an equi-join on (keys, period + 1): both sides are
    one row per key and period, and a missing period yields NULL.
    """
    before = df.select(*keys, (F.col(period) + 1).alias(period), F.col(value).alias("_before"))
    joined = join_null_safe(df, before, [*keys, period], "left")
    return joined.withColumn(out, pct_change_of(value, "_before")).withColumnRenamed("_before", f"previous_{value}")


def dense_periods(df: DataFrame, keys: list[str], period: str, value: str, first: Column, last: Column) -> DataFrame:
    """One row per key and whole-number period from `first` to `last`; periods without a row count 0."""
    every = df.select(*keys).distinct().withColumn(period, F.explode(F.sequence(first, last)))
    return join_null_safe(every, df, [*keys, period], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def rolling(daily: DataFrame, days: int, day: str = "day", value: str = "n", keys: tuple = ()) -> DataFrame:
    """Rolling sum and mean per calendar day over the last `days` days, gaps counted as 0.

    Runs on a daily aggregate: each day's value is sent to the `days` days it counts for and
    summed there, so there is no single-group window. Missing keys are a key of their own; a row
    without a day stays, with no rolling values.
    """
    ahead = F.explode(F.sequence(F.lit(0), F.lit(days - 1)))
    dated = daily.filter(F.col(day).isNotNull())
    spread = dated.select(*keys, day, value, ahead.alias("_ahead")).withColumn("_to", F.date_add(day, F.col("_ahead")))
    sums = spread.groupBy(*keys, F.col("_to").alias(day)).agg(F.sum(value).alias(f"rolling_{value}"))
    return (
        join_null_safe(daily, sums, [*keys, day], "left")
        .withColumn(f"rolling_avg_{value}", F.col(f"rolling_{value}") / F.lit(float(days)))
    )


def ranked(df: DataFrame, part: list[str], order: list, k: int | None = None, dense: bool = False) -> DataFrame:
    """Rank with ties. With k, Spark keeps at most the top ranks per partition before the shuffle.

    Without k, each part is one window group; `ranked_all` ranks parts of any size.
    """
    w = W.partitionBy(*part).orderBy(*order)
    out = df.withColumn("rank", (F.dense_rank() if dense else F.rank()).over(w))
    return out if k is None else out.filter(F.col("rank") <= k)


def ranked_all(df: DataFrame, part: list[str], columns: list[tuple[str, str]], dense: bool = False, out: str = "rank") -> DataFrame:
    """Rank with ties of every row within `part` by (column, "asc" or "desc"), hot parts included.

    Rows are counted per distinct value first, which combines before the shuffle. The values are
    cut by range, so a part with very many of them lies in several pieces; running sums inside a
    piece start from the totals of the pieces before it. Missing keys are a part of their own;
    missing values come first ascending and last descending.
    """
    names = [c for c, _ in columns]
    order = [F.col(c).asc() if d == "asc" else F.col(c).desc() for c, d in columns]
    values = df.groupBy(*part, *names).agg(F.count(F.lit(1)).alias("_n"))
    cut = materialize(values.repartitionByRange(*part, *order).withColumn("_piece", F.spark_partition_id()), "rank-values")
    step = F.lit(1) if dense else F.col("_n")
    totals = cut.groupBy(*part, "_piece").agg(F.sum(step).alias("_total"))
    before = W.partitionBy(*part).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    opening = totals.select(*part, "_piece", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*part, "_piece").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = join_null_safe(cut, opening, [*part, "_piece"])
    rank = F.lit(1) + F.col("_before") + F.coalesce(F.sum(step).over(inside), F.lit(0))
    return join_null_safe(df, placed.select(*part, *names, rank.alias(out)), [*part, *names])


def timeline(su: DataFrame, r: DataFrame) -> DataFrame:
    """Tracker steps: a request's history rows, or four synthetic steps when it has none.

    The newest history row is current and the others are done. It is found by one
    combinable aggregate per request, so a long history is not gathered in one task. History
    without a request id is kept, as the history of one request of its own.
    """
    newest = su.groupBy("request_id").agg(
        F.max(F.struct("updated_at", "update_id")).alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    is_last = F.struct("updated_at", "update_id") == F.col("_last")
    real = join_null_safe(su, newest, ["request_id"]).select(
        "request_id",
        F.initcap(F.replace("new_status", F.lit("_"), F.lit(" "))).alias("step"),
        F.col("updated_at").alias("at"),
        (~is_last).cast("int").alias("done"),
        is_last.cast("int").alias("is_current"),
    )
    status = F.col("status")

    def step(name, at, done, current):
        return F.struct(
            F.lit(name).alias("step"),
            at.cast("timestamp_ntz").alias("at"),
            done.cast("int").alias("done"),
            current.cast("int").alias("is_current"),
        )

    none = F.lit(None)
    steps = F.array(
        step("Submitted", F.col("submitted_at"), status != "pending", F.lit(False)),
        step(
            "Assigned",
            F.col("assigned_at"),
            status.isin("assigned", "in_progress", "resolved", "closed"),
            status == "assigned",
        ),
        step("In Progress", none, status.isin("in_progress", "resolved", "closed"), status == "in_progress"),
        step("Resolved", F.col("resolved_at"), status.isin("resolved", "closed"), status == "resolved"),
    )
    bare = join_null_safe(r, newest.select("request_id"), ["request_id"], "left_anti")
    synthetic = bare.select("request_id", F.explode(steps).alias("s")).select("request_id", "s.*")
    return real.unionByName(synthetic)


# -- sort, limit, top-k -----------------------------------------------------------


def top_sorted(df: DataFrame, *orders) -> DataFrame:
    return df.orderBy(*orders)


def flag_first(df: DataFrame, cond: Column, *orders) -> DataFrame:
    return df.orderBy(cond.desc(), *orders)


def top_k(df: DataFrame, orders: list, k: int, tiebreak: list) -> DataFrame:
    """First k rows; planned as a per-partition top-k and one merge."""
    return df.orderBy(*orders, *tiebreak).limit(k)


def page(df: DataFrame, orders: list, page_no: int, limit: int) -> DataFrame:
    return df.orderBy(*orders).offset((page_no - 1) * limit).limit(limit)


def page_after(df: DataFrame, ts: str, id_col: str, last_ts, last_id, limit: int) -> DataFrame:
    """Keyset page, newest first: reads only rows after the last one shown."""
    bound = F.lit(str(last_ts)).cast("timestamp_ntz")
    after = (F.col(ts) < bound) | ((F.col(ts) == bound) & (F.col(id_col) > last_id))
    return df.filter(after).orderBy(F.col(ts).desc(), id_col).limit(limit)


def top_k_per(df: DataFrame, key: list[str], score: list, k: int, out: str = "rn") -> DataFrame:
    """Best k rows per key; Spark cuts each partition to k per key before the shuffle."""
    w = W.partitionBy(*key).orderBy(*score)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def sort_by(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    return df.orderBy(*[F.col(c).asc() if d == "asc" else F.col(c).desc() for c, d in columns])


def sample_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """A repeatable sample: the n rows with the smallest key hash."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


# -- set operations ---------------------------------------------------------------


def union_to(shape: list[str], *dfs: DataFrame) -> DataFrame:
    out = dfs[0].select(*shape)
    for df in dfs[1:]:
        out = out.unionByName(df.select(*shape))
    return out


def first_distinct(df: DataFrame, key: list[str], rank: str) -> DataFrame:
    """One row per key, the one of lowest rank, of equal ranks the least by all columns."""
    ordered = [rank, *(c for c in df.columns if c not in (rank, *key))]
    least = df.groupBy(*key).agg(F.min(F.struct(*ordered)).alias("_row"))
    return least.select(*(F.col(c) if c in key else F.col(f"_row.{c}") for c in df.columns))


def sorted_set(c) -> Column:
    return F.array_sort(F.array_distinct(c))
