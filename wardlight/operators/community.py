"""Duplicates, contribution badges, leaderboards, digests and area activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.columns import ago, as_of_ts
from wardlight.functions.measures import count_where, is_done, n_rows, status_is
from wardlight.operators.windows import ranked
from wardlight.session import materialize


def word_set(text) -> Column:
    """Sorted distinct lower-case words of a text."""
    c = F.col(text) if isinstance(text, str) else text
    words = F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def duplicate_requests(r: DataFrame, id_col: str, text: str, block: list[str]) -> DataFrame:
    """Requests of one block (say category and location) that say the same thing.

    Two texts match when their sets of words are equal, whatever the order, case and
    punctuation. Every later request is linked to the first of its group, so a group of n
    copies gives n - 1 rows, not all pairs. The texts are read once into a table of
    (id, block, hash of the word set); the first id is a combinable minimum over it, and
    texts are never shuffled.
    """
    words = F.array_join(word_set(text), " ")
    keyed = materialize(r.select(id_col, *block, F.md5(words).alias("_print")), "fingerprints")
    first = keyed.groupBy(*block, "_print").agg(F.min(id_col).alias("original_id"), n_rows().alias("copies"))
    linked = keyed.join(first.filter("copies > 1"), [*block, "_print"])
    return linked.filter(F.col(id_col) != F.col("original_id")).select(id_col, *block, "original_id", "copies")


# Badge names and the counts that earn them.
BADGES = {
    "first_reporter": 1,
    "category_hunter": 5,
    "ward_warrior": 3,
    "quick_fix": 5,
    "community_champion": 10,
    "super_helper": 50,
}


def badges(r: DataFrame, usr: DataFrame, hunter_cat: int, quick_hours: float = 24) -> DataFrame:
    """Badges per user: first report, 5 of one category, 3 in the own ward, 5 fixed quickly,
    10 in a month, 50 in all. Requests are counted per (user, location, month) before the
    users are joined, so a very active user meets the join as a few rows."""
    home = usr.select("user_id", F.col("location_id").alias("_home"))
    cells = r.groupBy("user_id", "location_id", F.trunc("submitted_at", "MM").alias("_m")).agg(
        n_rows().alias("n"),
        count_where(F.col("cat_id") == hunter_cat).alias("cat"),
        count_where(is_done() & (F.col("resolution_hours") < quick_hours)).alias("quick"),
    )
    local = F.when(F.col("location_id") == F.col("_home"), F.col("n")).otherwise(0)
    months = (
        cells.join(home, "user_id")
        .groupBy("user_id", "_m")
        .agg(F.sum("n").alias("n"), F.sum("cat").alias("cat"), F.sum(local).alias("ward"), F.sum("quick").alias("quick"))
    )
    per_user = months.groupBy("user_id").agg(
        F.sum("n").alias("total"),
        F.sum("cat").alias("in_category"),
        F.sum("ward").alias("in_ward"),
        F.sum("quick").alias("quick_fixes"),
        F.max("n").alias("best_month"),
    )
    source = dict(zip(BADGES, ["total", "in_category", "in_ward", "quick_fixes", "best_month", "total"]))
    earned = F.array_compact(F.array(*[F.when(F.col(c) >= BADGES[b], F.lit(b)) for b, c in source.items()]))
    return per_user.withColumn("badges", F.array_join(earned, ", "))


def leaderboard(r: DataFrame, usr: DataFrame, month: str, k: int = 10) -> DataFrame:
    """Top contributors per ward in one month, opted-in users only, ties share a rank."""
    start = F.to_date(F.lit(f"{month}-01"))
    in_month = (F.col("submitted_at") >= start.cast("timestamp_ntz")) & (
        F.col("submitted_at") < F.add_months(start, 1).cast("timestamp_ntz")
    )
    counts = r.filter(in_month).groupBy("user_id").agg(n_rows().alias("reports"), F.max("submitted_at").alias("last_report"))
    shown = usr.filter("opt_in").select("user_id", F.split("full_name", " ")[0].alias("first_name"), "location_id")
    return ranked(counts.join(shown, "user_id"), ["location_id"], [F.col("reports").desc()], k)


def user_digest(r: DataFrame, as_of) -> DataFrame:
    """Per user: requests by state, this week's reports and fixes, and a one-line summary."""
    week = ago(as_of, 7, "DAY")
    counts = r.groupBy("user_id").agg(
        n_rows().alias("total"),
        count_where(is_done()).alias("fixed"),
        count_where(status_is("assigned", "in_progress")).alias("assigned"),
        count_where(status_is("pending")).alias("pending"),
        count_where(F.col("submitted_at") >= week).alias("reported_this_week"),
        count_where(F.col("resolved_at") >= week).alias("fixed_this_week"),
    )
    text = F.format_string(
        "Your %d complaints: %d fixed, %d assigned, %d pending", "total", "fixed", "assigned", "pending"
    )
    return counts.withColumn("summary", text)


def impact_counters(r: DataFrame, cat: DataFrame) -> DataFrame:
    """Requests fixed per category over all time."""
    fixed = r.filter(is_done()).groupBy("cat_id").agg(n_rows().alias("fixed"))
    return cat.select("cat_id", "cat_name").join(fixed, "cat_id")


def area_activity(r: DataFrame, usr: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Per user: other people of the same location who reported in the last `days`."""
    active = r.filter(
        (F.col("submitted_at") >= ago(as_of, days, "DAY")) & (F.col("submitted_at") <= as_of_ts(as_of))
    ).select("user_id").distinct()
    homes = usr.select("user_id", "location_id")
    per_area = active.join(homes, "user_id").groupBy("location_id").agg(n_rows().alias("_active"))
    own = active.withColumn("_own", F.lit(1))
    joined = homes.join(per_area, "location_id", "left").join(own, "user_id", "left")
    others = F.coalesce("_active", F.lit(0)) - F.coalesce("_own", F.lit(0))
    return joined.select("user_id", "location_id", others.cast("long").alias("neighbours_active"))


def slow_report(log: DataFrame, limit_ms: float = 100, op: str = "operation", duration: str = "duration_ms") -> DataFrame:
    """Operations with a mean duration above the limit, most frequent first."""
    stats = log.groupBy(op).agg(F.round(F.avg(duration), 4).alias("avg_ms"), n_rows().alias("n"), F.avg(duration).alias("_raw"))
    return stats.filter(F.col("_raw") > limit_ms).drop("_raw").orderBy(F.col("n").desc(), op)
