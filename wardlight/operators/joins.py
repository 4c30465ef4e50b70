"""Star joins, dimension-preserving aggregates and existence checks.

No join carries a broadcast hint: Catalyst broadcasts a side only when its measured size is
under `autoBroadcastJoinThreshold`, and otherwise sorts and merges with AQE splitting skew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.columns import as_of_ts, units_between
from wardlight.functions.measures import DONE


def enrich_requests(r: DataFrame, cat=None, loc=None, dept=None, pri=None, usr=None) -> DataFrame:
    """Inner star join over the dimensions that are given."""
    out = r
    if usr is not None:
        out = out.join(usr.selectExpr("user_id", "full_name AS citizen_name"), "user_id")
    if cat is not None:
        out = out.join(cat.select("cat_id", "cat_name", "icon_class"), "cat_id")
    if loc is not None:
        out = out.join(loc.select("location_id", "area_name", "ward_number", "zone"), "location_id")
    if dept is not None:
        out = out.join(dept.select("dept_id", "dept_name", "dept_code"), "dept_id")
    if pri is not None:
        out = out.join(
            pri.select("priority_id", "priority_name", "priority_level", "color_code", "sla_hours"), "priority_id"
        )
    return out


def enrich_incidents(i: DataFrame, types: DataFrame, loc: DataFrame) -> DataFrame:
    kinds = types.select("crime_type_id", "type_name", "type_code", "severity", "icon", "color_hex", "ipc_section")
    places = loc.select("location_id", "area_name", "ward_number", "zone")
    return i.join(kinds, "crime_type_id").join(places, "location_id")


def dim_left_agg(dim: DataFrame, fact: DataFrame, key: str, aggs: dict[str, Column], zero=()) -> DataFrame:
    """Every dimension row with its fact measures; the fact is reduced to one row per key first."""
    summary = fact.groupBy(key).agg(*[a.alias(n) for n, a in aggs.items()])
    return left_join_aggs(dim, [summary], key, zero)


def left_join_aggs(dim: DataFrame, aggs: list[DataFrame], key: str, zero=()) -> DataFrame:
    out = reduce(lambda left, right: left.join(right, key, "left"), aggs, dim)
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero}) if zero else out


def category_join(cat: DataFrame, r: DataFrame, dept: DataFrame, aggs: dict[str, Column], zero=()) -> DataFrame:
    """Categories LEFT JOIN facts, then INNER JOIN departments."""
    base = dim_left_agg(cat, r, "cat_id", aggs, zero)
    return base.join(dept.select("dept_id", "dept_name"), "dept_id")


def with_actor_names(r: DataFrame, usr: DataFrame, default: str = "Assigned Officer") -> DataFrame:
    """The users dimension in two roles: the citizen (inner) and the officer (left, with default)."""
    citizen = usr.selectExpr("user_id", "full_name AS citizen_name")
    officer = usr.selectExpr("user_id AS assigned_to", "full_name AS _officer")
    joined = r.join(citizen, "user_id").join(officer, "assigned_to", "left")
    return joined.withColumn("officer_name", F.coalesce("_officer", F.lit(default))).drop("_officer")


def join_using(left: DataFrame, right: DataFrame, key) -> DataFrame:
    return left.join(right, key)


def left_join_on(left: DataFrame, right: DataFrame, cond: Column) -> DataFrame:
    return left.join(right, cond, "left")


def with_scalar(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Attach the single value of a one-row, one-column frame as a scalar subquery."""
    return df.withColumn(name, one_row.scalar())


def location_counts(r: DataFrame, i: DataFrame, types: DataFrame, loc: DataFrame, as_of_r, as_of_i, days=30) -> DataFrame:
    """Recent incidents, severe incidents and requests per location: each fact is scanned once."""
    since = F.date_sub(as_of_ts(as_of_i).cast("date"), days)
    severe = F.col("severity").isin("critical", "high")
    kinds = types.select("crime_type_id", "severity")
    crimes = (
        i.filter(F.col("incident_date") >= since)
        .join(kinds, "crime_type_id", "left")
        .groupBy("location_id")
        .agg(
            F.count(F.lit(1)).alias("crime_count_30d"),
            F.count_if(severe).alias("critical_crimes_30d"),
        )
    )
    recent = F.col("submitted_at") >= as_of_ts(as_of_r) - F.expr(f"INTERVAL {days} DAY")
    asks = r.filter(recent).groupBy("location_id").agg(F.count(F.lit(1)).alias("request_count_30d"))
    return left_join_aggs(
        loc, [crimes, asks], "location_id", ("crime_count_30d", "critical_crimes_30d", "request_count_30d")
    )


def known_fk(df: DataFrame, dim: DataFrame, key) -> DataFrame:
    return df.join(dim.select(key), key, "left_semi")


def missing_keys(df: DataFrame, dim: DataFrame, key) -> DataFrame:
    return df.join(dim.select(key), key, "left_anti")


def lookup_or_default(df: DataFrame, dim: DataFrame, key: str, value: str, default) -> DataFrame:
    """Left lookup of one value with a default for unknown keys."""
    return df.join(dim.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def age_hours(as_of, ts: str = "submitted_at") -> Column:
    return units_between("HOUR", ts, as_of_ts(as_of))


def is_breached(as_of, closed_statuses=DONE) -> Column:
    """1 when an unfinished request is older than its SLA; age equal to the SLA is in time."""
    late = ~F.col("status").isin(*closed_statuses) & (age_hours(as_of) > F.col("sla_hours"))
    return F.when(late, 1).otherwise(0)
