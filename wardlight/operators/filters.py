"""Projections, filters and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.columns import ago, as_of_ts, col


def select_as(df: DataFrame, columns: dict) -> DataFrame:
    return df.select(*[col(expr).alias(name) for name, expr in columns.items()])


def with_tag(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def _equals(df: DataFrame, options: dict) -> DataFrame:
    return df.filter(all_of([F.col(c) == F.lit(v) for c, v in options.items() if v is not None]))


def filter_requests(r: DataFrame, status=None, cat_id=None, location_id=None, dept_id=None, search=None) -> DataFrame:
    """AND of the given filters; a filter left as None is not applied."""
    out = _equals(r, {"status": status, "cat_id": cat_id, "location_id": location_id, "dept_id": dept_id})
    return search_requests(out, search) if search else out


def filter_incidents(
    i: DataFrame, as_of, days: int = 90, crime_type_id=None, location_id=None, severity=None, status=None
) -> DataFrame:
    recent = i.filter(F.col("incident_date") >= F.date_sub(as_of_ts(as_of).cast("date"), days))
    return _equals(
        recent, {"crime_type_id": crime_type_id, "location_id": location_id, "severity": severity, "status": status}
    )


def search_requests(r: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring of title or code; '%' and '_' are plain characters."""
    needle = F.lit(text.lower())
    return r.filter(F.contains(F.lower("title"), needle) | F.contains(F.lower("code"), needle))


def find_by_code(r: DataFrame, i: DataFrame, codes: DataFrame) -> DataFrame:
    """Look codes up, trimmed and upper-cased; CRM- codes are incidents, all others requests."""
    asked = codes.select(F.upper(F.trim("code")).alias("code")).distinct()
    is_crime = F.startswith(F.col("code"), F.lit("CRM-"))
    requests = r.select(F.upper("code").alias("code"), F.col("request_id").alias("id"), "status")
    incidents = i.select(F.upper("incident_code").alias("code"), F.col("incident_id").alias("id"), "status")
    return (
        asked.filter(~is_crime).join(requests, "code").withColumn("record_type", F.lit("request"))
    ).unionByName(asked.filter(is_crime).join(incidents, "code").withColumn("record_type", F.lit("incident")))


def scope_for(r: DataFrame, user_id: int, role: str, dept_id: int | None = None) -> DataFrame:
    """The rows a viewer may see: citizens their own, officers their department's, admins all."""
    if role == "citizen":
        return r.filter(F.col("user_id") == user_id)
    if role == "officer":
        return r.filter(F.col("dept_id") == dept_id)
    return r


def scope_rows(r: DataFrame, users: DataFrame, viewer_id: int) -> DataFrame:
    """`scope_for` with role and department looked up in the users table.

    The viewer's one row is read first, so the scope is a literal filter that reaches the scan.
    """
    who = users.filter(F.col("user_id") == viewer_id).select("role", "dept_id").first()
    if who is None:
        return r.limit(0)
    return scope_for(r, viewer_id, who["role"], who["dept_id"])


def in_set(c, values) -> Column:
    return col(c).isin(*values)


def not_in_set(c, values) -> Column:
    return ~col(c).isin(*values)


def in_range(c, lo, hi) -> Column:
    return col(c).between(lo, hi)


def present(*cols) -> Column:
    return all_of([col(c).isNotNull() for c in cols])


def like_const(c, text: str, prefix: bool = False) -> Column:
    lowered, needle = F.lower(col(c)), F.lit(text.lower())
    return F.startswith(lowered, needle) if prefix else F.contains(lowered, needle)


def trailing(df: DataFrame, ts: str, as_of, window: str) -> DataFrame:
    """Rows of the last n units, e.g. '30 days'; the bound is a literal and reaches the scan."""
    n, unit = window.split()
    return df.filter(F.col(ts) >= ago(as_of, int(n), unit.rstrip("s").upper()))


def is_night() -> Column:
    return (F.col("time_of_day") == "night") | (F.col("incident_hour").isNotNull() & (F.col("incident_hour") >= 20))


def match_dept(df: DataFrame, text: str) -> DataFrame:
    """Department names containing the part of the text before '&'."""
    return df.filter(F.contains("dept_name", F.lit(text.split("&")[0].strip())))


_OPS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(*v),
    "contains": lambda c, v: F.contains(F.lower(c), F.lit(v.lower())),
}


def apply_filters(df: DataFrame, triples) -> DataFrame:
    return df.filter(all_of([_OPS[op](F.col(c), v) for c, op, v in triples]))


def date_preset(df: DataFrame, ts: str, name: str, as_of, lo=None, hi=None) -> DataFrame:
    """Rows of 'today', '7d', '30d' or a 'custom' closed range, up to `as_of`."""
    now = as_of_ts(as_of)
    start = {
        "today": now.cast("date").cast("timestamp_ntz"),
        "7d": ago(as_of, 7, "DAY"),
        "30d": ago(as_of, 30, "DAY"),
        "custom": as_of_ts(lo) if lo is not None else now,
    }[name]
    end = as_of_ts(hi) if name == "custom" else now
    return df.filter(F.col(ts).between(start, end))
