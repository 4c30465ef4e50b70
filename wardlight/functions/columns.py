"""Scalar column helpers. Every helper is a native expression, so plans stay in codegen."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER = {
    "SECOND": 1_000_000,
    "MINUTE": 60_000_000,
    "HOUR": 3_600_000_000,
    "DAY": 86_400_000_000,
    "WEEK": 604_800_000_000,
}

# Hour ranges (first hour, last hour, name) of the three time-of-day presets.
TIME_OF_DAY = {
    "schema": [(4, 7, "dawn"), (8, 11, "morning"), (12, 16, "afternoon"), (17, 20, "evening")],
    "api": [(5, 11, "morning"), (12, 16, "afternoon"), (17, 20, "evening")],
    "forecast": [(6, 11, "morning"), (12, 17, "afternoon"), (18, 20, "evening")],
}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- time -------------------------------------------------------------------------


def as_of_ts(as_of) -> Column:
    """The caller's "now": a string or datetime literal, or any timestamp column."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, datetime):
        as_of = as_of.isoformat(sep=" ")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def ago(as_of, n: int, unit: str) -> Column:
    """`as_of` minus n units; folds to a literal, so filters on it reach the scan."""
    return as_of_ts(as_of) - F.expr(f"INTERVAL {int(n)} {unit}")


def micros(c) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def seconds(c) -> Column:
    return F.unix_seconds(col(c).cast("timestamp"))


def units_between(unit: str, start, end) -> Column:
    """Whole elapsed units from start to end, truncated towards zero."""
    return F.call_function("div", micros(end) - micros(start), F.lit(MICROS_PER[unit.upper()]))


def resolution_hours(start, end) -> Column:
    """Elapsed whole minutes as hours with two decimals; NULL while unresolved."""
    return (units_between("MINUTE", start, end) / 60).cast("decimal(8,2)")


def month_key(c) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def month_label(c) -> Column:
    return F.date_format(col(c), "MMM yyyy")


def week_label(c) -> Column:
    return F.date_format(col(c), "'Week of 'dd MMM")


def iso_yearweek(c) -> Column:
    """ISO year * 100 + ISO week, e.g. 2024-12-30 -> 202501."""
    return (F.extract(F.lit("YEAROFWEEK"), col(c)) * 100 + F.weekofyear(col(c))).cast("int")


def dow(c) -> Column:
    """1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(col(c))


def month(c) -> Column:
    return F.month(col(c))


def hour(c) -> Column:
    return F.hour(col(c))


def year(c) -> Column:
    return F.year(col(c))


def shift_days(c, n) -> Column:
    return F.date_add(col(c).cast("date"), n)


def as_event_time(c) -> Column:
    return col(c).cast("timestamp_ntz")


def time_of_day(hour_col, preset: str = "schema") -> Column:
    """Bucket an hour number; hours outside every range are 'night', NULL is 'unknown'."""
    h = col(hour_col)
    out = F.when(h.isNull(), "unknown")
    for first, last, name in TIME_OF_DAY[preset]:
        out = out.when(h.between(first, last), name)
    return out.otherwise("night")


# -- numbers ----------------------------------------------------------------------


def rnd(c, n: int) -> Column:
    return F.round(col(c), n)


def clamp(c, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(c)))


def or_default(c, default) -> Column:
    return F.coalesce(col(c), default if isinstance(default, Column) else F.lit(default))


def nullif(a, b) -> Column:
    return F.nullif(col(a), b if isinstance(b, Column) else F.lit(b))


def pmod(a, b) -> Column:
    return F.pmod(col(a), b if isinstance(b, Column) else F.lit(b))


def euclid(x1, y1, x2, y2) -> Column:
    dx, dy = col(x1) - col(x2), col(y1) - col(y2)
    return F.sqrt(dx * dx + dy * dy)


def haversine_m(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle distance in metres on a sphere of radius 6371 km."""
    a1, a2 = F.radians(col(lat1)), F.radians(col(lat2))
    half_lat = F.sin((a2 - a1) / 2)
    half_lng = F.sin(F.radians(col(lng2) - col(lng1)) / 2)
    h = half_lat * half_lat + F.cos(a1) * F.cos(a2) * half_lng * half_lng
    return F.lit(2 * 6371 * 1000) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


# -- text and nesting -------------------------------------------------------------


def map_value(c, mapping: dict, default=None) -> Column:
    """Simple CASE over literal keys."""
    out = None
    for key, value in mapping.items():
        cond = col(c) == F.lit(key)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def code(prefix: str, year_col, seq_col) -> Column:
    """PREFIX-YYYY-00001; numbers above 99,999 keep all their digits."""
    return F.format_string(f"{prefix}-%d-%05d", col(year_col), col(seq_col))


def norm_text(c) -> Column:
    return F.lower(F.trim(col(c)))


def title_case(c) -> Column:
    return F.initcap(F.replace(col(c), F.lit("_"), F.lit(" ")))


def has_text(c, keyword: str) -> Column:
    return F.contains(F.lower(col(c)), F.lit(keyword.lower()))


def count_char(c, ch: str) -> Column:
    return F.length(col(c)) - F.length(F.replace(col(c), F.lit(ch), F.lit("")))


def to_meta(**cols) -> Column:
    """A JSON document from named columns."""
    return F.to_json(F.struct(*[col(v).alias(k) for k, v in cols.items()]))


def from_meta(c, schema: str) -> Column:
    return F.from_json(col(c), schema)


def cut_template(template) -> Column:
    """A template cut at its `{{ key }}` marks: the pieces of text, and the mark before each ('' before the first)."""
    text = F.coalesce(col(template), F.lit(""))
    marks = F.regexp_extract_all(text, F.lit(r"\{\{\s*([^}]+)\s*\}\}"), F.lit(1))
    pieces = F.split(text, r"\{\{\s*[^}]+\s*\}\}", -1)
    return F.struct(F.concat(F.array(F.lit("")), F.transform(marks, lambda mark: F.trim(mark))).alias("marks"), pieces.alias("pieces"))


def fill_cut(cut: Column, context: dict) -> Column:
    """Fill a cut template from context columns; NULLs and unknown keys become ''.

    Each mark is looked up once, so a value that itself contains `{{...}}` is never expanded again.
    """

    def filled(mark, piece):
        value = F.lit("")
        for key, source in context.items():
            value = F.when(mark == key, F.coalesce(col(source).cast("string"), F.lit(""))).otherwise(value)
        return F.concat(value, piece)

    return F.array_join(F.zip_with(cut["marks"], cut["pieces"], filled), "")


def fill_template(template, context: dict) -> Column:
    """Replace `{{ key }}` marks by context columns; NULLs and unknown keys become ''.

    Where few templates fill many rows, cut them before they are joined (`cut_template`).
    """
    return fill_cut(cut_template(template), context)


def pct_change_of(now, before, digits: int = 1) -> Column:
    """Percent change from `before` to `now`; NULL when there is nothing to compare with."""
    base = F.nullif(col(before).cast("double"), F.lit(0.0))
    return F.round((col(now).cast("double") - base) * 100.0 / base, digits)
