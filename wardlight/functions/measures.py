"""Aggregate expressions and grouped reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.columns import col
from wardlight.session import settle

DONE = ("resolved", "closed")
OPEN = ("pending", "assigned", "in_progress")


def n_rows() -> Column:
    return F.count(F.lit(1))


def n_of(c) -> Column:
    return F.count(col(c))


def stat(c, fn: str, digits: int | None = None) -> Column:
    """sum, avg, min or max over doubles, optionally rounded."""
    out = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[fn](col(c).cast("double"))
    return out if digits is None else F.round(out, digits)


def count_where(cond: Column) -> Column:
    """Rows that satisfy the condition; 0, never NULL, for an empty group."""
    return F.count_if(cond)


def avg_where(cond: Column, c) -> Column:
    return F.avg(F.when(cond, col(c).cast("double")))


def pct(num, den, digits: int = 1) -> Column:
    """Percentage that is NULL, not an error, on a zero denominator."""
    return F.round(col(num) * F.lit(100.0) / F.nullif(col(den).cast("double"), F.lit(0.0)), digits)


def is_done() -> Column:
    return F.col("status").isin(*DONE)


def status_is(*values: str) -> Column:
    return F.col("status").isin(*values)


def pct_of_total(df: DataFrame, count_col: str, digits: int = 1, out: str = "pct_of_total") -> DataFrame:
    """Share of the grand total, read through a one-row scalar subquery."""
    total = df.agg(F.sum(count_col).alias("grand_total"))
    return df.withColumn(out, pct(F.col(count_col), total.scalar(), digits))


def distinct_list(df: DataFrame, keys: list[str], c: str, out: str) -> DataFrame:
    """Sorted distinct values joined by ', ' per group.

    Values are made distinct by a combinable aggregate first, so a hot group brings only
    its distinct values, never its rows, to one task.
    """
    seen = df.select(*keys, c).distinct()
    return seen.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(c)), ", ").alias(out))


def grouped(df: DataFrame, keys: list, measures: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])


def totals(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    return df.agg(*[m.alias(n) for n, m in measures.items()])


def having(df: DataFrame, cond: Column) -> DataFrame:
    return df.filter(cond)


def group_mean(df: DataFrame, key: str, c: str, out: str) -> DataFrame:
    """Mean of a group on each of its rows: a combinable aggregate joined back.

    A window would bring a hot group's rows to one task; the aggregate is one row per key.
    """
    means = df.groupBy(key).agg(F.avg(F.col(c).cast("double")).alias(out))
    return df.join(settle(means, "group-means"), key, "left")


def daily_counts(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("location_id", "incident_date").agg(n_rows().alias("n"))


def error_metrics(df: DataFrame, pred, actual, keys: tuple = ()) -> DataFrame:
    """MAE, RMSE and R2 in one pass, from sums that combine map-side.

    The spread of the actuals comes from `var_pop`, which merges partial moments stably.
    """
    p, a = col(pred).cast("double"), col(actual).cast("double")
    both = p.isNotNull() & a.isNotNull()
    base = df.filter(both).select(*keys, (p - a).alias("_e"), a.alias("_a"))
    agg = base.groupBy(*keys).agg(
        n_rows().alias("n"),
        F.avg(F.abs("_e")).alias("mae"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.avg(F.col("_e") * F.col("_e")).alias("_mse"),
        F.var_pop("_a").alias("_var"),
    )
    r2 = 1 - F.col("_mse") / F.nullif(F.col("_var"), F.lit(0.0))
    return agg.withColumn("r2", r2).drop("_mse", "_var")
