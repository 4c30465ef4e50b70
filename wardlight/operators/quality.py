"""Constraint checks: each returns the rows (or keys) that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.functions.measures import n_rows


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; counts combine map-side, so hot keys cost nothing extra."""
    return df.groupBy(*keys).agg(n_rows().alias("n")).filter("n > 1")


def check_fk(df: DataFrame, col: str, dim: DataFrame, key: str) -> DataFrame:
    """Foreign-key values without a dimension row, with how many rows carry them.

    Values are counted before the anti-join, so only distinct values meet the dimension.
    """
    used = df.filter(F.col(col).isNotNull()).groupBy(F.col(col)).agg(n_rows().alias("n"))
    return used.join(dim.select(F.col(key).alias(col)), col, "left_anti")


def check_domain(df: DataFrame, col: str, values) -> DataFrame:
    return df.filter(F.col(col).isNull() | ~F.col(col).isin(*values))


def check_range(df: DataFrame, col: str, lo=None, hi=None) -> DataFrame:
    bad = F.col(col).isNull()
    if lo is not None:
        bad = bad | (F.col(col) < lo)
    if hi is not None:
        bad = bad | (F.col(col) > hi)
    return df.filter(bad)


def check_required(df: DataFrame, col: str, min_length: int = 1) -> DataFrame:
    """Missing texts and texts shorter than `min_length` after trimming."""
    return df.filter(F.col(col).isNull() | (F.length(F.trim(F.col(col))) < min_length))


def check_lifecycle(r: DataFrame) -> DataFrame:
    """Requests whose status and times contradict each other, with the reason."""
    problem = F.when(F.col("status").isin("resolved", "closed") & F.col("resolved_at").isNull(), "done without resolved_at")
    problem = problem.when(F.col("resolved_at") < F.col("submitted_at"), "resolved before submitted")
    problem = problem.when(
        F.col("resolved_at").isNotNull() & ~F.col("status").isin("resolved", "closed"), "resolved_at on open request"
    )
    return r.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def cascade_delete(child: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent was not removed."""
    return child.join(removed.select(key), key, "left_anti")


def set_null_on_delete(child: DataFrame, removed: DataFrame, col: str, key: str) -> DataFrame:
    """Child rows with references to removed parents set to NULL."""
    gone = removed.select(F.col(key).alias(col), F.lit(True).alias("_gone")).distinct()
    joined = child.join(gone, col, "left")
    kept = F.when(F.col("_gone").isNull(), F.col(col))
    return joined.withColumn(col, kept).select(*child.columns)
