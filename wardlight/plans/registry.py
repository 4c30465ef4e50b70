"""Name -> (query, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.plans.roles import Roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain_types(df: DataFrame) -> DataFrame:
    """Timestamps without zone and decimals as doubles, so any client reads the same values."""
    out = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz").alias(field.name)
        elif isinstance(field.dataType, T.DecimalType):
            c = c.cast("double").alias(field.name)
        out.append(c)
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register `fn(roles) -> DataFrame`, with its oracle SQL where one exists."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: plain_types(fn(Roles(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
