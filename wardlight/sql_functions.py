"""Rules as SQL functions, so that they can be called from `spark.sql`."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "time_of_day(h INT)": (
        "STRING",
        "CASE WHEN h IS NULL THEN 'unknown' WHEN h BETWEEN 4 AND 7 THEN 'dawn' WHEN h BETWEEN 8 AND 11 THEN 'morning' "
        "WHEN h BETWEEN 12 AND 16 THEN 'afternoon' WHEN h BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END",
    ),
    "sla_status(age_hours BIGINT, sla_hours BIGINT)": (
        "STRING",
        "CASE WHEN age_hours > sla_hours THEN 'BREACHED' ELSE 'WITHIN SLA' END",
    ),
    "risk_level(score DOUBLE)": (
        "STRING",
        "CASE WHEN score >= 75 THEN 'critical' WHEN score >= 55 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END",
    ),
    "frequency_priority(base INT, freq BIGINT)": (
        "INT",
        "CASE WHEN freq >= 10 THEN 1 WHEN freq >= 5 THEN greatest(1, base - 1) WHEN freq >= 2 THEN base "
        "ELSE least(4, base + 1) END",
    ),
    "routed_department(cat INT, routes MAP<INT, INT>)": ("INT", "try_element_at(routes, cat)"),
    "safety_score(crimes BIGINT, severe BIGINT, requests BIGINT)": (
        "DOUBLE",
        "greatest(0.0D, least(100.0D, 100.0D - crimes * 4 - severe * 3 - requests * 0.5D))",
    ),
    "resolution_hours(a TIMESTAMP, b TIMESTAMP)": (
        "DECIMAL(8,2)",
        "CAST(((unix_micros(b) - unix_micros(a)) DIV 60000000) / 60 AS DECIMAL(8,2))",
    ),
}


def register_functions(spark: SparkSession) -> None:
    for signature, (result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body}")
