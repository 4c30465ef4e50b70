"""The given tables in the roles of requests, incidents and their dimensions.

Each fact view joins only the tables its caller asks for: foreign keys hold, so a join whose
columns nobody reads could only cost a shuffle. `sql.py` states the same views as CTEs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.functions.columns import code, map_value, resolution_hours, time_of_day, year
from wardlight.sources.tables import Tables

REQ_AS_OF = "2001-08-02 00:00:00"
INC_AS_OF = "2024-01-31 00:00:00"

# The dimension rows of the test roles.
PRIORITIES = [
    (1, "Critical", 1, 4380, "#dc3545"),
    (2, "High", 2, 8760, "#fd7e14"),
    (3, "Medium", 3, 17520, "#ffc107"),
    (4, "Low", 4, 26280, "#28a745"),
]
DEPARTMENTS = [
    (1, "Roads & Works", "ROAD", "Head 1", True),
    (2, "Waste & Cleaning", "WAST", "Head 2", True),
    (3, "Water", "WATR", "Head 3", True),
    (4, "Power", "POWR", "Head 4", True),
    (5, "Parks", "PARK", "Head 5", True),
    (6, "Archive", "ARCH", "Head 6", False),
]
CATEGORIES = [
    (1, "ECONOMY", 1, 2, "fa-road", True),
    (2, "LARGE", 2, 2, "fa-trash", True),
    (3, "MEDIUM", 3, 1, "fa-tint", True),
    (4, "PROMO", 4, 1, "fa-bolt", True),
    (5, "SMALL", 5, 3, "fa-tree", True),
    (6, "STANDARD", 1, 4, "fa-building", True),
    (11, "AUTOMOBILE", 1, 3, "fa-car", True),
    (12, "BUILDING", 2, 2, "fa-city", True),
    (13, "FURNITURE", 3, 4, "fa-chair", True),
    (14, "HOUSEHOLD", 4, 1, "fa-house", True),
    (15, "MACHINERY", 5, 2, "fa-gear", True),
    (18, "Other", 6, 4, "fa-question-circle", False),
]
CRIME_TYPES = [
    (1, "error", "ERR", "critical", "E", "#dc2626", True),
    (2, "purchase", "PUR", "high", "P", "#ff3d5a", True),
    (3, "signup", "SIG", "moderate", "S", "#f59e0b", True),
    (4, "click", "CLK", "moderate", "C", "#ff6b35", True),
    (5, "view", "VIW", "low", "V", "#69db7c", False),
]
CAT_IDS = {name: cat_id for cat_id, name, *_ in CATEGORIES}
DEPT_OF = {cat_id: dept for cat_id, _, dept, *_ in CATEGORIES}
DEPT_IDS = {name: dept for _, name, dept, *_ in CATEGORIES}
TYPE_IDS = {name: type_id for type_id, name, *_ in CRIME_TYPES}
LINE_STATUS = {
    "AF": "resolved",
    "NF": "closed",
    "RF": "rejected",
    "NO": "pending",
    "AO": "assigned",
    "RO": "in_progress",
}
ORDER_STATUS = {"P": "pending", "O": "in_progress", "F": "resolved"}
INCIDENT_STATUS = {0: "reported", 1: "fir_filed", 2: "under_investigation", 3: "chargesheet", 4: "resolved"}


def sql_rows(rows) -> str:
    """Python rows as the body of a VALUES clause, readable by Spark and DuckDB alike."""

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


class Roles:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.path = sf_dir
        self.t = Tables(spark, sf_dir)

    def values(self, rows, columns: str) -> DataFrame:
        """A literal relation: Catalyst knows its exact size."""
        return self.spark.sql(f"SELECT * FROM VALUES {sql_rows(rows)} AS v({columns})")

    # -- dimensions ---------------------------------------------------------------

    @cached_property
    def pri(self) -> DataFrame:
        return self.values(PRIORITIES, "priority_id, priority_name, priority_level, sla_hours, color_code")

    @cached_property
    def dept(self) -> DataFrame:
        return self.values(DEPARTMENTS, "dept_id, dept_name, dept_code, head_name, is_active")

    @cached_property
    def cat(self) -> DataFrame:
        return self.values(CATEGORIES, "cat_id, cat_name, dept_id, default_priority_id, icon_class, is_active")

    @cached_property
    def types(self) -> DataFrame:
        return self.values(
            CRIME_TYPES, "crime_type_id, type_name, type_code, severity, icon, color_hex, is_active"
        ).withColumn("ipc_section", F.lit(None).cast("string"))

    @cached_property
    def loc(self) -> DataFrame:
        n = F.col("n_nationkey")
        placed = n != 24
        return (
            self.t["nation"]
            .join(self.t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                n.alias("location_id"),
                F.concat(F.lit("W"), F.lpad((n + 1).cast("string"), 2, "0")).alias("ward_number"),
                F.col("n_name").alias("area_name"),
                F.col("r_name").alias("zone"),
                F.when(placed, F.lit(18.40) + n * F.lit(0.01)).alias("latitude"),
                F.when(placed, F.lit(73.70) + n * F.lit(0.01)).alias("longitude"),
            )
        )

    @cached_property
    def usr(self) -> DataFrame:
        """Customers as users: every 50th is an officer, customer 1 the admin, the rest citizens."""
        key = F.col("c_custkey")
        role = F.when(key == 1, "admin").when(key % 50 == 0, "officer").otherwise("citizen")
        return self.t["customer"].select(
            key.alias("user_id"),
            F.col("c_name").alias("full_name"),
            F.when(key % 23 != 0, F.concat(F.lit("user"), key.cast("string"), F.lit("@example.org"))).alias("email"),
            role.alias("role"),
            F.when(role == "officer", (key % 5 + 1).cast("int")).alias("dept_id"),
            F.col("c_nationkey").alias("location_id"),
            (key % 3 == 0).alias("opt_in"),
        )

    @cached_property
    def docs(self) -> DataFrame:
        return self.t["documents"]

    # -- requests -----------------------------------------------------------------

    def lines(self, category: bool = False, location: bool = False) -> DataFrame:
        """Requests at line grain (no unique id). Joins part and customer only on demand."""
        orders = self.t["orders"].select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
        if location:
            orders = orders.join(
                self.t["customer"].select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
            )
        df = self.t["lineitem"].join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        if category:
            df = df.join(self.t["part"].select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        # Each derived column is a step of its own, so that it is computed once per row.
        df = df.withColumn("status", map_value(F.concat("l_returnflag", "l_linestatus"), LINE_STATUS))
        shipped_after = F.col("status").isin("resolved", "closed") & (F.col("l_shipdate") > F.col("o_orderdate"))
        df = df.withColumn("resolved_at", F.when(shipped_after, F.col("l_shipdate")))
        columns = [
            F.col("o_custkey").alias("user_id"),
            F.least(F.substring("o_orderpriority", 1, 1).cast("int"), F.lit(4)).alias("priority_id"),
            "status",
            F.col("o_orderdate").alias("submitted_at"),
            "resolved_at",
            resolution_hours("o_orderdate", "resolved_at").alias("resolution_hours"),
            F.lit(0).alias("is_hotspot_flag"),
        ]
        if location:
            columns.append(F.col("c_nationkey").alias("location_id"))
        if category:
            columns += [map_value("p_type", CAT_IDS).alias("cat_id"), map_value("p_type", DEPT_IDS).alias("dept_id")]
        return df.select(*columns)

    def requests(self, resolved: bool = True) -> DataFrame:
        """Requests at order grain, one row per order with a unique id; see `with_resolution`."""
        df = self.t["orders"].join(
            self.t["customer"].select("c_custkey", "c_nationkey", "c_mktsegment"),
            F.col("o_custkey") == F.col("c_custkey"),
        )
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        rows = df.select(
            key.alias("request_id"),
            code("REQ", year("o_orderdate"), key).alias("code"),
            cust.alias("user_id"),
            map_value("c_mktsegment", CAT_IDS).alias("cat_id"),
            F.col("c_nationkey").alias("location_id"),
            map_value("c_mktsegment", DEPT_IDS).alias("dept_id"),
            F.least(F.substring("o_orderpriority", 1, 1).cast("int"), F.lit(4)).alias("priority_id"),
            F.concat(F.col("c_mktsegment"), F.lit(" request "), key.cast("string")).alias("title"),
            map_value("o_orderstatus", ORDER_STATUS).alias("status"),
            F.when(F.col("o_orderstatus") != "P", cust - cust % 50).alias("assigned_to"),
            F.col("o_orderdate").alias("submitted_at"),
            F.lit(None).cast("timestamp_ntz").alias("assigned_at"),
            F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
            resolution_hours("o_orderdate", F.lit(None).cast("timestamp_ntz")).alias("resolution_hours"),
            F.lit(0).alias("is_hotspot_flag"),
        )
        return self.with_resolution(rows) if resolved else rows

    def with_resolution(self, rows: DataFrame) -> DataFrame:
        """Requests with their resolution time: the first ship date after the order date.

        A minimum over line items and their request's date, joined and summed up on the same
        key. Given one page of requests, only their line items are kept.
        """
        asked = rows.filter("status = 'resolved'").select(F.col("request_id").alias("_key"), F.col("submitted_at").alias("_asked"))
        shipped = self.t["lineitem"].select("l_orderkey", "l_shipdate")
        later = shipped.join(asked, (F.col("_key") == F.col("l_orderkey")) & (F.col("l_shipdate") > F.col("_asked")))
        first = later.groupBy("_key").agg(F.min("l_shipdate").alias("_first"))
        found = rows.join(first, F.col("request_id") == F.col("_key"), "left").withColumn("resolved_at", F.col("_first"))
        return found.withColumn("resolution_hours", resolution_hours("submitted_at", "resolved_at")).select(rows.columns)

    # -- incidents ----------------------------------------------------------------

    def incidents(self, preset: str = "schema") -> DataFrame:
        parsed = self.t["events"].select(
            "event_id",
            "user_id",
            "event_type",
            "ts",
            F.from_json("props", "k INT")["k"].alias("k"),
            (F.col("user_id") % 25).cast("int").alias("location_id"),
            F.hour("ts").alias("incident_hour"),
        )
        place, k = F.col("location_id"), F.col("k")
        return parsed.select(
            F.col("event_id").alias("incident_id"),
            code("CRM", F.lit(2024), "event_id").alias("incident_code"),
            "user_id",
            map_value("event_type", TYPE_IDS).alias("crime_type_id"),
            "location_id",
            F.col("ts").cast("date").alias("incident_date"),
            "incident_hour",
            time_of_day("incident_hour", preset).alias("time_of_day"),
            (F.lit(18.40) + place * F.lit(0.01) + (k % 10) * F.lit(0.001)).alias("latitude"),
            (F.lit(73.70) + place * F.lit(0.01)).alias("longitude"),
            (k % 4).alias("victim_count"),
            map_value(k % 5, INCIDENT_STATUS).alias("status"),
            F.lit(0).alias("is_hotspot_flag"),
            "k",
            F.col("ts").alias("created_at"),
        )

    # -- logs and state -----------------------------------------------------------

    def status_events(self) -> DataFrame:
        """Events as a status log: the user is the request, the event type its new status."""
        return self.t["events"].select(
            F.col("user_id").alias("request_id"),
            "event_id",
            F.col("event_type").alias("new_status"),
            F.col("ts").alias("event_at"),
        )

    def preferences(self) -> DataFrame:
        """E-mail preferences for two thirds of the customers."""
        key = F.col("c_custkey")
        return self.t["customer"].filter(key % 3 != 0).select(
            key.alias("user_id"),
            F.when(key % 4 == 0, F.concat(F.lit("alt"), key.cast("string"), F.lit("@example.org"))).alias(
                "preferred_email"
            ),
            (key % 24).cast("int").alias("preferred_hour"),
            F.when(key % 7 == 0, 0).otherwise(1).alias("quiet_hours_enabled"),
            F.when(key % 5 == 0, 1).otherwise(22).alias("quiet_start_hour"),
            F.when(key % 5 == 0, 5).otherwise(7).alias("quiet_end_hour"),
            F.when(key % 17 == 0, 1).otherwise(0).alias("opted_out"),
        )
