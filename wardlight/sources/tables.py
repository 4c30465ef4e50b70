"""Readers, writers and keyed-table maintenance."""

from __future__ import annotations

import os
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.functions.columns import resolution_hours, time_of_day
from wardlight.sources import schemas


class Tables(Mapping):
    """Readers for `<path>/<name>.parquet` with declared schemas, each opened on first use."""

    def __init__(self, spark: SparkSession, path: str, names=None, catalog=None):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.path = spark, path
        self.catalog = catalog or schemas.RAW
        self.names = list(names or self.catalog)
        self.opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        if name not in self.opened:
            reader = self.spark.read.schema(self.catalog[name])
            self.opened[name] = reader.parquet(os.path.join(self.path, f"{name}.parquet"))
        return self.opened[name]

    def __iter__(self):
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)


def load_tables(spark: SparkSession, path: str, names=None, catalog=None) -> Tables:
    return Tables(spark, path, names, catalog)


def load_requests(spark: SparkSession, path: str) -> DataFrame:
    """The requests fact with its derived `resolution_hours`."""
    df = spark.read.schema(schemas.MODEL["requests"]).parquet(path)
    return df.withColumn("resolution_hours", resolution_hours("submitted_at", "resolved_at"))


def jdbc_options(url: str, table: str, part_col: str, lo: int, hi: int, n: int, **extra) -> dict[str, str]:
    """Options of a parallel range read: n queries, each over one slice of part_col."""
    if n < 1 or lo > hi:
        raise ValueError("need n >= 1 and lo <= hi")
    options = {
        "url": url,
        "dbtable": table,
        "partitionColumn": part_col,
        "lowerBound": str(lo),
        "upperBound": str(hi),
        "numPartitions": str(n),
        "fetchsize": "10000",
        "pushDownPredicate": "true",
    }
    return options | {k: str(v) for k, v in extra.items()}


def read_jdbc(spark: SparkSession, url, table, part_col, lo, hi, n, **extra) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, table, part_col, lo, hi, n, **extra)).load()


# -- lookup dimensions ------------------------------------------------------------


def dim_categories(cat: DataFrame, dept: DataFrame, pri: DataFrame) -> DataFrame:
    return (
        cat.filter("is_active")
        .join(dept.select("dept_id", "dept_name", "dept_code"), "dept_id")
        .join(pri.selectExpr("priority_id AS default_priority_id", "priority_name"), "default_priority_id")
        .select("cat_id", "cat_name", "icon_class", "dept_name", "dept_code", "priority_name")
        .orderBy("cat_name")
    )


def dim_departments(dept: DataFrame) -> DataFrame:
    return dept.filter("is_active").orderBy("dept_name")


def dim_locations(loc: DataFrame) -> DataFrame:
    return loc.orderBy("area_name")


def dim_crime_types(types: DataFrame) -> DataFrame:
    return types.orderBy("type_name")


# -- derived loads ----------------------------------------------------------------

# Hour limits and the rating and comment given below each.
RATING_STEPS = [
    (24, 5, "Issue resolved quickly. Very satisfied!"),
    (48, 4, "Good response time. Thank you."),
    (72, 3, "Took some time but resolved. Okay experience."),
]
RATING_REST = (2, "Took too long to resolve. Needs improvement.")


def by_hours(hours: Column, steps, rest, pick: int) -> Column:
    out = None
    for step in steps:
        cond = hours <= F.lit(step[0])
        out = F.when(cond, step[pick]) if out is None else out.when(cond, step[pick])
    return out.otherwise(rest[pick - 1])


def derive_feedback(r: DataFrame, limits: tuple = (24, 48, 72)) -> DataFrame:
    """One feedback row per resolved request, rated by how long it took."""
    steps = [(limit, rating, text) for limit, (_, rating, text) in zip(limits, RATING_STEPS)]
    hours = F.col("resolution_hours")
    done = r.filter(F.col("status").isin("resolved", "closed") & F.col("resolved_at").isNotNull())
    return done.select(
        "request_id",
        "user_id",
        by_hours(hours, steps, RATING_REST, 1).cast("int").alias("rating"),
        by_hours(hours, steps, RATING_REST, 2).alias("comment"),
        F.when(hours <= limits[-1], 1).otherwise(0).alias("is_satisfied"),
    )


def derive_history(r: DataFrame, default_actor: int = 1) -> DataFrame:
    """The status legs a request must have gone through: one scan, exploded per request.

    Assigned two hours after submission, in progress after six, resolved at resolved_at.
    """
    status, actor = F.col("status"), F.coalesce("assigned_to", F.lit(default_actor).cast("long"))

    def leg(cond, old, new, remarks, at):
        return F.when(
            cond,
            F.struct(
                F.lit(old).alias("old_status"),
                F.lit(new).alias("new_status"),
                F.lit(remarks).alias("remarks"),
                at.alias("updated_at"),
            ),
        )

    legs = F.array(
        leg(
            ~status.isin("pending", "rejected"),
            "pending",
            "assigned",
            "Complaint assigned to field officer",
            F.col("submitted_at") + F.expr("INTERVAL 2 HOUR"),
        ),
        leg(
            status.isin("in_progress", "resolved", "closed"),
            "assigned",
            "in_progress",
            "Officer visited site, work in progress",
            F.col("submitted_at") + F.expr("INTERVAL 6 HOUR"),
        ),
        leg(
            status.isin("resolved", "closed") & F.col("resolved_at").isNotNull(),
            "in_progress",
            "resolved",
            "Issue resolved and verified by officer",
            F.col("resolved_at"),
        ),
    )
    return r.select("request_id", actor.alias("updated_by"), F.explode(F.array_compact(legs)).alias("leg")).select(
        "request_id", "updated_by", "leg.*"
    )


# -- validated appends ------------------------------------------------------------


def split_rejects(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    tagged = df.withColumn("reject_reason", reason)
    ok = tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return ok, tagged.filter(F.col("reject_reason").isNotNull())


def ingest_requests(raw: DataFrame, cat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Check new requests and fill department and priority from their category."""
    keyed = raw.withColumn("cat_id", F.expr("try_cast(cat_id AS int)")).withColumn(
        "location_id", F.expr("try_cast(location_id AS int)")
    )
    routes = cat.selectExpr("cat_id", "dept_id", "default_priority_id AS priority_id", "true AS _known")
    joined = keyed.join(routes, "cat_id", "left")
    missing = reduce(
        lambda a, b: a | b, [F.col(c).isNull() for c in ("cat_id", "location_id", "title", "description")]
    )
    reason = F.when(missing, "missing required field").when(F.col("_known").isNull(), "invalid category")
    ok, bad = split_rejects(joined, reason)
    return ok.drop("_known").withColumn("status", F.lit("pending")), bad.drop("_known")


def ingest_incidents(raw: DataFrame, types: DataFrame, loc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Check new incidents: required fields, whole-number fields, active type, known location."""
    required = ("crime_type_id", "location_id", "description", "incident_date")
    absent = reduce(
        lambda a, b: a | b, [F.col(c).isNull() | (F.col(c).cast("string") == "") for c in required]
    )
    counted = F.coalesce(F.nullif(F.col("victim_count").cast("string"), F.lit("")), F.lit("0"))
    cast = raw.select(
        "*",
        F.expr("try_cast(crime_type_id AS int)").alias("_type"),
        F.expr("try_cast(location_id AS int)").alias("_loc"),
        counted.try_cast("int").alias("_victims"),
        F.nullif(F.lower(F.trim("time_of_day")), F.lit("")).alias("_tod"),
        F.nullif(F.trim("incident_time"), F.lit("")).alias("_time"),
        absent.alias("_absent"),
    )
    known_types = types.filter("is_active").selectExpr("crime_type_id AS _type", "true AS _type_ok")
    known_locs = loc.selectExpr("location_id AS _loc", "true AS _loc_ok")
    joined = cast.join(known_types, "_type", "left").join(known_locs, "_loc", "left")
    reason = (
        F.when(F.col("_absent"), "missing required field")
        .when(F.col("_type").isNull() | F.col("_loc").isNull() | F.col("_victims").isNull(), "invalid numeric field")
        .when(F.col("_type_ok").isNull(), "invalid crime type")
        .when(F.col("_loc_ok").isNull(), "invalid location")
    )
    ok, bad = split_rejects(joined, reason)
    hour = F.split("_time", ":")[0].try_cast("int")
    bucket = F.when(F.col("_time").isNotNull() & hour.isNull(), "unknown").otherwise(time_of_day(hour, "api"))
    internal = [c for c in joined.columns if c.startswith("_")]
    filled = ok.withColumns(
        {
            "crime_type_id": F.col("_type"),
            "location_id": F.col("_loc"),
            "victim_count": F.greatest(F.lit(0), F.col("_victims")),
            "time_of_day": F.coalesce("_tod", bucket),
            "incident_time": F.col("_time"),
            "status": F.lit("reported"),
        }
    )
    return filled.drop(*internal), bad.drop(*internal)


# -- keyed tables -----------------------------------------------------------------


def latest_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Newest row per key, as a `max_by` aggregate: hot keys collapse before the shuffle."""
    order_cols = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, order_cols).alias("_row")).select("_row.*")


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Delta rows replace base rows of the same key; the newest delta row of a key wins, of
    equally new ones the largest by all columns."""
    fresh = latest_per_key(delta, keys, [order_col, *(c for c in delta.columns if c != order_col)])
    return base.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def insert_ignore(base: DataFrame, delta: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Append only delta rows whose key the base lacks; of a new key the first row by `order`,
    then by all columns."""
    first = [*(order or []), *(c for c in delta.columns if c not in (order or []))]
    new = delta.join(base.select(*keys), keys, "left_anti")
    fresh = new.groupBy(*keys).agg(F.min_by(F.struct(*delta.columns), F.struct(*first)).alias("_row")).select("_row.*")
    return base.unionByName(fresh, allowMissingColumns=True)


def patch(base: DataFrame, delta: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Overwrite the named columns where the delta has a non-NULL value."""
    changes = delta.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    joined = base.join(changes, key, "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in cols}).select(*base.columns)


def refresh(path: str, df: DataFrame) -> DataFrame:
    """Replace a summary table by a full rebuild and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_partitioned(df: DataFrame, path: str, ts: str) -> None:
    """Append a fact by month of event time, so that time windows prune folders."""
    month = F.date_format(ts, "yyyy-MM")
    df.withColumn("month", month).write.mode("append").partitionBy("month").parquet(path)


def align_schema(df: DataFrame, struct: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Cast to a target schema, adding absent columns with their default or NULL."""
    defaults = defaults or {}
    out = []
    for field in struct:
        source = F.col(field.name) if field.name in df.columns else F.lit(defaults.get(field.name))
        out.append(source.cast(field.dataType).alias(field.name))
    return df.select(*out)


def has_columns(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


# -- exports ----------------------------------------------------------------------

CSV_COLUMNS = ["Code", "Title", "Category", "Area", "Department", "Priority", "Status", "Age(h)"]


def csv_rows(detail: DataFrame) -> DataFrame:
    source = ["code", "title", "category", "area_name", "department", "priority_name", "status", "age_hours"]
    return detail.select(*[F.col(c).alias(n) for c, n in zip(source, CSV_COLUMNS)])


def export_csv(detail: DataFrame, path: str) -> None:
    """Eight fixed columns, every field quoted and inner quotes doubled."""
    writer = csv_rows(detail).write.mode("overwrite").option("header", True)
    writer.option("quoteAll", True).option("escape", '"').csv(path)


def to_documents(df: DataFrame, out: str = "document") -> DataFrame:
    """One JSON document per row, nested columns included."""
    return df.select(F.to_json(F.struct("*")).alias(out))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table"), "n_rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


