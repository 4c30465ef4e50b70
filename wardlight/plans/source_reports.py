"""S01-S15 and R01: readers, writers and keyed-table maintenance over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.functions import columns as X
from wardlight.operators import requests as Q
from wardlight.operators.intake import Intake, submit_requests
from wardlight.plans.forecast_reports import ETA_SQL
from wardlight.plans.lifecycle_reports import HISTORY
from wardlight.plans.registry import query
from wardlight.plans.request_reports import DETAIL, FEEDBACK_LIMITS
from wardlight.plans.roles import REQ_AS_OF
from wardlight.plans.sql import with_views
from wardlight.session import materialize, scratch_dir
from wardlight.sources import tables as S
from wardlight.sources.store import KeyedTable
from wardlight.sql_functions import register_functions

NAMES = ["customer", "documents", "events", "lineitem", "nation", "orders", "part", "region", "supplier"]


@query(
    "s01_load_tables",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders",
)
def s01(r):
    return S.load_tables(r.spark, r.path, ["orders"])["orders"]


@query(
    "s03_dim_categories",
    with_views(
        "cat dept pri",
        """SELECT c.cat_id, cat_name, icon_class, dept_name, dept_code, priority_name, (SELECT count(*) FROM customer
          WHERE c_mktsegment = cat_name) AS n_customers
        FROM cat c JOIN dept d ON c.dept_id = d.dept_id JOIN pri p ON c.default_priority_id = p.priority_id WHERE c.is_active""",
    ),
)
def s03(r):
    used = r.t["customer"].groupBy(F.col("c_mktsegment").alias("cat_name")).agg(F.count(F.lit(1)).alias("n_customers"))
    out = S.dim_categories(r.cat, r.dept, r.pri).join(used, "cat_name", "left")
    return out.withColumn("n_customers", F.coalesce("n_customers", F.lit(0)))


@query("s03_dim_locations", with_views("loc", "SELECT * FROM loc ORDER BY area_name"))
def s03b(r):
    return S.dim_locations(r.loc)


@query(
    "s03_dim_departments",
    with_views(
        "dept req",
        """SELECT dept_id, dept_name, dept_code, head_name, (SELECT count(*) FROM req WHERE req.dept_id = dept.dept_id) AS n_requests
        FROM dept WHERE is_active""",
    ),
)
def s03_departments(r):
    used = r.requests(resolved=False).groupBy("dept_id").agg(F.count(F.lit(1)).alias("n_requests"))
    out = S.dim_departments(r.dept).join(used, "dept_id", "left").withColumn("n_requests", F.coalesce("n_requests", F.lit(0)))
    return out.select("dept_id", "dept_name", "dept_code", "head_name", "n_requests")


@query(
    "s03_dim_crime_types",
    with_views(
        "types inc",
        """SELECT crime_type_id, type_name, type_code, severity, (SELECT count(*) FROM inc WHERE inc.crime_type_id = types.crime_type_id) AS n_incidents
        FROM types""",
    ),
)
def s03_types(r):
    used = r.incidents().groupBy("crime_type_id").agg(F.count(F.lit(1)).alias("n_incidents"))
    out = S.dim_crime_types(r.types).join(used, "crime_type_id", "left").withColumn("n_incidents", F.coalesce("n_incidents", F.lit(0)))
    return out.select("crime_type_id", "type_name", "type_code", "severity", "n_incidents")


@query("s04_derive_feedback", with_views("fb", "SELECT request_id, user_id, rating, comment, is_satisfied FROM fb"))
def s04a(r):
    return S.derive_feedback(r.requests(), FEEDBACK_LIMITS)


@query(
    "s04_derive_history",
    with_views("req", f"WITH {HISTORY} SELECT request_id, updated_by, old_status, new_status, remarks, updated_at FROM hist"),
)
def s04b(r):
    return S.derive_history(r.requests())


RAW_REQ = """raw AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 13 = 0 THEN 'x' || c_custkey WHEN c_custkey % 7 = 0 THEN '99'
          ELSE CAST(c_custkey % 6 + 1 AS VARCHAR) END AS cat_id, c_nationkey AS location_id, c_name AS title,
          CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS description FROM customer)"""


def _raw_requests(r):
    key = F.col("c_custkey")
    cat = F.when(key % 13 == 0, F.concat(F.lit("x"), key.cast("string"))).when(key % 7 == 0, "99")
    return r.t["customer"].select(
        key.alias("user_id"),
        cat.otherwise((key % 6 + 1).cast("string")).alias("cat_id"),
        F.col("c_nationkey").alias("location_id"),
        F.col("c_name").alias("title"),
        F.when(key % 11 != 0, F.col("c_mktsegment")).alias("description"),
    )


@query(
    "s05_ingest_requests",
    with_views(
        "cat",
        f"""WITH {RAW_REQ} SELECT r.user_id, c.cat_id, c.dept_id, c.default_priority_id AS priority_id, location_id, title, description,
        'pending' AS status FROM raw r JOIN cat c ON try_cast(r.cat_id AS INTEGER) = c.cat_id WHERE description IS NOT NULL""",
    ),
)
def s05(r):
    ok, _ = S.ingest_requests(_raw_requests(r), r.cat)
    return ok


@query(
    "s05_rejected_requests",
    with_views(
        "cat",
        f"""WITH {RAW_REQ} SELECT user_id, CASE WHEN try_cast(r.cat_id AS INTEGER) IS NULL OR description IS NULL THEN 'missing required field'
          ELSE 'invalid category' END AS reject_reason
        FROM raw r LEFT JOIN cat c ON try_cast(r.cat_id AS INTEGER) = c.cat_id WHERE description IS NULL OR c.cat_id IS NULL""",
    ),
)
def s05_rejects(r):
    return S.ingest_requests(_raw_requests(r), r.cat)[1].select("user_id", "reject_reason")


def _raw_incidents(r):
    key = F.col("event_id")
    kind = X.map_value("event_type", {"error": "1", "purchase": "2", "signup": "3", "click": "", "view": "5"})
    place = F.when(key % 17 == 0, "nowhere").when(key % 13 == 0, "77").otherwise((F.col("user_id") % 25).cast("string"))
    clock = F.when(key % 5 == 0, "").when(key % 7 == 0, "noonish").otherwise(F.date_format("ts", "HH:mm"))
    return r.t["events"].select(
        key.alias("event_id"),
        kind.alias("crime_type_id"),
        place.alias("location_id"),
        F.col("event_type").alias("description"),
        F.col("ts").cast("date").alias("incident_date"),
        clock.alias("incident_time"),
        F.when(key % 19 == 0, " Dawn ").alias("time_of_day"),
        ((key % 4) - 1).cast("string").alias("victim_count"),
    )


RAW_INC = """raw AS (SELECT event_id, CASE event_type WHEN 'error' THEN '1' WHEN 'purchase' THEN '2' WHEN 'signup' THEN '3'
          WHEN 'click' THEN '' ELSE '5' END AS t, CASE WHEN event_id % 17 = 0 THEN 'nowhere' WHEN event_id % 13 = 0 THEN '77'
          ELSE CAST(user_id % 25 AS VARCHAR) END AS l, hour(ts) AS h, event_id % 4 - 1 AS v,
          CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN 'noonish' ELSE strftime(ts, '%H:%M') END AS clock FROM events),
        checked AS (SELECT *, CASE WHEN t = '' THEN 'missing required field' WHEN l = 'nowhere' THEN 'invalid numeric field'
          WHEN t = '5' THEN 'invalid crime type' WHEN l = '77' THEN 'invalid location' END AS reject_reason,
          CASE WHEN event_id % 19 = 0 THEN 'dawn' WHEN clock IN ('', 'noonish') THEN 'unknown' WHEN h BETWEEN 5 AND 11 THEN 'morning'
          WHEN h BETWEEN 12 AND 16 THEN 'afternoon' WHEN h BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END AS tod FROM raw)"""


@query(
    "s06_ingest_incidents",
    f"""WITH {RAW_INC} SELECT event_id, CAST(t AS INTEGER) AS crime_type_id, CAST(l AS INTEGER) AS location_id, tod AS time_of_day,
      CAST(greatest(0, v) AS INTEGER) AS victim_count, 'reported' AS status FROM checked WHERE reject_reason IS NULL""",
)
def s06(r):
    ok, _ = S.ingest_incidents(_raw_incidents(r), r.types, r.loc)
    return ok.select("event_id", "crime_type_id", "location_id", "time_of_day", "victim_count", "status")


@query(
    "s06_rejected_incidents",
    f"WITH {RAW_INC} SELECT event_id, reject_reason FROM checked WHERE reject_reason IS NOT NULL",
)
def s06_rejects(r):
    return S.ingest_incidents(_raw_incidents(r), r.types, r.loc)[1].select("event_id", "reject_reason")


def _base(r):
    """One row per user of the event log: the state before the delta."""
    return r.t["customer"].select(F.col("c_custkey").alias("user_id"), F.lit("none").alias("kind"), F.lit(0.0).alias("value"))


def _delta(r):
    return r.t["events"].select(
        (F.col("user_id") * 11).alias("user_id"), F.col("event_type").alias("kind"), "value", F.col("event_id").alias("version")
    )


NEWEST = "SELECT user_id * 11 AS user_id, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) AS value, max(event_id) AS version FROM events GROUP BY 1"


@query(
    "s07_upsert",
    f"""WITH d AS ({NEWEST}) SELECT user_id, kind, value, version FROM d
      UNION ALL SELECT c_custkey, 'none', 0.0, NULL FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM d)""",
)
def s07(r):
    base = _base(r).withColumn("version", F.lit(None).cast("long"))
    return S.upsert(base, _delta(r), ["user_id"], "version")


@query(
    "s07_keyed_table",
    f"""WITH d AS ({NEWEST}) SELECT user_id, kind, value, version FROM d
      UNION ALL SELECT c_custkey, 'none', 0.0, -1 FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM d)""",
)
def s07_table(r):
    """The same on disk, the newer half of the delta first; only touched buckets are written again."""
    base = _base(r).withColumn("version", F.lit(-1).cast("long"))
    table = KeyedTable(r.spark, scratch_dir(r.spark, "keyed"), base.schema, ["user_id"], ["version"], 16)
    middle = r.t["events"].agg(F.percentile_approx("event_id", 0.5)).first()[0]
    delta = _delta(r)
    for rows in (base, delta.filter(F.col("version") > middle), delta.filter(F.col("version") <= middle)):
        table.upsert(rows)
    return table.read()


@query(
    "s08_insert_ignore",
    """SELECT c_custkey AS user_id, 'none' AS kind, 'base' AS origin FROM customer
      UNION ALL SELECT user_id * 11, arg_min(event_type, event_id), 'delta' FROM events
      WHERE user_id * 11 NOT IN (SELECT c_custkey FROM customer) GROUP BY 1""",
)
def s08(r):
    base = _base(r).select("user_id", "kind", F.lit("base").alias("origin"))
    delta = _delta(r).select("user_id", "kind", F.lit("delta").alias("origin"), "version")
    return S.insert_ignore(base, delta, ["user_id"], ["version"]).select("user_id", "kind", "origin")


@query(
    "s09_patch",
    f"""WITH d AS ({NEWEST}) SELECT c_custkey AS user_id, coalesce(d.kind, 'none') AS kind, 0.0::DOUBLE AS value
      FROM customer LEFT JOIN d ON d.user_id = c_custkey""",
)
def s09(r):
    return S.patch(_base(r), S.latest_per_key(_delta(r), ["user_id"], ["version"]), "user_id", ["kind"])


@query("s10_refresh", "SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last_order FROM orders GROUP BY 1")
def s10(r):
    summary = r.t["orders"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last_order"))
    return S.refresh(scratch_dir(r.spark, "refresh"), summary)


TARGET = T.StructType().add("c_custkey", T.LongType()).add("c_name", T.StringType()).add("boosted", T.IntegerType()).add("photo_url", T.StringType())


@query("s11_align_schema", "SELECT c_custkey, c_name, 0 AS boosted, CAST(NULL AS VARCHAR) AS photo_url FROM customer")
def s11(r):
    return S.align_schema(r.t["customer"], TARGET, {"boosted": 0})


@query("s12_has_columns", "SELECT c_custkey, 1 AS n_present FROM customer")
def s12(r):
    df = r.t["customer"]
    present = int(S.has_columns(df, "c_custkey", "c_name")) + int(S.has_columns(df, "c_custkey", "photo_url"))
    return df.select("c_custkey", F.lit(present).alias("n_present"))


@query(
    "s13_export_csv",
    with_views(
        "req usr cat loc dept pri",
        f"""SELECT code AS "Code", title AS "Title", category AS "Category", area_name AS "Area", department AS "Department",
        priority_name AS "Priority", status AS "Status", CAST(age_hours AS VARCHAR) AS "Age(h)" FROM ({DETAIL})""",
    ),
)
def s13(r):
    detail = Q.request_detail(r.requests(resolved=False), r.usr, r.cat, r.loc, r.dept, r.pri, REQ_AS_OF)
    path = scratch_dir(r.spark, "csv")
    S.export_csv(detail, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in S.CSV_COLUMNS])
    return r.spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


@query(
    "s14_to_documents",
    """SELECT '{"user_id":' || user_id || ',"profile":{"events":' || count(*) || ',"kinds":[' ||
      string_agg(DISTINCT '"' || event_type || '"', ',' ORDER BY '"' || event_type || '"') || ']}}' AS document FROM events GROUP BY user_id""",
)
def s14(r):
    per_user = r.t["events"].groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"), F.sort_array(F.collect_set("event_type")).alias("kinds")
    )
    return S.to_documents(per_user.select("user_id", F.struct("events", "kinds").alias("profile")))


@query("s15_row_counts", " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n_rows FROM {n}" for n in NAMES))
def s15(r):
    return S.row_counts({n: r.t[n] for n in NAMES})


@query(
    "r01_sql_functions",
    with_views(
        "inc",
        """SELECT incident_id, time_of_day AS tod, CASE WHEN incident_hour * 10 > 100 THEN 'BREACHED' ELSE 'WITHIN SLA' END AS sla,
        CASE WHEN k >= 75 THEN 'critical' WHEN k >= 55 THEN 'high' WHEN k >= 30 THEN 'medium' ELSE 'low' END AS risk,
        CASE WHEN k >= 10 THEN 1 WHEN k >= 5 THEN 2 WHEN k >= 2 THEN 3 ELSE 4 END AS prio,
        CAST(greatest(0, least(100, 100 - victim_count * 4 - victim_count * 3 - k * 0.5)) AS DOUBLE) AS score FROM inc""",
    ),
)
def r01(r):
    register_functions(r.spark)
    r.incidents().createOrReplaceTempView("wardlight_incidents")
    return r.spark.sql(
        """SELECT incident_id, time_of_day(incident_hour) AS tod, sla_status(incident_hour * 10, 100) AS sla,
        risk_level(CAST(k AS DOUBLE)) AS risk, frequency_priority(3, k) AS prio,
        safety_score(victim_count, victim_count, k) AS score FROM wardlight_incidents"""
    )


# Urgency words that occur in the role data.
INTAKE_WORDS = {"critical": ["machin"], "high": ["build"], "medium": ["furn"]}


def _submitted(r):
    """Raw requests that come over two days, many at the same hour."""
    at = F.lit(REQ_AS_OF).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("user_id") % 40).cast("int"))
    return _raw_requests(r).withColumns({"raw_id": F.col("user_id"), "submitted_at": at})


SUBMITTED = f"""{RAW_REQ}, ok AS (SELECT r.user_id, c.cat_id, c.dept_id, r.location_id, c.default_priority_id AS base, description,
          {{R_NOW}} + to_hours(CAST(r.user_id % 40 AS INTEGER)) AS submitted_at
          FROM raw r JOIN cat c ON try_cast(r.cat_id AS INTEGER) = c.cat_id WHERE description IS NOT NULL),
        num AS (SELECT *, (SELECT count(*) FROM orders) + row_number() OVER (ORDER BY submitted_at, user_id) AS request_id FROM ok),
        line AS (SELECT cat_id, location_id, submitted_at, 0 AS k FROM req UNION ALL SELECT cat_id, location_id, submitted_at, user_id FROM ok),
        freq AS (SELECT n.user_id, count(l.k) AS frequency_30d FROM num n LEFT JOIN line l ON l.cat_id = n.cat_id AND l.location_id = n.location_id
          AND l.submitted_at >= n.submitted_at - INTERVAL 30 DAY AND (l.submitted_at < n.submitted_at OR l.submitted_at = n.submitted_at AND l.k < n.user_id)
          GROUP BY n.user_id),
        s AS (SELECT n.*, frequency_30d, CASE WHEN description = 'MACHINERY' THEN 'critical' WHEN description = 'BUILDING' THEN 'high' ELSE 'low' END AS urgency_level
          FROM num n JOIN freq USING (user_id)),
        f AS (SELECT *, CASE WHEN frequency_30d >= 10 THEN 1 WHEN frequency_30d >= 5 THEN greatest(1, base - 1)
          WHEN frequency_30d >= 2 THEN base ELSE least(4, base + 1) END AS fp FROM s),
        sub AS (SELECT *, format('CMP-{{}}-{{:05d}}', year(submitted_at), request_id) AS code,
          CASE urgency_level WHEN 'critical' THEN 1 WHEN 'high' THEN least(fp, 2) ELSE fp END AS priority_id,
          CASE WHEN urgency_level IN ('critical','high') THEN 1 ELSE 0 END AS auto_priority_boosted FROM f)"""


@query(
    "s05_submit_requests",
    with_views(
        "cat req",
        f"""WITH {SUBMITTED}, {ETA_SQL.split("p AS (SELECT")[0].rstrip().rstrip(",")},
        v AS (SELECT sub.*, (coalesce(nullif(ch.h, 0), 24) * CAST(0.6 AS DOUBLE) + coalesce(nullif(lh.h, 0), 30) * CAST(0.4 AS DOUBLE))
          * CAST(CASE base WHEN 1 THEN 0.45 WHEN 2 THEN 0.7 WHEN 3 THEN 1.0 ELSE 1.25 END AS DOUBLE)
          + least(18.0, coalesce(d.n, 0) * CAST(0.35 AS DOUBLE)) AS v FROM sub
          LEFT JOIN cat_h ch ON ch.cat_id = sub.cat_id LEFT JOIN loc_h lh ON lh.location_id = sub.location_id LEFT JOIN load d ON d.dept_id = sub.dept_id)
        SELECT user_id, request_id, code, cat_id, dept_id, frequency_30d, urgency_level, priority_id, auto_priority_boosted,
          round(greatest(2.0, v), 1) AS predicted_hours FROM v""",
    ),
)
def s05_submit(r):
    history = r.requests()
    out, _ = submit_requests(_submitted(r), r.cat, history, REQ_AS_OF, INTAKE_WORDS, last_number=history.count())
    return out.select(
        "user_id", "request_id", "code", "cat_id", "dept_id", "frequency_30d", "urgency_level", "priority_id", "auto_priority_boosted", "predicted_hours"
    )


def _two_batches(r):
    raw, history = _submitted(r), materialize(r.requests(), "history")
    intake = Intake(r.spark, scratch_dir(r.spark, "intake"), r.cat, r.preferences(), history.count(), keywords=INTAKE_WORDS)
    early = F.col("user_id") % 40 < 15
    for k, part in enumerate((raw.filter(early), raw.filter(~early), raw.filter(early))):
        intake.submit(part, history, REQ_AS_OF, k % 2)  # the first batch is delivered again
    return intake


@query(
    "s05_intake",
    with_views("cat req", f"WITH {SUBMITTED} SELECT user_id, request_id, code, frequency_30d, priority_id, auto_priority_boosted, submitted_at FROM sub"),
)
def s05_intake(r):
    """Two batches, one of them delivered twice, against all rows in one."""
    return _two_batches(r).requests().select(
        "user_id", "request_id", "code", "frequency_30d", "priority_id", "auto_priority_boosted", "submitted_at"
    )


@query(
    "s05_receipts",
    with_views(
        "cat req",
        f"""WITH {SUBMITTED} SELECT request_id AS queue_id, user_id, 'complaint_received' AS template_key, submitted_at AS scheduled_at,
        CASE WHEN priority_id = 1 THEN 'critical' ELSE 'normal' END AS priority,
        request_id || ':complaint_received:pending:' || strftime(submitted_at, '%Y%m%d%H') AS idempotency_key FROM sub""",
    ),
)
def s05_receipts(r):
    return _two_batches(r).receipts().select("queue_id", "user_id", "template_key", "scheduled_at", "priority", "idempotency_key")
