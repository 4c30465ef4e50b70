"""P, J, A, K, U and F operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.functions import columns as X
from wardlight.functions import measures as M
from wardlight.operators import filters as P
from wardlight.operators import joins as J
from wardlight.operators import windows as W
from wardlight.plans.registry import query
from wardlight.plans.roles import INC_AS_OF, REQ_AS_OF
from wardlight.plans.sql import with_views


# -- projections and filters -----------------------------------------------------------


@query("p01_select_as", "SELECT o_orderkey AS id, o_totalprice * 2 AS doubled, upper(o_orderstatus) AS st FROM orders")
def p01(r):
    cols = {"id": "o_orderkey", "doubled": F.col("o_totalprice") * 2, "st": F.upper("o_orderstatus")}
    return P.select_as(r.t["orders"], cols)


@query("p02_with_tag", "SELECT c_custkey, 'HOTSPOT' AS zone_status FROM customer")
def p02(r):
    return P.with_tag(r.t["customer"].select("c_custkey"), "zone_status", "HOTSPOT")


@query(
    "p03_filter_requests",
    with_views("req", "SELECT request_id, status, cat_id, location_id FROM req WHERE status = 'pending' AND cat_id = 12 AND location_id = 3"),
)
def p03(r):
    out = P.filter_requests(r.requests(resolved=False), status="pending", cat_id=12, location_id=3)
    return out.select("request_id", "status", "cat_id", "location_id")


@query(
    "p03_filter_incidents",
    with_views(
        "inc",
        "SELECT incident_id, status FROM inc WHERE incident_date >= {I_TODAY} - 10 AND status = 'resolved' AND location_id = 4",
    ),
)
def p03i(r):
    out = P.filter_incidents(r.incidents(), INC_AS_OF, 10, status="resolved", location_id=4)
    return out.select("incident_id", "status")


@query(
    "p04_search_requests",
    with_views("req", "SELECT request_id, code, title FROM req WHERE contains(lower(title), 't 12') OR contains(lower(code), 't 12')"),
)
def p04(r):
    return P.search_requests(r.requests(resolved=False), "T 12").select("request_id", "code", "title")


@query(
    "p05_find_by_code",
    with_views(
        "req inc",
        """SELECT code, request_id AS id, status, 'request' AS record_type FROM req
        UNION ALL SELECT incident_code, incident_id, status, 'incident' FROM inc""",
    ),
)
def p05(r):
    req, inc = r.requests(resolved=False), r.incidents()
    asked = req.select(F.concat(F.lit(" "), F.lower("code")).alias("code"))
    asked = asked.unionByName(inc.select(F.col("incident_code").alias("code")))
    return P.find_by_code(req, inc, asked)


def _scoped(viewer: int):
    return with_views(
        "req usr",
        f"""SELECT request_id, r.user_id, r.dept_id FROM req r, (SELECT role, dept_id AS d FROM usr WHERE user_id = {viewer}) v
        WHERE role = 'admin' OR (role = 'citizen' AND r.user_id = {viewer}) OR (role = 'officer' AND r.dept_id = d)""",
    )


@query("p06_scope_citizen", _scoped(77))
def p06a(r):
    return P.scope_rows(r.requests(resolved=False), r.usr, 77).select("request_id", "user_id", "dept_id")


@query("p06_scope_officer", _scoped(100))
def p06b(r):
    return P.scope_rows(r.requests(resolved=False), r.usr, 100).select("request_id", "user_id", "dept_id")


@query("p06_scope_admin", _scoped(1))
def p06c(r):
    return P.scope_rows(r.requests(resolved=False), r.usr, 1).select("request_id", "user_id", "dept_id")


@query(
    "p07_in_set",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('P','O') AND o_orderpriority NOT IN ('5-LOW','1-URGENT')",
)
def p07(r):
    cond = P.in_set("o_orderstatus", ["P", "O"]) & P.not_in_set("o_orderpriority", ["5-LOW", "1-URGENT"])
    return r.t["orders"].filter(cond).select("o_orderkey", "o_orderstatus")


@query("p08_in_range", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
def p08(r):
    return r.t["lineitem"].filter(P.in_range("l_quantity", 10, 12)).select("l_orderkey", "l_quantity")


@query("p09_present", with_views("req", "SELECT request_id FROM req WHERE resolved_at IS NOT NULL AND assigned_to IS NOT NULL"))
def p09(r):
    return r.requests().filter(P.present("resolved_at", "assigned_to")).select("request_id")


@query("p10_like_const", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ring%' OR p_name ILIKE 'red%'")
def p10(r):
    cond = P.like_const("p_name", "RING") | P.like_const("p_name", "Red", prefix=True)
    return r.t["part"].filter(cond).select("p_partkey", "p_name")


@query("p11_trailing", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-02' - INTERVAL 12 WEEK")
def p11(r):
    return P.trailing(r.t["orders"], "o_orderdate", REQ_AS_OF, "12 weeks").select("o_orderkey", "o_orderdate")


@query("p12_is_night", with_views("inc", "SELECT incident_id, incident_hour FROM inc WHERE time_of_day = 'night' OR incident_hour >= 20"))
def p12(r):
    return r.incidents().filter(P.is_night()).select("incident_id", "incident_hour")


@query(
    "p13_match_dept",
    with_views("req dept", "SELECT request_id, dept_name FROM req r JOIN dept d ON r.dept_id = d.dept_id WHERE contains(dept_name, 'Waste')"),
)
def p13(r):
    named = r.requests(resolved=False).join(r.dept.select("dept_id", "dept_name"), "dept_id")
    return P.match_dept(named, "Waste & Sanitation").select("request_id", "dept_name")


@query(
    "p14_apply_filters",
    "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT','2-HIGH')",
)
def p14(r):
    triples = [
        ("o_totalprice", ">", 300000),
        ("o_orderstatus", "!=", "P"),
        ("o_orderpriority", "in", ["1-URGENT", "2-HIGH"]),
    ]
    return P.apply_filters(r.t["orders"], triples).select("o_orderkey")


@query(
    "p15_date_preset",
    "SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-24 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'",
)
def p15(r):
    return P.date_preset(r.t["events"], "ts", "7d", INC_AS_OF).select("event_id", "ts")


# -- joins -----------------------------------------------------------------------------


@query(
    "j01_enrich_requests",
    with_views(
        "req usr cat loc dept pri",
        """SELECT request_id, full_name AS citizen_name, cat_name, area_name, zone, dept_name, priority_name, sla_hours
        FROM req r JOIN usr u ON r.user_id = u.user_id JOIN cat c ON r.cat_id = c.cat_id JOIN loc l ON r.location_id = l.location_id
        JOIN dept d ON r.dept_id = d.dept_id JOIN pri p ON r.priority_id = p.priority_id""",
    ),
)
def j01(r):
    out = J.enrich_requests(r.requests(resolved=False), r.cat, r.loc, r.dept, r.pri, r.usr)
    return out.select("request_id", "citizen_name", "cat_name", "area_name", "zone", "dept_name", "priority_name", "sla_hours")


@query(
    "j02_enrich_incidents",
    with_views(
        "inc types loc",
        """SELECT incident_id, type_name, severity, area_name, ward_number, zone FROM inc i
        JOIN types t ON i.crime_type_id = t.crime_type_id JOIN loc l ON i.location_id = l.location_id""",
    ),
)
def j02(r):
    out = J.enrich_incidents(r.incidents(), r.types, r.loc)
    return out.select("incident_id", "type_name", "severity", "area_name", "ward_number", "zone")


@query(
    "j03_dim_left_agg",
    "SELECT c_custkey, count(o_orderkey) AS n, sum(o_totalprice) FILTER (o_orderstatus = 'P') IS NOT NULL AS has_open FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
)
def j03(r):
    fact = r.t["orders"].select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_totalprice")
    open_sum = F.sum(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")))
    out = J.dim_left_agg(r.t["customer"].select("c_custkey"), fact, "c_custkey", {"n": M.n_rows(), "s": open_sum}, ("n",))
    return out.select("c_custkey", "n", F.col("s").isNotNull().alias("has_open"))


@query(
    "j04_category_join",
    with_views(
        "cat dept lines",
        "SELECT c.cat_id, d.dept_name, count(r.status) AS total FROM cat c LEFT JOIN lines r ON c.cat_id = r.cat_id JOIN dept d ON c.dept_id = d.dept_id GROUP BY ALL",
    ),
)
def j04(r):
    out = J.category_join(r.cat, r.lines(category=True), r.dept, {"total": M.n_rows()}, ("total",))
    return out.select("cat_id", "dept_name", "total")


@query(
    "j05_with_actor_names",
    with_views(
        "req usr",
        """SELECT request_id, u.full_name AS citizen_name, coalesce(o.full_name, 'Assigned Officer') AS officer_name FROM req r
        JOIN usr u ON r.user_id = u.user_id LEFT JOIN usr o ON r.assigned_to = o.user_id""",
    ),
)
def j05(r):
    return J.with_actor_names(r.requests(resolved=False), r.usr).select("request_id", "citizen_name", "officer_name")


@query(
    "j06_left_join_aggs",
    """SELECT c_custkey, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM customer
      LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a ON a.o_custkey = c_custkey
      LEFT JOIN (SELECT user_id, count(*) AS m FROM events GROUP BY 1) b ON b.user_id = c_custkey""",
)
def j06(r):
    waiting = r.t["orders"].filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(M.n_rows().alias("n"))
    seen = r.t["events"].groupBy(F.col("user_id").alias("c_custkey")).agg(M.n_rows().alias("m"))
    return J.left_join_aggs(r.t["customer"].select("c_custkey"), [waiting, seen], "c_custkey", ("n", "m"))


@query("j07_join_using", "SELECT doc_id, quality, lang FROM documents JOIN labels USING (doc_id)")
def j07(r):
    return J.join_using(r.t["documents"].select("doc_id", "lang"), r.t["labels"].select("doc_id", "quality"), "doc_id")


@query(
    "j08_left_join_on",
    """SELECT o_orderkey, count(l_orderkey) AS late_lines FROM orders LEFT JOIN lineitem
      ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 365 DAY GROUP BY 1""",
)
def j08(r):
    orders, lines = r.t["orders"].select("o_orderkey", "o_orderdate"), r.t["lineitem"].select("l_orderkey", "l_shipdate")
    late = (F.col("l_orderkey") == F.col("o_orderkey")) & (
        F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 365 DAY")
    )
    return J.left_join_on(orders, lines, late).groupBy("o_orderkey").agg(F.count("l_orderkey").alias("late_lines"))


@query("j09_with_scalar", "SELECT event_type, count(*) AS n, (SELECT count(*) FROM events) AS total FROM events GROUP BY 1")
def j09(r):
    ev = r.t["events"]
    return J.with_scalar(ev.groupBy("event_type").agg(M.n_rows().alias("n")), ev.agg(M.n_rows()), "total")


@query(
    "j10_location_counts",
    with_views(
        "req inc types loc",
        """SELECT l.location_id,
        (SELECT count(*) FROM inc i WHERE i.location_id = l.location_id AND incident_date >= {I_TODAY} - 30) AS crime_count_30d,
        (SELECT count(*) FROM inc i JOIN types t ON i.crime_type_id = t.crime_type_id WHERE i.location_id = l.location_id
          AND incident_date >= {I_TODAY} - 30 AND severity IN ('critical','high')) AS critical_crimes_30d,
        (SELECT count(*) FROM req r WHERE r.location_id = l.location_id AND submitted_at >= {R_NOW} - INTERVAL 30 DAY) AS request_count_30d
        FROM loc l""",
    ),
)
def j10(r):
    return J.location_counts(
        r.requests(resolved=False), r.incidents(), r.types, r.loc.select("location_id"), REQ_AS_OF, INC_AS_OF
    )


@query("j12_known_fk", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def j12a(r):
    return J.known_fk(r.t["documents"].select("doc_id"), r.t["labels"], "doc_id")


@query("j12_missing_keys", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j12b(r):
    return J.missing_keys(r.t["documents"].select("doc_id"), r.t["labels"], "doc_id")


@query("j13_lookup_or_default", "SELECT d.doc_id, coalesce(quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j13(r):
    return J.lookup_or_default(r.t["documents"].select("doc_id"), r.t["labels"], "doc_id", "quality", -1)


# -- aggregates --------------------------------------------------------------------------


@query("a01_counts", "SELECT c_nationkey, count(*) AS n_rows, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def a01(r):
    joined = r.t["customer"].join(r.t["orders"], F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_nationkey").agg(M.n_rows().alias("n_rows"), M.n_of("o_orderkey").alias("n_orders"))


@query(
    "a02_stats",
    """SELECT l_returnflag, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc,
      min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price FROM lineitem GROUP BY 1""",
)
def a02(r):
    measures = {
        "sum_qty": M.stat("l_quantity", "sum", 2),
        "avg_disc": M.stat("l_discount", "avg", 6),
        "min_price": M.stat("l_extendedprice", "min"),
        "max_price": M.stat("l_extendedprice", "max"),
    }
    return M.grouped(r.t["lineitem"], ["l_returnflag"], measures)


@query("a03_count_where", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY 1")
def a03(r):
    return r.t["orders"].groupBy("o_custkey").agg(M.count_where(F.col("o_orderstatus") == "P").alias("pending"))


@query("a04_avg_where", "SELECT l_linestatus, round(avg(l_tax) FILTER (l_quantity > 25), 6) AS avg_tax FROM lineitem GROUP BY 1")
def a04(r):
    return r.t["lineitem"].groupBy("l_linestatus").agg(F.round(M.avg_where(F.col("l_quantity") > 25, "l_tax"), 6).alias("avg_tax"))


@query(
    "a05_pct",
    """SELECT user_id, event_type, round(count(*) FILTER (value > 10) * 100.0 / nullif(count(*) FILTER (value > 1), 0), 1) AS pct
      FROM events GROUP BY ALL""",
)
def a05(r):
    v = F.col("value")
    agg = r.t["events"].groupBy("user_id", "event_type").agg(M.count_where(v > 10).alias("a"), M.count_where(v > 1).alias("b"))
    return agg.select("user_id", "event_type", M.pct("a", "b").alias("pct"))


@query("a06_pct_of_total", "SELECT p_brand, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM part), 1) AS pct_of_total FROM part GROUP BY 1")
def a06(r):
    return M.pct_of_total(r.t["part"].groupBy("p_brand").agg(M.n_rows().alias("n")), "n")


@query("a07_distinct_list", "SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS types FROM events GROUP BY 1")
def a07(r):
    return M.distinct_list(r.t["events"], ["user_id"], "event_type", "types")


@query("a08_grouped", "SELECT year(o_orderdate) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def a08(r):
    return M.grouped(r.t["orders"], [F.year("o_orderdate").cast("long").alias("y"), "o_orderstatus"], {"n": M.n_rows()})


@query("a09_totals", "SELECT count(*) AS n, round(avg(o_totalprice), 2) AS avg_price, max(o_orderdate) AS last FROM orders")
def a09(r):
    return M.totals(r.t["orders"], {"n": M.n_rows(), "avg_price": M.stat("o_totalprice", "avg", 2), "last": F.max("o_orderdate")})


@query("a10_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
def a10(r):
    return M.having(r.t["orders"].groupBy("o_custkey").agg(M.n_rows().alias("n")), F.col("n") >= 15)


@query("a11_group_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type), 6) AS mean_value FROM events")
def a11(r):
    out = M.group_mean(r.t["events"].select("event_id", "event_type", "value"), "event_type", "value", "mean_value")
    return out.select("event_id", F.round("mean_value", 6).alias("mean_value"))


@query("a12_daily_counts", with_views("inc", "SELECT location_id, incident_date, count(*) AS n FROM inc GROUP BY ALL"))
def a12(r):
    return M.daily_counts(r.incidents())


@query(
    "a13_error_metrics",
    """SELECT l_returnflag, count(*) AS n, round(avg(abs(l_quantity * 1500 - l_extendedprice)), 4) AS mae,
      round(sqrt(avg((l_quantity * 1500 - l_extendedprice) ** 2)), 4) AS rmse,
      round(1 - avg((l_quantity * 1500 - l_extendedprice) ** 2) / var_pop(l_extendedprice), 6) AS r2 FROM lineitem GROUP BY 1""",
)
def a13(r):
    out = M.error_metrics(r.t["lineitem"], F.col("l_quantity") * 1500, "l_extendedprice", ("l_returnflag",))
    return out.select("l_returnflag", "n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


# -- sort, limit, sets ---------------------------------------------------------------------


@query("k01_top_sorted", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey")
def k01(r):
    return W.top_sorted(r.t["orders"].groupBy("o_custkey").agg(M.n_rows().alias("n")), F.col("n").desc(), "o_custkey")


@query("k02_mixed_sort", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC LIMIT 40")
def k02(r):
    rows = r.t["supplier"].select("s_suppkey", "s_nationkey", "s_acctbal")
    return W.top_sorted(rows, F.col("s_nationkey").asc_nulls_first(), F.col("s_acctbal").desc()).limit(40)


@query("k03_flag_first", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority = '3-MEDIUM' DESC, o_orderkey LIMIT 50")
def k03(r):
    rows = r.t["orders"].select("o_orderkey", "o_orderpriority")
    return W.flag_first(rows, F.col("o_orderpriority") == "3-MEDIUM", "o_orderkey").limit(50)


@query("k04_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30")
def k04(r):
    return W.top_k(r.t["part"].select("p_partkey", "p_retailprice"), [F.col("p_retailprice").desc()], 30, ["p_partkey"])


@query("k05_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def k05(r):
    return W.page(r.t["orders"].select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 3, 25)


@query(
    "k05_page_after",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'
      OR (o_orderdate = TIMESTAMP '2000-01-01' AND o_orderkey > 100) ORDER BY o_orderdate DESC, o_orderkey LIMIT 25""",
)
def k05b(r):
    return W.page_after(r.t["orders"].select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", "2000-01-01 00:00:00", 100, 25)


@query(
    "k06_top_k_per",
    """SELECT user_id, event_id, value, CAST(rn AS INTEGER) AS rn FROM (SELECT *,
      row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 3""",
)
def k06(r):
    return W.top_k_per(r.t["events"].select("user_id", "event_id", "value"), ["user_id"], [F.col("value").desc(), F.col("event_id")], 3)


@query("k07_sort_by", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey DESC, c_acctbal, c_custkey LIMIT 60")
def k07(r):
    rows = r.t["customer"].select("c_custkey", "c_nationkey", "c_acctbal")
    return W.sort_by(rows, [("c_nationkey", "desc"), ("c_acctbal", "asc"), ("c_custkey", "asc")]).limit(60)


@query("k08_sample_n", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 200")
def k08(r):
    return W.sample_n(r.t["orders"].select("o_orderkey", "o_orderstatus"), "o_orderkey", 200)


@query(
    "u01_union_to",
    """SELECT o_orderkey AS id, o_orderdate AS at, 'order' AS kind FROM orders UNION ALL SELECT event_id, ts, 'event' FROM events""",
)
def u01(r):
    orders = r.t["orders"].select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.lit("order").alias("kind"))
    events = r.t["events"].select(F.lit("event").alias("kind"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return W.union_to(["id", "at", "kind"], orders, events)


@query("u03_first_distinct", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def u03(r):
    return W.first_distinct(r.t["events"].select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query(
    "u04_sorted_set",
    "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name || ' ' || p_name || ' ' || lower(p_type), ' '))), ',') AS words FROM part",
)
def u04(r):
    words = F.split(F.concat_ws(" ", "p_name", "p_name", F.lower("p_type")), " ")
    return r.t["part"].select("p_partkey", F.array_join(W.sorted_set(words), ",").alias("words"))


# -- scalar functions ----------------------------------------------------------------------


@query("f01_ago", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 36 HOUR AND ts < TIMESTAMP '2024-01-31'")
def f01(r):
    ts = F.col("ts")
    return r.t["events"].filter((ts >= X.ago(INC_AS_OF, 36, "HOUR")) & (ts < X.as_of_ts(INC_AS_OF))).select("event_id")


@query(
    "f02_units_between",
    """SELECT event_id, date_sub('hour', ts, TIMESTAMP '2024-01-31') AS hours, date_sub('minute', ts, TIMESTAMP '2024-01-31') AS minutes,
      date_sub('day', ts, TIMESTAMP '2024-01-31') AS days FROM events""",
)
def f02(r):
    now = X.as_of_ts(INC_AS_OF)
    cols = {u: X.units_between(k, "ts", now) for u, k in (("hours", "HOUR"), ("minutes", "MINUTE"), ("days", "DAY"))}
    return r.t["events"].select("event_id", *[c.alias(n) for n, c in cols.items()])


@query(
    "f03_resolution_hours",
    "SELECT event_id, CAST(round(date_sub('minute', ts, TIMESTAMP '2024-02-01 12:34:56') / 60.0, 2) AS DOUBLE) AS hours FROM events",
)
def f03(r):
    return r.t["events"].select("event_id", X.resolution_hours("ts", X.as_of_ts("2024-02-01 12:34:56")).alias("hours"))


@query(
    "f04_date_labels",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS m, strftime(o_orderdate, '%b %Y') AS l,
      strftime(o_orderdate, 'Week of %d %b') AS w FROM orders""",
)
def f04(r):
    d = "o_orderdate"
    return r.t["orders"].select("o_orderkey", X.month_key(d).alias("m"), X.month_label(d).alias("l"), X.week_label(d).alias("w"))


@query("f05_iso_yearweek", "SELECT o_orderkey, CAST(yearweek(o_orderdate) AS INTEGER) AS yw FROM orders")
def f05(r):
    return r.t["orders"].select("o_orderkey", X.iso_yearweek("o_orderdate").alias("yw"))


@query(
    "f06_date_parts",
    "SELECT event_id, CAST(dayofweek(ts) + 1 AS INTEGER) AS d, CAST(month(ts) AS INTEGER) AS m, CAST(hour(ts) AS INTEGER) AS h, CAST(year(ts) AS INTEGER) AS y FROM events",
)
def f06(r):
    return r.t["events"].select("event_id", X.dow("ts").alias("d"), X.month("ts").alias("m"), X.hour("ts").alias("h"), X.year("ts").alias("y"))


@query("f07_shift_days", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 7 AS DATE) AS due FROM orders")
def f07(r):
    return r.t["orders"].select("o_orderkey", X.shift_days("o_orderdate", 7).alias("due"))


@query("f08_as_event_time", "SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day_start, CAST(CAST(ts AS DATE) AS VARCHAR) AS day_text FROM events")
def f08(r):
    day = F.col("ts").cast("date")
    return r.t["events"].select("event_id", X.as_event_time(day).alias("day_start"), day.cast("string").alias("day_text"))


def _tod(preset):
    whens = " ".join(f"WHEN hour(ts) BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in X.TIME_OF_DAY[preset])
    return f"CASE {whens} ELSE 'night' END"


@query(
    "f09_time_of_day",
    f"SELECT event_id, {_tod('schema')} AS by_schema, {_tod('api')} AS by_api, {_tod('forecast')} AS by_forecast FROM events",
)
def f09(r):
    h = F.hour("ts")
    return r.t["events"].select("event_id", *[X.time_of_day(h, p).alias(f"by_{p}") for p in ("schema", "api", "forecast")])


@query("f10_round", "SELECT event_id, round(value, 1) AS v1, round(value, 0) AS v0 FROM events")
def f10(r):
    return r.t["events"].select("event_id", X.rnd("value", 1).alias("v1"), X.rnd("value", 0).alias("v0"))


@query("f11_clamp", "SELECT event_id, greatest(5.0::DOUBLE, least(20.0::DOUBLE, value)) AS v FROM events")
def f11(r):
    return r.t["events"].select("event_id", X.clamp("value", 5.0, 20.0).alias("v"))


@query(
    "f12_null_handling",
    with_views("req", "SELECT request_id, coalesce(assigned_to, -1) AS officer, nullif(status, 'pending') AS st FROM req"),
)
def f12(r):
    out = r.requests(resolved=False)
    return out.select("request_id", X.or_default("assigned_to", -1).alias("officer"), X.nullif("status", "pending").alias("st"))


@query("f13_map_value", "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS k FROM events")
def f13(r):
    return r.t["events"].select("event_id", X.map_value("event_type", {"click": 1, "view": 2}, 0).alias("k"))


@query("f14_code", "SELECT o_orderkey, format('CMP-{}-{:05d}', year(o_orderdate), o_orderkey * 9) AS code FROM orders")
def f14(r):
    return r.t["orders"].select("o_orderkey", X.code("CMP", X.year("o_orderdate"), F.col("o_orderkey") * 9).alias("code"))


@query(
    "f15_text_case",
    """SELECT c_custkey, lower(trim('  ' || c_name || ' ')) AS norm, upper(c_mktsegment) AS up,
      CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'In Automobile' WHEN 'BUILDING' THEN 'In Building' WHEN 'FURNITURE' THEN 'In Furniture'
      WHEN 'HOUSEHOLD' THEN 'In Household' ELSE 'In Machinery' END AS titled, split_part(c_name, '#', 2) AS tail, length(c_name) AS n FROM customer""",
)
def f15(r):
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    return r.t["customer"].select(
        "c_custkey",
        X.norm_text(F.concat(F.lit("  "), name, F.lit(" "))).alias("norm"),
        F.upper(seg).alias("up"),
        X.title_case(F.concat(F.lit("in_"), F.lower(seg))).alias("titled"),
        F.split(name, "#")[1].alias("tail"),
        F.length(name).cast("long").alias("n"),
    )


@query(
    "f16_text_tests",
    """SELECT doc_id, contains(lower(text), 'tion') AS has_tion, length(text) - length(replace(text, '!', '')) AS marks FROM documents""",
)
def f16(r):
    return r.t["documents"].select(
        "doc_id", X.has_text("text", "TION").alias("has_tion"), X.count_char("text", "!").cast("long").alias("marks")
    )


@query(
    "f17_json",
    """SELECT event_id, '{"kind":"' || event_type || '","user":' || user_id || '}' AS meta,
      CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events""",
)
def f17(r):
    return r.t["events"].select(
        "event_id", X.to_meta(kind="event_type", user="user_id").alias("meta"), X.from_meta("props", "k INT")["k"].alias("k")
    )


@query("f18_euclid", "SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt((l_tax - l_discount) ** 2 + (l_quantity - 25) ** 2), 6) AS d FROM lineitem")
def f18(r):
    d = X.euclid("l_tax", "l_quantity", F.col("l_discount"), F.lit(25.0))
    return r.t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", F.round(d, 6).alias("d"))


@query(
    "f19_fill_template",
    "SELECT c_custkey, 'Hello ' || c_name || ' of ' || c_nationkey || ', ' || '!' AS body FROM customer",
)
def f19(r):
    rows = r.t["customer"].withColumn("t", F.lit("Hello {{ name }} of {{nation}}, {{unknown}}!"))
    return rows.select("c_custkey", X.fill_template("t", {"name": "c_name", "nation": "c_nationkey"}).alias("body"))


@query("f20_pmod", "SELECT o_orderkey, (o_orderkey - 7000) % 18 + CASE WHEN (o_orderkey - 7000) % 18 < 0 THEN 18 ELSE 0 END AS m FROM orders")
def f20(r):
    return r.t["orders"].select("o_orderkey", X.pmod(F.col("o_orderkey") - 7000, 18).alias("m"))


@query(
    "f21_haversine",
    with_views(
        "inc loc",
        """SELECT incident_id, round(2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)), 3) AS metres FROM (SELECT incident_id,
        sin(radians(l.latitude - i.latitude) / 2) ** 2 + cos(radians(i.latitude)) * cos(radians(l.latitude))
          * sin(radians(l.longitude + 0.002 - i.longitude) / 2) ** 2 AS h
        FROM inc i JOIN loc l ON i.location_id = l.location_id WHERE l.latitude IS NOT NULL)""",
    ),
)
def f21(r):
    places = r.loc.filter("latitude IS NOT NULL").selectExpr("location_id", "latitude AS lat2", "longitude + 0.002D AS lng2")
    joined = r.incidents().join(places, "location_id")
    return joined.select("incident_id", F.round(X.haversine_m("latitude", "longitude", "lat2", "lng2"), 3).alias("metres"))
