"""Declared schemas. Tables are never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_NAMES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "ts": T.TimestampNTZType(),
    "date": T.DateType(),
    "bool": T.BooleanType(),
    "geo": T.DecimalType(10, 7),
    "hours": T.DecimalType(8, 2),
}


def fields(text: str) -> T.StructType:
    """'name:type name:type' -> StructType."""
    out = T.StructType()
    for item in text.split():
        name, kind = item.split(":")
        dtype = T.ArrayType(T.FloatType()) if kind == "floats" else _NAMES[kind]
        out.add(name, dtype)
    return out


# The raw tables the registered queries read.
RAW = {
    "region": fields("r_regionkey:int r_name:string"),
    "nation": fields("n_nationkey:int n_name:string n_regionkey:int"),
    "customer": fields("c_custkey:long c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string"),
    "supplier": fields("s_suppkey:long s_name:string s_nationkey:int s_acctbal:double"),
    "part": fields("p_partkey:long p_name:string p_brand:string p_type:string p_size:int p_retailprice:double"),
    "orders": fields(
        "o_orderkey:long o_custkey:long o_orderstatus:string o_totalprice:double o_orderdate:ts "
        "o_orderpriority:string"
    ),
    "lineitem": fields(
        "l_orderkey:long l_partkey:long l_suppkey:long l_linenumber:int l_quantity:double "
        "l_extendedprice:double l_discount:double l_tax:double l_returnflag:string l_linestatus:string "
        "l_shipdate:ts"
    ),
    "events": fields("event_id:long ts:ts user_id:long event_type:string value:double props:string"),
    "documents": fields("doc_id:long text:string lang:string source:string n_chars:long"),
    "labels": fields("doc_id:long quality:int toxic:int"),
    "conversations": fields("conv_id:long turn:long role:string text:string"),
    "benchmark": fields("item_id:long text:string"),
    "pages": fields("page_id:long url:string html:string"),
    "embeddings": fields("vec_id:long embedding:floats label:int"),
}

# The application's own tables.
MODEL = {
    "priorities": fields("priority_id:int priority_name:string priority_level:int sla_hours:int color_code:string"),
    "departments": fields(
        "dept_id:int dept_name:string dept_code:string head_name:string contact_email:string "
        "contact_phone:string is_active:bool created_at:ts"
    ),
    "categories": fields(
        "cat_id:int cat_name:string cat_description:string dept_id:int default_priority_id:int "
        "icon_class:string is_active:bool"
    ),
    "locations": fields(
        "location_id:int ward_number:string area_name:string zone:string latitude:geo longitude:geo "
        "pincode:string district:string"
    ),
    "users": fields(
        "user_id:long full_name:string email:string role:string dept_id:int location_id:int is_verified:bool "
        "is_active:bool created_at:ts last_login:ts"
    ),
    "requests": fields(
        "request_id:long code:string user_id:long cat_id:int location_id:int dept_id:int priority_id:int "
        "title:string description:string address_detail:string latitude:geo longitude:geo status:string "
        "assigned_to:long submitted_at:ts assigned_at:ts resolved_at:ts closed_at:ts is_hotspot_flag:int "
        "upvotes:int views:int ai_suggested_category:string ai_confidence_score:double sentiment_score:double "
        "urgency_level:string auto_priority_boosted:int predicted_resolution_hours:hours photo_url:string "
        "ai_detected_issue:string photo_gps_lat:geo photo_gps_lng:geo gps_verified:int"
    ),
    "status_updates": fields(
        "update_id:long request_id:long updated_by:long old_status:string new_status:string remarks:string "
        "updated_at:ts"
    ),
    "feedback": fields(
        "feedback_id:long request_id:long user_id:long rating:int comment:string is_satisfied:int submitted_at:ts"
    ),
    "analytics_logs": fields(
        "log_id:long log_type:string entity_type:string entity_id:long message:string meta_json:string logged_at:ts"
    ),
    "crime_types": fields(
        "crime_type_id:int type_name:string type_code:string severity:string icon:string color_hex:string "
        "ipc_section:string is_active:bool"
    ),
    "incidents": fields(
        "incident_id:long incident_code:string user_id:long crime_type_id:int location_id:int incident_date:date "
        "incident_hour:int time_of_day:string description:string address_detail:string latitude:geo longitude:geo "
        "victim_count:int status:string reporting_source:string fir_number:string assigned_station:string "
        "is_verified:int is_hotspot_flag:int created_at:ts resolved_at:ts"
    ),
    "safety_scores": fields(
        "location_id:int safety_score:double crime_count_30d:long request_count_30d:long "
        "critical_crimes_30d:long risk_level:string"
    ),
    "email_preferences": fields(
        "user_id:long preferred_email:string preferred_hour:int frequency:string quiet_hours_enabled:int "
        "quiet_start_hour:int quiet_end_hour:int critical_override:int opted_out:int"
    ),
    "email_queue": fields(
        "queue_id:long user_id:long request_id:long template_key:string priority:string status:string "
        "scheduled_at:ts attempts:int max_attempts:int payload_json:string idempotency_key:string "
        "last_error:string sent_at:ts"
    ),
    "email_templates": fields("template_key:string subject_template:string html_template:string is_active:int"),
    "email_logs": fields(
        "queue_id:long user_id:long request_id:long template_key:string recipient_email:string "
        "subject_rendered:string delivery_status:string event_at:ts metadata_json:string"
    ),
}
