"""Declared schemas (never inferred) and dialect adapters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = T.StructType([
    T.StructField("applicant_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("txn_type", T.StringType()), T.StructField("amount", T.DecimalType(18, 2)),
    T.StructField("source", T.StringType()), T.StructField("message", T.StringType()),
    T.StructField("category", T.StringType())])

TXN = T.StructType([f for f in LEDGER.fields if f.name != "applicant_id"])

APPLICANT_ATTRS = T.StructType([
    T.StructField("total_contacts", T.IntegerType()), T.StructField("family_contacts", T.IntegerType()),
    T.StructField("business_contacts", T.IntegerType()), T.StructField("government_contacts", T.IntegerType()),
    T.StructField("avg_communication_frequency", T.DoubleType()),
    T.StructField("unique_locations_count", T.IntegerType()),
    T.StructField("average_distance_from_home", T.DoubleType()),
    T.StructField("max_distance_from_home", T.DoubleType()), T.StructField("area_type", T.StringType()),
    T.StructField("gambling_app_usage", T.BooleanType()),
    T.StructField("frequent_location_changes", T.IntegerType()),
    T.StructField("night_transaction_ratio", T.DoubleType()),
    T.StructField("financial_app_usage_score", T.DoubleType())])

# One self-contained application record (transactions inside): the stream shape.
NESTED_APPLICATION = T.StructType(
    [T.StructField("applicant_id", T.LongType())] + list(APPLICANT_ATTRS.fields)
    + [T.StructField("sms_transactions", T.ArrayType(TXN))])

# Canonical attribute defaults when a field is absent from a dialect.
LOCATION_DEFAULTS = {"unique_locations_count": 0, "average_distance_from_home": 0.0,
                     "max_distance_from_home": None, "area_type": "Unknown"}
BEHAVIOR_DEFAULTS = {"gambling_app_usage": False, "frequent_location_changes": 0,
                     "night_transaction_ratio": 0.0, "financial_app_usage_score": 0.0}


def _lits(defaults: dict) -> dict:
    return {k: (F.lit(v) if v is not None else F.lit(None).cast("double")) for k, v in defaults.items()}


def adapt_pipeline(df: DataFrame, key: str = "application_id") -> DataFrame:
    """Pipeline dialect -> canonical attributes.  Contacts and behaviour
    carry over by name; the pipeline's location fields (latitude, longitude,
    location_type, ...) are not the ones the location features read, so those
    take their defaults."""
    return df.select(F.col(key).alias("applicant_id"), "total_contacts", "family_contacts",
                     "business_contacts", "government_contacts", "avg_communication_frequency",
                     *[v.alias(k) for k, v in _lits(LOCATION_DEFAULTS).items()],
                     "gambling_app_usage", "frequent_location_changes", "night_transaction_ratio",
                     "financial_app_usage_score")


def adapt_api(df: DataFrame, key: str = "application_id") -> DataFrame:
    """API dialect (nested structs) -> canonical attributes.  Only the
    contact counts and ``area_type`` share names with what the features read;
    everything else takes the feature defaults (communication frequency 0,
    behaviour defaults, radius 2 x average)."""
    c, loc = F.col("contact_metadata"), F.col("location_pattern")
    defaults = _lits(LOCATION_DEFAULTS)
    defaults["area_type"] = loc["area_type"]
    return df.select(F.col(key).alias("applicant_id"),
                     c["total_contacts"].alias("total_contacts"), c["family_contacts"].alias("family_contacts"),
                     c["business_contacts"].alias("business_contacts"),
                     c["government_contacts"].alias("government_contacts"),
                     F.lit(0.0).alias("avg_communication_frequency"),
                     *[v.alias(k) for k, v in defaults.items()],
                     *[v.alias(k) for k, v in _lits(BEHAVIOR_DEFAULTS).items()])


def api_transactions(df: DataFrame, key: str = "application_id") -> DataFrame:
    """P15 for the transaction list: API items have no source / message."""
    t = df.select(F.col(key).alias("applicant_id"), F.explode("sms_transactions").alias("t"))
    return t.select("applicant_id", F.col("t.timestamp").alias("ts"), F.col("t.transaction_type").alias("txn_type"),
                    F.col("t.amount").cast("decimal(18,2)").alias("amount"),
                    F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("message"),
                    F.col("t.merchant_category").alias("category"))


# The six tables as they are kept, in the columns that the given data has.
TABLE_SCHEMAS = {
    "users": "user_id long, full_name string, monthly_income double, employment_type string, nation_id long",
    "applications": "application_id long, user_id long, loan_amount double, submitted_at timestamp, status string, loan_purpose string",
    "predictions": "prediction_id long, application_id long, score double, confidence double, decision string, "
                   "prediction_timestamp timestamp, latency_ms double",
    "audit_logs": "audit_id long, application_id long, actor_id long, event_type string, event_data string, created_at timestamp",
    "model_metrics": "period_start timestamp_ntz, period_end timestamp_ntz, period_type string, total_predictions long, "
                     "total_approvals long, total_rejections long, approval_rate double, avg_profitability_score double, "
                     "avg_confidence double, avg_latency_ms double, p95_latency_ms double, p99_latency_ms double, "
                     "total_errors long, error_rate double, total_loan_amount double, avg_loan_amount double",
    "cache_metrics": "timestamp timestamp_ntz, period_minutes int, total_requests long, cache_hits long, cache_misses long, hit_rate double",
}


def declared(df: DataFrame, table: str) -> DataFrame:
    """``df`` in the declared columns and types of a table; a missing column is an error."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(TABLE_SCHEMAS[table])])
