"""Canonical credit-analytics tables derived from the driver tables.

The mapping is fixed by FIXTURES.md §2: orders are credits, line items are
debits (``ledger``); the event stream gives a 30-day ledger
(``ledger_events``), predictions, audit logs and a request log; customers give
applicants and users; orders give applications.  All derivations are plain
projections, unions and one equi-join, so Catalyst prunes columns and pushes
filters into the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import load

CREDIT_SOURCE_SQL = """CASE {k} % 6 WHEN 0 THEN 'UPI' WHEN 1 THEN 'Bank Transfer' WHEN 2 THEN 'Mandi Sale'
  WHEN 3 THEN 'Customer Payment' WHEN 4 THEN 'Government Subsidy' ELSE 'Rent Income' END"""
DEBIT_SOURCE_SQL = """CASE {k} % 8 WHEN 0 THEN 'Electricity Bill' WHEN 1 THEN 'Mobile Recharge'
  WHEN 2 THEN 'Grocery' WHEN 3 THEN 'Medical' WHEN 4 THEN 'Fuel' WHEN 5 THEN 'School Fees'
  WHEN 6 THEN 'Loan EMI' ELSE 'Insurance' END"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per transaction: ``(applicant_id, ts, txn_type, amount DECIMAL(18,2),
    source, message, category)``."""
    orders = load(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"])
    credits = orders.selectExpr(
        "o_custkey AS applicant_id",
        "CAST(o_orderdate AS TIMESTAMP) AS ts",
        "'credit' AS txn_type",
        "CAST(o_totalprice AS DECIMAL(18,2)) AS amount",
        CREDIT_SOURCE_SQL.format(k="o_orderkey") + " AS source",
        """CASE WHEN o_orderkey % 9 = 0 THEN 'Credit card refund'
                WHEN o_orderkey % 17 = 0 THEN 'Transfer REJECTED'
                ELSE 'Credited to account' END AS message""",
        "'income' AS category")
    items = load(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate"])
    owners = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    debits = items.join(owners, "l_orderkey").selectExpr(
        "o_custkey AS applicant_id",
        "CAST(l_shipdate AS TIMESTAMP) AS ts",
        "'debit' AS txn_type",
        "CAST(l_extendedprice AS DECIMAL(18,2)) AS amount",
        DEBIT_SOURCE_SQL.format(k="l_partkey") + " AS source",
        """CASE WHEN l_partkey % 13 = 0 THEN 'Card payment'
                WHEN l_partkey % 11 = 0 THEN 'Payment Failed'
                ELSE 'Debited from account' END AS message""",
        "'expense' AS category")
    return credits.unionByName(debits)


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30-day ledger derived from the event stream (user_id = applicant)."""
    ev = load(spark, sf_dir, "events", ["ts", "user_id", "event_type", "value", "props"])
    ev = ev.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    is_credit = "event_type IN ('purchase','signup')"
    return ev.selectExpr(
        "user_id AS applicant_id",
        "CAST(ts AS TIMESTAMP) AS ts",
        f"CASE WHEN {is_credit} THEN 'credit' ELSE 'debit' END AS txn_type",
        "CAST(value AS DECIMAL(18,2)) AS amount",
        f"CASE WHEN {is_credit} THEN {CREDIT_SOURCE_SQL.format(k='k')} "
        f"ELSE {DEBIT_SOURCE_SQL.format(k='k')} END AS source",
        """CASE event_type WHEN 'error' THEN 'Transaction FAILED' WHEN 'view' THEN 'Credit card payment'
             WHEN 'signup' THEN 'Card payment refund' ELSE 'Ok' END AS message""",
        f"CASE WHEN {is_credit} THEN 'income' ELSE 'expense' END AS category")


APPLICANT_EXPRS = [
    "c_custkey AS applicant_id",
    """CAST(CASE c_custkey % 4 WHEN 0 THEN 200 + (c_custkey*37) % 301
         WHEN 1 THEN 100 + (c_custkey*37) % 101 WHEN 2 THEN 50 + (c_custkey*37) % 51
         ELSE (c_custkey % 8 - 3) * 175 END AS INT) AS total_contacts""",
    "CAST(5 + (c_custkey*13) % 46 AS INT) AS family_contacts",
    "CAST(5 + (c_custkey*17) % 76 AS INT) AS business_contacts",
    "CAST((c_custkey*7) % 11 AS INT) AS government_contacts",
    "((c_custkey*29) % 7501 + 500) / 100.0D AS avg_communication_frequency",
    "CAST((c_custkey*11) % 61 AS INT) AS unique_locations_count",
    "((c_custkey*23) % 20001) / 100.0D AS average_distance_from_home",
    "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE ((c_custkey*41) % 60001) / 100.0D END AS max_distance_from_home",
    "CASE c_custkey % 3 WHEN 0 THEN 'Urban' WHEN 1 THEN 'rural' ELSE 'urban' END AS area_type",
    "c_custkey % 5 = 0 AS gambling_app_usage",
    "CAST((c_custkey*19) % 31 AS INT) AS frequent_location_changes",
    "((c_custkey*31) % 61) / 100.0D AS night_transaction_ratio",
    "((c_custkey*43) % 91 + 10) / 10.0D AS financial_app_usage_score",
]


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicant attributes (contacts, location, behaviour) in the extractor dialect."""
    cust = load(spark, sf_dir, "customer", ["c_custkey"])
    return cust.selectExpr(*APPLICANT_EXPRS)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = load(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey"])
    return cust.selectExpr(
        "c_custkey AS user_id", "c_name AS full_name", "c_acctbal AS monthly_income",
        "c_mktsegment AS employment_type", "c_nationkey AS nation_id")


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate",
                                       "o_orderstatus", "o_orderpriority"])
    return o.selectExpr(
        "o_orderkey AS application_id", "o_custkey AS user_id", "o_totalprice AS loan_amount",
        "CAST(o_orderdate AS TIMESTAMP) AS submitted_at",
        "CASE o_orderstatus WHEN 'O' THEN 'submitted' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status",
        "o_orderpriority AS loan_purpose")


def _events(spark: SparkSession, sf_dir: str, columns: list[str], events: DataFrame | None) -> DataFrame:
    """The event table, or the given stream of it."""
    return load(spark, sf_dir, "events", columns) if events is None else events.select(*columns)


def _with_application(ev: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events dealt over the applications: ``event_id`` modulo the number of orders."""
    n = load(spark, sf_dir, "orders", ["o_orderkey"]).agg(F.count(F.lit(1)).alias("n_orders"))
    n = F.broadcast(n.withColumn("_one", F.lit(1)))                 # one row
    return ev.withColumn("_one", F.lit(1)).join(n, "_one").withColumn("application_id", F.col("event_id") % F.col("n_orders"))


def predictions(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    ev = _with_application(_events(spark, sf_dir, ["event_id", "ts", "value", "props"], events), spark, sf_dir)
    return (ev.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
            .selectExpr(
                "event_id AS prediction_id",
                "application_id",
                "k / 100.0D AS score",
                "0.3D + (event_id % 66) / 100.0D AS confidence",
                "CASE WHEN k / 100.0D > 0.6D THEN 'approve' ELSE 'reject' END AS decision",
                "ts AS prediction_timestamp",
                "value AS latency_ms"))


def audit_logs(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    ev = _events(spark, sf_dir, ["event_id", "ts", "user_id", "event_type", "props"], events)
    return _with_application(ev, spark, sf_dir).selectExpr(
        "event_id AS audit_id", "application_id", "user_id AS actor_id",
        "event_type", "props AS event_data", "ts AS created_at")


# Proxy headers made up per request (FIXTURES: the request log has no headers).
REQUEST_HEADER_EXPRS = [
    "CASE WHEN k % 4 = 0 THEN concat(' 10.0.0.', CAST(user_id AS STRING), ' , 172.16.0.1') END AS x_forwarded_for",
    "CASE WHEN k % 4 = 1 THEN concat('192.168.1.', CAST(user_id AS STRING)) END AS x_real_ip",
    "CASE WHEN k % 4 = 2 THEN concat('host-', CAST(user_id AS STRING)) END AS client_host",
]


def request_log(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    ev = _events(spark, sf_dir, ["event_id", "ts", "user_id", "event_type", "value", "props"], events)
    return (ev.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
            .selectExpr(
                "event_id AS request_id", "CAST(user_id AS STRING) AS client", "ts",
                "'POST' AS method", "concat('/api/v1/', event_type) AS endpoint",
                "value AS latency_ms",
                "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status",
                "k % 3 = 0 AS cache_hit",
                "k / 100.0D AS score",
                *REQUEST_HEADER_EXPRS))


def eval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y_true, y_pred) evaluation pairs from the predictions view."""
    return predictions(spark, sf_dir).selectExpr(
        "prediction_id AS id", "((prediction_id * 7) % 100) / 100.0D AS y_true", "score AS y_pred")


# Pipeline-dialect application fields over orders (o), customer (c),
# applicants (a) and per-applicant ledger counts (t).  Written in SQL that
# Spark and ANSI engines read alike; a few values fall outside the schema
# limits on purpose, so that every validation rule has failures to find.
LOAN_APPLICATION_EXPRS = [
    "o_orderkey AS application_id",
    "o_custkey AS user_id",
    "CAST(18 + (o_custkey * 7) % 70 AS INT) AS age",
    "CASE o_custkey % 4 WHEN 0 THEN 'male' WHEN 1 THEN 'female' WHEN 2 THEN 'other' ELSE 'unspecified' END AS gender",
    """CASE o_custkey % 6 WHEN 0 THEN 'farmer' WHEN 1 THEN 'shopkeeper' WHEN 2 THEN 'daily_wage'
         WHEN 3 THEN 'self_employed' WHEN 4 THEN 'salaried' ELSE 'student' END AS occupation""",
    "CAST(c_acctbal AS DECIMAL(18,2)) AS monthly_income",
    "CAST(o_totalprice AS DECIMAL(18,2)) AS loan_amount_requested",
    "o_orderpriority AS loan_purpose",
    "coalesce(n_txns, 0) AS n_transactions",
    "coalesce(n_bad, 0) AS n_bad_transactions",
    "CAST(NULL AS DOUBLE) AS profitability_score",
    "total_contacts", "family_contacts", "business_contacts", "government_contacts",
    "avg_communication_frequency",
    "((o_custkey * 23) % 18101) / CAST(100 AS DOUBLE) - 90 AS latitude",
    "((o_custkey * 31) % 36001) / CAST(100 AS DOUBLE) - 180 AS longitude",
    """CASE o_custkey % 4 WHEN 0 THEN 'rural' WHEN 1 THEN 'semi_urban' WHEN 2 THEN 'urban'
         ELSE 'metro' END AS location_type""",
    "((o_custkey * 13) % 105) / CAST(100 AS DOUBLE) AS stability_score",
    "average_distance_from_home AS distance_from_financial_center",
    "CAST((o_custkey * 3) % 33 AS INT) AS travel_frequency",
    "gambling_app_usage", "frequent_location_changes", "night_transaction_ratio",
    "financial_app_usage_score",
]

API_REQUEST_EXPRS = [
    "o_orderkey AS application_id",
    "CAST(o_custkey AS STRING) AS user_id",
    "o_totalprice AS loan_amount",
    "o_orderpriority AS loan_purpose",
    "coalesce(n_txns, 0) AS n_transactions",
    "((o_custkey * 3) % 120) / CAST(100 AS DOUBLE) AS contact_diversity_score",
    "CAST(o_custkey % 27 AS DOUBLE) AS app_usage_hours_per_day",
    "((o_custkey * 7) % 110) / CAST(100 AS DOUBLE) AS literacy_score",
]


def _application_base(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    from ..functions.rules import TRANSACTION_RULES
    led = ledger(spark, sf_dir)
    ok = None
    for sql in TRANSACTION_RULES.values():
        p = F.coalesce(F.expr(sql), F.lit(False))
        ok = p if ok is None else (ok & p)
    t = led.groupBy("applicant_id").agg(F.count(F.lit(1)).alias("n_txns"), F.count_if(~ok).alias("n_bad"))
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
    o = load(spark, sf_dir, "orders", columns) if orders is None else orders.select(*columns)
    c = load(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"])
    a = applicants(spark, sf_dir)
    return (o.join(c, o["o_custkey"] == c["c_custkey"])
            .join(a, o["o_custkey"] == a["applicant_id"])
            .join(t.withColumnRenamed("applicant_id", "t_id"), o["o_custkey"] == F.col("t_id"), "left"))


def loan_applications(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """One pipeline-dialect application per order (flat; transactions as counts);
    ``orders`` may be a stream of that table."""
    return _application_base(spark, sf_dir, orders).selectExpr(*LOAN_APPLICATION_EXPRS)


def api_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One API-dialect request per order."""
    return _application_base(spark, sf_dir).selectExpr(*API_REQUEST_EXPRS)


def api_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API-dialect request records (nested structs) built from the applicants:
    contact / location / behaviour blocks under the API's own field names."""
    a = applicants(spark, sf_dir)
    return a.select(
        "applicant_id",
        F.struct(F.col("total_contacts"), F.col("family_contacts"), F.col("business_contacts"),
                 F.col("government_contacts"),
                 (F.col("avg_communication_frequency") * 3).alias("avg_call_duration"),
                 (F.col("family_contacts") / F.greatest(F.col("total_contacts"), F.lit(1))).alias(
                     "contact_diversity_score")).alias("contact_metadata"),
        F.struct(F.col("unique_locations_count").alias("unique_locations"),
                 F.create_map(F.lit("lat"), F.lit(28.7041), F.lit("lon"), F.lit(77.1025)).alias("home_location"),
                 F.coalesce("max_distance_from_home", F.col("average_distance_from_home") * 2).alias(
                     "travel_radius_km"),
                 F.lower("area_type").alias("area_type"),
                 (F.lit(1.0) - F.col("night_transaction_ratio")).alias("location_stability_score")
                 ).alias("location_pattern"),
        F.struct((F.col("financial_app_usage_score") / 2).alias("app_usage_hours_per_day"),
                 F.col("night_transaction_ratio").alias("night_activity_ratio"),
                 F.col("gambling_app_usage").cast("int").alias("gambling_indicators"),
                 (F.col("financial_app_usage_score") > 5).alias("financial_app_usage"),
                 (F.col("financial_app_usage_score") / 10).alias("literacy_score")).alias("behavioral_data"))
