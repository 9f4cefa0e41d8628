"""§2.1 sources, sinks and application records."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import to_ntz
from ..operators import scoring as S
from ..session import scratch_path
from ..sources import io as IO
from ..sources import views as V
from ..sources.tables import load
from .oracle_views import cte
from .q_portfolio import table
from .q_quality import _METRICS
from .q_scoring import _SCORE_SQL, _SUBSCORE_SQL
from .registry import register


TXN_ORDER = "ts, txn_type, amount, source, message, category"
BATCH_TXN_SQL = cte("ledger") + f"""
SELECT applicant_id, ts, txn_type, CAST(amount AS DOUBLE) AS amount, source, message, category FROM (
  SELECT *, row_number() OVER (PARTITION BY applicant_id ORDER BY {TXN_ORDER}) AS n FROM ledger) WHERE n <= 100"""


@register("gen_transactions", BATCH_TXN_SQL)
def q_gen_transactions(spark, sf_dir):
    """S9 on the given tables: the transactions of an application record, by
    time, the first 100 kept (the limit is the record's)."""
    first = Window.partitionBy("applicant_id").orderBy(*TXN_ORDER.split(", "))
    t = V.ledger(spark, sf_dir).withColumn("n", F.row_number().over(first)).where("n <= 100")
    return t.select("applicant_id", to_ntz("ts").alias("ts"), "txn_type", F.col("amount").cast("double"),
                    "source", "message", "category")


@register("gen_attributes", cte("applicants") + "SELECT applicant_id AS application_id, * EXCLUDE (applicant_id) FROM applicants")
def q_gen_attributes(spark, sf_dir):
    """S10-S12 on the given tables: contacts, location and behaviour of each applicant."""
    return V.applicants(spark, sf_dir).withColumnRenamed("applicant_id", "application_id")


APPLICATION_COLUMNS = ["application_id", "user_id", "age", "gender", "occupation", "monthly_income", "loan_amount_requested",
                       "n_transactions", "total_contacts", "family_contacts", "business_contacts", "government_contacts",
                       "location_type", "travel_frequency"]
_MONEY = ("monthly_income", "loan_amount_requested")
BATCH_APPS_SQL = cte("ledger", "applicants", "loan_applications", extra=[("sub", _SUBSCORE_SQL), ("sc", _SCORE_SQL)]) + f"""
SELECT {", ".join(f"CAST(a.{c} AS DOUBLE) AS {c}" if c in _MONEY else f"a.{c}" for c in APPLICATION_COLUMNS)},
       sc.profitability_score, sc.profitability_score >= 50 AS approved,
       CASE WHEN sc.profitability_score >= 50 THEN sc.profitability_score < 40 END AS default_status
FROM loan_applications a JOIN sc ON a.user_id = sc.applicant_id"""


def scored_dataset(spark, sf_dir):
    """Applications with the rule score and labels of their applicant."""
    apps = V.loan_applications(spark, sf_dir).select(
        *[F.col(c).cast("double").alias(c) if c in _MONEY else c for c in APPLICATION_COLUMNS])
    sc = S.profitability_score(V.ledger(spark, sf_dir), V.applicants(spark, sf_dir))
    sc = sc.select(F.col("applicant_id").alias("user_id"), "profitability_score", "approved", "default_status")
    return apps.join(sc, "user_id").select(*APPLICATION_COLUMNS, "profitability_score", "approved", "default_status")


@register("gen_applications", BATCH_APPS_SQL)
def q_gen_applications(spark, sf_dir):
    """S13 on the given tables: applications with the rule score and labels."""
    return scored_dataset(spark, sf_dir)


def _roundtrip(spark, df, fmt):
    path = scratch_path(spark, f"sinks/{fmt}-{uuid.uuid4().hex}")
    IO.write(df, path, fmt)
    return IO.read_back(spark, path, fmt, df.schema)


@register("sink_parquet", BATCH_APPS_SQL)
def q_sink_parquet(spark, sf_dir):
    """S4 + S1: write the scored applications as snappy Parquet, read them back."""
    return _roundtrip(spark, scored_dataset(spark, sf_dir), "parquet")


@register("scan_by_suffix", cte("applicants") + """
SELECT 'parquet' AS kind, count(*) AS n_rows, sum(total_contacts)::BIGINT AS contacts FROM applicants
UNION ALL SELECT 'csv', count(*), sum(total_contacts)::BIGINT FROM applicants""")
def q_scan_by_suffix(spark, sf_dir):
    """S1 + S2: one table written in both formats and loaded by its suffix."""
    out = None
    for fmt in ("parquet", "csv"):
        path = scratch_path(spark, f"sinks/{uuid.uuid4().hex}.{fmt}")
        a = V.applicants(spark, sf_dir)
        IO.write(a, path, fmt)
        part = IO.scan(spark, path, a.schema).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("total_contacts").alias("contacts"))
        part = part.select(F.lit(fmt).alias("kind"), "n_rows", "contacts")
        out = part if out is None else out.unionByName(part)
    return out


BROKEN_SQL = "\nUNION ALL\n".join(f"""
SELECT '{fmt}' AS format, count(*) FILTER (WHERE c_custkey % 10 NOT IN (3, 5)) AS n_rows,
       sum(c_acctbal) FILTER (WHERE c_custkey % 10 NOT IN (3, 5)) AS balance,
       count(*) FILTER (WHERE c_custkey % 10 = 3) AS n_wrong_type, count(*) FILTER (WHERE c_custkey % 10 = 5) AS n_cut FROM customer""" for fmt in ("csv", "json"))


@register("scan_quarantine", f"SELECT format, n_rows, round(balance::DOUBLE, 2) AS balance, n_wrong_type, n_cut FROM ({BROKEN_SQL})")
def q_scan_quarantine(spark, sf_dir):
    """Customers as CSV and JSON lines of which some hold no number where one belongs
    and some are cut off: good lines are rows, bad ones are kept with file and reason."""
    c = load(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_acctbal"]).withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)"))
    row, out = F.struct("c_custkey", "c_name", "c_acctbal"), None
    for fmt, line, cut in (("csv", F.to_csv(row), F.to_csv(F.struct("c_custkey", "c_name"))), ("json", F.to_json(row), F.substring(F.to_json(row), 1, 20))):
        wrong = F.regexp_replace(line, "-?[0-9]+[.][0-9]+", "n/a" if fmt == "csv" else '"n/a"')
        path = scratch_path(spark, f"broken/{uuid.uuid4().hex}.{fmt}")
        c.select(F.when(F.col("c_custkey") % 10 == 3, wrong).when(F.col("c_custkey") % 10 == 5, cut).otherwise(line)).write.text(path)
        rows, bad = IO.scan_checked(spark, path, c.schema, fmt, header=False)
        kept = scratch_path(spark, f"quarantine/{uuid.uuid4().hex}")
        bad.write.parquet(kept)
        bad = spark.read.schema(IO.QUARANTINE).parquet(kept).agg(F.count_if(F.col("reason").startswith("c_acctbal is not")).alias("n_wrong_type"),
                                                              F.count_if(F.col("reason").isin("wrong number of fields", "not a JSON object")).alias("n_cut"))
        part = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.bround(F.sum("c_acctbal").cast("double"), 2).alias("balance"))
        part = part.withColumn("_k", F.lit(1)).join(bad.withColumn("_k", F.lit(1)), "_k").select(F.lit(fmt).alias("format"), "n_rows", "balance", "n_wrong_type", "n_cut")
        out = part if out is None else out.unionByName(part)
    return out


@register("sink_csv", cte("applicants") + "SELECT * FROM applicants")
def q_sink_csv(spark, sf_dir):
    """S5 + S2: CSV with header, read back with the declared schema."""
    return _roundtrip(spark, V.applicants(spark, sf_dir), "csv")


def _json_oracle():
    from .q_evaluate import P, _reg_sql
    return cte(P) + _reg_sql(P)


@register("sink_json", _json_oracle())
def q_sink_json(spark, sf_dir):
    """A nested result row ({"regression": {...}}) to JSON lines and back;
    flattened after the read it must equal the regression metrics exactly."""
    from ..operators import evaluate as EV
    p = V.eval_pairs(spark, sf_dir)
    res = EV.regression_metrics(p).select(F.struct("*").alias("regression"))
    return _roundtrip(spark, res, "json").select("regression.*")


@register("json_columns", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k,
       to_json({'event_id': event_id, 'event_type': event_type}) AS event_data
FROM events""")
def q_json_columns(spark, sf_dir):
    """Read a JSON text column and write a struct back as JSON text."""
    ev = load(spark, sf_dir, "events", ["event_id", "event_type", "props"])
    parsed = ev.withColumn("p", F.from_json("props", "k int"))
    return IO.json_struct(parsed, ["event_id", "event_type"], "event_data").select(
        "event_id", F.col("p.k").alias("k"), "event_data")


def _ledger_oracle():
    from . import oracle_features as O
    return O.ledger_features_sql("ledger", O.INCOME_COLS + O.EXPENSE_COLS + O.DISCIPLINE_COLS)


@register("detect_input_kind", _ledger_oracle())
def q_detect_input_kind(spark, sf_dir):
    """S3: branch on the schema: raw applications (a nested transaction list)
    get their features extracted; a feature table passes through."""
    from ..operators.ledger_features import KEY, LEDGER_FEATURES, ledger_features
    from ..operators.nested import nest_ledger, nested_ledger_features
    nested, rest = nest_ledger(V.ledger(spark, sf_dir))
    flat = ledger_features(rest).select(KEY, *LEDGER_FEATURES)
    # both kinds of input occur: records with their transactions, and the
    # feature rows of those too long to nest
    return _features(nested, nested_ledger_features).unionByName(_features(flat, nested_ledger_features))


def _features(df, extract):
    return extract(df) if IO.detect_input_kind(df) == "applications" else df


_TABLES = ("users", "applications", "predictions", "audit_logs", "model_metrics", "cache_metrics")
TABLE_COUNTS_SQL = cte("users", "applications", "predictions", "audit_logs", "request_log", extra=_METRICS) + "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _TABLES)


@register("table_sources", TABLE_COUNTS_SQL)
def q_table_sources(spark, sf_dir):
    """The six tables over the given data in their declared schemas, with their row counts."""
    out = None
    for name in _TABLES:
        part = table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out
