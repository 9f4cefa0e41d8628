"""§2.9 portfolio queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import to_ntz
from ..operators import portfolio as PF
from ..sources import views as V
from ..sources.schemas import declared
from ..sources.tables import load
from .oracle_views import cte
from .registry import register

APP_ID = 7          # application looked up by Q4 / Q7 (exists at every scale)
EVENT_TYPE = "error"


@register("apps_by_user_latest", cte("applications") + """
SELECT user_id, rank, application_id, submitted_at FROM (
  SELECT user_id, application_id, submitted_at,
         row_number() OVER (PARTITION BY user_id ORDER BY submitted_at DESC, application_id DESC) AS rank
  FROM applications) WHERE rank <= 10""")
def q_apps_by_user_latest(spark, sf_dir):
    a = V.applications(spark, sf_dir)
    r = PF.latest_n_per_key(a, "user_id", "submitted_at", "application_id", 10)
    return r.select("user_id", F.col("rank").cast("bigint"), "application_id", to_ntz("submitted_at").alias("submitted_at"))


@register("recent_applications", cte("applications") + """
SELECT application_id, user_id, submitted_at FROM applications
ORDER BY submitted_at DESC, application_id DESC LIMIT 100""")
def q_recent_applications(spark, sf_dir):
    a = V.applications(spark, sf_dir)
    return PF.top_recent(a, "submitted_at", "application_id", 100).select(
        "application_id", "user_id", to_ntz("submitted_at").alias("submitted_at"))


@register("count_by_status", cte("applications") + "SELECT status, count(*) AS n FROM applications GROUP BY status")
def q_count_by_status(spark, sf_dir):
    return PF.count_by(V.applications(spark, sf_dir), "status")


@register("predictions_by_application", cte("predictions") + f"""
SELECT prediction_id, score, decision, prediction_timestamp FROM predictions WHERE application_id = {APP_ID}""")
def q_predictions_by_application(spark, sf_dir):
    p = V.predictions(spark, sf_dir).filter(F.col("application_id") == APP_ID)
    return p.orderBy(F.col("prediction_timestamp").desc(), F.col("prediction_id").desc()).select(
        "prediction_id", "score", "decision", to_ntz("prediction_timestamp").alias("prediction_timestamp"))


@register("recent_predictions", cte("predictions") + """
SELECT prediction_id, application_id, score, decision FROM predictions
ORDER BY prediction_timestamp DESC, prediction_id DESC LIMIT 100""")
def q_recent_predictions(spark, sf_dir):
    p = V.predictions(spark, sf_dir)
    return PF.top_recent(p, "prediction_timestamp", "prediction_id", 100).select(
        "prediction_id", "application_id", "score", "decision")


@register("prediction_statistics", cte("predictions") + """
SELECT count(*) AS total_predictions, count(*) FILTER (WHERE decision = 'approve') AS approvals,
       count(*) FILTER (WHERE decision = 'reject') AS rejections,
       count(*) FILTER (WHERE decision = 'manual_review') AS manual_reviews,
       coalesce(round(avg(score), 4), 0.0) AS avg_score, coalesce(round(avg(latency_ms), 2), 0.0) AS avg_latency_ms
FROM predictions
WHERE prediction_timestamp >= (SELECT max(prediction_timestamp) FROM predictions) - INTERVAL 24 HOUR""")
def q_prediction_statistics(spark, sf_dir):
    return PF.prediction_statistics(V.predictions(spark, sf_dir), 24)


@register("audit_by_application", cte("audit_logs") + f"""
SELECT audit_id, event_type, created_at FROM audit_logs WHERE application_id = {APP_ID}
ORDER BY created_at DESC, audit_id DESC LIMIT 50""")
def q_audit_by_application(spark, sf_dir):
    a = V.audit_logs(spark, sf_dir).filter(F.col("application_id") == APP_ID)
    return PF.top_recent(a, "created_at", "audit_id", 50).select(
        "audit_id", "event_type", to_ntz("created_at").alias("created_at"))


@register("audit_by_event_type", cte("audit_logs") + f"""
SELECT audit_id, application_id, created_at FROM audit_logs WHERE event_type = '{EVENT_TYPE}'
ORDER BY created_at DESC, audit_id DESC LIMIT 100""")
def q_audit_by_event_type(spark, sf_dir):
    a = V.audit_logs(spark, sf_dir).filter(F.col("event_type") == EVENT_TYPE)
    return PF.top_recent(a, "created_at", "audit_id", 100).select(
        "audit_id", "application_id", to_ntz("created_at").alias("created_at"))


@register("recent_audit", cte("audit_logs") + """
SELECT audit_id, application_id, event_type FROM audit_logs ORDER BY created_at DESC, audit_id DESC LIMIT 100""")
def q_recent_audit(spark, sf_dir):
    return PF.top_recent(V.audit_logs(spark, sf_dir), "created_at", "audit_id", 100).select(
        "audit_id", "application_id", "event_type")


# ---------------------------------------------------------------- Q19 / Q10
def _rollup_sql(period_type: str) -> str:
    unit, length = {"hourly": ("hour", "1 hour"), "daily": ("day", "1 day"), "weekly": ("week", "7 days")}[period_type]
    return f"""
SELECT m.period_start::TIMESTAMP AS period_start, (m.period_start + INTERVAL '{length}')::TIMESTAMP AS period_end,
       '{period_type}' AS period_type, total_predictions, total_approvals, total_rejections,
       round(total_approvals / total_predictions, 6) AS approval_rate,
       round(avg_profitability_score, 6) AS avg_profitability_score, round(avg_confidence, 6) AS avg_confidence,
       round(avg_latency_ms, 6) AS avg_latency_ms, round(p95_latency_ms, 6) AS p95_latency_ms,
       round(p99_latency_ms, 6) AS p99_latency_ms, coalesce(total_errors, 0) AS total_errors,
       round(coalesce(total_errors / n_requests, 0.0), 6) AS error_rate,
       total_loan_amount, round(total_loan_amount / n_loans, 6) AS avg_loan_amount
FROM (SELECT date_trunc('{unit}', prediction_timestamp) AS period_start, count(*) AS total_predictions,
             count(*) FILTER (WHERE decision = 'approve') AS total_approvals,
             count(*) FILTER (WHERE decision = 'reject') AS total_rejections,
             avg(score) AS avg_profitability_score, avg(confidence) AS avg_confidence,
             avg(latency_ms) AS avg_latency_ms, quantile_cont(latency_ms, 0.95) AS p95_latency_ms,
             quantile_cont(latency_ms, 0.99) AS p99_latency_ms,
             sum(loan_amount::DECIMAL(18,2))::DOUBLE AS total_loan_amount, count(loan_amount) AS n_loans
      FROM predictions p LEFT JOIN applications a ON p.application_id = a.application_id
      GROUP BY 1) m
LEFT JOIN (SELECT date_trunc('{unit}', ts) AS period_start, count(*) AS n_requests,
                  count(*) FILTER (WHERE status >= 500) AS total_errors
           FROM request_log GROUP BY 1) r ON m.period_start = r.period_start"""


ROLLUP_SQL = cte("predictions", "applications", "request_log") + "\nUNION ALL\n".join(
    _rollup_sql(p) for p in ("hourly", "daily", "weekly"))


def _rollups(spark, sf_dir, types=("hourly", "daily", "weekly")):
    preds, apps, reqs = V.predictions(spark, sf_dir), V.applications(spark, sf_dir), V.request_log(spark, sf_dir)
    return PF.period_rollups(preds, apps, reqs, types)


def table(spark, sf_dir, name):
    """One of the six tables, in its declared schema."""
    made = {"model_metrics": lambda: _rollups(spark, sf_dir),
            "cache_metrics": lambda: PF.cache_rollup(V.request_log(spark, sf_dir), 60)}
    df = made[name]() if name in made else getattr(V, name)(spark, sf_dir)
    return declared(df, name)


@register("period_rollup", ROLLUP_SQL)
def q_period_rollup(spark, sf_dir):
    """Q19: model_metrics rows for hourly, daily and weekly periods."""
    return _rollups(spark, sf_dir)


@register("model_metrics_latest", cte("predictions", "applications", "request_log") + f"""
SELECT * FROM ({_rollup_sql('hourly')}) ORDER BY period_start DESC LIMIT 24""")
def q_model_metrics_latest(spark, sf_dir):
    """Q10: newest 24 hourly periods."""
    return _rollups(spark, sf_dir, ("hourly",)).orderBy(F.col("period_start").desc()).limit(24)


# ---------------------------------------------------------------- Q20 / Q11
CACHE_BODY = """
SELECT time_bucket(INTERVAL 60 MINUTE, ts)::TIMESTAMP AS timestamp, 60 AS period_minutes, count(*) AS total_requests,
       count(*) FILTER (WHERE cache_hit) AS cache_hits, count(*) FILTER (WHERE NOT cache_hit) AS cache_misses,
       round(count(*) FILTER (WHERE cache_hit) / count(*) * 100.0, 4) AS hit_rate
FROM request_log GROUP BY 1"""


@register("cache_rollup", cte("request_log") + CACHE_BODY)
def q_cache_rollup(spark, sf_dir):
    return PF.cache_rollup(V.request_log(spark, sf_dir), 60)


@register("cache_metrics_window", cte("request_log", extra=[("cm", CACHE_BODY)]) + """
SELECT * FROM cm WHERE timestamp >= (SELECT max(ts) FROM request_log)::TIMESTAMP - INTERVAL 24 HOUR""")
def q_cache_metrics_window(spark, sf_dir):
    """Q11: cache rollup rows of the last 24 hours, newest first."""
    reqs = V.request_log(spark, sf_dir)
    now = PF.as_of(reqs, "ts")
    cm = PF.cache_rollup(reqs, 60)
    bound = F.lit(now).cast("timestamp_ntz") - F.expr("INTERVAL 24 HOURS")
    return cm.filter(F.col("timestamp") >= bound).orderBy(F.col("timestamp").desc())


# ---------------------------------------------------------------- Q12 / U1
NEW_USERS_SQL = "SELECT s_suppkey + 10000000 AS user_id, s_name AS full_name, s_acctbal AS monthly_income, " \
                "'SUPPLIER' AS employment_type, s_nationkey AS nation_id FROM supplier"


@register("append_rows", cte("users") + f"SELECT * FROM users UNION ALL {NEW_USERS_SQL}")
def q_append_rows(spark, sf_dir):
    """Q12: append new user rows (suppliers onboarding as users)."""
    s = load(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_acctbal", "s_nationkey"])
    new = s.selectExpr("s_suppkey + 10000000 AS user_id", "s_name AS full_name", "s_acctbal AS monthly_income",
                       "'SUPPLIER' AS employment_type", "s_nationkey AS nation_id")
    return V.users(spark, sf_dir).unionByName(new)


@register("union_batches", cte("ledger_events") + """
SELECT 1 AS batch, applicant_id, ts, amount FROM ledger_events WHERE txn_type = 'credit'
UNION ALL SELECT 2, applicant_id, ts, amount FROM ledger_events WHERE txn_type = 'debit'""")
def q_union_batches(spark, sf_dir):
    """Processed batches concatenated, duplicates kept (UNION ALL)."""
    le = V.ledger_events(spark, sf_dir)
    b1 = le.filter(F.col("txn_type") == "credit").select(F.lit(1).alias("batch"), "applicant_id", "ts", "amount")
    b2 = le.filter(F.col("txn_type") == "debit").select(F.lit(2).alias("batch"), "applicant_id", "ts", "amount")
    return b1.unionByName(b2).select("batch", "applicant_id", to_ntz("ts").alias("ts"),
                                     F.col("amount").cast("double").alias("amount"))


# ---------------------------------------------------------------- Q13 / Q18
STATUS_OF_EVENT = """CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected'
  WHEN 'signup' THEN 'submitted' ELSE 'processing' END"""


@register("apply_updates", cte("applications", "audit_logs") + f"""
SELECT application_id, max(updated_at) AS updated_at,
       arg_max(status, (updated_at, seq)) AS status,
       arg_max(processed_at, CASE WHEN processed_at IS NOT NULL THEN (updated_at, seq) END) AS processed_at
FROM (SELECT application_id, submitted_at AS updated_at, -1::BIGINT AS seq, status, NULL::TIMESTAMP AS processed_at
      FROM applications
      UNION ALL
      SELECT application_id, created_at, audit_id, {STATUS_OF_EVENT},
             CASE WHEN event_type IN ('purchase', 'error') THEN created_at END
      FROM audit_logs)
GROUP BY application_id""")
def q_apply_updates(spark, sf_dir):
    """Q13: status changes (from the audit stream) applied latest-wins; the
    processed time is a partial update kept from the last change that set it."""
    apps = V.applications(spark, sf_dir).select(
        "application_id", F.col("submitted_at").alias("updated_at"), "status",
        F.lit(None).cast("timestamp").alias("processed_at"))
    aud = V.audit_logs(spark, sf_dir)
    changes = aud.select("application_id", F.col("created_at").alias("updated_at"),
                         F.col("audit_id").alias("seq"), F.expr(STATUS_OF_EVENT).alias("status"),
                         F.when(F.col("event_type").isin("purchase", "error"), F.col("created_at"))
                         .alias("processed_at"))
    out = PF.apply_updates(apps, changes, "application_id", "updated_at", "seq", ["status", "processed_at"])
    return out.select("application_id", to_ntz("updated_at").alias("updated_at"), "status",
                      to_ntz("processed_at").alias("processed_at"))


@register("latest_prediction_per_application", cte("predictions") + """
SELECT application_id, arg_max(prediction_id, (prediction_timestamp, prediction_id)) AS prediction_id,
       arg_max(score, (prediction_timestamp, prediction_id)) AS score,
       arg_max(decision, (prediction_timestamp, prediction_id)) AS decision
FROM predictions GROUP BY application_id""")
def q_latest_prediction(spark, sf_dir):
    p = V.predictions(spark, sf_dir)
    return PF.latest_per_key(p, "application_id", ["prediction_timestamp", "prediction_id"],
                             ["prediction_id", "score", "decision"])


# ---------------------------------------------------------------- Q14-Q17
@register("purge_cascade", cte("users", "applications", "predictions", "audit_logs", extra=[
    ("gone_users", "SELECT user_id FROM users WHERE monthly_income < 0"),
    ("gone_apps", "SELECT application_id FROM applications WHERE user_id IN (SELECT user_id FROM gone_users)")]) + """
SELECT 'users' AS table_name, count(*) AS n_remaining FROM users WHERE user_id NOT IN (SELECT user_id FROM gone_users)
UNION ALL SELECT 'applications', count(*) FROM applications WHERE user_id NOT IN (SELECT user_id FROM gone_users)
UNION ALL SELECT 'predictions', count(*) FROM predictions WHERE application_id NOT IN (SELECT application_id FROM gone_apps)
UNION ALL SELECT 'audit_logs', count(*) FROM audit_logs WHERE application_id NOT IN (SELECT application_id FROM gone_apps)""")
def q_purge_cascade(spark, sf_dir):
    """Q14: deleting users with a negative balance cascades to their rows."""
    users = V.users(spark, sf_dir)
    res = PF.purge_cascade(users, V.applications(spark, sf_dir), V.predictions(spark, sf_dir),
                           V.audit_logs(spark, sf_dir), users.filter(F.col("monthly_income") < 0))
    out = None
    for name in ("users", "applications", "predictions", "audit_logs"):
        part = res[name].agg(F.count(F.lit(1)).alias("n_remaining")).select(
            F.lit(name).alias("table_name"), "n_remaining")
        out = part if out is None else out.unionByName(part)
    return out


@register("join_user_applications", cte("users", "applications") + """
SELECT u.user_id, a.application_id FROM users u LEFT JOIN applications a ON u.user_id = a.user_id""")
def q_join_user_applications(spark, sf_dir):
    return V.users(spark, sf_dir).select("user_id").join(
        V.applications(spark, sf_dir).select("user_id", "application_id"), "user_id", "left")


@register("join_application_predictions", cte("applications", "predictions") + """
SELECT a.application_id, p.prediction_id FROM applications a LEFT JOIN predictions p
ON a.application_id = p.application_id""")
def q_join_application_predictions(spark, sf_dir):
    return V.applications(spark, sf_dir).select("application_id").join(
        V.predictions(spark, sf_dir).select("application_id", "prediction_id"), "application_id", "left")


@register("join_application_audit", cte("applications", "audit_logs") + """
SELECT a.application_id, l.audit_id FROM applications a LEFT JOIN audit_logs l
ON a.application_id = l.application_id""")
def q_join_application_audit(spark, sf_dir):
    return V.applications(spark, sf_dir).select("application_id").join(
        V.audit_logs(spark, sf_dir).select("application_id", "audit_id"), "application_id", "left")


