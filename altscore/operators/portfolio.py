"""Portfolio queries: latest-N, counts, period rollups, upserts, cascades
(SURVEY §2.9).

Per-key "latest" uses ``max_by`` aggregates (mergeable, map-side partial
aggregation) instead of a window, so a hot key never has to be sorted in one
task.  Per-key top-N uses ``row_number() <= n``, which Spark plans with a
partial group limit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import rnd, to_ntz

PERIOD_UNITS = {"hourly": ("hour", "1 hour"), "daily": ("day", "1 day"), "weekly": ("week", "7 days")}


def latest_n_per_key(df: DataFrame, key: str, order_col: str, tie_col: str, n: int) -> DataFrame:
    """Q1: newest ``n`` rows per key, ranked 1..n (tie-break: ``tie_col`` desc)."""
    w = Window.partitionBy(key).orderBy(F.col(order_col).desc(), F.col(tie_col).desc())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_recent(df: DataFrame, order_col: str, tie_col: str, n: int) -> DataFrame:
    """Q2/Q5/Q9: newest ``n`` rows overall (TakeOrderedAndProject: per-task
    top-n, then a merge of n x tasks rows)."""
    return df.orderBy(F.col(order_col).desc(), F.col(tie_col).desc()).limit(n)


def count_by(df: DataFrame, col: str) -> DataFrame:
    """Q3."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def as_of(df: DataFrame, ts_col: str):
    """Reference time for "last N hours": the newest timestamp in the data
    (one scalar; never the wall clock)."""
    return df.agg(F.max(ts_col).alias("m")).first()["m"]


def last_hours(df: DataFrame, ts_col: str, hours: int, now=None) -> DataFrame:
    """Rows with ``ts >= now - hours`` (a literal bound, pushed to the scan)."""
    now = now if now is not None else as_of(df, ts_col)
    if now is None:
        return df.limit(0)
    return df.filter(F.col(ts_col) >= F.lit(now) - F.expr(f"INTERVAL {int(hours)} HOURS"))


def prediction_statistics(preds: DataFrame, hours: int = 24, now=None) -> DataFrame:
    """Q6: count, count per decision, mean score (4 dp), mean latency (2 dp)."""
    recent = last_hours(preds, "prediction_timestamp", hours, now)
    return recent.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(F.col("decision") == "approve").alias("approvals"),
        F.count_if(F.col("decision") == "reject").alias("rejections"),
        F.count_if(F.col("decision") == "manual_review").alias("manual_reviews"),
        F.coalesce(rnd(F.avg("score"), 4), F.lit(0.0)).alias("avg_score"),
        F.coalesce(rnd(F.avg("latency_ms"), 2), F.lit(0.0)).alias("avg_latency_ms"))


def latest_per_key(df: DataFrame, key: str, order_cols: list[str], value_cols: list[str]) -> DataFrame:
    """Q18 / Q13 core: the row with the greatest ``order_cols`` per key (max_by)."""
    order = F.struct(*[F.col(c) for c in order_cols])
    best = F.max_by(F.struct(*[F.col(c) for c in value_cols]), order)
    return df.groupBy(key).agg(best.alias("_b")).select(key, *[F.col(f"_b.{c}").alias(c) for c in value_cols])


def apply_updates(base: DataFrame, changes: DataFrame, key: str, ts_col: str, seq_col: str,
                  value_cols: list[str]) -> DataFrame:
    """Q13: latest-wins upsert of ``changes`` onto ``base``.

    Partial updates (NULL field in a change) keep the previous value: a
    field's value is the latest non-null one (``max_by`` over rows where it is
    set).  Rows of ``base`` rank below any change with the same timestamp.
    """
    b = base.select(key, ts_col, *value_cols).withColumn(seq_col, F.lit(-1).cast("long"))
    c = changes.select(key, ts_col, seq_col, *value_cols)
    u = b.unionByName(c)
    order = F.struct(F.col(ts_col), F.col(seq_col))
    aggs = [F.max(ts_col).alias(ts_col)]
    for v in value_cols:
        aggs.append(F.max_by(F.col(v), F.when(F.col(v).isNotNull(), order)).alias(v))
    return u.groupBy(key).agg(*aggs)


def purge_cascade(users: DataFrame, apps: DataFrame, preds: DataFrame, audit: DataFrame,
                  deleted_users: DataFrame) -> dict:
    """Q14: remove deleted users and, transitively, their applications and the
    predictions / audit logs of those applications (anti joins)."""
    del_ids = deleted_users.select("user_id").distinct()
    users2 = users.join(del_ids, "user_id", "left_anti")
    gone_apps = apps.join(del_ids, "user_id", "left_semi").select("application_id").distinct()
    apps2 = apps.join(del_ids, "user_id", "left_anti")
    preds2 = preds.join(gone_apps, "application_id", "left_anti")
    audit2 = audit.join(gone_apps, "application_id", "left_anti")
    return {"users": users2, "applications": apps2, "predictions": preds2, "audit_logs": audit2}


def _period_keys(ts_col: str, types) -> F.Column:
    """One (period_type, period_start) struct per requested granularity."""
    return F.explode(F.array(*[F.struct(F.lit(t).alias("period_type"),
                                        F.date_trunc(PERIOD_UNITS[t][0], ts_col).alias("period_start"))
                               for t in types])).alias("pk")


def period_rollups(preds: DataFrame, apps: DataFrame, requests: DataFrame,
                   types=("hourly", "daily", "weekly")) -> DataFrame:
    """Q19: one ``model_metrics`` row per period for every granularity.

    All granularities share one pass: each row is expanded to its period
    keys, so one aggregate, one keyed quantile (exact p95 / p99 per period,
    a busy period spread over many tasks) and one join serve all of them.
    """
    from .ordered import keyed_exact_quantiles
    p = preds.join(apps.select("application_id", "loan_amount"), "application_id", "left")
    p = p.select("*", _period_keys("prediction_timestamp", types))
    m = p.groupBy("pk").agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(F.col("decision") == "approve").alias("total_approvals"),
        F.count_if(F.col("decision") == "reject").alias("total_rejections"),
        F.avg("score").alias("avg_profitability_score"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        # money summed as exact decimals: order-independent on any cluster
        F.sum(F.col("loan_amount").cast("decimal(18,2)")).cast("double").alias("total_loan_amount"),
        F.count("loan_amount").alias("_n_loans"))
    q = keyed_exact_quantiles(p, "pk", "latency_ms", [0.95, 0.99], ["p95_latency_ms", "p99_latency_ms"])
    r = requests.select("status", _period_keys("ts", types)).groupBy("pk").agg(
        F.count(F.lit(1)).alias("_requests"), F.count_if(F.col("status") >= 500).alias("total_errors"))
    j = m.join(q, "pk", "left").join(r, "pk", "left")
    length = F.when(F.col("pk.period_type") == "hourly", F.expr("INTERVAL 1 HOUR")) \
              .when(F.col("pk.period_type") == "daily", F.expr("INTERVAL 1 DAY")) \
              .otherwise(F.expr("INTERVAL 7 DAYS"))
    return j.select(
        to_ntz("pk.period_start").alias("period_start"),
        to_ntz(F.col("pk.period_start") + length).alias("period_end"),
        F.col("pk.period_type").alias("period_type"),
        "total_predictions", "total_approvals", "total_rejections",
        rnd(F.col("total_approvals") / F.col("total_predictions"), 6).alias("approval_rate"),
        *[rnd(F.col(c), 6).alias(c) for c in ("avg_profitability_score", "avg_confidence", "avg_latency_ms",
                                              "p95_latency_ms", "p99_latency_ms")],
        F.coalesce(F.col("total_errors"), F.lit(0)).alias("total_errors"),
        rnd(F.coalesce(F.col("total_errors") / F.col("_requests"), F.lit(0.0)), 6).alias("error_rate"),
        F.col("total_loan_amount"),
        rnd(F.col("total_loan_amount") / F.col("_n_loans"), 6).alias("avg_loan_amount"))


def period_rollup(preds: DataFrame, apps: DataFrame, requests: DataFrame, period_type: str) -> DataFrame:
    """Q19 for one granularity."""
    return period_rollups(preds, apps, requests, (period_type,))


def cache_rollup(requests: DataFrame, minutes: int = 60) -> DataFrame:
    """Q20: requests, hits, misses and hit rate (%) per ``minutes`` window."""
    w = F.window("ts", f"{minutes} minutes")
    g = requests.groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(F.col("cache_hit")).alias("cache_hits"),
        F.count_if(~F.col("cache_hit")).alias("cache_misses"))
    return g.select(to_ntz("w.start").alias("timestamp"), F.lit(minutes).alias("period_minutes"),
                    "total_requests", "cache_hits", "cache_misses",
                    rnd(F.col("cache_hits") / F.col("total_requests") * 100.0, 4).alias("hit_rate"))
