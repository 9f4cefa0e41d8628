"""§2.10 request-log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import requests as RQ
from ..sources import views as V
from .oracle_views import cte
from .registry import register

# FIXTURES: a small limit and a long window so that the 30-day event log
# actually produces rejections; the reference defaults are 100 / 900 s.
LIMIT, WINDOW_S = 3, 6 * 3600
W_US = WINDOW_S * 1_000_000


def _limiter_sql() -> str:
    kept = f"list_filter(r.acc, lambda x: x > s.t - {W_US})"
    body = cte("request_log", extra=[
        ("seq", "SELECT client, request_id, ts, epoch_us(ts) AS t, "
                "row_number() OVER (PARTITION BY client ORDER BY epoch_us(ts), request_id) AS rn FROM request_log"),
        ("r", f"""
SELECT client, rn, request_id, ts, t, true AS accepted, [t] AS acc, {LIMIT - 1}::BIGINT AS remaining,
       0::BIGINT AS retry_after
FROM seq WHERE rn = 1
UNION ALL
SELECT s.client, s.rn, s.request_id, s.ts, s.t,
       len({kept}) < {LIMIT} AS accepted,
       CASE WHEN len({kept}) < {LIMIT} THEN list_append({kept}, s.t) ELSE {kept} END AS acc,
       CASE WHEN len({kept}) < {LIMIT} THEN greatest(0, {LIMIT} - len({kept}) - 1)
            ELSE greatest(0, {LIMIT} - len({kept})) END::BIGINT AS remaining,
       CASE WHEN len({kept}) < {LIMIT} THEN 0
            ELSE greatest(0, ({kept}[1] + {W_US} - s.t) // 1000000) END::BIGINT AS retry_after
FROM r JOIN seq s ON s.client = r.client AND s.rn = r.rn + 1""")])
    return ("WITH RECURSIVE " + body[len("WITH "):] +
            "SELECT request_id, client, ts, accepted, remaining, retry_after FROM r")


@register("rate_limit_flags", _limiter_sql())
def q_rate_limit_flags(spark, sf_dir):
    """W1 + W2: accepted flag, remaining quota, retry-after per request."""
    return RQ.rate_limit(V.request_log(spark, sf_dir), LIMIT, WINDOW_S)


@register("sliding_request_count", cte("request_log") + """
SELECT request_id, client, count(*) OVER (PARTITION BY client ORDER BY epoch_us(ts)
       RANGE BETWEEN 899999999 PRECEDING AND CURRENT ROW) - 1 AS n_recent
FROM request_log""")
def q_sliding_request_count(spark, sf_dir):
    """Requests of the same client in the trailing 900 s."""
    return RQ.sliding_request_count(V.request_log(spark, sf_dir), 900)


@register("client_key", cte("request_log") + """
SELECT request_id, CASE WHEN coalesce(length(x_forwarded_for), 0) > 0 THEN trim(split_part(x_forwarded_for, ',', 1))
                        WHEN coalesce(length(x_real_ip), 0) > 0 THEN x_real_ip
                        ELSE coalesce(client_host, 'unknown') END AS client_key
FROM request_log""")
def q_client_key(spark, sf_dir):
    """W4."""
    return V.request_log(spark, sf_dir).select("request_id", RQ.client_key().alias("client_key"))


_LAT_SQL = """
SELECT t.total_requests, t.total_errors, round(t.total_errors / greatest(t.total_requests, 1), 9) AS error_rate,
       coalesce(round(p.avg, 2), 0.0) AS avg_latency_ms, coalesce(round(p.p50, 2), 0.0) AS p50_latency_ms,
       coalesce(round(p.p95, 2), 0.0) AS p95_latency_ms, coalesce(round(p.p99, 2), 0.0) AS p99_latency_ms
FROM (SELECT count(*) AS total_requests, count(*) FILTER (WHERE status >= 500) AS total_errors FROM request_log) t,
     (SELECT avg(latency_ms) AS avg,
             max(latency_ms) FILTER (WHERE rk = floor(n * 0.5) + 1) AS p50,
             max(latency_ms) FILTER (WHERE rk = floor(n * 0.95) + 1) AS p95,
             max(latency_ms) FILTER (WHERE rk = floor(n * 0.99) + 1) AS p99
      FROM (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms, request_id) AS rk, count(*) OVER () AS n
            FROM (SELECT * FROM request_log ORDER BY ts DESC, request_id DESC LIMIT 10000))) p"""


@register("latency_metrics", cte("request_log") + _LAT_SQL)
def q_latency_metrics(spark, sf_dir):
    """W5."""
    return RQ.latency_metrics(V.request_log(spark, sf_dir))


@register("endpoint_status_counts", cte("request_log") + """
SELECT 'endpoint' AS kind, concat_ws(' ', method, endpoint) AS key, count(*) AS n FROM request_log GROUP BY 2
UNION ALL SELECT 'status', CAST(status AS VARCHAR), count(*) FROM request_log GROUP BY 2""")
def q_endpoint_status_counts(spark, sf_dir):
    """W6."""
    return RQ.endpoint_status_counts(V.request_log(spark, sf_dir))


@register("score_buckets", cte("predictions") + """
SELECT le, count FROM (UNPIVOT (SELECT count(*) FILTER (WHERE score * 100 <= 0) AS "0",
  count(*) FILTER (WHERE score * 100 <= 20) AS "20", count(*) FILTER (WHERE score * 100 <= 40) AS "40",
  count(*) FILTER (WHERE score * 100 <= 60) AS "60", count(*) FILTER (WHERE score * 100 <= 80) AS "80",
  count(*) FILTER (WHERE score * 100 <= 100) AS "100", count(score) AS "+Inf" FROM predictions)
  ON COLUMNS(*) INTO NAME le VALUE count)""")
def q_score_buckets(spark, sf_dir):
    """Profitability-score histogram (0-100 units)."""
    p = V.predictions(spark, sf_dir).withColumn("score100", F.col("score") * 100)
    return RQ.score_buckets(p, "score100")


def _counters_sql(source: str = "request_log", labels: str = "method, endpoint, status") -> str:
    b = ", ".join(f"count(*) FILTER (WHERE latency_ms / 1000.0 <= {x}) AS le_{str(x).replace('.', '_')}"
                  for x in RQ.LATENCY_BUCKETS_S)
    return f"""
SELECT {labels}, count(*) AS requests, round(sum(latency_ms / 1000.0), 9) AS latency_sum_s, {b}
FROM {source} GROUP BY {labels}"""


@register("labelled_counters", cte("request_log") + _counters_sql())
def q_labelled_counters(spark, sf_dir):
    """W8."""
    return RQ.labelled_counters(V.request_log(spark, sf_dir))


# The given data names neither; versions follow the prediction's id, query types the endpoint.
_VERSIONED = "(SELECT *, concat('v', prediction_id % 3) AS model_version FROM predictions)"
_TYPED = "(SELECT *, split_part(endpoint, '/', 4) AS query_type FROM request_log)"


@register("labelled_model_counters", cte("predictions") + _counters_sql(_VERSIONED, "model_version"))
def q_labelled_model_counters(spark, sf_dir):
    """W8 by model version: predictions and their latency."""
    p = V.predictions(spark, sf_dir).withColumn("model_version", F.expr("concat('v', prediction_id % 3)"))
    return RQ.labelled_counters(p, ["model_version"])


@register("labelled_query_counters", cte("request_log") + _counters_sql(_TYPED, "query_type"))
def q_labelled_query_counters(spark, sf_dir):
    """W8 by query type: requests and their latency."""
    r = V.request_log(spark, sf_dir).withColumn("query_type", F.split_part("endpoint", F.lit("/"), F.lit(4)))
    return RQ.labelled_counters(r, ["query_type"])


@register("uptime_window", cte("request_log", "predictions", extra=[("lm", _LAT_SQL)]) + """
SELECT lm.total_requests AS total_predictions,
       (SELECT count(*) FROM request_log WHERE ts >= (SELECT max(ts) FROM request_log) - INTERVAL 1 HOUR)
         AS predictions_last_hour,
       lm.avg_latency_ms, lm.p95_latency_ms, lm.p99_latency_ms, lm.error_rate,
       (SELECT round(count(*) FILTER (WHERE decision = 'approve') / count(*), 9) FROM predictions) AS approval_rate,
       (SELECT round(count(*) FILTER (WHERE cache_hit) / count(*), 9) FROM request_log) AS cache_hit_rate
FROM lm""")
def q_uptime_window(spark, sf_dir):
    """W9."""
    return RQ.uptime_window(V.request_log(spark, sf_dir), V.predictions(spark, sf_dir))
