"""§2.11 streaming queries: each runs a Structured Streaming job to
completion (``availableNow``) over the files of the driver tables and
returns its sink.  Where the stream must equal its batch twin, the batch
twin's oracle SQL is registered."""

from __future__ import annotations

from ..streaming import jobs as J
from .q_quality import CLEAN_SQL
from .q_requests import LIMIT, WINDOW_S, _limiter_sql
from .q_scoring import DECISION_SQL
from .oracle_views import cte
from .registry import ORACLES, register


@register("stream_score", DECISION_SQL)
def q_stream_score(spark, sf_dir):
    """Equals the batch scored applicants."""
    return J.stream_score(spark, sf_dir)


@register("stream_validate", CLEAN_SQL)
def q_stream_validate(spark, sf_dir):
    """The main sink equals the batch clean set."""
    return J.stream_validate(spark, sf_dir)


TUMBLING_SQL = cte("predictions") + """
SELECT time_bucket(INTERVAL 1 HOUR, prediction_timestamp)::TIMESTAMP AS period_start,
       (time_bucket(INTERVAL 1 HOUR, prediction_timestamp) + INTERVAL 1 HOUR)::TIMESTAMP AS period_end,
       'hourly' AS period_type, count(*) AS total_predictions,
       count(*) FILTER (WHERE decision = 'approve') AS total_approvals,
       round(avg(score), 6) AS avg_profitability_score, round(avg(latency_ms), 6) AS avg_latency_ms
FROM predictions GROUP BY 1, 2"""

SLIDING_SQL = cte("request_log") + """
SELECT client, window_start::TIMESTAMP AS window_start, (window_start + INTERVAL 15 MINUTE)::TIMESTAMP AS window_end,
       count(*) AS n_requests
FROM (SELECT client, time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(k) AS window_start
      FROM request_log, (SELECT unnest(generate_series(0, 14)) AS k))
GROUP BY client, window_start"""


@register("stream_tumbling_metrics", TUMBLING_SQL)
def q_stream_tumbling_metrics(spark, sf_dir):
    """Hourly metrics of a stream with a 1 h watermark, open hours included."""
    return J.stream_tumbling_metrics(spark, sf_dir)


@register("stream_sliding_requests", SLIDING_SQL)
def q_stream_sliding_requests(spark, sf_dir):
    """T4: 15-minute windows sliding by 1 minute, per client, open ones included."""
    return J.stream_sliding_requests(spark, sf_dir)


@register("stream_rate_limit", _limiter_sql())
def q_stream_rate_limit(spark, sf_dir):
    """T5: equals the batch limiter W1 / W2."""
    return J.stream_rate_limit(spark, sf_dir, LIMIT, WINDOW_S)


@register("stream_dedup", cte("predictions") +
          "SELECT prediction_id, application_id, score, decision FROM predictions")
def q_stream_dedup(spark, sf_dir):
    """Every prediction exactly once although the source repeats all rows."""
    return J.stream_dedup(spark, sf_dir)


@register("stream_latest_status")
def q_stream_latest_status(spark, sf_dir):
    """The final state equals the batch upsert Q13."""
    return J.stream_latest_status(spark, sf_dir)


ORACLES.setdefault("stream_latest_status", ORACLES["apply_updates"])
