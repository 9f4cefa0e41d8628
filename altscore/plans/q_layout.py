"""P12, Q4, Q7, Q15-Q17 and V16 on tables stored by their keys.

The tables are laid out once a session and folder; every query here reads them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import to_ntz
from ..operators import portfolio as PF
from ..sources import layout as L
from ..sources import views as V
from .oracle_views import cte
from .q_portfolio import APP_ID
from .registry import ORACLES, register

SOURCES = {
    "users": (V.users, "user_id", ()),
    "user_applications": (V.applications, "user_id", ("application_id",)),
    "applications": (V.applications, "application_id", ()),
    "predictions": (V.predictions, "application_id", ("prediction_id",)),
    "audit_logs": (V.audit_logs, "application_id", ("audit_id",)),
}
_written: dict[tuple, L.KeyedTable] = {}


def keyed(spark, sf_dir: str, name: str) -> L.KeyedTable:
    at = (spark.sparkContext.applicationId, sf_dir, name, spark.conf.get("spark.sql.shuffle.partitions"))
    if at not in _written:
        source, key, ids = SOURCES[name]
        _written[at] = L.write_keyed(source(spark, sf_dir), key, f"keyed_{name}", ids=ids)
    return _written[at]


@register("lookup_keyed_predictions", ORACLES["predictions_by_application"])
def q_lookup_predictions(spark, sf_dir):
    return keyed(spark, sf_dir, "predictions").lookup(APP_ID).select(
        "prediction_id", "score", "decision", to_ntz("prediction_timestamp").alias("prediction_timestamp"))


@register("lookup_keyed_audit", ORACLES["audit_by_application"])
def q_lookup_audit(spark, sf_dir):
    a = keyed(spark, sf_dir, "audit_logs").lookup(APP_ID)
    return PF.top_recent(a, "created_at", "audit_id", 50).select(
        "audit_id", "event_type", to_ntz("created_at").alias("created_at"))


@register("join_keyed_applications", ORACLES["join_user_applications"])
def q_join_applications(spark, sf_dir):
    return L.join_keyed(keyed(spark, sf_dir, "users").only([]), keyed(spark, sf_dir, "user_applications").only(["application_id"]))


@register("join_keyed_predictions", ORACLES["join_application_predictions"])
def q_join_predictions(spark, sf_dir):
    return L.join_keyed(keyed(spark, sf_dir, "applications").only([]), keyed(spark, sf_dir, "predictions").only(["prediction_id"]))


@register("join_keyed_audit", ORACLES["join_application_audit"])
def q_join_audit(spark, sf_dir):
    return L.join_keyed(keyed(spark, sf_dir, "applications").only([]), keyed(spark, sf_dir, "audit_logs").only(["audit_id"]))


@register("orphans_keyed", cte("applications", "predictions", "audit_logs") + """
SELECT 'predictions' AS table_name, count(*) AS n_orphans FROM predictions p
WHERE NOT EXISTS (SELECT 1 FROM applications a WHERE a.application_id = p.application_id)
UNION ALL
SELECT 'audit_logs', count(*) FROM audit_logs l
WHERE NOT EXISTS (SELECT 1 FROM applications a WHERE a.application_id = l.application_id)""")
def q_orphans(spark, sf_dir):
    """Children without a parent, bucket against bucket."""
    parents = keyed(spark, sf_dir, "applications").only([])
    out = [L.join_keyed(keyed(spark, sf_dir, t).only([]), parents, "left_anti").agg(F.count(F.lit(1)).alias("n_orphans"))
           .select(F.lit(t).alias("table_name"), "n_orphans") for t in ("predictions", "audit_logs")]
    return out[0].unionByName(out[1])
