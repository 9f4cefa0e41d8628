"""§2.4 feature queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import attribute_features as A
from ..operators import ledger_features as L
from ..operators.feature_store import FeatureStore
from ..session import scratch_path, stored
from ..sources import views as V
from . import oracle_features as O
from .features import FEATURE_NAMES, feature_matrix, with_attributes
from .oracle_views import VIEWS, cte
from .registry import register


@register("feat_income", O.ledger_features_sql("ledger", O.INCOME_COLS))
def feat_income(spark, sf_dir):
    return L.income_features(V.ledger(spark, sf_dir))


@register("feat_expense", O.ledger_features_sql("ledger", O.EXPENSE_COLS))
def feat_expense(spark, sf_dir):
    return L.expense_features(V.ledger(spark, sf_dir))


@register("feat_discipline", O.ledger_features_sql("ledger", O.DISCIPLINE_COLS))
def feat_discipline(spark, sf_dir):
    return L.discipline_features(V.ledger(spark, sf_dir))


@register("feat_ledger_events",
          O.ledger_features_sql("ledger_events", O.INCOME_COLS + O.EXPENSE_COLS + O.DISCIPLINE_COLS))
def feat_ledger_events(spark, sf_dir):
    """All 24 transaction features on the 30-day event ledger (covers the
    EMI / bill frequency bands that the order ledger does not reach)."""
    return L.ledger_features(V.ledger_events(spark, sf_dir))


@register("feat_social", O.attribute_sql(O.SOCIAL))
def feat_social(spark, sf_dir):
    return A.social_features(V.applicants(spark, sf_dir))


@register("feat_behavior", O.attribute_sql(O.BEHAVIOR))
def feat_behavior(spark, sf_dir):
    return A.behavior_features(V.applicants(spark, sf_dir))


@register("feat_location", O.attribute_sql(O.LOCATION))
def feat_location(spark, sf_dir):
    return A.location_features(V.applicants(spark, sf_dir))


FEATURE_MATRIX_SQL = O.fm_with() + "SELECT * FROM fm"


@register("feature_matrix", FEATURE_MATRIX_SQL)
def q_feature_matrix(spark, sf_dir):
    fm = feature_matrix(V.applicants(spark, sf_dir), V.ledger(spark, sf_dir))
    return fm.select("applicant_id", *FEATURE_NAMES)


@register("features_incremental", FEATURE_MATRIX_SQL)
def q_features_incremental(spark, sf_dir):
    """FP1 kept up to date: the older half of the ledger first, then three increments of
    newer rows; a few older ones arrive with each."""
    ledger = stored(V.ledger(spark, sf_dir), "ledger")
    low, high = ledger.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    store = FeatureStore(spark, scratch_path(spark, f"feature-store-{uuid.uuid4().hex}"))
    if low is not None:
        sixth = F.floor((F.unix_micros("ts") - low) * 6 / (high - low + 1))
        late = F.pmod(F.xxhash64(*ledger.columns), F.lit(50)) < 2
        part = F.greatest(sixth - 2, F.when(late, F.pmod(F.xxhash64("ts", "applicant_id"), F.lit(4))).otherwise(F.lit(0)), F.lit(0))
        ledger = stored(ledger.withColumn("_part", F.coalesce(part, F.lit(0)).cast("int")), "ledger-parts")
        for k in range(4):
            store.add(ledger.where(F.col("_part") == k).drop("_part"), k, ledger.where(F.col("_part") < k))
    fm = with_attributes(V.applicants(spark, sf_dir), store.read())
    return fm.select("applicant_id", *FEATURE_NAMES)


@register("features_nested", O.ledger_features_sql("ledger", O.INCOME_COLS + O.EXPENSE_COLS + O.DISCIPLINE_COLS))
def q_features_nested(spark, sf_dir):
    """FP5: the 24 transaction features from nested per-application lists
    (higher-order functions, no shuffle after nesting); must equal FP1."""
    from ..operators.nested import features_nested_or_flat
    return features_nested_or_flat(V.ledger(spark, sf_dir))


def _canonical_sql(src: str, select: str) -> str:
    attr = {**O.SOCIAL, **O.BEHAVIOR, **O.LOCATION}
    return (f"WITH applicants AS (SELECT {select} FROM ({src}))\n"
            "SELECT applicant_id, " + ", ".join(f"{v} AS {k}" for k, v in attr.items()) + " FROM applicants")


_LOC_DEFAULTS = ("0 AS unique_locations_count, 0.0::DOUBLE AS average_distance_from_home, "
                 "NULL::DOUBLE AS max_distance_from_home")


_PIPELINE_SQL = _canonical_sql(
    cte("loan_applications") + "SELECT * FROM loan_applications",
    "application_id AS applicant_id, total_contacts, family_contacts, business_contacts, government_contacts, "
    f"avg_communication_frequency, {_LOC_DEFAULTS}, 'Unknown' AS area_type, gambling_app_usage, "
    "frequent_location_changes, night_transaction_ratio, financial_app_usage_score")


@register("adapt_batch_schema", _PIPELINE_SQL)
def q_adapt_batch_schema(spark, sf_dir):
    """Pipeline-dialect applications -> canonical -> 21 attribute features."""
    from ..sources.schemas import adapt_pipeline
    return A.attribute_features(adapt_pipeline(V.loan_applications(spark, sf_dir)))


_API_SQL = _canonical_sql(
    VIEWS["applicants"],
    "applicant_id, total_contacts, family_contacts, business_contacts, government_contacts, "
    f"0.0::DOUBLE AS avg_communication_frequency, {_LOC_DEFAULTS}, lower(area_type) AS area_type, "
    "false AS gambling_app_usage, 0 AS frequent_location_changes, 0.0::DOUBLE AS night_transaction_ratio, "
    "0.0::DOUBLE AS financial_app_usage_score")


@register("adapt_api_schema", _API_SQL)
def q_adapt_api_schema(spark, sf_dir):
    """API-dialect requests -> canonical -> 21 attribute features (fields
    the features do not know take their defaults, as in the reference)."""
    from ..sources.schemas import adapt_api
    return A.attribute_features(adapt_api(V.api_applications(spark, sf_dir), key="applicant_id"))
