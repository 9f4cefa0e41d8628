"""Feature-matrix plan: the 45 features for every applicant (FP1/FP2).

``applicants LEFT JOIN ledger_features`` on ``applicant_id``; applicants
without ledger rows get the per-group defaults.  The ledger side is the big
one and is aggregated to one row per applicant before the join, so the join
moves one small row per applicant, not the ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.attribute_features import ATTRIBUTE_FEATURES, attribute_features
from ..operators.ledger_features import LEDGER_DEFAULTS, LEDGER_FEATURES, ledger_features

KEY = "applicant_id"
# Order of the feature vector: income, expense, discipline, social,
# behavioural, location.
FEATURE_NAMES = LEDGER_FEATURES + ATTRIBUTE_FEATURES
ID_COLUMNS = ["applicant_id", "user_id"]


def feature_matrix(applicants: DataFrame, ledger: DataFrame, keep=(), keep_raw=()) -> DataFrame:
    """One row per applicant: ``applicant_id``, ``keep`` applicant columns,
    ``keep_raw`` ledger aggregates (e.g. ``n_cr``, ``sum_cr``, ``sum_dr``; NULL
    without ledger rows) and the 45 features."""
    return with_attributes(applicants, ledger_features(ledger, keep_raw), keep, keep_raw)


def with_attributes(applicants: DataFrame, lf: DataFrame, keep=(), keep_raw=()) -> DataFrame:
    """The matrix from ledger features that are there already."""
    attrs = attribute_features(applicants, keep=keep)
    joined = attrs.join(lf, KEY, "left")
    return joined.select(
        F.col(KEY), *[F.col(k) for k in keep], *[F.col(r) for r in keep_raw],
        *[F.coalesce(F.col(f), F.lit(LEDGER_DEFAULTS[f])).alias(f) for f in LEDGER_FEATURES],
        *[F.col(f) for f in ATTRIBUTE_FEATURES])


# FP4: feature groups with their category weights (location weighs 0).
FEATURE_GROUPS = {
    "income": LEDGER_FEATURES[:9],
    "expense": LEDGER_FEATURES[9:18],
    "discipline": LEDGER_FEATURES[18:],
    "social": ATTRIBUTE_FEATURES[:8],
    "behavioral": ATTRIBUTE_FEATURES[8:14],
    "location": ATTRIBUTE_FEATURES[14:],
}


def feature_groups(spark):
    """FP4 as a 45-row DataFrame ``(feature, feature_group, group_weight, importance)``.

    ``importance`` spreads the group weight evenly over its features; it is
    the importance table used by the linear contributions (R9) when no model
    is given.  The table is bounded by the feature count, so joins broadcast it.
    """
    from ..functions.constants import GROUP_WEIGHTS
    rows = [(f, g, GROUP_WEIGHTS[g], GROUP_WEIGHTS[g] / len(fs))
            for g, fs in FEATURE_GROUPS.items() for f in fs]
    return spark.createDataFrame(rows, "feature string, feature_group string, group_weight double, "
                                       "importance double")
