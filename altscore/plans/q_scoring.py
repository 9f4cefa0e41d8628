"""§2.5 rule scores, decisions, confidence and contributions; FP6/FP7/P6/P17."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import scoring as S
from ..sources import views as V
from . import oracle_features as O
from .features import FEATURE_GROUPS, FEATURE_NAMES, feature_groups, feature_matrix
from .oracle_views import cte
from .registry import register

# ---------------------------------------------------------------- R1-R4
_SUBSCORE_SQL = """
SELECT a.applicant_id,
  (CASE WHEN coalesce(n_cr, 0) > 10 THEN 1.0::DOUBLE ELSE coalesce(n_cr, 0) / 10.0::DOUBLE END) * 100 AS income_score,
  greatest(0.0::DOUBLE, 1.0::DOUBLE - CASE WHEN coalesce(sum_cr, 0) > 0
      THEN coalesce(sum_dr, 0)::DOUBLE / sum_cr::DOUBLE ELSE 1.0::DOUBLE END) * 100 AS expense_score,
  least(100.0::DOUBLE, total_contacts / 500 * 100) AS social_score,
  financial_app_usage_score * 10 AS discipline_score,
  greatest(0, 100 - (CASE WHEN coalesce(gambling_app_usage, false) THEN 40 ELSE 0 END)
                  - (CASE WHEN frequent_location_changes > 10 THEN 30 ELSE 0 END)
                  - (CASE WHEN night_transaction_ratio > 0.3 THEN 30 ELSE 0 END))::DOUBLE AS behavioral_score
FROM applicants a LEFT JOIN (
  SELECT applicant_id, count(*) FILTER (WHERE txn_type = 'credit') AS n_cr,
         sum(amount) FILTER (WHERE txn_type = 'credit') AS sum_cr,
         sum(amount) FILTER (WHERE txn_type = 'debit') AS sum_dr
  FROM ledger GROUP BY applicant_id) t ON a.applicant_id = t.applicant_id"""

_SCORE_SQL = """
SELECT *, round(income_score * 0.4::DOUBLE + expense_score * 0.25::DOUBLE + social_score * 0.15::DOUBLE
                + discipline_score * 0.1::DOUBLE + behavioral_score * 0.1::DOUBLE, 2) AS profitability_score
FROM sub"""

PROFIT_SQL = (cte("ledger", "applicants", extra=[("sub", _SUBSCORE_SQL), ("sc", _SCORE_SQL)]) + """
SELECT applicant_id, income_score, expense_score, social_score, discipline_score, behavioral_score,
       profitability_score, profitability_score >= 50 AS approved,
       CASE WHEN profitability_score >= 50 THEN profitability_score < 40 END AS default_status
FROM sc""")


@register("profitability_score", PROFIT_SQL)
def q_profitability(spark, sf_dir):
    return S.profitability_score(V.ledger(spark, sf_dir), V.applicants(spark, sf_dir))


# ---------------------------------------------------------------- scored batch
def _nonzero_sql() -> str:
    return " + ".join(f"(CASE WHEN coalesce({c}, 0) <> 0 THEN 1 ELSE 0 END)" for c in O.FEATURE_NAMES)


DECISION_SQL = O.fm_with(extra=[("sub", _SUBSCORE_SQL), ("sc", _SCORE_SQL)]) + f"""
SELECT fm.applicant_id,
       greatest(0.0::DOUBLE, least(1.0::DOUBLE, sc.profitability_score / 100.0::DOUBLE)) AS score,
       CASE WHEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, sc.profitability_score / 100.0::DOUBLE)) > 0.6::DOUBLE
            THEN 'approve' ELSE 'reject' END AS decision,
       greatest(0.3::DOUBLE, least(0.95::DOUBLE, ({_nonzero_sql()}) / 45.0::DOUBLE * 0.7::DOUBLE)) AS confidence
FROM fm JOIN sc ON fm.applicant_id = sc.applicant_id"""


def scored_applicants(spark, sf_dir):
    """Feature matrix -> rule score in 0-1 units -> decision + confidence."""
    return score_of(V.ledger(spark, sf_dir), V.applicants(spark, sf_dir))


def score_of(ledger, apps):
    """The scores of ``apps`` from their rows of ``ledger``."""
    # One ledger aggregation feeds both the features and the rule score.
    fm = feature_matrix(apps, ledger, keep=S.SCORE_INPUTS, keep_raw=S.TOTALS)
    fm = fm.withColumn("_c", S.confidence(FEATURE_NAMES))
    sc = S.weighted(S.subscores_from_totals(fm, keep=["_c"]))
    score = S.clip_score(F.col("profitability_score") / 100.0)
    return sc.select("applicant_id", score.alias("score"), S.decide(score).alias("decision"),
                     F.col("_c").alias("confidence"))


register("score_decisions", DECISION_SQL)(scored_applicants)


# ---------------------------------------------------------------- R5 / R6
def _target_sql(scaled: bool) -> str:
    d = "/ 100.0::DOUBLE" if scaled else ""
    return O.fm_with() + f"""
SELECT applicant_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    0.4::DOUBLE * coalesce(income_consistency_score, 0.0)
  + 0.25::DOUBLE * (1 - coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, expense_to_income_ratio)), 0.5::DOUBLE))
  + 0.15::DOUBLE * coalesce(social_network_strength {d}, 0.0)
  + 0.1::DOUBLE * coalesce(discipline_overall_score {d}, 0.0)
  + 0.1::DOUBLE * (1 - coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, behavioral_risk_score {d})), 0.0)))) AS profitability_score
FROM fm"""


@register("feature_target", _target_sql(False))
def q_feature_target(spark, sf_dir):
    fm = feature_matrix(V.applicants(spark, sf_dir), V.ledger(spark, sf_dir))
    return S.feature_target(fm).select("applicant_id", "profitability_score")


@register("feature_target_scaled", _target_sql(True))
def q_feature_target_scaled(spark, sf_dir):
    fm = feature_matrix(V.applicants(spark, sf_dir), V.ledger(spark, sf_dir))
    return S.feature_target(fm, scaled=True).select("applicant_id", "profitability_score")


# ---------------------------------------------------------------- R8
def _conf_pop_sql() -> str:
    stats = ", ".join(f"avg({c}) AS m_{i}, stddev_samp({c}) AS s_{i}" for i, c in enumerate(O.FEATURE_NAMES))
    outl = " OR ".join(f"coalesce(abs((fm.{c} - m_{i}) / (s_{i} + 1e-10)) > 3, false)"
                       for i, c in enumerate(O.FEATURE_NAMES))
    raw = f"({_nonzero_sql()}) / 45.0::DOUBLE * 0.7::DOUBLE"
    return O.fm_with(extra=[("st", f"SELECT {stats} FROM fm")]) + f"""
SELECT fm.applicant_id, greatest(0.3::DOUBLE, least(0.95::DOUBLE,
    CASE WHEN {outl} THEN {raw} * 0.8::DOUBLE ELSE {raw} END)) AS confidence
FROM fm, st"""


@register("confidence_population", _conf_pop_sql())
def q_confidence_population(spark, sf_dir):
    fm = feature_matrix(V.applicants(spark, sf_dir), V.ledger(spark, sf_dir))
    return S.confidence_population(fm, FEATURE_NAMES).select("applicant_id", "confidence")


# ---------------------------------------------------------------- FP6 / R9 / R10
def _groups_values_sql() -> str:
    rows = []
    for g, fs in FEATURE_GROUPS.items():
        w = K.GROUP_WEIGHTS[g]
        for f in fs:
            rows.append(f"('{f}', '{g}', {w!r}::DOUBLE, {w!r}::DOUBLE / {len(fs)})")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") t(feature, feature_group, group_weight, importance)"


_UNPIVOT = ("SELECT applicant_id, feature, value FROM (UNPIVOT fm ON " + ", ".join(O.FEATURE_NAMES) +
            " INTO NAME feature VALUE value)")

FEATURE_LONG_SQL = O.fm_with(extra=[("fg", _groups_values_sql()), ("lg", _UNPIVOT)]) + """
SELECT lg.applicant_id, fg.feature_group, lg.feature, lg.value FROM lg JOIN fg ON lg.feature = fg.feature"""


def _fm(spark, sf_dir):
    return feature_matrix(V.applicants(spark, sf_dir), V.ledger(spark, sf_dir))


def group_importance() -> dict[str, float]:
    """Importance of each feature: its group's weight, spread evenly."""
    return {f: K.GROUP_WEIGHTS[g] / len(fs) for g, fs in FEATURE_GROUPS.items() for f in fs}


@register("feature_long", FEATURE_LONG_SQL)
def q_feature_long(spark, sf_dir):
    fg = feature_groups(spark).select("feature", "feature_group")
    return S.feature_long(_fm(spark, sf_dir), FEATURE_NAMES).join(F.broadcast(fg), "feature").select(
        "applicant_id", "feature_group", "feature", "value")


CONTRIB_SQL = O.fm_with(extra=[("fg", _groups_values_sql()), ("lg", _UNPIVOT)]) + """
SELECT applicant_id, rank, feature, value, importance, contribution FROM (
  SELECT lg.applicant_id, lg.feature, lg.value, fg.importance, lg.value * fg.importance AS contribution,
         row_number() OVER (PARTITION BY lg.applicant_id
                            ORDER BY abs(lg.value * fg.importance) DESC, lg.feature) AS rank
  FROM lg JOIN fg ON lg.feature = fg.feature) WHERE rank <= 10"""


@register("linear_contributions", CONTRIB_SQL)
def q_linear_contributions(spark, sf_dir):
    return S.top_contributions(_fm(spark, sf_dir), group_importance(), FEATURE_NAMES, top_n=10).withColumn(
        "rank", F.col("rank").cast("bigint"))


_W = K.SCORE_WEIGHTS
WEIGHTED_SQL = cte("ledger", "applicants", extra=[("sub", _SUBSCORE_SQL)]) + f"""
SELECT applicant_id, round(sum(score * weight), 6) AS weighted_score FROM (
  UNPIVOT sub ON income_score, expense_score, social_score, discipline_score, behavioral_score
  INTO NAME category VALUE score) u
JOIN (VALUES ('income_score', {_W['income']}::DOUBLE), ('expense_score', {_W['expense']}::DOUBLE),
             ('social_score', {_W['social']}::DOUBLE), ('discipline_score', {_W['discipline']}::DOUBLE),
             ('behavioral_score', {_W['behavioral']}::DOUBLE)) w(category, weight) USING (category)
GROUP BY applicant_id"""


@register("weighted_category_score", WEIGHTED_SQL)
def q_weighted_category_score(spark, sf_dir):
    sub = S.subscores(V.ledger(spark, sf_dir), V.applicants(spark, sf_dir))
    return S.weighted_category_score(sub)


# ---------------------------------------------------------------- P6 / P7 / FP7
@register("align_features", O.fm_with() + "SELECT * FROM fm")
def q_align_features(spark, sf_dir):
    """Sparse (non-zero only) feature maps re-aligned to the dense model
    layout; absent features become 0.  Must equal the feature matrix."""
    sparse = S.sparse_features(_fm(spark, sf_dir), FEATURE_NAMES)
    return S.align_features(S.explode_sparse(sparse, FEATURE_NAMES), FEATURE_NAMES, keep=["applicant_id"])


MISSING_SQL = O.fm_with() + f"""
SELECT applicant_id, (45 - ({_nonzero_sql()}))::BIGINT AS n_missing FROM fm"""


@register("missing_features", MISSING_SQL)
def q_missing_features(spark, sf_dir):
    sparse = S.sparse_features(_fm(spark, sf_dir), FEATURE_NAMES)
    return S.missing_features(sparse, FEATURE_NAMES)


# ---------------------------------------------------------------- P17
IDS_SQL = cte("applications") + """
SELECT application_id, concat('APP_', upper(substr(md5(CAST(application_id AS VARCHAR)), 1, 12))) AS app_code,
       concat('user_', substr(md5(CAST(user_id AS VARCHAR)), 1, 8)) AS user_code
FROM applications"""


@register("make_ids", IDS_SQL)
def q_make_ids(spark, sf_dir):
    a = V.applications(spark, sf_dir)
    return a.select("application_id",
                    F.concat(F.lit("APP_"), F.upper(F.substring(F.md5(F.col("application_id").cast("string")), 1, 12)))
                    .alias("app_code"),
                    F.concat(F.lit("user_"), F.substring(F.md5(F.col("user_id").cast("string")), 1, 8))
                    .alias("user_code"))
