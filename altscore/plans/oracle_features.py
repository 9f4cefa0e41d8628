"""DuckDB oracle SQL for the 45 features (independent formulation)."""

from __future__ import annotations

from .oracle_views import cte

CR = "txn_type = 'credit'"
DR = "txn_type = 'debit'"
ESS5 = "('Electricity Bill','Medical','School Fees','Insurance','Loan EMI')"
ESS6 = "('Electricity Bill','Medical','School Fees','Insurance','Loan EMI','Grocery')"


def _months(t0: str, t1: str) -> str:
    return f"greatest(1.0::DOUBLE, date_sub('day', {t0}, {t1}) / 30.0::DOUBLE)"


LEDGER_AGG = f"""
SELECT l.applicant_id,
  count(*) AS n_all,
  count(*) FILTER (WHERE {CR}) AS n_cr,
  sum(amount) FILTER (WHERE {CR}) AS sum_cr,
  min(ts) FILTER (WHERE {CR}) AS cr_t0, max(ts) FILTER (WHERE {CR}) AS cr_t1,
  stddev_samp(amount::DOUBLE) FILTER (WHERE {CR}) AS cr_sd,
  count(DISTINCT source) FILTER (WHERE {CR}) AS cr_sources,
  regr_slope(amount::DOUBLE, date_sub('day', first_cr, ts)::DOUBLE) FILTER (WHERE {CR}) AS cr_slope,
  max(amount::DOUBLE) FILTER (WHERE {CR}) AS cr_max, min(amount::DOUBLE) FILTER (WHERE {CR}) AS cr_min,
  quantile_cont(amount::DOUBLE, 0.25) FILTER (WHERE {CR}) AS q1,
  quantile_cont(amount::DOUBLE, 0.75) FILTER (WHERE {CR}) AS q3,
  count(*) FILTER (WHERE {DR}) AS n_dr,
  sum(amount) FILTER (WHERE {DR}) AS sum_dr,
  min(ts) FILTER (WHERE {DR}) AS dr_t0, max(ts) FILTER (WHERE {DR}) AS dr_t1,
  stddev_samp(amount::DOUBLE) FILTER (WHERE {DR}) AS dr_sd,
  coalesce(sum(amount) FILTER (WHERE {DR} AND source IN {ESS5}), 0) AS sum_ess5,
  coalesce(sum(amount) FILTER (WHERE {DR} AND (source IS NULL OR source NOT IN {ESS6})), 0) AS sum_discr,
  count(*) FILTER (WHERE {DR} AND source IN ('Electricity Bill','Mobile Recharge')) AS n_bill2,
  min(ts) FILTER (WHERE {DR} AND source IN ('Electricity Bill','Mobile Recharge')) AS bill2_t0,
  max(ts) FILTER (WHERE {DR} AND source IN ('Electricity Bill','Mobile Recharge')) AS bill2_t1,
  count(*) FILTER (WHERE {DR} AND amount::DOUBLE > dmean + 2 * dsd) AS n_spike,
  count(*) FILTER (WHERE {DR} AND source = 'Loan EMI') AS n_emi,
  min(ts) FILTER (WHERE {DR} AND source = 'Loan EMI') AS emi_t0,
  max(ts) FILTER (WHERE {DR} AND source = 'Loan EMI') AS emi_t1,
  count(*) FILTER (WHERE {DR} AND source IN ('Electricity Bill','Mobile Recharge','Insurance')) AS n_bill3,
  min(ts) FILTER (WHERE {DR} AND source IN ('Electricity Bill','Mobile Recharge','Insurance')) AS bill3_t0,
  max(ts) FILTER (WHERE {DR} AND source IN ('Electricity Bill','Mobile Recharge','Insurance')) AS bill3_t1,
  count(*) FILTER (WHERE coalesce(regexp_matches(message, 'fail|bounce|reject', 'i'), false)) AS n_failed,
  count(*) FILTER (WHERE {DR} AND coalesce(regexp_matches(message, 'credit card|card payment', 'i'), false)) AS n_card_dr,
  count(*) FILTER (WHERE {CR} AND coalesce(regexp_matches(message, 'credit card|card payment', 'i'), false)) AS n_card_cr
FROM {{view}} l JOIN (
  SELECT applicant_id, min(ts) FILTER (WHERE {CR}) AS first_cr,
         avg(amount::DOUBLE) FILTER (WHERE {DR}) AS dmean,
         stddev_samp(amount::DOUBLE) FILTER (WHERE {DR}) AS dsd
  FROM {{view}} GROUP BY applicant_id) s ON l.applicant_id = s.applicant_id
GROUP BY l.applicant_id"""

# Raw-aggregate -> feature projections, each guarded by its group default.
_FEATS = {
    "income_monthly_avg": f"round(sum_cr::DOUBLE / {_months('cr_t0', 'cr_t1')}, 2)",
    "income_consistency_score": "CASE WHEN n_cr < 2 OR sum_cr = 0 THEN 0.0 "
                                "ELSE round(greatest(0.0, 1.0 - cr_sd / (sum_cr::DOUBLE / n_cr)), 4) END",
    "income_source_diversity": "cr_sources::DOUBLE",
    "income_transaction_frequency": f"round(n_cr / {_months('cr_t0', 'cr_t1')}, 2)",
    "income_growth_trend": "CASE WHEN n_cr < 2 OR cr_slope IS NULL OR isnan(cr_slope) THEN 0.0 "
                           "ELSE round(cr_slope, 4) END",
    "income_regularity": "CASE WHEN n_cr < 2 OR sum_cr = 0 THEN 0.0 "
                         "ELSE round(1.0 / (1.0 + cr_sd / (sum_cr::DOUBLE / n_cr)), 4) END",
    "income_max_transaction": "cr_max",
    "income_min_transaction": "cr_min",
    "income_quartile_ratio": "CASE WHEN n_cr < 4 OR q1 = 0 THEN 1.0 ELSE round(q3 / q1, 4) END",
}
_INCOME_DEFAULT = {k: "0.0" for k in _FEATS} | {"income_quartile_ratio": "1.0"}

_EXP = {
    "expense_monthly_avg": f"round(sum_dr::DOUBLE / {_months('dr_t0', 'dr_t1')}, 2)",
    "expense_to_income_ratio": "CASE WHEN n_cr = 0 THEN 0.0 WHEN sum_cr = 0 THEN 1.0 "
                               "ELSE round(sum_dr::DOUBLE / sum_cr::DOUBLE, 4) END",
    "essential_expense_ratio": "CASE WHEN sum_dr = 0 THEN 0.0 ELSE round(sum_ess5::DOUBLE / sum_dr::DOUBLE, 4) END",
    "expense_consistency": "CASE WHEN n_dr < 2 OR sum_dr = 0 THEN 0.0 "
                           "ELSE round(greatest(0.0, 1.0 - dr_sd / (sum_dr::DOUBLE / n_dr)), 4) END",
    "bill_payment_regularity": f"CASE WHEN n_bill2 = 0 THEN 0.0 ELSE round(least(1.0, "
                               f"(n_bill2 / {_months('bill2_t0', 'bill2_t1')}) / 2.5), 4) END",
    "savings_potential": "CASE WHEN n_cr = 0 THEN 0.0 ELSE round((sum_cr - sum_dr)::DOUBLE, 2) END",
    "expense_spike_count": "CASE WHEN n_dr < 2 THEN 0.0 ELSE n_spike::DOUBLE END",
    "discretionary_spending_ratio": "CASE WHEN sum_dr = 0 THEN 0.0 "
                                    "ELSE round(sum_discr::DOUBLE / sum_dr::DOUBLE, 4) END",
    "expense_volatility": "CASE WHEN n_dr < 2 THEN 0.0 ELSE round(dr_sd, 2) END",
}

_DIS_INNER = {
    "emi": f"""CASE WHEN n_emi = 0 THEN 0.5 ELSE (
        CASE WHEN n_emi / {_months('emi_t0', 'emi_t1')} BETWEEN 0.9 AND 1.1 THEN 1.0
             WHEN n_emi / {_months('emi_t0', 'emi_t1')} BETWEEN 0.7 AND 1.3 THEN 0.7
             WHEN n_emi / {_months('emi_t0', 'emi_t1')} > 1.3 THEN 0.5 ELSE 0.3 END) END""",
    "bills": f"""CASE WHEN n_bill3 = 0 THEN 0.0 ELSE (
        CASE WHEN n_bill3 / {_months('bill3_t0', 'bill3_t1')} >= 2.0 THEN 1.0
             WHEN n_bill3 / {_months('bill3_t0', 'bill3_t1')} >= 1.0 THEN 0.6 ELSE 0.3 END) END""",
    "failed": "round(n_failed / n_all, 4)",
    "savings": """CASE WHEN n_cr = 0 THEN 0.0 ELSE (
        CASE WHEN (CASE WHEN sum_cr > 0 THEN (sum_cr::DOUBLE - coalesce(sum_dr, 0)::DOUBLE) / sum_cr::DOUBLE ELSE 0.0 END) >= 0.3 THEN 1.0
             WHEN (CASE WHEN sum_cr > 0 THEN (sum_cr::DOUBLE - coalesce(sum_dr, 0)::DOUBLE) / sum_cr::DOUBLE ELSE 0.0 END) >= 0.2 THEN 0.8
             WHEN (CASE WHEN sum_cr > 0 THEN (sum_cr::DOUBLE - coalesce(sum_dr, 0)::DOUBLE) / sum_cr::DOUBLE ELSE 0.0 END) >= 0.1 THEN 0.6
             WHEN (CASE WHEN sum_cr > 0 THEN (sum_cr::DOUBLE - coalesce(sum_dr, 0)::DOUBLE) / sum_cr::DOUBLE ELSE 0.0 END) >= 0.0 THEN 0.4
             ELSE 0.0 END) END""",
    "usage": """CASE WHEN n_card_cr = 0 THEN 0.5
        WHEN n_card_dr / n_card_cr >= 1.0 THEN 1.0 WHEN n_card_dr / n_card_cr >= 0.7 THEN 0.7 ELSE 0.4 END""",
}

INCOME_COLS = list(_FEATS)
EXPENSE_COLS = list(_EXP)
DISCIPLINE_COLS = ["discipline_emi_regularity", "discipline_bill_timeliness",
                   "discipline_failed_transaction_ratio", "discipline_savings_behavior",
                   "discipline_credit_usage_score", "discipline_overall_score"]


def ledger_feature_select() -> list[str]:
    """Select list turning the LEDGER_AGG columns (+ d.* discipline parts) into features."""
    out = []
    for k, v in _FEATS.items():
        out.append(f"CASE WHEN n_cr = 0 THEN {_INCOME_DEFAULT[k]} ELSE {v} END::DOUBLE AS {k}")
    for k, v in _EXP.items():
        out.append(f"CASE WHEN n_dr = 0 THEN 0.0 ELSE {v} END::DOUBLE AS {k}")
    out += ["emi::DOUBLE AS discipline_emi_regularity", "bills::DOUBLE AS discipline_bill_timeliness",
            "failed::DOUBLE AS discipline_failed_transaction_ratio",
            "savings::DOUBLE AS discipline_savings_behavior", "usage::DOUBLE AS discipline_credit_usage_score",
            "round(greatest(0.0, emi * 30 + bills * 25 + savings * 30 - failed * 15), 2)::DOUBLE "
            "AS discipline_overall_score"]
    return out


def ledger_features_body(view: str = "ledger") -> str:
    """Body (no WITH) computing applicant_id + 24 features from ``view``."""
    inner = ",\n  ".join(f"{v} AS {k}" for k, v in _DIS_INNER.items())
    return (f"SELECT applicant_id,\n  " + ",\n  ".join(ledger_feature_select()) +
            f"\nFROM (SELECT a.*,\n  {inner}\nFROM ({LEDGER_AGG.format(view=view)}) a)")


def ledger_features_sql(view: str, columns: list[str]) -> str:
    return (cte(view, extra=[("lf", ledger_features_body(view))]) +
            "SELECT applicant_id, " + ", ".join(columns) + " FROM lf")


# --- attribute features (social, behaviour, location) -----------------------
SOCIAL = {
    "social_total_contacts": "total_contacts::DOUBLE",
    "social_network_strength": """CASE WHEN total_contacts >= 500 THEN 100.0
        WHEN total_contacts >= 200 THEN 60.0 + (total_contacts - 200) / 300 * 40
        WHEN total_contacts >= 100 THEN 30.0 + (total_contacts - 100) / 100 * 30
        ELSE total_contacts / 100 * 30 END::DOUBLE""",
    "social_family_size": "family_contacts::DOUBLE",
    "social_business_size": "business_contacts::DOUBLE",
    "social_government_connections": "government_contacts::DOUBLE",
    "social_communication_frequency": "avg_communication_frequency::DOUBLE",
    "social_network_diversity": """CASE WHEN total_contacts = 0 THEN 0.0 ELSE round(-(
        (CASE WHEN family_contacts > 0 THEN family_contacts / total_contacts * ln(family_contacts / total_contacts + 1e-10) ELSE 0.0 END)
      + (CASE WHEN business_contacts > 0 THEN business_contacts / total_contacts * ln(business_contacts / total_contacts + 1e-10) ELSE 0.0 END)
      + (CASE WHEN government_contacts > 0 THEN government_contacts / total_contacts * ln(government_contacts / total_contacts + 1e-10) ELSE 0.0 END)
      + (CASE WHEN greatest(0, total_contacts - family_contacts - business_contacts - government_contacts) > 0
              THEN greatest(0, total_contacts - family_contacts - business_contacts - government_contacts) / total_contacts
                   * ln(greatest(0, total_contacts - family_contacts - business_contacts - government_contacts) / total_contacts + 1e-10)
              ELSE 0.0 END)) / ln(4), 4) END::DOUBLE""",
    "social_business_ratio": "CASE WHEN total_contacts = 0 THEN 0.0 "
                             "ELSE round(business_contacts / total_contacts, 4) END::DOUBLE",
}
BEHAVIOR = {
    "behavioral_gambling_flag": "CASE WHEN coalesce(gambling_app_usage, false) THEN 1.0 ELSE 0.0 END",
    "behavioral_location_changes": "frequent_location_changes::DOUBLE",
    "behavioral_location_stability": """CASE WHEN frequent_location_changes >= 20 THEN 0.0
        WHEN frequent_location_changes >= 10 THEN 0.3 WHEN frequent_location_changes >= 5 THEN 0.6 ELSE 1.0 END""",
    "behavioral_night_transaction_ratio": "night_transaction_ratio::DOUBLE",
    "behavioral_financial_literacy": "financial_app_usage_score::DOUBLE",
    "behavioral_risk_score": """least(100.0,
        (CASE WHEN coalesce(gambling_app_usage, false) THEN 40 ELSE 0 END)
      + (CASE WHEN frequent_location_changes > 10 THEN 30 WHEN frequent_location_changes > 5 THEN 15 ELSE 0 END)
      + (CASE WHEN night_transaction_ratio > 0.3 THEN 30 WHEN night_transaction_ratio > 0.2 THEN 20
              WHEN night_transaction_ratio > 0.1 THEN 10 ELSE 0 END)
      + (CASE WHEN financial_app_usage_score < 3 THEN 20 WHEN financial_app_usage_score < 5 THEN 10 ELSE 0 END))::DOUBLE""",
}
_RADIUS = "coalesce(max_distance_from_home, average_distance_from_home * 2)"
LOCATION = {
    "location_unique_count": "unique_locations_count::DOUBLE",
    "location_stability_score": """CASE WHEN unique_locations_count <= 5 THEN 100.0
        WHEN unique_locations_count <= 10 THEN 70.0 WHEN unique_locations_count <= 20 THEN 40.0
        WHEN unique_locations_count <= 50 THEN 20.0 ELSE 0.0 END""",
    "location_avg_distance_from_home": "round(average_distance_from_home, 2)::DOUBLE",
    "location_travel_radius": f"round({_RADIUS}, 2)::DOUBLE",
    "location_area_type_urban": "CASE WHEN area_type = 'Urban' THEN 1.0 ELSE 0.0 END",
    "location_mobility_score": f"round(least(100, unique_locations_count / 50 * 50) "
                               f"+ least(100, {_RADIUS} / 500 * 50), 2)::DOUBLE",
    "location_diversity_score": f"CASE WHEN unique_locations_count = 0 THEN 0.0 ELSE "
                                f"round(least(100, sqrt(unique_locations_count) * ln({_RADIUS} + 1) * 5), 2) END::DOUBLE",
}


def attribute_sql(features: dict) -> str:
    return (cte("applicants") + "SELECT applicant_id, " +
            ", ".join(f"{v} AS {k}" for k, v in features.items()) + " FROM applicants")


def feature_matrix_body() -> str:
    ledger_cols = INCOME_COLS + EXPENSE_COLS + DISCIPLINE_COLS
    defaults = {c: "0.0" for c in ledger_cols} | {"income_quartile_ratio": "1.0"}
    attr = {**SOCIAL, **BEHAVIOR, **LOCATION}
    sel = ["a.applicant_id"]
    sel += [f"coalesce(lf.{c}, {defaults[c]})::DOUBLE AS {c}" for c in ledger_cols]
    sel += [f"{v} AS {k}" for k, v in attr.items()]
    return ("SELECT " + ",\n ".join(sel) +
            "\nFROM applicants a LEFT JOIN lf ON a.applicant_id = lf.applicant_id")


FEATURE_NAMES = INCOME_COLS + EXPENSE_COLS + DISCIPLINE_COLS + list(SOCIAL) + list(BEHAVIOR) + list(LOCATION)


def fm_with(extra: list[tuple[str, str]] | None = None, ledger_view: str = "ledger",
            views: tuple = ()) -> str:
    """WITH prefix defining ``fm`` (applicant_id + 45 features), the named
    ``views`` and the ``extra`` CTEs."""
    ctes = [("lf", ledger_features_body(ledger_view)), ("fm", feature_matrix_body())]
    return cte(ledger_view, "applicants", *views, extra=ctes + list(extra or []))
