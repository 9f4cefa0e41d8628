"""Validation rules as SQL predicates (Spark SQL and ANSI SQL alike).

A rule passes when its predicate is TRUE; NULL counts as a failure (a
required field is missing).  FIXED VALUES: the limits below are the schema
limits of the applications being validated.
"""

from __future__ import annotations

# V1 — one transaction (ledger row).
TRANSACTION_RULES = {
    "txn_type_enum": "txn_type IN ('credit', 'debit')",
    "amount_positive": "amount > 0",
    "message_length": "length(message) <= 500",
    "required_fields": "ts IS NOT NULL AND source IS NOT NULL AND message IS NOT NULL",
}

# V2 — contact metadata.
CONTACT_RULES = {
    "contacts_total_range": "total_contacts BETWEEN 0 AND 1000",
    "contacts_parts_nonnegative": "family_contacts >= 0 AND business_contacts >= 0 AND government_contacts >= 0",
    "communication_range": "avg_communication_frequency BETWEEN 0 AND 100",
}

# V3 — location pattern.
LOCATION_RULES = {
    "latitude_range": "latitude BETWEEN -90 AND 90",
    "longitude_range": "longitude BETWEEN -180 AND 180",
    "location_type_enum": "location_type IN ('rural', 'semi_urban', 'urban')",
    "stability_range": "stability_score BETWEEN 0 AND 1",
    "distance_nonnegative": "distance_from_financial_center >= 0",
    "travel_range": "travel_frequency BETWEEN 0 AND 30",
}

# V4 — behavioural data (gambling flag defaults to false).
BEHAVIOR_RULES = {
    "location_changes_range": "frequent_location_changes BETWEEN 0 AND 100",
    "night_ratio_range": "night_transaction_ratio BETWEEN 0 AND 1",
    "app_score_range": "financial_app_usage_score BETWEEN 0 AND 10",
}

# V5 — the application itself; V6 — loan versus income (skipped when the
# income is itself invalid).
APPLICATION_RULES = {
    "age_range": "age BETWEEN 18 AND 80",
    "gender_enum": "gender IN ('male', 'female', 'other')",
    "occupation_enum": "occupation IN ('farmer', 'shopkeeper', 'daily_wage', 'self_employed', 'salaried')",
    "income_positive": "monthly_income > 0",
    "loan_positive": "loan_amount_requested > 0",
    "purpose_length": "length(loan_purpose) <= 200",
    "transaction_count": "n_transactions BETWEEN 10 AND 200",
    "transactions_valid": "n_bad_transactions = 0",
    "score_range": "profitability_score IS NULL OR profitability_score BETWEEN 0 AND 100",
    "loan_vs_income": "NOT (monthly_income > 0) OR loan_amount_requested <= monthly_income * 24",
}

ALL_APPLICATION_RULES = {**APPLICATION_RULES, **CONTACT_RULES, **LOCATION_RULES, **BEHAVIOR_RULES}

# V7 — API request limits.
API_RULES = {
    "api_loan_range": "loan_amount BETWEEN 1000 AND 500000",
    "api_user_id_length": "length(user_id) BETWEEN 1 AND 100",
    "api_purpose_present": "length(loan_purpose) >= 1",
    "api_transaction_limit": "n_transactions <= 10000",
    "api_contact_diversity_range": "contact_diversity_score BETWEEN 0 AND 1",
    "api_app_hours_range": "app_usage_hours_per_day BETWEEN 0 AND 24",
    "api_literacy_range": "literacy_score BETWEEN 0 AND 1",
}

# V19 — enumerated columns.
STATUS_VALUES = ("submitted", "processing", "approved", "rejected", "disbursed")
DECISION_VALUES = ("approve", "reject", "manual_review")
PERIOD_VALUES = ("hourly", "daily", "weekly")
