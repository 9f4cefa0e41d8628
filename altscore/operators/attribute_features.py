"""Social, behavioural and location features: 21 projections of applicant
attributes.  Narrow transformations only (no shuffle); missing attributes take
the extractor defaults (0 / False / 'Unknown' / radius = 2 x average distance).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from ..functions.expr import sql_rnd

KEY = "applicant_id"

SOCIAL_FEATURES = [
    "social_total_contacts", "social_network_strength", "social_family_size",
    "social_business_size", "social_government_connections",
    "social_communication_frequency", "social_network_diversity", "social_business_ratio"]
BEHAVIOR_FEATURES = [
    "behavioral_gambling_flag", "behavioral_location_changes", "behavioral_location_stability",
    "behavioral_night_transaction_ratio", "behavioral_financial_literacy", "behavioral_risk_score"]
LOCATION_FEATURES = [
    "location_unique_count", "location_stability_score", "location_avg_distance_from_home",
    "location_travel_radius", "location_area_type_urban", "location_mobility_score",
    "location_diversity_score"]
ATTRIBUTE_FEATURES = SOCIAL_FEATURES + BEHAVIOR_FEATURES + LOCATION_FEATURES

# Attribute defaults when the field is missing (NULL).
ATTRIBUTE_DEFAULTS = {
    "total_contacts": 0, "family_contacts": 0, "business_contacts": 0, "government_contacts": 0,
    "avg_communication_frequency": 0.0, "unique_locations_count": 0,
    "average_distance_from_home": 0.0, "area_type": "Unknown", "gambling_app_usage": False,
    "frequent_location_changes": 0, "night_transaction_ratio": 0.0,
    "financial_app_usage_score": 0.0,
}


def _attr(name: str) -> str:
    d = ATTRIBUTE_DEFAULTS[name]
    lit = (f"'{d}'" if isinstance(d, str) else ("false" if d is False else
           (f"{d!r}D" if isinstance(d, float) else str(d))))
    return f"coalesce({name}, {lit})"


def social_columns() -> dict:
    t = _attr("total_contacts")
    fam, bus, gov = _attr("family_contacts"), _attr("business_contacts"), _attr("government_contacts")
    other = f"greatest(0, {t} - {fam} - {bus} - {gov})"

    def term(part):
        p = f"({part} / {t})"
        return f"(CASE WHEN {part} > 0 THEN {p} * ln({p} + 1.0E-10D) ELSE 0.0D END)"

    entropy = f"(-(((({term(fam)} + {term(bus)}) + {term(gov)}) + {term(other)})))"
    return {
        "social_total_contacts": t,
        "social_network_strength": f"""CASE WHEN {t} >= 500 THEN 100.0D
            WHEN {t} >= 200 THEN 60.0D + ({t} - 200) / 300 * 40
            WHEN {t} >= 100 THEN 30.0D + ({t} - 100) / 100 * 30 ELSE {t} / 100 * 30 END""",
        "social_family_size": fam,
        "social_business_size": bus,
        "social_government_connections": gov,
        "social_communication_frequency": _attr("avg_communication_frequency"),
        "social_network_diversity": f"CASE WHEN {t} = 0 THEN 0.0D "
                                    f"ELSE {sql_rnd(f'{entropy} / {math.log(4)!r}D', 4)} END",
        "social_business_ratio": f"CASE WHEN {t} = 0 THEN 0.0D ELSE {sql_rnd(f'{bus} / {t}', 4)} END",
    }


def behavior_columns() -> dict:
    gamb, ch = _attr("gambling_app_usage"), _attr("frequent_location_changes")
    night, lit_ = _attr("night_transaction_ratio"), _attr("financial_app_usage_score")
    risk = (f"((((CASE WHEN {gamb} THEN 40 ELSE 0 END)"
            f" + (CASE WHEN {ch} > 10 THEN 30 WHEN {ch} > 5 THEN 15 ELSE 0 END))"
            f" + (CASE WHEN {night} > 0.3D THEN 30 WHEN {night} > 0.2D THEN 20 WHEN {night} > 0.1D THEN 10"
            f" ELSE 0 END))"
            f" + (CASE WHEN {lit_} < 3 THEN 20 WHEN {lit_} < 5 THEN 10 ELSE 0 END))")
    return {
        "behavioral_gambling_flag": f"CASE WHEN {gamb} THEN 1 ELSE 0 END",
        "behavioral_location_changes": ch,
        "behavioral_location_stability": f"CASE WHEN {ch} >= 20 THEN 0.0D WHEN {ch} >= 10 THEN 0.3D "
                                         f"WHEN {ch} >= 5 THEN 0.6D ELSE 1.0D END",
        "behavioral_night_transaction_ratio": night,
        "behavioral_financial_literacy": lit_,
        "behavioral_risk_score": f"least(100.0D, CAST({risk} AS DOUBLE))",
    }


def location_columns() -> dict:
    u, avg = _attr("unique_locations_count"), _attr("average_distance_from_home")
    radius = f"coalesce(max_distance_from_home, {avg} * 2)"
    return {
        "location_unique_count": u,
        "location_stability_score": f"CASE WHEN {u} <= 5 THEN 100.0D WHEN {u} <= 10 THEN 70.0D "
                                    f"WHEN {u} <= 20 THEN 40.0D WHEN {u} <= 50 THEN 20.0D ELSE 0.0D END",
        "location_avg_distance_from_home": sql_rnd(avg, 2),
        "location_travel_radius": sql_rnd(radius, 2),
        "location_area_type_urban": f"CASE WHEN {_attr('area_type')} = 'Urban' THEN 1 ELSE 0 END",
        "location_mobility_score": sql_rnd(f"least(100.0D, {u} / 50 * 50) + least(100.0D, {radius} / 500 * 50)", 2),
        "location_diversity_score": f"CASE WHEN {u} = 0 THEN 0.0D ELSE "
                                    f"{sql_rnd(f'least(100.0D, sqrt({u}) * ln({radius} + 1) * 5)', 2)} END",
    }


def _project(applicants: DataFrame, cols: dict) -> DataFrame:
    return applicants.selectExpr(KEY, *[f"CAST({v} AS DOUBLE) AS {k}" for k, v in cols.items()])


def social_features(applicants: DataFrame) -> DataFrame:
    return _project(applicants, social_columns())


def behavior_features(applicants: DataFrame) -> DataFrame:
    return _project(applicants, behavior_columns())


def location_features(applicants: DataFrame) -> DataFrame:
    return _project(applicants, location_columns())


def attribute_features(applicants: DataFrame, keep=()) -> DataFrame:
    cols = social_columns() | behavior_columns() | location_columns()
    return applicants.selectExpr(KEY, *keep, *[f"CAST({v} AS DOUBLE) AS {k}" for k, v in cols.items()])
