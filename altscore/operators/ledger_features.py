"""Income, expense and discipline features: 24 aggregates over the ledger.

Plan (two aggregation rounds, both with map-side partial aggregation):

1. ``applicant_stats`` — per applicant: first credit time, debit mean and
   sample sd.  These are the only inputs that a feature needs *before* it can
   look at a row (the income trend regresses on days since the first credit,
   the spike count compares every debit with mean + 2 sd).
2. The ledger is joined with those statistics on ``applicant_id`` (sort-merge
   join; AQE splits a skewed applicant's partition) and one ``groupBy`` with
   conditional aggregates yields the raw inputs of the 24 features; quartiles
   and distinct sources come from the credits alone.
3. A projection turns the raw aggregates into the features with the band
   rules and per-group zero defaults.

No Python runs on the executors; every step stays inside whole-stage codegen
except the object aggregates for the exact quartiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import sql_d, sql_in, sql_months, sql_rnd

KEY = "applicant_id"

INCOME_FEATURES = [
    "income_monthly_avg", "income_consistency_score", "income_source_diversity",
    "income_transaction_frequency", "income_growth_trend", "income_regularity",
    "income_max_transaction", "income_min_transaction", "income_quartile_ratio"]
EXPENSE_FEATURES = [
    "expense_monthly_avg", "expense_to_income_ratio", "essential_expense_ratio",
    "expense_consistency", "bill_payment_regularity", "savings_potential",
    "expense_spike_count", "discretionary_spending_ratio", "expense_volatility"]
DISCIPLINE_FEATURES = [
    "discipline_emi_regularity", "discipline_bill_timeliness",
    "discipline_failed_transaction_ratio", "discipline_savings_behavior",
    "discipline_credit_usage_score", "discipline_overall_score"]
LEDGER_FEATURES = INCOME_FEATURES + EXPENSE_FEATURES + DISCIPLINE_FEATURES

# Value of each feature when its group has no input rows.
INCOME_DEFAULTS = {f: 0.0 for f in INCOME_FEATURES} | {"income_quartile_ratio": 1.0}
EXPENSE_DEFAULTS = {f: 0.0 for f in EXPENSE_FEATURES}
DISCIPLINE_DEFAULTS = {f: 0.0 for f in DISCIPLINE_FEATURES}
LEDGER_DEFAULTS = INCOME_DEFAULTS | EXPENSE_DEFAULTS | DISCIPLINE_DEFAULTS



# Above this many credits an applicant's quartiles leave ``percentile`` (whose
# buffer holds one applicant's distinct amounts in one task) for the keyed
# distributed quantile, which spreads a hot applicant over many tasks.
HEAVY_KEY_ROWS = 1_000_000


CR = "txn_type = 'credit'"
DR = "txn_type = 'debit'"
AMT = "CAST(amount AS DOUBLE)"
MESSAGE_FLAGS = [f"coalesce(message RLIKE '(?i){pattern}', false) AS {flag}"
                 for flag, pattern in (("_failed", K.FAILED_PATTERN), ("_card", K.CARD_PATTERN))]


def applicant_stats(ledger: DataFrame) -> DataFrame:
    """Per-applicant statistics needed before the row-level pass."""
    return ledger.groupBy(KEY).agg(*[F.expr(e) for e in (
        f"min(CASE WHEN {CR} THEN ts END) AS _cr_first_ts",
        f"avg(CASE WHEN {DR} THEN {AMT} END) AS _dr_mean",
        f"stddev_samp(CASE WHEN {DR} THEN {AMT} END) AS _dr_sd")])


def _raw_aggregate_exprs() -> list[str]:
    ess5, ess6 = sql_in("source", K.ESSENTIAL5), sql_in("source", K.ESSENTIAL6)
    bill2 = f"{DR} AND {sql_in('source', K.BILLS2)}"
    bill3 = f"{DR} AND {sql_in('source', K.BILLS3)}"
    emi = f"{DR} AND coalesce(source = '{K.EMI_SOURCE}', false)"
    day = "CAST(timestampdiff(DAY, _cr_first_ts, ts) AS DOUBLE)"

    def when(cond, val):
        return f"CASE WHEN {cond} THEN {val} END"
    return [
        "count(1) AS n_all",
        # income inputs
        f"count_if({CR}) AS n_cr",
        f"sum({when(CR, 'amount')}) AS sum_cr",
        f"min({when(CR, 'ts')}) AS cr_t0", f"max({when(CR, 'ts')}) AS cr_t1",
        f"stddev_samp({when(CR, AMT)}) AS cr_sd",
        f"regr_slope({when(CR, AMT)}, {when(CR, day)}) AS cr_slope",
        f"max({when(CR, AMT)}) AS cr_max", f"min({when(CR, AMT)}) AS cr_min",
        # expense inputs
        f"count_if({DR}) AS n_dr",
        f"sum({when(DR, 'amount')}) AS sum_dr",
        f"min({when(DR, 'ts')}) AS dr_t0", f"max({when(DR, 'ts')}) AS dr_t1",
        f"stddev_samp({when(DR, AMT)}) AS dr_sd",
        f"sum({when(f'{DR} AND {ess5}', 'amount')}) AS sum_ess5",
        f"sum({when(f'{DR} AND NOT {ess6}', 'amount')}) AS sum_discr",
        f"count_if({bill2}) AS n_bill2",
        f"min({when(bill2, 'ts')}) AS bill2_t0", f"max({when(bill2, 'ts')}) AS bill2_t1",
        f"count_if({DR} AND {AMT} > _dr_mean + 2.0D * _dr_sd) AS n_spike",
        # discipline inputs
        f"count_if({emi}) AS n_emi",
        f"min({when(emi, 'ts')}) AS emi_t0", f"max({when(emi, 'ts')}) AS emi_t1",
        f"count_if({bill3}) AS n_bill3",
        f"min({when(bill3, 'ts')}) AS bill3_t0", f"max({when(bill3, 'ts')}) AS bill3_t1",
        "count_if(_failed) AS n_failed",
        f"count_if(_card AND {DR}) AS n_card_dr",
        f"count_if(_card AND {CR}) AS n_card_cr",
    ]


def raw_aggregates(ledger: DataFrame, heavy_rows: int = HEAVY_KEY_ROWS) -> DataFrame:
    """One row per applicant with every raw input of the 24 features."""
    # the message is matched once a row, and two flags are shuffled in its place
    rows = ledger.selectExpr(KEY, "ts", "txn_type", "amount", "source", *MESSAGE_FLAGS).join(applicant_stats(ledger), KEY)
    agg = rows.groupBy(KEY).agg(*[F.expr(e) for e in _raw_aggregate_exprs()])
    # Quartiles and distinct sources have objects for buffers.  On their own, over
    # the credits alone, they leave all other aggregates to generated code.
    # Heavy applicants (normally none): exact quartiles distributed per key,
    # and distinct sources as a two-level count (pairs spread by source).
    # Their keys number at most rows / heavy_rows, a proven bound, so they are
    # broadcast into a semi join with the credits; with no heavy applicant the
    # branch is empty and never re-reads the shuffled ledger.
    from .ordered import keyed_exact_quantiles
    credits = ledger.filter(F.expr(CR)).select(KEY, "amount", "source")
    heavy_keys = F.broadcast(credits.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > heavy_rows).select(KEY))
    # a set is bounded by the source vocabulary; it avoids the distinct-aggregate
    # rewrite (four aggregation operators)
    light = credits.join(heavy_keys, KEY, "left_anti").groupBy(KEY).agg(
        F.size(F.collect_set("source")).alias("cr_sources"), F.expr(f"percentile({AMT}, array(0.25D, 0.75D))").alias("cr_q"))
    heavy_cr = credits.join(heavy_keys, KEY, "left_semi")
    heavy = keyed_exact_quantiles(heavy_cr, KEY, "amount", [0.25, 0.75], ["_hq1", "_hq3"])
    hsrc = (heavy_cr.filter(F.col("source").isNotNull()).select(KEY, "source").distinct()
            .groupBy(KEY).agg(F.count(F.lit(1)).alias("_hsrc")))
    return (agg.join(light, KEY, "left").join(heavy, KEY, "left").join(hsrc, KEY, "left")
            .withColumn("cr_q", F.coalesce("cr_q", F.array("_hq1", "_hq3")))
            .withColumn("cr_sources", F.coalesce(F.col("_hsrc").cast("int"), F.col("cr_sources"), F.lit(0)))
            .drop("_hq1", "_hq3", "_hsrc"))


def _bands(x: str, cases: list[tuple[str, float]], otherwise: float) -> str:
    """Ordered CASE: ``cases`` are (predicate on ``x`` with ``{x}``, result); first match wins."""
    return ("CASE " + " ".join(f"WHEN {pred.format(x=x)} THEN {sql_d(v)}" for pred, v in cases)
            + f" ELSE {sql_d(otherwise)} END")


def feature_exprs() -> dict[str, str]:
    """The 24 features as SQL over the raw aggregate columns (group defaults included)."""
    sum_cr, sum_dr = "CAST(sum_cr AS DOUBLE)", "CAST(sum_dr AS DOUBLE)"
    mean_cr, mean_dr = f"({sum_cr} / n_cr)", f"({sum_dr} / n_dr)"
    m_cr, m_dr = sql_months("cr_t0", "cr_t1"), sql_months("dr_t0", "dr_t1")

    def cv(n, mean, sd, fn):
        return f"CASE WHEN {n} < 2 OR {mean} = 0 THEN 0.0D ELSE {sql_rnd(fn(f'({sd} / {mean})'), 4)} END"

    def safe_ratio(num, den):
        return f"CASE WHEN {den} IS NULL OR {den} = 0 THEN 0.0D ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END"

    income = {
        "income_monthly_avg": sql_rnd(f"{sum_cr} / {m_cr}", 2),
        "income_consistency_score": cv("n_cr", mean_cr, "cr_sd", lambda x: f"greatest(0.0D, 1.0D - {x})"),
        "income_source_diversity": "CAST(cr_sources AS DOUBLE)",
        "income_transaction_frequency": sql_rnd(f"n_cr / {m_cr}", 2),
        "income_growth_trend": f"CASE WHEN n_cr < 2 THEN 0.0D ELSE {sql_rnd('coalesce(cr_slope, 0.0D)', 4)} END",
        "income_regularity": cv("n_cr", mean_cr, "cr_sd", lambda x: f"1.0D / (1.0D + {x})"),
        "income_max_transaction": "cr_max",
        "income_min_transaction": "cr_min",
        "income_quartile_ratio": f"CASE WHEN n_cr < 4 OR cr_q[0] = 0 THEN 1.0D "
                                 f"ELSE {sql_rnd('cr_q[1] / cr_q[0]', 4)} END",
    }
    income = {k: f"CASE WHEN n_cr > 0 THEN {v} ELSE {sql_d(INCOME_DEFAULTS[k])} END" for k, v in income.items()}
    bills_m = sql_months("bill2_t0", "bill2_t1")
    expense = {
        "expense_monthly_avg": sql_rnd(f"{sum_dr} / {m_dr}", 2),
        "expense_to_income_ratio": f"CASE WHEN NOT n_cr > 0 THEN 0.0D WHEN {sum_cr} = 0 THEN 1.0D "
                                   f"ELSE {sql_rnd(f'{sum_dr} / {sum_cr}', 4)} END",
        "essential_expense_ratio": sql_rnd(safe_ratio("coalesce(sum_ess5, 0)", "sum_dr"), 4),
        "expense_consistency": cv("n_dr", mean_dr, "dr_sd", lambda x: f"greatest(0.0D, 1.0D - {x})"),
        "bill_payment_regularity": f"CASE WHEN n_bill2 = 0 THEN 0.0D "
                                   f"ELSE {sql_rnd(f'least(1.0D, (n_bill2 / {bills_m}) / 2.5D)', 4)} END",
        "savings_potential": f"CASE WHEN NOT n_cr > 0 THEN 0.0D "
                             f"ELSE {sql_rnd('CAST(sum_cr - sum_dr AS DOUBLE)', 2)} END",
        "expense_spike_count": "CASE WHEN n_dr < 2 THEN 0.0D ELSE CAST(n_spike AS DOUBLE) END",
        "discretionary_spending_ratio": sql_rnd(safe_ratio("coalesce(sum_discr, 0)", "sum_dr"), 4),
        "expense_volatility": f"CASE WHEN n_dr < 2 THEN 0.0D ELSE {sql_rnd('dr_sd', 2)} END",
    }
    expense = {k: f"CASE WHEN n_dr > 0 THEN {v} ELSE {sql_d(EXPENSE_DEFAULTS[k])} END" for k, v in expense.items()}

    emi_f = f"(n_emi / {sql_months('emi_t0', 'emi_t1')})"
    emi = (f"CASE WHEN n_emi = 0 THEN 0.5D ELSE " + _bands(emi_f, [
        ("{x} >= 0.9D AND {x} <= 1.1D", 1.0), ("{x} >= 0.7D AND {x} <= 1.3D", 0.7), ("{x} > 1.3D", 0.5)], 0.3)
        + " END")
    bill_f = f"(n_bill3 / {sql_months('bill3_t0', 'bill3_t1')})"
    bills = (f"CASE WHEN n_bill3 = 0 THEN 0.0D ELSE "
             + _bands(bill_f, [("{x} >= 2.0D", 1.0), ("{x} >= 1.0D", 0.6)], 0.3) + " END")
    failed = sql_rnd("n_failed / n_all", 4)
    rate = f"(CASE WHEN {sum_cr} > 0 THEN ({sum_cr} - coalesce({sum_dr}, 0.0D)) / {sum_cr} ELSE 0.0D END)"
    savings = ("CASE WHEN NOT n_cr > 0 THEN 0.0D ELSE " + _bands(rate, [
        ("{x} >= 0.3D", 1.0), ("{x} >= 0.2D", 0.8), ("{x} >= 0.1D", 0.6), ("{x} >= 0.0D", 0.4)], 0.0) + " END")
    usage = ("CASE WHEN n_card_cr = 0 THEN 0.5D ELSE "
             + _bands("(n_card_dr / n_card_cr)", [("{x} >= 1.0D", 1.0), ("{x} >= 0.7D", 0.7)], 0.4) + " END")
    overall = sql_rnd(f"greatest(0.0D, ({emi}) * 30 + ({bills}) * 25 + ({savings}) * 30 - ({failed}) * 15)", 2)
    discipline = {
        "discipline_emi_regularity": emi, "discipline_bill_timeliness": bills,
        "discipline_failed_transaction_ratio": failed, "discipline_savings_behavior": savings,
        "discipline_credit_usage_score": usage, "discipline_overall_score": overall,
    }
    return income | expense | discipline


def features_from_aggregates(agg: DataFrame, keep_raw=()) -> DataFrame:
    """Project the raw aggregates into the 24 features (plus ``applicant_id``
    and any ``keep_raw`` aggregate columns)."""
    return agg.selectExpr(KEY, *keep_raw, *[f"CAST({v} AS DOUBLE) AS {k}" for k, v in feature_exprs().items()])


def ledger_features(ledger: DataFrame, keep_raw=()) -> DataFrame:
    """All 24 transaction features, one row per applicant that has ledger rows."""
    return features_from_aggregates(raw_aggregates(ledger), keep_raw)


def income_features(ledger: DataFrame) -> DataFrame:
    return ledger_features(ledger).select(KEY, *INCOME_FEATURES)


def expense_features(ledger: DataFrame) -> DataFrame:
    return ledger_features(ledger).select(KEY, *EXPENSE_FEATURES)


def discipline_features(ledger: DataFrame) -> DataFrame:
    return ledger_features(ledger).select(KEY, *DISCIPLINE_FEATURES)
