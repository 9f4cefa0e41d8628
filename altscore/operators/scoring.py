"""Rule scores, labels, confidence and contributions.

All of these are projections or per-applicant aggregates; the only global
statistic (R8's population mean / sd per feature) is one fixed-size row of
2 x #features numbers, read once and inlined as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import add_all, clip, rnd
from ..session import stored

KEY = "applicant_id"
SUBSCORES = ["income_score", "expense_score", "social_score", "discipline_score", "behavioral_score"]


def ledger_totals(ledger: DataFrame) -> DataFrame:
    """Per applicant: credit count and credit / debit totals (partial aggregation)."""
    cr = F.col("txn_type") == "credit"
    dr = F.col("txn_type") == "debit"
    return ledger.groupBy(KEY).agg(
        F.count_if(cr).alias("n_cr"),
        F.sum(F.when(cr, F.col("amount"))).alias("sum_cr"),
        F.sum(F.when(dr, F.col("amount"))).alias("sum_dr"))


SCORE_INPUTS = ["total_contacts", "financial_app_usage_score", "gambling_app_usage",
                "frequent_location_changes", "night_transaction_ratio"]
TOTALS = ["n_cr", "sum_cr", "sum_dr"]


def subscores(ledger: DataFrame, applicants: DataFrame) -> DataFrame:
    """R2: the five 0-100 sub-scores of the profitability rule."""
    a = applicants.select(KEY, *SCORE_INPUTS)
    return subscores_from_totals(a.join(ledger_totals(ledger), KEY, "left"))


def subscores_from_totals(j: DataFrame, keep=()) -> DataFrame:
    """R2 from a frame holding the score inputs and the ledger totals
    (``n_cr``, ``sum_cr``, ``sum_dr``; NULL when the applicant has no ledger)."""
    n_cr = F.coalesce(F.col("n_cr"), F.lit(0))
    sum_cr = F.coalesce(F.col("sum_cr"), F.lit(0)).cast("double")
    sum_dr = F.coalesce(F.col("sum_dr"), F.lit(0)).cast("double")
    ratio = F.when(sum_cr > 0, sum_dr / sum_cr).otherwise(F.lit(1.0))
    behav = F.greatest(F.lit(0), add_all([
        F.lit(100),
        F.when(F.coalesce(F.col("gambling_app_usage"), F.lit(False)), F.lit(-40)).otherwise(F.lit(0)),
        F.when(F.col("frequent_location_changes") > 10, F.lit(-30)).otherwise(F.lit(0)),
        F.when(F.col("night_transaction_ratio") > 0.3, F.lit(-30)).otherwise(F.lit(0))]))
    return j.select(
        KEY, *keep,
        (F.when(n_cr > 10, F.lit(1.0)).otherwise(n_cr / 10.0) * 100).alias("income_score"),
        (F.greatest(F.lit(0.0), 1.0 - ratio) * 100).alias("expense_score"),
        F.least(F.lit(100.0), F.col("total_contacts") / 500 * 100).alias("social_score"),
        (F.col("financial_app_usage_score") * 10).alias("discipline_score"),
        behav.cast("double").alias("behavioral_score"))


def weighted(sub: DataFrame) -> DataFrame:
    """R1 from R2: weighted sum, rounded to 2 decimals, plus R3 / R4 labels."""
    w = K.SCORE_WEIGHTS
    score = (F.col("income_score") * w["income"] + F.col("expense_score") * w["expense"]
             + F.col("social_score") * w["social"] + F.col("discipline_score") * w["discipline"]
             + F.col("behavioral_score") * w["behavioral"])
    out = sub.withColumn("profitability_score", rnd(score, 2))
    return out.withColumn("approved", F.col("profitability_score") >= K.APPROVAL_SCORE).withColumn(
        "default_status",
        F.when(F.col("approved"), F.col("profitability_score") < K.DEFAULT_SCORE))


def profitability_score(ledger: DataFrame, applicants: DataFrame) -> DataFrame:
    """Per applicant score 0-100, approve label, default label."""
    return weighted(subscores(ledger, applicants))


def decide(score) -> F.Column:
    """P10: approve iff score > 0.6 (strict)."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s > K.DECISION_THRESHOLD, F.lit("approve")).otherwise(F.lit("reject"))


def clip_score(score, lo=0.0, hi=1.0) -> F.Column:
    """P9."""
    return clip(score, lo, hi)


def feature_target(fm: DataFrame, scaled: bool = False, noise_sd: float = 0.0,
                   seed: int = 42) -> DataFrame:
    """R5 (verbatim units) / R6 (``scaled``: N2, D6, B6 divided by 100).

    Terms use a feature only when the column is present; ``noise_sd`` > 0
    adds seeded normal noise before the final clip.
    """
    cols = set(fm.columns)
    div = 100.0 if scaled else 1.0
    terms = []
    if "income_consistency_score" in cols:
        terms.append(0.40 * F.coalesce(F.col("income_consistency_score"), F.lit(0.0)))
    if "expense_to_income_ratio" in cols:
        terms.append(0.25 * (1 - F.coalesce(clip("expense_to_income_ratio", 0.0, 1.0), F.lit(0.5))))
    if "social_network_strength" in cols:
        terms.append(0.15 * F.coalesce(F.col("social_network_strength") / div, F.lit(0.0)))
    if "discipline_overall_score" in cols:
        terms.append(0.10 * F.coalesce(F.col("discipline_overall_score") / div, F.lit(0.0)))
    if "behavioral_risk_score" in cols:
        terms.append(0.10 * (1 - F.coalesce(clip(F.col("behavioral_risk_score") / div, 0.0, 1.0),
                                            F.lit(0.0))))
    score = add_all(terms) if terms else F.lit(0.0)
    if noise_sd:
        score = score + F.randn(seed) * noise_sd
    return fm.withColumn("profitability_score", clip(score, 0.0, 1.0))


def confidence(features: list[str]) -> F.Column:
    """clip(0.7 x share of non-zero features, 0.30, 0.95).

    The reference's outlier penalty is evaluated on one row, where the
    standard deviation is undefined, so it never applies (see R8).
    """
    return clip(_nonzero_share(features) * K.CONFIDENCE_SCALE, K.CONFIDENCE_MIN, K.CONFIDENCE_MAX)


def _nonzero_share(features: list[str]) -> F.Column:
    # one SQL expression (one JVM call) instead of a 45-term Column tree
    terms = " + ".join(f"(CASE WHEN coalesce({c}, 0.0D) != 0 THEN 1 ELSE 0 END)" for c in features)
    return F.expr(f"({terms}) / {float(len(features))!r}D")


def confidence_population(fm: DataFrame, features: list[str]) -> DataFrame:
    """R7 with the outlier penalty against population mean / sample sd."""
    fm = stored(fm, "features")          # read twice: for the statistics and for the rows
    stats = fm.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(features)],
                   *[F.stddev_samp(c).alias(f"s_{i}") for i, c in enumerate(features)]).first()
    outlier = None
    for i, c in enumerate(features):
        m, s = stats[f"m_{i}"], stats[f"s_{i}"]
        if m is None or s is None:
            continue
        z = F.abs((F.col(c) - F.lit(m)) / F.lit(s + 1e-10)) > K.OUTLIER_Z
        outlier = z if outlier is None else (outlier | z)
    raw = _nonzero_share(features) * K.CONFIDENCE_SCALE
    if outlier is not None:
        raw = F.when(F.coalesce(outlier, F.lit(False)), raw * K.OUTLIER_PENALTY).otherwise(raw)
    return fm.withColumn("confidence", clip(raw, K.CONFIDENCE_MIN, K.CONFIDENCE_MAX))


def align_features(df: DataFrame, names: list[str], keep=()) -> DataFrame:
    """P6 + P7: model columns in model order, absent ones as 0, nulls as 0."""
    present = set(df.columns)
    return df.select(*keep, *[
        (F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) if c in present
         else F.lit(0.0)).alias(c) for c in names])


def feature_long(fm: DataFrame, features: list[str], key: str = KEY) -> DataFrame:
    """FP6 core: (key, feature, value) long form (narrow: unpivot, no shuffle)."""
    return fm.select(key, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(
        key, features, "feature", "value")


def top_contributions(fm: DataFrame, importance: dict[str, float], features: list[str], top_n: int = 10,
                      key: str = KEY) -> DataFrame:
    """Value x importance, top-n per row by |contribution| (tie-break: name).

    All within the row: the features become an array that is sorted, cut and
    exploded; nothing is shuffled.
    """
    def entry(name):
        v, w = F.col(name).cast("double"), F.lit(float(importance.get(name, 0.0)))
        return F.struct((-F.abs(v * w)).alias("by"), F.lit(name).alias("feature"), v.alias("value"),
                        w.alias("importance"), (v * w).alias("contribution"))

    # sorted by the first fields: largest |contribution| first, then name
    entries = F.filter(F.array(*[entry(f) for f in features]), lambda x: x["value"].isNotNull())
    best = F.slice(F.array_sort(entries), 1, top_n)
    d = fm.select(key, F.posexplode(best).alias("at", "e"))
    return d.select(key, (F.col("at") + 1).alias("rank"), "e.feature", "e.value", "e.importance", "e.contribution")


def weighted_category_score(sub: DataFrame, key: str = KEY) -> DataFrame:
    """Category weights applied to the sub-scores; absent ones count nothing."""
    terms = [F.coalesce(F.col(f"{g}_score") * float(w), F.lit(0.0)) for g, w in K.SCORE_WEIGHTS.items()]
    return sub.select(key, rnd(add_all(terms), 6).alias("weighted_score"))


def sparse_features(fm: DataFrame, features: list[str], key: str = KEY) -> DataFrame:
    """Feature map holding only non-zero entries (the request form, where
    absent features mean 0)."""
    whole = F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*[F.col(c).cast("double") for c in features]))
    return fm.select(key, F.map_filter(whole, lambda k, v: v != 0).alias("features"))


def explode_sparse(sparse: DataFrame, names: list[str], key: str = KEY) -> DataFrame:
    """Map column -> one nullable column per feature name."""
    return sparse.select(key, *[F.col("features")[n].alias(n) for n in names])


def missing_features(sparse: DataFrame, names: list[str], key: str = KEY) -> DataFrame:
    """FP7: number of model features absent from each row's map."""
    return sparse.select(key, (F.lit(len(names)) - F.size("features")).cast("bigint").alias("n_missing"))
