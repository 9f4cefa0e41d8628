"""FP5: the 24 transaction features from the nested per-application list.

Applications arrive with their transactions inside the record (``array<struct>``,
at most 200 per the schema, 10,000 per the API).  Every raw aggregate of the
flat plan is recomputed with higher-order functions on the array — no
shuffle — and fed to the same projection (``features_from_aggregates``), so
both paths share one definition of the features.  This is also the
streaming path (each record is self-contained).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from .ledger_features import KEY, LEDGER_FEATURES, features_from_aggregates, ledger_features

TXN_FIELDS = ["ts", "txn_type", "amount", "source", "message", "category"]
NESTED_LIMIT = K.API_MAX_TXNS   # larger lists are routed to the flat (shuffle) plan


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _stage1(col: str) -> list[str]:
    """Split the list; count failed messages over the whole list."""
    return [
        KEY, f"CAST(size({col}) AS BIGINT) AS n_all",
        f"filter({col}, t -> t.txn_type = 'credit') AS _cr",
        f"filter({col}, t -> t.txn_type = 'debit') AS _dr",
        f"CAST(size(filter({col}, t -> coalesce(t.message RLIKE '(?i){K.FAILED_PATTERN}', false))) AS BIGINT)"
        " AS n_failed",
    ]


def _stage2() -> list[str]:
    """Per-list scalars the later lambdas read: counts, means (null without
    rows: dividing by the size of an empty list is an error), first credit."""
    amt = "CAST(t.amount AS DOUBLE)"
    return [
        KEY, "n_all", "n_failed", "_cr", "_dr",
        "CAST(size(_cr) AS BIGINT) AS n_cr", "CAST(size(_dr) AS BIGINT) AS n_dr",
        f"aggregate(_cr, 0D, (a, t) -> a + {amt}) / nullif(size(_cr), 0) AS _cr_mean",
        f"aggregate(_dr, 0D, (a, t) -> a + {amt}) / nullif(size(_dr), 0) AS _dr_mean",
        "array_min(transform(_cr, t -> t.ts)) AS cr_t0",
        "array_sort(transform(_cr, t -> CAST(t.amount AS DOUBLE))) AS _cr_sorted",
    ]


def _stage3() -> dict[str, str]:
    amt = "CAST(t.amount AS DOUBLE)"
    dec0 = "CAST(0 AS DECIMAL(38,2))"

    def total(arr):
        return f"aggregate({arr}, {dec0}, (a, t) -> CAST(a + t.amount AS DECIMAL(38,2)))"

    def tmin(arr):
        return f"array_min(transform({arr}, t -> t.ts))"

    def tmax(arr):
        return f"array_max(transform({arr}, t -> t.ts))"

    def sd(arr, mean):
        ss = f"aggregate({arr}, 0D, (a, t) -> a + ({amt} - {mean}) * ({amt} - {mean}))"
        return f"CASE WHEN size({arr}) > 1 THEN sqrt({ss} / (size({arr}) - 1)) END"

    def q(p):
        h = f"((size(_cr) - 1) * {p}D)"
        lo = f"CAST(floor({h}) AS INT)"
        return (f"CASE WHEN size(_cr) = 0 THEN NULL ELSE element_at(_cr_sorted, {lo} + 1) + ({h} - {lo}) * "
                f"(element_at(_cr_sorted, least({lo} + 2, size(_cr))) - element_at(_cr_sorted, {lo} + 1)) END")

    day = "CAST(timestampdiff(DAY, cr_t0, t.ts) AS DOUBLE)"
    xbar = f"(aggregate(_cr, 0D, (a, t) -> a + {day}) / nullif(size(_cr), 0))"
    bill2 = f"filter(_dr, t -> coalesce(t.source IN {_in(K.BILLS2)}, false))"
    bill3 = f"filter(_dr, t -> coalesce(t.source IN {_in(K.BILLS3)}, false))"
    emi = f"filter(_dr, t -> coalesce(t.source = '{K.EMI_SOURCE}', false))"
    card = f"coalesce(t.message RLIKE '(?i){K.CARD_PATTERN}', false)"
    return {
        "sum_cr": f"CASE WHEN size(_cr) > 0 THEN {total('_cr')} END",
        "cr_t1": tmax("_cr"), "cr_sd": sd("_cr", "_cr_mean"),
        "cr_sources": "size(array_distinct(filter(transform(_cr, t -> t.source), s -> s IS NOT NULL)))",
        "_xbar": xbar,
        "cr_max": "array_max(_cr_sorted)",
        "cr_min": "array_min(_cr_sorted)",
        "cr_q": f"array({q(0.25)}, {q(0.75)})",
        "sum_dr": f"CASE WHEN size(_dr) > 0 THEN {total('_dr')} END",
        "dr_t0": tmin("_dr"), "dr_t1": tmax("_dr"), "dr_sd": sd("_dr", "_dr_mean"),
        "sum_ess5": total(f"filter(_dr, t -> coalesce(t.source IN {_in(K.ESSENTIAL5)}, false))"),
        "sum_discr": total(f"filter(_dr, t -> NOT coalesce(t.source IN {_in(K.ESSENTIAL6)}, false))"),
        "n_bill2": f"CAST(size({bill2}) AS BIGINT)", "bill2_t0": tmin(bill2), "bill2_t1": tmax(bill2),
        "n_emi": f"CAST(size({emi}) AS BIGINT)", "emi_t0": tmin(emi), "emi_t1": tmax(emi),
        "n_bill3": f"CAST(size({bill3}) AS BIGINT)", "bill3_t0": tmin(bill3), "bill3_t1": tmax(bill3),
        "n_card_dr": f"CAST(size(filter(_dr, t -> {card})) AS BIGINT)",
        "n_card_cr": f"CAST(size(filter(_cr, t -> {card})) AS BIGINT)",
    }


def _stage4() -> list[str]:
    """Terms needing stage-3 scalars: income slope and debit spikes."""
    amt = "CAST(t.amount AS DOUBLE)"
    day = "CAST(timestampdiff(DAY, cr_t0, t.ts) AS DOUBLE)"
    sxy = f"aggregate(_cr, 0D, (a, t) -> a + ({day} - _xbar) * ({amt} - _cr_mean))"
    sxx = f"aggregate(_cr, 0D, (a, t) -> a + ({day} - _xbar) * ({day} - _xbar))"
    return [f"CASE WHEN size(_cr) > 1 AND {sxx} > 0 THEN {sxy} / {sxx} END AS cr_slope",
            f"CAST(size(filter(_dr, t -> {amt} > _dr_mean + 2 * dr_sd)) AS BIGINT) AS n_spike"]


RAW_COLUMNS = ["n_all", "n_cr", "sum_cr", "cr_t0", "cr_t1", "cr_sd", "cr_sources", "cr_slope", "cr_max",
               "cr_min", "cr_q", "n_dr", "sum_dr", "dr_t0", "dr_t1", "dr_sd", "sum_ess5", "sum_discr",
               "n_bill2", "bill2_t0", "bill2_t1", "n_spike", "n_emi", "emi_t0", "emi_t1", "n_bill3",
               "bill3_t0", "bill3_t1", "n_failed", "n_card_dr", "n_card_cr"]


def nested_raw_aggregates(apps: DataFrame, col: str = "sms_transactions", keep=()) -> DataFrame:
    """Raw aggregates per application row (narrow projections, no shuffle).

    Four stacked projections so that every per-list scalar is computed once
    and the lambdas only read columns: the work is linear in the list size.
    """
    keep = list(keep)
    d = apps.selectExpr(*_stage1(col), *keep).selectExpr(*_stage2(), *keep)
    d = d.selectExpr("*", *[f"{e} AS {k}" for k, e in _stage3().items()])
    d = d.selectExpr("*", *_stage4())
    return d.select(KEY, *keep, *RAW_COLUMNS)


def nested_ledger_features(apps: DataFrame, col: str = "sms_transactions") -> DataFrame:
    """FP5: 24 features for applications whose transactions are nested.
    Applications with an empty list get no row (like the flat plan)."""
    return features_from_aggregates(nested_raw_aggregates(apps.filter(F.size(col) > 0), col))


def nest_ledger(ledger: DataFrame, limit: int = NESTED_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Split the ledger into nested applications (<= ``limit`` transactions,
    one row each: the API's limit for a record) and the flat rows of larger ones.

    Per-applicant counts come first (a one-column partial aggregation), so a
    list is only ever collected for applicants within the limit.
    """
    counts = ledger.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    txn = F.struct(*[F.col(c) for c in TXN_FIELDS])
    small = counts.filter(F.col("_n") <= limit).select(KEY)
    big = counts.filter(F.col("_n") > limit).select(KEY)
    nested = (ledger.join(small, KEY, "left_semi").groupBy(KEY)
              .agg(F.collect_list(txn).alias("sms_transactions")))
    return nested, ledger.join(big, KEY, "left_semi")


def features_nested_or_flat(ledger: DataFrame, limit: int = NESTED_LIMIT) -> DataFrame:
    """All applicants: nested plan for lists within the limit, flat plan for
    the rest — whole results, no application dropped or truncated."""
    nested, rest = nest_ledger(ledger, limit)
    return nested_ledger_features(nested).unionByName(ledger_features(rest).select(KEY, *LEDGER_FEATURES))


def nested_feature_matrix(apps: DataFrame, col: str = "sms_transactions") -> DataFrame:
    """All 45 features (plus the score inputs and ledger totals) for
    self-contained records; an empty list gives the per-group defaults."""
    from .attribute_features import attribute_features
    from .ledger_features import LEDGER_DEFAULTS
    from .scoring import TOTALS
    attrs = [c for c in apps.columns if c not in (KEY, col)]
    raw = nested_raw_aggregates(apps, col, keep=attrs)
    lf = features_from_aggregates(raw, keep_raw=attrs + TOTALS + ["n_all"])
    empty = F.col("n_all") == 0
    fixed = lf.select(KEY, *attrs, *TOTALS, *[
        F.when(empty, F.lit(LEDGER_DEFAULTS[f])).otherwise(F.col(f)).alias(f) for f in LEDGER_FEATURES])
    return attribute_features(fixed, keep=attrs + TOTALS + LEDGER_FEATURES)


def score_records(apps: DataFrame, col: str = "sms_transactions") -> DataFrame:
    """T1 / M5 record path: features -> rule score (0-1) -> decision + confidence."""
    from ..plans.features import FEATURE_NAMES
    from .scoring import clip_score, confidence, decide, subscores_from_totals, weighted
    fm = nested_feature_matrix(apps, col).withColumn("_c", confidence(FEATURE_NAMES))
    sc = weighted(subscores_from_totals(fm, keep=["_c"]))
    score = clip_score(F.col("profitability_score") / 100.0)
    return sc.select(KEY, score.alias("score"), decide(score).alias("decision"), F.col("_c").alias("confidence"))
