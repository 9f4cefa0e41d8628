"""§2.2 projections, filters and predicates as standalone queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import isin_or_false, rlike_ci
from ..operators import portfolio as PF
from ..sources import views as V
from .features import FEATURE_NAMES
from .oracle_views import cte
from .registry import register


def _in(vals):
    return "(" + ", ".join(f"'{v}'" for v in vals) + ")"


@register("filter_credit_debit", cte("ledger") + """
SELECT txn_type, count(*) AS n, sum(amount)::DOUBLE AS total FROM ledger GROUP BY txn_type""")
def q_filter_credit_debit(spark, sf_dir):
    """The ledger split by transaction type (exact decimal totals)."""
    return V.ledger(spark, sf_dir).groupBy("txn_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("total"))


_SETS = {"essential5": K.ESSENTIAL5, "bills2": K.BILLS2, "bills3": K.BILLS3, "emi": [K.EMI_SOURCE]}


@register("filter_category_in", cte("ledger") + "\nUNION ALL\n".join(
    f"SELECT '{k}' AS category_set, count(*) AS n FROM ledger WHERE txn_type = 'debit' AND source IN {_in(v)}"
    for k, v in _SETS.items()))
def q_filter_category_in(spark, sf_dir):
    """Debits whose source is in each fixed category list."""
    d = V.ledger(spark, sf_dir).filter(F.col("txn_type") == "debit")
    agg = d.agg(*[F.count_if(isin_or_false("source", v)).alias(k) for k, v in _SETS.items()])
    return agg.unpivot([], list(_SETS), "category_set", "n")


@register("filter_category_not_in", cte("ledger") + f"""
SELECT count(*) AS n_discretionary, coalesce(sum(amount), 0)::DOUBLE AS total_discretionary
FROM ledger WHERE txn_type = 'debit' AND (source IS NULL OR source NOT IN {_in(K.ESSENTIAL6)})""")
def q_filter_category_not_in(spark, sf_dir):
    """Debits outside the six essential sources; NULL source counts as outside."""
    d = V.ledger(spark, sf_dir).filter((F.col("txn_type") == "debit") & ~isin_or_false("source", K.ESSENTIAL6))
    return d.agg(F.count(F.lit(1)).alias("n_discretionary"),
                 F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("total_discretionary"))


@register("filter_message_regex", cte("ledger") + """
SELECT count(*) FILTER (WHERE coalesce(regexp_matches(message, 'fail|bounce|reject', 'i'), false)) AS n_failed,
       count(*) FILTER (WHERE coalesce(regexp_matches(message, 'credit card|card payment', 'i'), false)) AS n_card
FROM ledger""")
def q_filter_message_regex(spark, sf_dir):
    """Case-insensitive message patterns; NULL never matches."""
    return V.ledger(spark, sf_dir).agg(F.count_if(rlike_ci("message", K.FAILED_PATTERN)).alias("n_failed"),
                                       F.count_if(rlike_ci("message", K.CARD_PATTERN)).alias("n_card"))


def _fm_sql():
    from . import oracle_features as O
    return O.fm_with() + "SELECT " + ", ".join(O.FEATURE_NAMES) + " FROM fm"


@register("select_feature_columns", _fm_sql())
def q_select_feature_columns(spark, sf_dir):
    """P5: model inputs = every column except ids and the target."""
    from .q_ml import training_frame
    tf = training_frame(spark, sf_dir)
    drop = {"applicant_id", "user_id", "label", "split", "profitability_score"}
    cols = [c for c in tf.columns if c not in drop]
    assert cols == FEATURE_NAMES
    return tf.select(*cols)


@register("filter_last_hours", cte("predictions") + """
SELECT prediction_id, score, decision FROM predictions
WHERE prediction_timestamp >= (SELECT max(prediction_timestamp) FROM predictions) - INTERVAL 24 HOUR""")
def q_filter_last_hours(spark, sf_dir):
    """Rows of the last 24 hours before the newest timestamp."""
    return PF.last_hours(V.predictions(spark, sf_dir), "prediction_timestamp", 24).select(
        "prediction_id", "score", "decision")


_CATS = ["gender", "occupation", "location_type"]


def _cat_sql():
    extra = [(f"idx_{c}", f"""SELECT v, (dense_rank() OVER (ORDER BY n DESC, v) - 1)::DOUBLE AS idx
  FROM (SELECT coalesce(CAST({c} AS VARCHAR), 'missing') AS v, count(*) AS n FROM loan_applications GROUP BY 1)""")
             for c in _CATS]
    joins = " ".join(f"JOIN idx_{c} ON coalesce(CAST(a.{c} AS VARCHAR), 'missing') = idx_{c}.v" for c in _CATS)
    sel = ", ".join(f"coalesce(CAST(a.{c} AS VARCHAR), 'missing') AS {c}, idx_{c}.idx AS {c}_index" for c in _CATS)
    return cte("loan_applications", extra=extra) + f"SELECT a.application_id, {sel} FROM loan_applications a {joins}"


@register("category_to_string", _cat_sql())
def q_category_to_string(spark, sf_dir):
    """Categorical columns as strings (NULL -> 'missing') and their Spark
    ML ``StringIndexer`` codes (most frequent label first, ties by label)."""
    from pyspark.ml.feature import StringIndexer
    a = V.loan_applications(spark, sf_dir).select(
        "application_id", *[F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias(c) for c in _CATS])
    idx = StringIndexer(inputCols=_CATS, outputCols=[f"{c}_index" for c in _CATS],
                        stringOrderType="frequencyDesc").fit(a)
    return idx.transform(a).select("application_id", *[x for c in _CATS for x in (c, f"{c}_index")])
