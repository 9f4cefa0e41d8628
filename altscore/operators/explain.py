"""Explanations.

* Linear SHAP of the rule score: R1 is linear in its five sub-scores, so with
  independent features the exact SHAP value of sub-score i is
  ``w_i * (x_i - mean(x_i))`` and the base value is ``sum_i w_i * mean(x_i)``.
  Only the five population means are needed: one global aggregate.
* Global importance, dependence points and waterfall rows are plain
  aggregates / projections / per-row windows over the long SHAP table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import rnd
from ..session import stored
from .scoring import SUBSCORES

DIGITS = 9
WEIGHTS = {f"{g}_score": w for g, w in K.SCORE_WEIGHTS.items()}


def shap_wide(sub: DataFrame, key: str = "applicant_id") -> DataFrame:
    """Per applicant: sub-scores, ``shap_<sub-score>`` and ``base_value``.

    The sub-scores are stored, for they are read twice: for the five means
    (one row) and for the rows.
    """
    sub = stored(sub.select(key, *SUBSCORES), "subscores")
    means = sub.agg(*[F.avg(c).alias(c) for c in SUBSCORES]).first()
    base = sum(WEIGHTS[c] * (means[c] or 0.0) for c in SUBSCORES)
    return sub.select("*", *[rnd(F.lit(WEIGHTS[c]) * (F.col(c) - F.lit(means[c])), DIGITS).alias(f"shap_{c}") for c in SUBSCORES],
                      rnd(F.lit(base), DIGITS).alias("base_value"))


def linear_shap(sub: DataFrame, key: str = "applicant_id") -> DataFrame:
    """X4 long form: (key, feature, value, shap, base_value)."""
    cols = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"), F.col(f"shap_{c}").alias("shap")) for c in SUBSCORES]
    return shap_wide(sub, key).select(key, "base_value", F.explode(F.array(*cols)).alias("s")).select(
        key, "s.*", "base_value")


def explain_rows(shap_long: DataFrame, key: str = "applicant_id", top_n: int = 10) -> DataFrame:
    """X1 shape: top-n features per row by |shap| with the row's prediction
    (= base + sum of shap) and decision."""
    w_all = Window.partitionBy(key)
    w = Window.partitionBy(key).orderBy(F.abs("shap").desc(), F.col("feature"))
    r = (shap_long.withColumn("prediction", rnd(F.col("base_value") + F.sum("shap").over(w_all), DIGITS))
         .withColumn("rank", F.row_number().over(w)))
    return r.filter(F.col("rank") <= top_n)


def global_importance(shap_long: DataFrame, top_n: int = 20) -> DataFrame:
    """Mean |shap| per feature, highest first."""
    return (shap_long.groupBy("feature").agg(rnd(F.avg(F.abs("shap")), DIGITS).alias("mean_abs_shap"))
            .orderBy(F.col("mean_abs_shap").desc(), F.col("feature")).limit(top_n))


def dependence_points(wide: DataFrame, feature: str, interaction: str | None = None,
                      key: str = "applicant_id") -> DataFrame:
    """(value, shap[, interaction value]) for one feature of ``shap_wide``."""
    for name in filter(None, (feature, interaction)):
        if name not in SUBSCORES:
            raise ValueError(f"unknown feature {name!r}")
    extra = [F.col(interaction).alias("interaction_value")] if interaction else []
    return wide.select(key, F.col(feature).alias("value"), F.col(f"shap_{feature}").alias("shap"), *extra)


def waterfall(shap_long: DataFrame, key: str = "applicant_id") -> DataFrame:
    """Contributions ordered by |shap| with the running total from the base."""
    w = (Window.partitionBy(key).orderBy(F.abs("shap").desc(), F.col("feature"))
         .rowsBetween(Window.unboundedPreceding, 0))
    return shap_long.select(key, "feature", "shap", F.row_number().over(
        Window.partitionBy(key).orderBy(F.abs("shap").desc(), F.col("feature"))).alias("step"),
        rnd(F.col("base_value") + F.sum("shap").over(w), DIGITS).alias("running_total"))
