"""Model evaluation over ``(y_true, y_pred)`` pairs.

Every metric is a global aggregate with map-side partial aggregation; the
rank-based ones (AUC, ROC points, percentiles) use the distributed prefix sum
in :mod:`altscore.operators.ordered` over distinct scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import rnd
from ..session import stored
from .ordered import exact_quantiles, global_cumsum

DIGITS = 9  # outputs are rounded so that summation order cannot show


def _r(c):
    return rnd(c, DIGITS)


def regression_metrics(pairs: DataFrame, t: str = "y_true", p: str = "y_pred") -> DataFrame:
    """EV1: rmse, mae, r2, mape, max_error, mean / population sd of predictions."""
    yt, yp = F.col(t), F.col(p)
    agg = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((yt - yp) * (yt - yp)).alias("mse"),
        F.avg(F.abs(yt - yp)).alias("mae"),
        F.sum((yt - yp) * (yt - yp)).alias("sse"),
        F.var_pop(yt).alias("var_t"),
        F.avg(F.abs((yt - yp) / (yt + F.lit(1e-10)))).alias("mape"),
        F.max(F.abs(yt - yp)).alias("max_error"),
        F.avg(yp).alias("mean_prediction"),
        F.stddev_pop(yp).alias("std_prediction"))
    sst = F.col("var_t") * F.col("n")
    return agg.select(
        _r(F.sqrt("mse")).alias("rmse"), _r(F.col("mae")).alias("mae"),
        _r(F.when(sst == 0, F.lit(0.0)).otherwise(1 - F.col("sse") / sst)).alias("r2"),
        _r(F.col("mape") * 100).alias("mape"), _r(F.col("max_error")).alias("max_error"),
        _r(F.col("mean_prediction")).alias("mean_prediction"),
        _r(F.col("std_prediction")).alias("std_prediction"))


def confusion_counts(pairs: DataFrame, t: str = "y_true", p: str = "y_pred",
                     threshold: float = K.DECISION_THRESHOLD) -> DataFrame:
    tb, pb = F.col(t) > threshold, F.col(p) > threshold
    return pairs.agg(F.count_if(pb & tb).alias("tp"), F.count_if(pb & ~tb).alias("fp"),
                     F.count_if(~pb & tb).alias("fn"), F.count_if(~pb & ~tb).alias("tn"))


def _div(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def classification_metrics(pairs: DataFrame, t: str = "y_true", p: str = "y_pred",
                           threshold: float = K.DECISION_THRESHOLD) -> DataFrame:
    """EV2: confusion counts and the ratios (0 on empty denominators)."""
    c = confusion_counts(pairs, t, p, threshold)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    precision, recall = _div(tp, tp + fp), _div(tp, tp + fn)
    return c.select(
        "tp", "fp", "fn", "tn",
        _r(precision).alias("precision"), _r(recall).alias("recall"),
        _r(F.when(precision + recall > 0, 2 * precision * recall / (precision + recall))
           .otherwise(F.lit(0.0))).alias("f1"),
        _r(_div(tp + tn, tp + tn + fp + fn)).alias("accuracy"),
        _r(_div(tn, tn + fp)).alias("specificity"), _r(_div(tn, tn + fn)).alias("npv"))


def _score_counts(pairs, t, p, threshold):
    pos = F.col(t) > threshold
    return pairs.groupBy(F.col(p).cast("double").alias("score")).agg(
        F.count_if(pos).alias("pos"), F.count_if(~pos).alias("neg"))


def roc_auc(pairs: DataFrame, t: str = "y_true", p: str = "y_pred",
            threshold: float = K.DECISION_THRESHOLD) -> DataFrame:
    """EV3: trapezoid AUC of ``y_pred`` against ``y_true > threshold``.

    Equal to the Mann-Whitney statistic with ties counted half:
    AUC = sum_s pos_s x (neg below s + neg_s / 2) / (P x N); 0.0 when one
    class is missing.
    """
    sc = global_cumsum(_score_counts(pairs, t, p, threshold), "score", ["neg"])
    agg = sc.agg(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0)).alias("u"),
                 F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return agg.select(_r(F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("u") / (F.col("P") * F.col("N")))
                         .otherwise(F.lit(0.0))).alias("roc_auc"))


def roc_points(pairs: DataFrame, t: str = "y_true", p: str = "y_pred",
               threshold: float = K.DECISION_THRESHOLD) -> DataFrame:
    """EV4: (threshold, fpr, tpr) at every distinct score, highest first."""
    sc = stored(global_cumsum(_score_counts(pairs, t, p, threshold), "score", ["pos", "neg"], descending=True), "roc")
    tot = sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    P, N = tot["P"] or 0, tot["N"] or 0
    return sc.select(F.col("score").alias("threshold"),
                     _r(F.col("cum_neg") / F.lit(N) if N else F.lit(0.0)).alias("fpr"),
                     _r(F.col("cum_pos") / F.lit(P) if P else F.lit(0.0)).alias("tpr"))


def distribution_metrics(pairs: DataFrame, t: str = "y_true", p: str = "y_pred") -> DataFrame:
    """EV5: residual moments (skew / kurtosis bias-corrected as in pandas),
    prediction percentiles (exact, linear), mean / population sd of both."""
    yt, yp = F.col(t), F.col(p)
    res = yt - yp
    m = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg(res).alias("residual_mean"),
                  F.stddev_pop(res).alias("residual_std"), F.skewness(res).alias("g1"),
                  F.kurtosis(res).alias("g2"), F.avg(yt).alias("true_mean"),
                  F.stddev_pop(yt).alias("true_std"), F.avg(yp).alias("pred_mean"),
                  F.stddev_pop(yp).alias("pred_std"))
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    moments = m.select(*[_r(F.col(c)).alias(c) for c in ("residual_mean", "residual_std")],
                       _r(skew).alias("residual_skewness"), _r(kurt).alias("residual_kurtosis"),
                       *[_r(F.col(c)).alias(c) for c in ("true_mean", "true_std", "pred_mean", "pred_std")])
    q = exact_quantiles(pairs, p, [0.10, 0.25, 0.50, 0.75, 0.90])
    q = q.select(*[_r(F.col(c)).alias(c) for c in q.columns])
    # Both sides are single rows: a one-row to one-row join on a constant key.
    return moments.withColumn("_k", F.lit(1)).join(q.withColumn("_k", F.lit(1)), "_k").drop("_k")


def business_metrics(pairs: DataFrame, t: str = "y_true", p: str = "y_pred",
                     threshold: float = K.DECISION_THRESHOLD) -> DataFrame:
    """EV6: approval rate, outcome counts, profit / cost in INR, FPR / FNR."""
    c = confusion_counts(pairs, t, p, threshold)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    profit = tp * K.TP_PROFIT + tn * K.TN_SAVING
    cost = fp * K.FP_COST + fn * K.FN_COST
    return c.select(
        _r(_div(tp + fp, total)).alias("approval_rate"),
        tp.alias("profitable_loans_approved"), fp.alias("unprofitable_loans_approved"),
        fn.alias("profitable_loans_rejected"), tn.alias("unprofitable_loans_rejected"),
        profit.cast("double").alias("estimated_total_profit_inr"),
        cost.cast("double").alias("estimated_total_cost_inr"),
        (profit - cost).cast("double").alias("estimated_net_profit_inr"),
        _r(_div(profit - cost, total)).alias("profit_per_application_inr"),
        _r(_div(fp, fp + tn)).alias("false_positive_rate"),
        _r(_div(fn, fn + tp)).alias("false_negative_rate"))


def histogram(pairs: DataFrame, cols=("y_true", "y_pred"), bins: int = 30) -> DataFrame:
    """EV9: equal-width bins over [min, max] of each series, with density
    count / (n x width); the last bin is closed (numpy convention)."""
    long_df = pairs.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], list(cols), "series", "x")
    rng = long_df.groupBy("series").agg(F.min("x").alias("lo"), F.max("x").alias("hi"),
                                        F.count("x").alias("n"))
    # One row per series: bounded by the number of series, so broadcast.
    j = long_df.join(F.broadcast(rng), "series")
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))))
    g = j.withColumn("bin", b.cast("int")).groupBy("series", "bin", "lo", "hi", "n").agg(
        F.count(F.lit(1)).alias("count"))
    w = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise(width)
    return g.select("series", "bin", _r(F.col("lo") + F.col("bin") * w).alias("bin_start"),
                    _r(F.col("lo") + (F.col("bin") + 1) * w).alias("bin_end"), "count",
                    _r(F.col("count") / (F.col("n") * w)).alias("density"))


def residual_points(pairs: DataFrame, key: str = "id", t: str = "y_true", p: str = "y_pred") -> DataFrame:
    """EV10: (pred, residual) and (true, pred) series."""
    return pairs.select(key, F.col(t).alias("y_true"), F.col(p).alias("y_pred"),
                        _r(F.col(t) - F.col(p)).alias("residual"))


def metrics_long(pairs: DataFrame, model: str, t="y_true", p="y_pred") -> DataFrame:
    """(model, metric, value) rows from the regression, classification and
    business groups (first group holding a metric wins)."""
    reg = regression_metrics(pairs, t, p)
    cls = classification_metrics(pairs, t, p).drop("tp", "fp", "fn", "tn")
    bus = business_metrics(pairs, t, p)
    parts = []
    for df in (reg, cls, bus):
        num = [c for c, ty in df.dtypes if ty in ("double", "bigint", "int")]
        parts.append(df.select(*[F.col(c).cast("double").alias(c) for c in num]).unpivot(
            [], num, "metric", "value"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.withColumn("model", F.lit(model))


def compare_models(long_df: DataFrame, metrics: list[str]) -> DataFrame:
    """EV7: models x metrics; a metric a model lacks is NULL."""
    return long_df.groupBy("model").pivot("metric", metrics).agg(F.first("value"))


# EV8: the report's sections, each with (label, column, decimals; None for counts).
REPORT = (
    ("REGRESSION", (
        ("RMSE", "rmse", 4), ("MAE", "mae", 4), ("R2", "r2", 4), ("MAPE (%)", "mape", 2), ("Max error", "max_error", 4),
        ("Mean prediction", "mean_prediction", 4), ("Std prediction", "std_prediction", 4))),
    ("CLASSIFICATION", (
        ("Precision", "precision", 4), ("Recall", "recall", 4), ("F1", "f1", 4), ("Accuracy", "accuracy", 4),
        ("Specificity", "specificity", 4), ("NPV", "npv", 4), ("ROC AUC", "roc_auc", 4),
        ("TP", "tp", None), ("FP", "fp", None), ("FN", "fn", None), ("TN", "tn", None))),
    ("DISTRIBUTION", (
        ("Residual mean", "residual_mean", 4), ("Residual std", "residual_std", 4),
        ("Residual skewness", "residual_skewness", 4), ("Residual kurtosis", "residual_kurtosis", 4),
        ("True mean", "true_mean", 4), ("True std", "true_std", 4), ("Predicted mean", "pred_mean", 4),
        ("Predicted std", "pred_std", 4), ("P10", "p10", 4), ("P25", "p25", 4), ("P50", "p50", 4), ("P75", "p75", 4), ("P90", "p90", 4))),
    ("BUSINESS", (
        ("Approval rate", "approval_rate", 4), ("Profitable approved", "profitable_loans_approved", None),
        ("Unprofitable approved", "unprofitable_loans_approved", None), ("Profitable rejected", "profitable_loans_rejected", None),
        ("Unprofitable rejected", "unprofitable_loans_rejected", None), ("Total profit (INR)", "estimated_total_profit_inr", 2),
        ("Total cost (INR)", "estimated_total_cost_inr", 2), ("Net profit (INR)", "estimated_net_profit_inr", 2),
        ("Profit per application (INR)", "profit_per_application_inr", 2), ("False positive rate", "false_positive_rate", 4),
        ("False negative rate", "false_negative_rate", 4))),
)


def evaluation_report(pairs: DataFrame, t: str = "y_true", p: str = "y_pred",
                      threshold: float = K.DECISION_THRESHOLD) -> DataFrame:
    """EV8: every figure of the four groups (EV1, EV2 with EV3, EV5, EV6) as
    columns, rounded as they are shown, and the text report made of them: one row.

    A figure that is undefined (no pairs, too few for a moment) reads ``n/a``.
    """
    pairs = stored(pairs.select(t, p), "evaluated")        # five aggregates read it
    row = regression_metrics(pairs, t, p).withColumn("_k", F.lit(1))
    for group in (classification_metrics(pairs, t, p, threshold), roc_auc(pairs, t, p, threshold),
                  distribution_metrics(pairs, t, p), business_metrics(pairs, t, p, threshold)):
        row = row.join(group.withColumn("_k", F.lit(1)), "_k")       # single rows
    lines = [F.lit("MODEL EVALUATION REPORT")]
    for title, figures in REPORT:
        lines.append(F.lit(title))
        for label, c, digits in figures:
            text = F.col(c).cast("string") if digits is None else F.format_number(c, digits)
            lines.append(F.concat(F.lit(f"  {label}: "), F.coalesce(text, F.lit("n/a"))))
    shown = [F.col(c) if digits is None else rnd(F.col(c), digits).alias(c) for _, figures in REPORT for _, c, digits in figures]
    return row.select(*shown, F.concat_ws("\n", *lines).alias("report"))
