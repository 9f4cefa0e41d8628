"""§2.7 evaluation queries over two pair sets.

* ``eval_pairs`` — the stored predictions (score) against an outcome derived
  from the prediction id (FIXTURES §2.4);
* ``rule_pairs`` — the rule score R1/100 against the scaled feature target R6.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import scoring as S
from ..session import stored
from ..sources import views as V
from ..sources.tables import load
from . import oracle_features as O
from .features import feature_matrix
from .oracle_views import cte
from .q_scoring import _SCORE_SQL, _SUBSCORE_SQL, _target_sql
from .registry import register

P = "eval_pairs"


def _pairs(spark, sf_dir):
    return V.eval_pairs(spark, sf_dir)


def rule_pairs(spark, sf_dir):
    """(id, y_true, y_pred): target and rule score of one pass over the ledger."""
    fm = feature_matrix(V.applicants(spark, sf_dir), V.ledger(spark, sf_dir), keep=S.SCORE_INPUTS, keep_raw=S.TOTALS)
    fm = S.feature_target(fm, scaled=True).withColumnRenamed("profitability_score", "y_true")
    sc = S.weighted(S.subscores_from_totals(fm, keep=["y_true"]))
    return sc.select(F.col("applicant_id").alias("id"), "y_true", (F.col("profitability_score") / 100.0).alias("y_pred"))


def _rule_pairs_with(extra=(), views=()) -> str:
    tgt = _target_sql(True).split("\nSELECT applicant_id, ", 1)[1]
    return O.fm_with(views=views, extra=[
        ("sub", _SUBSCORE_SQL), ("sc", _SCORE_SQL), ("tg", "SELECT applicant_id, " + tgt),
        ("rule_pairs", "SELECT tg.applicant_id AS id, tg.profitability_score AS y_true, "
                       "sc.profitability_score / 100.0::DOUBLE AS y_pred "
                       "FROM tg JOIN sc ON tg.applicant_id = sc.applicant_id"), *extra])


def _reg_sql(src: str) -> str:
    return f"""
SELECT round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 9) AS rmse,
       round(avg(abs(y_true - y_pred)), 9) AS mae,
       round(CASE WHEN var_pop(y_true) * count(*) = 0 THEN 0.0
                  ELSE 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) END, 9) AS r2,
       round(avg(abs((y_true - y_pred) / (y_true + 1e-10))) * 100, 9) AS mape,
       round(max(abs(y_true - y_pred)), 9) AS max_error,
       round(avg(y_pred), 9) AS mean_prediction, round(stddev_pop(y_pred), 9) AS std_prediction
FROM {src}"""


@register("eval_regression", cte(P) + _reg_sql(P))
def q_eval_regression(spark, sf_dir):
    return EV.regression_metrics(_pairs(spark, sf_dir))


@register("eval_regression_rule", _rule_pairs_with() + _reg_sql("rule_pairs"))
def q_eval_regression_rule(spark, sf_dir):
    return EV.regression_metrics(rule_pairs(spark, sf_dir))


_CONF = """
(SELECT count(*) FILTER (WHERE y_pred > 0.6 AND y_true > 0.6) AS tp,
        count(*) FILTER (WHERE y_pred > 0.6 AND NOT y_true > 0.6) AS fp,
        count(*) FILTER (WHERE NOT y_pred > 0.6 AND y_true > 0.6) AS fn,
        count(*) FILTER (WHERE NOT y_pred > 0.6 AND NOT y_true > 0.6) AS tn FROM {src})"""


def _cls_sql(src: str) -> str:
    return f"""
SELECT tp, fp, fn, tn, round(prec, 9) AS precision, round(rec, 9) AS recall,
       round(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END, 9) AS f1,
       round(CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0.0 END, 9) AS accuracy,
       round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END, 9) AS specificity,
       round(CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0 END, 9) AS npv
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS prec,
                CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rec
      FROM {_CONF.format(src=src)})"""


@register("eval_classification", cte(P) + _cls_sql(P))
def q_eval_classification(spark, sf_dir):
    return EV.classification_metrics(_pairs(spark, sf_dir))


def _auc_sql(src: str) -> str:
    return f"""
SELECT round(CASE WHEN npos > 0 AND nneg > 0
                  THEN (sum_rank_pos - npos * (npos + 1) / 2.0) / (npos * nneg) ELSE 0.0 END, 9) AS roc_auc
FROM (SELECT sum(avg_rank) FILTER (WHERE pos) AS sum_rank_pos, count(*) FILTER (WHERE pos) AS npos,
             count(*) FILTER (WHERE NOT pos) AS nneg
      FROM (SELECT y_true > 0.6 AS pos,
                   rank() OVER (ORDER BY y_pred) + (count(*) OVER (PARTITION BY y_pred) - 1) / 2.0 AS avg_rank
            FROM {src}))"""


@register("eval_roc_auc", cte(P) + _auc_sql(P))
def q_eval_roc_auc(spark, sf_dir):
    return EV.roc_auc(_pairs(spark, sf_dir))


@register("eval_roc_auc_rule", _rule_pairs_with() + _auc_sql("rule_pairs"))
def q_eval_roc_auc_rule(spark, sf_dir):
    return EV.roc_auc(rule_pairs(spark, sf_dir))


# Nearly as many distinct scores as rows: the line items' prices against their discounts.
LINE_PAIRS = """SELECT l_orderkey * 8 + l_linenumber AS id, l_discount * 10 AS y_true, l_extendedprice AS y_pred FROM lineitem"""


@register("eval_roc_auc_lines", f"WITH line_pairs AS ({LINE_PAIRS}) " + _auc_sql("line_pairs"))
def q_eval_roc_auc_lines(spark, sf_dir):
    """EV3 on a continuous score."""
    li = load(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_discount", "l_extendedprice"])
    return EV.roc_auc(li.selectExpr("l_orderkey * 8 + l_linenumber AS id", "l_discount * 10 AS y_true", "l_extendedprice AS y_pred"))


ROC_SQL = cte(P) + """
SELECT score AS threshold,
       round(CASE WHEN sum(neg) OVER () > 0 THEN sum(neg) OVER (ORDER BY score DESC) / sum(neg) OVER () ELSE 0.0 END, 9) AS fpr,
       round(CASE WHEN sum(pos) OVER () > 0 THEN sum(pos) OVER (ORDER BY score DESC) / sum(pos) OVER () ELSE 0.0 END, 9) AS tpr
FROM (SELECT y_pred AS score, count(*) FILTER (WHERE y_true > 0.6) AS pos,
             count(*) FILTER (WHERE NOT y_true > 0.6) AS neg FROM eval_pairs GROUP BY y_pred)"""


@register("roc_points", ROC_SQL)
def q_roc_points(spark, sf_dir):
    return EV.roc_points(_pairs(spark, sf_dir))


def _dist_sql(src: str) -> str:
    return f"""
SELECT round(avg(y_true - y_pred), 9) AS residual_mean, round(stddev_pop(y_true - y_pred), 9) AS residual_std,
       round(skewness(y_true - y_pred), 9) AS residual_skewness, round(kurtosis(y_true - y_pred), 9) AS residual_kurtosis,
       round(avg(y_true), 9) AS true_mean, round(stddev_pop(y_true), 9) AS true_std,
       round(avg(y_pred), 9) AS pred_mean, round(stddev_pop(y_pred), 9) AS pred_std,
       round(quantile_cont(y_pred, 0.10), 9) AS p10, round(quantile_cont(y_pred, 0.25), 9) AS p25,
       round(quantile_cont(y_pred, 0.50), 9) AS p50, round(quantile_cont(y_pred, 0.75), 9) AS p75,
       round(quantile_cont(y_pred, 0.90), 9) AS p90
FROM {src}"""


@register("eval_distribution", cte(P) + _dist_sql(P))
def q_eval_distribution(spark, sf_dir):
    return EV.distribution_metrics(_pairs(spark, sf_dir))


@register("eval_distribution_rule", _rule_pairs_with() + _dist_sql("rule_pairs"))
def q_eval_distribution_rule(spark, sf_dir):
    return EV.distribution_metrics(rule_pairs(spark, sf_dir))


def _bus_sql(src: str) -> str:
    return f"""
SELECT round(CASE WHEN n > 0 THEN (tp + fp) / n ELSE 0.0 END, 9) AS approval_rate,
       tp AS profitable_loans_approved, fp AS unprofitable_loans_approved,
       fn AS profitable_loans_rejected, tn AS unprofitable_loans_rejected,
       (tp * 5000 + tn * 100)::DOUBLE AS estimated_total_profit_inr,
       (fp * 50000 + fn * 1000)::DOUBLE AS estimated_total_cost_inr,
       (tp * 5000 + tn * 100 - fp * 50000 - fn * 1000)::DOUBLE AS estimated_net_profit_inr,
       round(CASE WHEN n > 0 THEN (tp * 5000 + tn * 100 - fp * 50000 - fn * 1000) / n ELSE 0.0 END, 9)
         AS profit_per_application_inr,
       round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END, 9) AS false_positive_rate,
       round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0.0 END, 9) AS false_negative_rate
FROM (SELECT *, tp + fp + fn + tn AS n FROM {_CONF.format(src=src)})"""


@register("eval_business", cte(P) + _bus_sql(P))
def q_eval_business(spark, sf_dir):
    return EV.business_metrics(_pairs(spark, sf_dir))


HIST_SQL = cte(P) + """
SELECT series, bin, round(lo + bin * w, 9) AS bin_start, round(lo + (bin + 1) * w, 9) AS bin_end,
       count(*) AS count, round(count(*) / (n * w), 9) AS density
FROM (SELECT series, x, lo, hi, n,
             CASE WHEN hi = lo THEN 1.0 ELSE (hi - lo) / 30 END AS w,
             CAST(CASE WHEN hi = lo THEN 0 ELSE least(29, floor((x - lo) * 30 / (hi - lo))) END AS INT) AS bin
      FROM (SELECT 'y_true' AS series, y_true AS x FROM eval_pairs
            UNION ALL SELECT 'y_pred', y_pred FROM eval_pairs) u
      JOIN (SELECT 'y_true' AS s, min(y_true) AS lo, max(y_true) AS hi, count(y_true) AS n FROM eval_pairs
            UNION ALL SELECT 'y_pred', min(y_pred), max(y_pred), count(y_pred) FROM eval_pairs) r ON u.series = r.s)
GROUP BY series, bin, lo, hi, n, w"""


@register("score_histogram", HIST_SQL)
def q_score_histogram(spark, sf_dir):
    return EV.histogram(_pairs(spark, sf_dir))


RESID_SQL = cte(P) + "SELECT id, y_true, y_pred, round(y_true - y_pred, 9) AS residual FROM eval_pairs"


@register("residual_points", RESID_SQL)
def q_residual_points(spark, sf_dir):
    return EV.residual_points(_pairs(spark, sf_dir))


COMPARE_METRICS = ["rmse", "r2", "f1", "roc_auc_missing", "approval_rate"]

COMPARE_SQL = _rule_pairs_with(views=("predictions", P), extra=[
    ("reg_e", _reg_sql(P)), ("cls_e", _cls_sql(P)), ("bus_e", _bus_sql(P)),
    ("reg_r", _reg_sql("rule_pairs")), ("cls_r", _cls_sql("rule_pairs")),
    ("bus_r", _bus_sql("rule_pairs"))]) + """
SELECT 'events_model' AS model, reg_e.rmse, reg_e.r2, cls_e.f1, CAST(NULL AS DOUBLE) AS roc_auc_missing,
       bus_e.approval_rate FROM reg_e, cls_e, bus_e
UNION ALL
SELECT 'rule_model', reg_r.rmse, reg_r.r2, cls_r.f1, NULL, bus_r.approval_rate FROM reg_r, cls_r, bus_r"""


@register("compare_models", COMPARE_SQL)
def q_compare_models(spark, sf_dir):
    """EV7: two models x metrics; a metric no group provides stays NULL.

    The pairs of each model are stored: three groups of metrics read them."""
    long_df = EV.metrics_long(stored(_pairs(spark, sf_dir), "pairs"), "events_model").unionByName(
        EV.metrics_long(stored(rule_pairs(spark, sf_dir), "pairs"), "rule_model"))
    return EV.compare_models(long_df, COMPARE_METRICS)


def _report_sql() -> str:
    def f(label, c, digits=4):
        return f"'  {label}: ' || coalesce(format('{{:,.{digits}f}}', {c}), 'n/a')"

    def n(label, c):
        return f"'  {label}: ' || {c}"

    lines = ["'MODEL EVALUATION REPORT'", "'REGRESSION'", f("RMSE", "rmse"), f("MAE", "mae"), f("R2", "r2"), f("MAPE (%)", "mape", 2),
             f("Max error", "max_error"), f("Mean prediction", "mean_prediction"), f("Std prediction", "std_prediction"),
             "'CLASSIFICATION'", f("Precision", "precision"), f("Recall", "recall"), f("F1", "f1"), f("Accuracy", "accuracy"),
             f("Specificity", "specificity"), f("NPV", "npv"), f("ROC AUC", "roc_auc"),
             n("TP", "tp"), n("FP", "fp"), n("FN", "fn"), n("TN", "tn"),
             "'DISTRIBUTION'", f("Residual mean", "residual_mean"), f("Residual std", "residual_std"),
             f("Residual skewness", "residual_skewness"), f("Residual kurtosis", "residual_kurtosis"), f("True mean", "true_mean"),
             f("True std", "true_std"), f("Predicted mean", "pred_mean"), f("Predicted std", "pred_std"),
             *[f(x.upper(), x) for x in ("p10", "p25", "p50", "p75", "p90")],
             "'BUSINESS'", f("Approval rate", "approval_rate"), n("Profitable approved", "profitable_loans_approved"),
             n("Unprofitable approved", "unprofitable_loans_approved"), n("Profitable rejected", "profitable_loans_rejected"),
             n("Unprofitable rejected", "unprofitable_loans_rejected"), f("Total profit (INR)", "estimated_total_profit_inr", 2),
             f("Total cost (INR)", "estimated_total_cost_inr", 2), f("Net profit (INR)", "estimated_net_profit_inr", 2),
             f("Profit per application (INR)", "profit_per_application_inr", 2), f("False positive rate", "false_positive_rate"),
             f("False negative rate", "false_negative_rate")]
    return cte(P, extra=[("reg", _reg_sql(P)), ("cls", _cls_sql(P)), ("auc", _auc_sql(P)), ("dist", _dist_sql(P)),
                         ("bus", _bus_sql(P))]) + f"""
SELECT round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 4) AS r2, round(mape, 2) AS mape, round(max_error, 4) AS max_error,
       round(mean_prediction, 4) AS mean_prediction, round(std_prediction, 4) AS std_prediction,
       round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, round(accuracy, 4) AS accuracy,
       round(specificity, 4) AS specificity, round(npv, 4) AS npv, round(roc_auc, 4) AS roc_auc, tp, fp, fn, tn,
       round(residual_mean, 4) AS residual_mean, round(residual_std, 4) AS residual_std,
       round(residual_skewness, 4) AS residual_skewness, round(residual_kurtosis, 4) AS residual_kurtosis,
       round(true_mean, 4) AS true_mean, round(true_std, 4) AS true_std, round(pred_mean, 4) AS pred_mean, round(pred_std, 4) AS pred_std,
       round(p10, 4) AS p10, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75, round(p90, 4) AS p90,
       round(approval_rate, 4) AS approval_rate, profitable_loans_approved, unprofitable_loans_approved, profitable_loans_rejected,
       unprofitable_loans_rejected, round(estimated_total_profit_inr, 2) AS estimated_total_profit_inr,
       round(estimated_total_cost_inr, 2) AS estimated_total_cost_inr, round(estimated_net_profit_inr, 2) AS estimated_net_profit_inr,
       round(profit_per_application_inr, 2) AS profit_per_application_inr,
       round(false_positive_rate, 4) AS false_positive_rate, round(false_negative_rate, 4) AS false_negative_rate,
       concat_ws(chr(10), {", ".join(lines)}) AS report
FROM reg, cls, auc, dist, bus"""


@register("evaluation_report", _report_sql())
def q_evaluation_report(spark, sf_dir):
    """EV8: every figure of the four groups and the text report of them, one row."""
    return EV.evaluation_report(_pairs(spark, sf_dir))
