"""EV8: the whole report, its figures and its text; pairs with one class, one pair, none."""

import re

import numpy as np

from altscore.operators import evaluate as EV


def _report(spark, rows):
    return EV.evaluation_report(spark.createDataFrame(rows, "y_true double, y_pred double")).collect()[0]


def test_figures_equal_plain_ones_and_stand_in_the_text(spark):
    r = np.random.default_rng(2)
    t = r.random(300)
    p = np.clip(t + r.normal(0, 0.2, 300), 0, 1)
    got = _report(spark, [(float(a), float(b)) for a, b in zip(t, p)])
    tb, pb = t > 0.6, p > 0.6
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in p[tb] for b in p[~tb]])
    plain = {"rmse": np.sqrt(np.mean((t - p) ** 2)), "max_error": np.max(np.abs(t - p)), "accuracy": np.mean(tb == pb),
             "roc_auc": auc, "tp": np.sum(tb & pb), "fn": np.sum(tb & ~pb), "residual_mean": np.mean(t - p),
             "pred_std": np.std(p), "p25": np.quantile(p, 0.25), "approval_rate": np.mean(pb)}
    for name, value in plain.items():
        assert abs(got[name] - value) < 6e-5, name
    lines = dict(re.findall(r"^  (.+): (.+)$", got.report, re.M))
    shown = {c: lines[label] for _, figures in EV.REPORT for label, c, _ in figures}
    assert len(lines) == len(shown) == len(got) - 1
    for c, text in shown.items():
        assert float(text.replace(",", "")) == got[c], c


def test_one_class_one_pair_and_none(spark):
    one = _report(spark, [(0.9, 0.8), (0.7, 0.9)])
    assert one.roc_auc == 0.0 and one.precision == 1.0 and "Residual skewness: n/a" in one.report
    assert _report(spark, [(0.2, 0.9)]).fp == 1
    none = _report(spark, [])
    assert none.rmse is None and none.tp == 0 and none.approval_rate == 0.0
    assert "RMSE: n/a" in none.report and "P50: n/a" in none.report and "TP: 0" in none.report
