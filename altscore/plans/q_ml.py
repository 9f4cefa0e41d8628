"""§2.6 training / scoring and §2.8 explanation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.expr import rnd
from ..operators import evaluate as EV
from ..operators import explain as X
from ..operators import ml as ML
from ..operators import quality as Q
from ..operators import scoring as S
from ..operators.ordered import exact_quantiles
from ..session import stored
from ..sources import views as V
from .features import FEATURE_NAMES, feature_matrix
from .oracle_views import cte
from .q_scoring import DECISION_SQL, _SCORE_SQL, _SUBSCORE_SQL, scored_applicants
from .registry import register



def training_frame(spark, sf_dir):
    """Feature matrix + label (rule score in 0-1 units) + split flag, stored:
    the model is fitted on it and then applied to it."""
    ledger, apps = V.ledger(spark, sf_dir), V.applicants(spark, sf_dir)
    fm = feature_matrix(apps, ledger, keep=S.SCORE_INPUTS, keep_raw=S.TOTALS)
    lab = S.weighted(S.subscores_from_totals(fm, keep=FEATURE_NAMES))
    return stored(lab.select("applicant_id", *FEATURE_NAMES,
                             (F.col("profitability_score") / 100.0).alias("label"),
                             ML.split_flag("applicant_id").alias("split")), "training")


def registered_model(tf):
    """M2: the GBT of the train split, fitted once for all queries."""
    return ML.fit_once(tf.filter(F.col("split") == "train"), FEATURE_NAMES, "label")


def trained_model(tf):
    return registered_model(tf).model


@register("train_test_split", cte("applicants") + """
SELECT applicant_id, CASE WHEN ((applicant_id * 37 + 11) % 100) < 80 THEN 'train' ELSE 'test' END AS split
FROM applicants""")
def q_train_test_split(spark, sf_dir):
    """M1: deterministic 80/20 split by key."""
    return V.applicants(spark, sf_dir).select("applicant_id", ML.split_flag("applicant_id").alias("split"))


@register("gbt_fit")
def q_gbt_fit(spark, sf_dir):
    """M2 + M11: fit on the train split; model summary row with the trees
    fitted and kept, and the validation error after each tree."""
    r = registered_model(training_frame(spark, sf_dir))
    curve = r.curve().agg(F.array_sort(F.collect_list(F.struct("tree", "validation_rmse"))).alias("c"))     # a row per tree
    info = ML.model_info(spark, r.model, FEATURE_NAMES, {"label": "profitability_score/100", "split": "80/20"})
    return info.withColumn("trees_fitted", F.lit(r.notes["n_fitted"])).withColumn("_k", F.lit(1)).join(
        curve.select(F.col("c.validation_rmse").alias("validation_curve"), F.lit(1).alias("_k")), "_k").drop("_k")


@register("training_curve")
def q_training_curve(spark, sf_dir):
    """M2: the stored validation error after each tree, and whether the tree is kept."""
    r = registered_model(training_frame(spark, sf_dir))
    return r.curve().withColumn("kept", F.col("tree") <= r.notes["n_kept"])


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    """M3: top-20 importances (they sum to 1 over all features)."""
    return ML.feature_importance(spark, trained_model(training_frame(spark, sf_dir)), FEATURE_NAMES, 20)


@register("gbt_transform")
def q_gbt_transform(spark, sf_dir):
    """M4 + M7: score every applicant; ids carried through the plan."""
    tf = training_frame(spark, sf_dir)
    return ML.score(trained_model(tf), tf, FEATURE_NAMES, keep=["applicant_id"])


@register("score_single")
def q_score_single(spark, sf_dir):
    """M5: the same plan on a one-row frame (lowest applicant id)."""
    apps, ledger = V.applicants(spark, sf_dir), V.ledger(spark, sf_dir)
    who = apps.agg(F.min("applicant_id")).first()[0]
    # the key is filtered before the features are built, and reaches the scans
    one = feature_matrix(apps.filter(F.col("applicant_id") == who), ledger.filter(F.col("applicant_id") == who))
    return ML.score(trained_model(training_frame(spark, sf_dir)), one, FEATURE_NAMES, keep=["applicant_id"])


@register("model_info")
def q_model_info(spark, sf_dir):
    """M11."""
    return ML.model_info(spark, trained_model(training_frame(spark, sf_dir)), FEATURE_NAMES)


@register("train_evaluate")
def q_train_evaluate(spark, sf_dir):
    """Features -> split -> fit -> evaluate on the test split (metrics row)."""
    tf = training_frame(spark, sf_dir)
    model = trained_model(tf)
    test = tf.filter(F.col("split") == "test")
    pred = model.transform(test.select("applicant_id", "label", *FEATURE_NAMES)).select(
        F.col("label").alias("y_true"), S.clip_score(F.col("raw_prediction")).alias("y_pred"))
    return EV.regression_metrics(pred)


@register("model_io", cte("applicants") + """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE applicant_id IS NULL) AS n_mismatch FROM applicants""")
def q_model_io(spark, sf_dir):
    """Save two versions, load the latest, and compare predictions: every
    applicant scored, no prediction changed by the round trip."""
    tf = training_frame(spark, sf_dir)
    model = trained_model(tf)
    path = ML.model_path(spark, f"gbt-{uuid.uuid4().hex}")
    ML.save_model(model, path, FEATURE_NAMES)
    ML.save_model(model, path, FEATURE_NAMES)
    again = ML.load_model(path)
    a = ML.score(model, tf, FEATURE_NAMES, keep=["applicant_id"]).select("applicant_id", F.col("score").alias("a"))
    b = ML.score(again, tf, FEATURE_NAMES, keep=["applicant_id"]).select("applicant_id", F.col("score").alias("b"))
    return a.join(b, "applicant_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                         F.count_if(F.col("a") != F.col("b")).alias("n_mismatch"))


@register("train_pipeline", cte("applicants") + """
SELECT count(*) AS n_applicants, count(*) FILTER (WHERE ((applicant_id * 37 + 11) % 100) < 80) AS n_train,
       count(*) FILTER (WHERE ((applicant_id * 37 + 11) % 100) >= 80) AS n_test, count(*) AS n_scored,
       count(*) FILTER (WHERE applicant_id IS NULL) AS n_score_outside, count(*) FILTER (WHERE applicant_id IS NULL) AS n_wrong_decision,
       count(*) FILTER (WHERE applicant_id IS NULL) AS n_changed_by_reload, count(*) FILTER (WHERE applicant_id IS NULL) AS n_not_additive,
       true AS importance_sums_to_one, true AS better_than_the_mean FROM applicants""")
def q_train_pipeline(spark, sf_dir):
    """Load, features, split, train, evaluate, importance, save, load,
    score and explain in one run; each step leaves a fact that can be checked
    against a second computation."""
    from ..operators import treeshap as TS
    tf = training_frame(spark, sf_dir)
    fitted = registered_model(tf)
    model = fitted.model
    path = ML.model_path(spark, f"pipeline-{uuid.uuid4().hex}")
    ML.save_model(model, path, FEATURE_NAMES)
    again = ML.load_model(path)
    raw = model.transform(tf.select("applicant_id", "split", "label", *FEATURE_NAMES)).drop("features")
    test = raw.filter(F.col("split") == "test")
    facts = EV.regression_metrics(test.select(F.col("label").alias("y_true"), F.col("raw_prediction").alias("y_pred")))
    facts = facts.select((F.col("r2") > 0).alias("better_than_the_mean"),
                         F.lit(abs(sum(ML.importances(model, FEATURE_NAMES).values()) - 1) < 1e-9).alias("importance_sums_to_one"))
    a = ML.score(model, tf, FEATURE_NAMES, keep=["applicant_id"])
    b = ML.score(again, tf, FEATURE_NAMES, keep=["applicant_id"]).select("applicant_id", F.col("score").alias("again"))
    # the decision once more, from the raw prediction by plain arithmetic
    plain = raw.select("applicant_id", "split", (F.least(F.greatest(F.col("raw_prediction"), F.lit(0.0)), F.lit(1.0)) > 0.6).alias("yes"))
    scored = a.join(b, "applicant_id").join(plain, "applicant_id").agg(
        F.count(F.lit(1)).alias("n_applicants"), F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"), F.count("score").alias("n_scored"),
        F.count_if((F.col("score") < 0) | (F.col("score") > 1)).alias("n_score_outside"),
        F.count_if((F.col("decision") == "approve") != F.col("yes")).alias("n_wrong_decision"),
        F.count_if(F.col("score") != F.col("again")).alias("n_changed_by_reload"))
    explained = TS.explain(raw.drop("split", "label"), FEATURE_NAMES, fitted.trees(), "applicant_id",
                           raw_col="raw_prediction").agg(F.count_if(F.col("additivity_error") > 1e-6).alias("n_not_additive"))
    # one row each, joined on a constant key
    one = [x.withColumn("_k", F.lit(1)) for x in (scored, facts, explained)]
    return one[0].join(one[1], "_k").join(one[2], "_k").drop("_k")


# ---------------------------------------------------------------- M6, M8-M10
_VALID = " AND ".join(f"coalesce({r}, false)" for r in R.ALL_APPLICATION_RULES.values())


@register("batch_result", cte("loan_applications") + f"""
SELECT user_id AS batch_id, concat('BATCH_', upper(substr(md5(CAST(user_id AS VARCHAR)), 1, 12))) AS batch_code,
       count(*) AS total_applications, count(*) FILTER (WHERE {_VALID}) AS successful,
       count(*) FILTER (WHERE NOT ({_VALID})) AS failed
FROM loan_applications GROUP BY user_id""")
def q_batch_result(spark, sf_dir):
    """M6: per batch (a user's applications): totals, successes, failures
    (failures = applications failing validation)."""
    v = Q.validate(V.loan_applications(spark, sf_dir), R.ALL_APPLICATION_RULES, "application_id", keep=["user_id"])
    return v.groupBy(F.col("user_id").alias("batch_id")).agg(
        F.count(F.lit(1)).alias("total_applications"), F.count_if("is_valid").alias("successful"),
        F.count_if(~F.col("is_valid")).alias("failed")).withColumn(
        "batch_code", F.concat(F.lit("BATCH_"), F.upper(F.substring(F.md5(F.col("batch_id").cast("string")), 1, 12))))


RANK_SQL = cte("ledger", "applicants", extra=[("sub", _SUBSCORE_SQL), ("sc", _SCORE_SQL)]) + """
SELECT * FROM (SELECT 'top' AS kind, row_number() OVER (ORDER BY profitability_score DESC, applicant_id) AS rank,
                      applicant_id, profitability_score FROM sc) WHERE rank <= 5
UNION ALL
SELECT * FROM (SELECT 'bottom' AS kind, row_number() OVER (ORDER BY profitability_score ASC, applicant_id) AS rank,
                      applicant_id, profitability_score FROM sc) WHERE rank <= 5"""


@register("rank_applications", RANK_SQL)
def q_rank_applications(spark, sf_dir):
    """M8: top 5 and bottom 5 by score (global top-k, tie-break id)."""
    sc = S.profitability_score(V.ledger(spark, sf_dir), V.applicants(spark, sf_dir)).select(
        "applicant_id", "profitability_score")
    top = sc.orderBy(F.col("profitability_score").desc(), "applicant_id").limit(5)
    bot = sc.orderBy(F.col("profitability_score").asc(), "applicant_id").limit(5)

    def ranked(df, kind, asc):
        o = F.col("profitability_score").asc() if asc else F.col("profitability_score").desc()
        # at most 5 rows: the window runs on the limited set
        from pyspark.sql import Window
        return df.select(F.lit(kind).alias("kind"),
                         F.row_number().over(Window.orderBy(o, "applicant_id")).cast("bigint").alias("rank"),
                         "applicant_id", "profitability_score")
    return ranked(top, "top", False).unionByName(ranked(bot, "bottom", True))


BATCH_SUMMARY_SQL = DECISION_SQL.rsplit("\nSELECT fm.applicant_id,", 1)[0] + """,
sd AS (SELECT fm.applicant_id""" + DECISION_SQL.rsplit("\nSELECT fm.applicant_id", 1)[1] + """)
SELECT count(*) AS n, count(*) FILTER (WHERE decision = 'approve') AS approvals,
       count(*) FILTER (WHERE decision = 'reject') AS rejections,
       round(count(*) FILTER (WHERE decision = 'approve') / count(*) * 100, 9) AS approval_pct,
       round(avg(score), 9) AS mean_score, round(avg(confidence), 9) AS mean_confidence,
       min(score) AS min_score, max(score) AS max_score,
       round(quantile_cont(score, 0.25), 9) AS p25, round(quantile_cont(score, 0.5), 9) AS p50,
       round(quantile_cont(score, 0.75), 9) AS p75
FROM sd"""


@register("batch_summary", BATCH_SUMMARY_SQL)
def q_batch_summary(spark, sf_dir):
    """M9: counts by decision, approval %, mean score / confidence, min / max
    and exact quartiles of the score."""
    sd = stored(scored_applicants(spark, sf_dir), "scored")       # read for the counts, the ranks and the total
    agg = sd.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "approve").alias("approvals"),
                 F.count_if(F.col("decision") == "reject").alias("rejections"),
                 rnd(F.count_if(F.col("decision") == "approve") / F.count(F.lit(1)) * 100, 9).alias("approval_pct"),
                 rnd(F.avg("score"), 9).alias("mean_score"), rnd(F.avg("confidence"), 9).alias("mean_confidence"),
                 F.min("score").alias("min_score"), F.max("score").alias("max_score"))
    q = exact_quantiles(sd, "score", [0.25, 0.5, 0.75])
    q = q.select(*[rnd(F.col(c), 9).alias(c) for c in q.columns])
    return agg.withColumn("_k", F.lit(1)).join(q.withColumn("_k", F.lit(1)), "_k").drop("_k")


DATASET_SQL = cte("ledger", "applicants", "loan_applications", extra=[("sub", _SUBSCORE_SQL), ("sc", _SCORE_SQL)]) + """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE sc.profitability_score >= 50) AS n_approved,
       round(count(*) FILTER (WHERE sc.profitability_score >= 50) / count(*), 9) AS approval_rate,
       round(avg(sc.profitability_score), 9) AS mean_score,
       round(sum(loan_amount_requested)::DOUBLE / count(*), 6) AS mean_loan,
       round(sum(monthly_income)::DOUBLE / count(*), 6) AS mean_income
FROM loan_applications la JOIN sc ON la.user_id = sc.applicant_id"""


@register("dataset_summary", DATASET_SQL)
def q_dataset_summary(spark, sf_dir):
    """Rows, approved count / rate, mean score, loan and income."""
    sc = S.profitability_score(V.ledger(spark, sf_dir), V.applicants(spark, sf_dir)).select(
        F.col("applicant_id").alias("user_id"), "profitability_score")
    la = V.loan_applications(spark, sf_dir).select("user_id", "loan_amount_requested", "monthly_income")
    j = la.join(sc, "user_id")
    n = F.count(F.lit(1))
    return j.agg(n.alias("n_rows"), F.count_if(F.col("profitability_score") >= 50).alias("n_approved"),
                 rnd(F.count_if(F.col("profitability_score") >= 50) / n, 9).alias("approval_rate"),
                 rnd(F.avg("profitability_score"), 9).alias("mean_score"),
                 rnd(F.sum("loan_amount_requested").cast("double") / n, 6).alias("mean_loan"),
                 rnd(F.sum("monthly_income").cast("double") / n, 6).alias("mean_income"))


# ---------------------------------------------------------------- X3-X6 on linear SHAP
def _shap(spark, sf_dir):
    return X.linear_shap(S.subscores(V.ledger(spark, sf_dir), V.applicants(spark, sf_dir)))


_W = X.WEIGHTS
_SHAP_LONG = ("shap_long", "SELECT applicant_id, feature, value, round(shap, 9) AS shap, round(base, 9) AS base_value "
              "FROM (" + " UNION ALL ".join(
                  f"SELECT applicant_id, '{c}' AS feature, {c} AS value, {_W[c]!r}::DOUBLE * ({c} - m_{c}) AS shap, "
                  f"base FROM sub, m" for c in S.SUBSCORES) + ")")
_MEANS = ("m", "SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in S.SUBSCORES) + ", " +
          " + ".join(f"{_W[c]!r}::DOUBLE * avg({c})" for c in S.SUBSCORES) + " AS base FROM sub")
_SHAP_WITH = cte("ledger", "applicants", extra=[("sub", _SUBSCORE_SQL), _MEANS, _SHAP_LONG])


@register("linear_shap", _SHAP_WITH + "SELECT * FROM shap_long")
def q_linear_shap(spark, sf_dir):
    """Exact SHAP values of the rule score's five sub-scores."""
    return _shap(spark, sf_dir)


@register("explain_rows", _SHAP_WITH + """
SELECT applicant_id, feature, value, shap, base_value, round(base_value + sum(shap) OVER (PARTITION BY applicant_id), 9)
       AS prediction, row_number() OVER (PARTITION BY applicant_id ORDER BY abs(shap) DESC, feature) AS rank
FROM shap_long""")
def q_explain_rows(spark, sf_dir):
    """X1 / X2 on the linear model: per-row contributions with prediction."""
    return X.explain_rows(_shap(spark, sf_dir)).withColumn("rank", F.col("rank").cast("bigint"))


@register("global_importance", _SHAP_WITH + """
SELECT feature, round(avg(abs(shap)), 9) AS mean_abs_shap FROM shap_long GROUP BY feature
ORDER BY mean_abs_shap DESC, feature LIMIT 20""")
def q_global_importance(spark, sf_dir):
    """X3."""
    return X.global_importance(_shap(spark, sf_dir))


@register("dependence_points", _SHAP_WITH + """
SELECT a.applicant_id, a.value, a.shap, b.value AS interaction_value
FROM shap_long a JOIN shap_long b ON a.applicant_id = b.applicant_id
WHERE a.feature = 'expense_score' AND b.feature = 'income_score'""")
def q_dependence_points(spark, sf_dir):
    """Expense sub-score against its SHAP value, coloured by income."""
    wide = X.shap_wide(S.subscores(V.ledger(spark, sf_dir), V.applicants(spark, sf_dir)))
    return X.dependence_points(wide, "expense_score", "income_score")


@register("waterfall_rows", _SHAP_WITH + """
SELECT applicant_id, feature, shap,
       row_number() OVER (PARTITION BY applicant_id ORDER BY abs(shap) DESC, feature) AS step,
       round(base_value + sum(shap) OVER (PARTITION BY applicant_id ORDER BY abs(shap) DESC, feature
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS running_total
FROM shap_long""")
def q_waterfall_rows(spark, sf_dir):
    """X6."""
    return X.waterfall(_shap(spark, sf_dir)).withColumn("step", F.col("step").cast("bigint"))


# ---------------------------------------------------------------- X1-X3 on the GBT
def _tree_explain(spark, sf_dir, top_n=None, with_raw=False):
    from ..operators import treeshap as TS
    tf = training_frame(spark, sf_dir)
    fitted = registered_model(tf)
    trees = fitted.trees()
    if with_raw:
        tf = fitted.model.transform(tf.select("applicant_id", *FEATURE_NAMES)).drop("features")
    return TS.explain(tf, FEATURE_NAMES, trees, "applicant_id", top_n=top_n,
                      raw_col="raw_prediction" if with_raw else None)


@register("explain_model_rows")
def q_explain_model_rows(spark, sf_dir):
    """TreeSHAP of the GBT, top-10 features per applicant with the
    prediction (= base + sum of SHAP) and its decision."""
    r = _tree_explain(spark, sf_dir, top_n=10)
    return r.withColumn("decision", S.decide(S.clip_score(F.col("prediction"))))


@register("dependence_model")
def q_dependence_model(spark, sf_dir):
    """X5 on the GBT: the expense ratio's SHAP value at every applicant, its main
    effect, and the interaction with the partner that the data show to be strongest."""
    from ..operators import treeshap as TS
    tf = training_frame(spark, sf_dir)
    return TS.dependence(tf, FEATURE_NAMES, registered_model(tf).trees(), "applicant_id", "expense_to_income_ratio")


@register("explain_model_batch")
def q_explain_model_batch(spark, sf_dir):
    """Full SHAP matrix rows with the additivity error against the
    model's own raw prediction (tests/test_models.py asserts that it is ~0)."""
    return _tree_explain(spark, sf_dir, with_raw=True)


@register("global_importance_model")
def q_global_importance_model(spark, sf_dir):
    """X3 on the GBT: mean |SHAP| per feature, top 20 (partial aggregation)."""
    m = _tree_explain(spark, sf_dir)
    long_df = m.select(F.posexplode("shap_values").alias("j", "shap"))
    names = F.element_at(F.array(*[F.lit(f) for f in FEATURE_NAMES]), F.col("j") + 1)
    return (long_df.groupBy(names.alias("feature")).agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))
            .orderBy(F.col("mean_abs_shap").desc(), F.col("feature")).limit(20))


@register("model_contributions")
def q_model_contributions(spark, sf_dir):
    """R9 with the model's own importances: value x importance per feature,
    top 10 per applicant by |contribution|."""
    tf = training_frame(spark, sf_dir)
    imp = ML.importances(trained_model(tf), FEATURE_NAMES)
    return S.top_contributions(tf, imp, FEATURE_NAMES, top_n=10).withColumn("rank", F.col("rank").cast("bigint"))
