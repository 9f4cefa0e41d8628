"""Distributed training and scoring with Spark ML.

The reference's boosted-tree regressor becomes ``GBTRegressor`` inside a
``Pipeline`` (``VectorAssembler`` -> GBT).  Training input is checkpointed
(reliably, into the cluster's checkpoint folder) so the boosting iterations
do not recompute the feature plan.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import time
from dataclasses import dataclass

import pyspark
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import checkpoint_dir, scratch_path
from .model_store import ModelStore
from .scoring import clip_score, confidence, decide
from .treeshap import saved_trees

VALIDATION_PCT = 20        # of the training rows, by key
PATIENCE = 50              # trees that must lower the validation error
TOLERANCE = 0.05           # by this share of it, or boosting ends
STAGES = (192, 384)        # trees fitted before the validation error is looked at
STAGED_ROWS = 50_000       # training rows beyond which all trees are fitted at once
PARTITION_ROWS = 50_000    # training rows of a partition, about
CURVE = "tree int, validation_rmse double"


def split_flag(key: str, train_pct: int = 80, salt: int = 11) -> F.Column:
    """M1: deterministic, partition-independent split: ``(key*37 + salt) % 100 < train_pct``."""
    return F.when(F.pmod(F.col(key) * 37 + salt, F.lit(100)) < train_pct, F.lit("train")).otherwise(F.lit("test"))


def gbt_pipeline(features: list[str], label: str = "label", max_iter: int | None = None, **overrides) -> Pipeline:
    """M2: assembler + GBT with the reference's hyper-parameters mapped to
    Spark ML (depth 5 ~ 31 leaves; no L1/L2 in Spark's learner)."""
    params = {**K.GBT_DEFAULTS, "validationTol": 0.0, **overrides}
    if max_iter is not None:
        params["maxIter"] = max_iter
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    gbt = GBTRegressor(featuresCol="features", labelCol=label, predictionCol="raw_prediction", **params)
    return Pipeline(stages=[assembler, gbt])


@dataclass
class Fitted:
    """A model and how it came about: root mean squared validation error after each tree
    (empty without held-out rows), trees of the stage at which boosting ended, and trees kept."""

    model: PipelineModel
    curve: list[float]
    n_fitted: int
    n_kept: int


def _without_trees(features: list[str]) -> PipelineModel:
    """The model of no rows: it predicts 0."""
    empty = SQLTransformer(statement="SELECT *, CAST(0 AS DOUBLE) AS raw_prediction FROM __THIS__")
    return PipelineModel([VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), empty])


def _first_trees(model: PipelineModel, n: int) -> PipelineModel:
    """The same model with its first ``n`` trees."""
    assembler, gbt = model.stages
    jvm, gateway = SparkSession.getActiveSession()._jvm, SparkSession.getActiveSession().sparkContext._gateway
    package = jvm.org.apache.spark.ml.regression
    trees, weights = gateway.new_array(package.DecisionTreeRegressionModel, n), gateway.new_array(jvm.double, n)
    all_trees, all_weights = gbt._java_obj.trees(), gbt._java_obj.treeWeights()
    for i in range(n):
        trees[i], weights[i] = all_trees[i], all_weights[i]
    cut = package.GBTRegressionModel(f"{gbt.uid}-{n}", trees, weights, gbt.numFeatures)
    cut.setFeaturesCol("features")
    cut.setPredictionCol("raw_prediction")
    cut = GBTRegressionModel(cut)
    cut._resetUid(cut._java_obj.uid())
    cut._transfer_params_from_java()
    return PipelineModel([assembler, cut])


def _stalled(errors: list[float], patience: int, tolerance: float) -> bool:
    """Whether any ``patience`` trees lowered the error (squared) by less than ``tolerance`` of its root."""
    return any(min(errors[i:i + patience]) >= min(errors[:i]) * (1.0 - tolerance) ** 2 for i in range(1, len(errors) - patience + 1))


def fit_staged(train: DataFrame, features: list[str], label: str = "label", key: str = "applicant_id", max_iter: int | None = None,
               patience: int = PATIENCE, tolerance: float = TOLERANCE, **overrides) -> Fitted:
    """M2: boosting that ends when ``patience`` trees lowered the validation error by
    less than ``tolerance`` of it (0: not at all); the model keeps the trees up to the best one.

    Trees are fitted in stages of growing number (Spark's learner has no warm start; its seeds make a
    shorter fit the beginning of a longer one).  After a stage, one pass over the held-out rows
    sums the errors of all its trees' running predictions.  Few rows stall early; with more than
    ``STAGED_ROWS`` the largest number is fitted right away, for earlier stages would be fitted again, and boosting ends at
    the same stage, looked up in the curve.  Rows are dealt into ranges of hash and
    sorted within, and their number sets that of the partitions: the model depends on the rows, and not
    on their layout or on the number of cores.  Rows without a label don't count; no rows give a model that predicts 0,
    and without held-out rows all trees stay.
    """
    most = max_iter or overrides.pop("maxIter", K.GBT_DEFAULTS["maxIter"])
    held = F.pmod(F.xxhash64(key), F.lit(100)) < VALIDATION_PCT
    data = train.where(F.col(label).isNotNull()).select(key, *features, F.col(label).cast("double").alias("label"), held.alias("held"))
    rows = data.groupBy("held").count().collect()
    n = {r.held: r["count"] for r in rows}
    if not n:
        return Fitted(_without_trees(features), [], 0, 0)
    both = len(n) == 2
    checkpoint_dir(train.sparkSession)
    data = data.repartition(max(2, math.ceil(sum(n.values()) / PARTITION_ROWS)), key).sortWithinPartitions(key).checkpoint()
    learn = data.where("not held") if both else data
    stages = [s for s in STAGES if s < most] + [most] if both else [most]
    for fitted in stages if sum(n.values()) <= STAGED_ROWS else stages[-1:]:
        model = gbt_pipeline(features, "label", fitted, **overrides).fit(learn)
        if not both:
            return Fitted(model, [], fitted, fitted)
        errors = model.stages[-1].evaluateEachIteration(model.stages[0].transform(data.where("held")), "squared")
        stage = next((s for s in stages if s < fitted and _stalled(errors[:s], patience, tolerance)), fitted)
        if stage < fitted or _stalled(errors, patience, tolerance):
            break
    errors = errors[:stage]
    best = min(range(stage), key=lambda i: errors[i]) + 1
    kept = model if best == fitted else _first_trees(model, best)
    return Fitted(kept, [math.sqrt(e) for e in errors], stage, best)


def fit(train: DataFrame, features: list[str], label: str = "label", key: str = "applicant_id",
        max_iter: int | None = None, **overrides) -> PipelineModel:
    """The model of ``fit_staged``."""
    return fit_staged(train, features, label, key, max_iter, **overrides).model


def score(model: PipelineModel, df: DataFrame, features: list[str], keep=()) -> DataFrame:
    """M4 / M5 / M7: predict, clip to [0, 1], decision, confidence; ids kept."""
    out = model.transform(df.select(*keep, *features))
    s = clip_score(F.col("raw_prediction"))
    return out.select(*keep, s.alias("score"), decide(s).alias("decision"),
                      confidence(features).alias("confidence"))


def ensemble(model: PipelineModel):
    """The trees' stage, None for the model of no rows."""
    return model.stages[-1] if hasattr(model.stages[-1], "treeWeights") else None


def importances(model: PipelineModel, features: list[str]) -> dict[str, float]:
    """Split-gain importance of each feature (0 without trees)."""
    gbt = ensemble(model)
    return dict(zip(features, map(float, gbt.featureImportances.toArray()))) if gbt else dict.fromkeys(features, 0.0)


def feature_importance(spark, model: PipelineModel, features: list[str], top_n: int | None = None) -> DataFrame:
    """M3: split-gain importances zipped to names (bounded by the feature count)."""
    df = spark.createDataFrame(list(importances(model, features).items()), "feature string, importance double")
    df = df.orderBy(F.col("importance").desc(), F.col("feature"))
    return df.limit(top_n) if top_n else df


def model_info(spark, model: PipelineModel, features: list[str], metadata: dict | None = None) -> DataFrame:
    """M11."""
    gbt = ensemble(model)
    return spark.createDataFrame(
        [(len(features), ",".join(features), int(gbt.getNumTrees) if gbt else 0, int(gbt.totalNumNodes) if gbt else 0,
          json.dumps(metadata or {}, sort_keys=True))],
        "n_features int, feature_names string, n_trees int, total_nodes int, metadata string")


def save_model(model: PipelineModel, path: str, features: list[str], metadata: dict | None = None, key: str | None = None,
               curve: list[float] | None = None) -> str:
    """Save a version below ``path`` and commit it: first the model, its importances and
    validation curve as tables, then the version's number.  Until that is written, readers see the version before."""
    store = ModelStore(SparkSession.getActiveSession(), path)
    artefact = store.new_name()
    save_parts(store.spark, model, f"{store.root}/{artefact}", features, curve or [])
    store.commit(artefact, key=key, feature_names=features, metadata=metadata or {})
    return f"{store.root}/{artefact}"


def save_parts(spark, model: PipelineModel, path: str, features: list[str], curve: list[float]) -> None:
    model.write().save(path + "/model")
    feature_importance(spark, model, features).coalesce(1).write.parquet(path + "/importance")
    rows = [(i + 1, e) for i, e in enumerate(curve)]
    spark.createDataFrame(rows, CURVE).coalesce(1).write.parquet(path + "/curve")


def load_model(path: str, version: str | None = None) -> PipelineModel:
    """The named version below ``path``, or the newest that was committed."""
    store = ModelStore(SparkSession.getActiveSession(), path)
    if version is None:
        newest = store.latest()
        if newest is None:
            raise FileNotFoundError(f"no model version below {path}")
        version = newest["artefact"]
    return PipelineModel.load(f"{store.root}/{version}/model")


def model_path(spark, name: str) -> str:
    """Below the folder that ``altscore.models`` names, else in the shared folder."""
    root = spark.conf.get("altscore.models", "")
    return f"{root.rstrip('/')}/{name}" if root else scratch_path(spark, os.path.join("models", name))


@dataclass
class Registered:
    """A committed model: where it lies, and what was noted when it was fitted."""

    model: PipelineModel
    path: str
    notes: dict

    def curve(self) -> DataFrame:
        """tree, validation_rmse."""
        return SparkSession.getActiveSession().read.schema(CURVE).parquet(self.path + "/curve")

    def trees(self) -> list:
        """As ``treeshap.extract_trees``, from the stored nodes."""
        gbt = ensemble(self.model)
        return saved_trees(SparkSession.getActiveSession(), f"{self.path}/model/stages/1_{gbt.uid}", gbt.treeWeights) if gbt else []


_LOADED: dict[tuple[str, str], Registered] = {}


def fingerprint(train: DataFrame, features: list[str], label: str, key: str, params: dict) -> str:
    """Hash of what a model follows from: the rows (in any order), the parameters and this code."""
    h = F.xxhash64(F.col(key).cast("string"), *[F.col(c).cast("double") for c in features], F.col(label).cast("double"))
    rows = train.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    with open(__file__, "rb") as f:
        code = hashlib.sha256(f.read()).hexdigest()
    what = [list(map(str, rows)), features, label, key, sorted(map(str, params.items())), code, pyspark.__version__]
    return hashlib.sha256(json.dumps(what).encode()).hexdigest()


def fit_once(train: DataFrame, features: list[str], label: str = "label", key: str = "applicant_id", path: str | None = None, **params) -> Registered:
    """The model of these rows, parameters and code: loaded if it was committed below ``path``, else fitted and committed.

    Two that fit the same model at once both commit; the first version counts.
    """
    spark = train.sparkSession
    store = ModelStore(spark, path or model_path(spark, "registry"))
    k = fingerprint(train, features, label, key, params)
    note = store.find(k)
    if note is None:
        t = time.time()
        fitted = fit_staged(train, features, label, key, **params)
        notes = {"n_fitted": fitted.n_fitted, "n_kept": fitted.n_kept, "fit_seconds": round(time.time() - t, 3)}
        save_model(fitted.model, store.root, features, notes, key=k, curve=fitted.curve)
        note = store.find(k)
    where = f"{store.root}/{note['artefact']}"
    slot = (spark.sparkContext.applicationId, where)
    if slot not in _LOADED:
        _LOADED.clear()
        _LOADED[slot] = Registered(PipelineModel.load(where + "/model"), where, note["metadata"])
    return _LOADED[slot]
