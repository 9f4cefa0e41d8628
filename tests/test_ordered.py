"""Distributed prefix sums / quantiles against numpy; evaluation invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from altscore.operators import evaluate as EV
from altscore.operators.ordered import exact_quantiles, global_cumsum


def test_global_cumsum_matches_numpy(spark):
    rng = np.random.default_rng(1)
    vals = rng.integers(0, 50, 500).tolist()
    df = spark.createDataFrame([(float(i), int(v)) for i, v in enumerate(vals)], "k double, v long")
    got = sorted(global_cumsum(df, "k", ["v"], num_partitions=7).select("k", "cum_v").collect())
    assert [r["cum_v"] for r in got] == np.cumsum(vals).tolist()


@pytest.mark.parametrize("n", [1, 2, 5, 101, 1000])
def test_exact_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=n), 2)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    got = exact_quantiles(df, "x", probs).collect()[0]
    for p, c in zip(probs, got):
        assert c == pytest.approx(float(np.percentile(x, p * 100)), abs=1e-12)


def test_auc_symmetry_and_confusion_total(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(rng.random()), float(np.round(rng.random(), 2))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y_true double, y_pred double")
    a = EV.roc_auc(df).collect()[0][0]
    neg = df.withColumn("y_pred", -F.col("y_pred"))
    b = EV.roc_auc(neg).collect()[0][0]
    assert a + b == pytest.approx(1.0, abs=1e-9)
    c = EV.classification_metrics(df).collect()[0]
    assert c["tp"] + c["fp"] + c["fn"] + c["tn"] == 400


def test_one_class_is_total(spark):
    df = spark.createDataFrame([(1, 0.1, 0.9), (2, 0.2, 0.1)], "id long, y_true double, y_pred double")
    assert EV.roc_auc(df).collect()[0][0] == 0.0
    c = EV.classification_metrics(df).collect()[0]
    assert c["precision"] == 0.0 and c["recall"] == 0.0


def test_keyed_quantiles_match_numpy_including_a_hot_key(spark):
    from altscore.operators.ordered import keyed_exact_quantiles
    rng = np.random.default_rng(5)
    rows = [(0, float(np.round(v, 2))) for v in rng.normal(size=3000)]          # hot key
    for k in range(1, 40):
        rows += [(k, float(np.round(v, 1))) for v in rng.normal(size=int(rng.integers(1, 30)))]
    df = spark.createDataFrame(rows, "k long, x double")
    got = {r["k"]: r for r in keyed_exact_quantiles(df, "k", "x", [0.25, 0.75], ["q1", "q3"]).collect()}
    for k in range(40):
        xs = np.array([x for kk, x in rows if kk == k])
        assert got[k]["q1"] == pytest.approx(float(np.percentile(xs, 25)), abs=1e-12)
        assert got[k]["q3"] == pytest.approx(float(np.percentile(xs, 75)), abs=1e-12)


def test_keyed_cumsum_matches_pandas_with_hot_key(spark):
    import pandas as pd
    from altscore.operators.ordered import keyed_cumsum
    rng = np.random.default_rng(11)
    rows = [(0, i, int(v)) for i, v in enumerate(rng.integers(0, 9, 2000))]       # hot key
    rows += [(k, i, int(rng.integers(0, 9))) for k in range(1, 30) for i in range(int(rng.integers(1, 20)))]
    df = spark.createDataFrame(rows, "k long, o long, v long")
    got = keyed_cumsum(df, "k", ["o"], "v", num_partitions=7).toPandas().sort_values(["k", "o"])
    exp = pd.DataFrame(rows, columns=["k", "o", "v"]).sort_values(["k", "o"])
    exp["cum"] = exp.groupby("k")["v"].cumsum()
    assert got["cum"].tolist() == exp["cum"].tolist()


def test_heavy_applicant_route_gives_identical_features(spark):
    from conftest import SF_SMALL
    from altscore.operators import ledger_features as L
    from altscore.sources import views as V
    led = V.ledger(spark, SF_SMALL)
    a = L.features_from_aggregates(L.raw_aggregates(led)).collect()
    b = L.features_from_aggregates(L.raw_aggregates(led, heavy_rows=0)).collect()
    key = lambda r: r["applicant_id"]
    assert sorted(a, key=key) == sorted(b, key=key)


@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_many_distinct_keys_over_several_ranges(spark, reuse, coalesce):
    """200,000 distinct scores: sampled range bounds, merged partitions and
    exchanges that aren't reused must not change a sum."""
    confs = {"spark.sql.exchange.reuse": reuse, "spark.sql.adaptive.coalescePartitions.enabled": coalesce,
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "300k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "100k"}
    old = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        n = 200_000
        df = spark.range(n).selectExpr("id", "((id * 48271) % 200003) / 200003.0D AS y_pred",
                                       "CASE WHEN (id * 69621) % 1000 < (id * 48271) % 200003 / 400 THEN 1.0D ELSE 0.0D END AS y_true")
        pdf = df.toPandas().sort_values("y_pred")
        pos = pdf.y_true.to_numpy() > 0.6
        ranks = np.arange(1, n + 1)
        auc = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
        assert EV.roc_auc(df).collect()[0][0] == pytest.approx(auc, abs=1e-6)
        got = exact_quantiles(df, "y_pred", [0.1, 0.5, 0.95]).collect()[0]
        assert list(got) == pytest.approx(np.percentile(pdf.y_pred, [10, 50, 95]).tolist(), abs=1e-12)
        from altscore.operators.ordered import keyed_cumsum
        keyed = keyed_cumsum(df.selectExpr("id % 3 AS k", "id AS o", "id % 7 AS v"), "k", ["o"], "v", "cum", num_partitions=16)
        last = {r["k"]: r["m"] for r in keyed.groupBy("k").agg(F.max("cum").alias("m")).collect()}
        assert last == {k: sum(i % 7 for i in range(k, n, 3)) for k in range(3)}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
