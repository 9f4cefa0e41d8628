"""Trained models: layout independence, saving, explanations; streams beyond the record limit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from altscore.operators import ml as ML
from altscore.operators import treeshap as TS

from conftest import SF_SMALL

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    d = spark.range(1200).selectExpr("id AS applicant_id", "((id * 37) % 101) / 101.0D AS a", "((id * 53) % 97) / 97.0D AS b",
                                     "((id * 71) % 89) / 89.0D AS c")
    return d.withColumn("label", F.col("a") * F.col("b") + F.sin(F.col("c") * 6) / 4)


@pytest.fixture(scope="module")
def model(frame):
    return ML.fit(frame, FEATURES, max_iter=8)


def test_model_does_not_depend_on_the_layout(frame, model):
    again = ML.fit(frame.orderBy(F.desc("b")).repartition(5), FEATURES, max_iter=8)
    a, b = (sorted(map(tuple, m.transform(frame).select("applicant_id", "raw_prediction").collect())) for m in (model, again))
    assert a == b


def test_defaults_are_the_full_size_with_validation(frame):
    gbt = ML.gbt_pipeline(FEATURES, validationIndicatorCol="validation").getStages()[-1]
    assert gbt.getMaxIter() == 500 and gbt.getValidationTol() == 0.0 and gbt.getValidationIndicatorCol() == "validation"


def test_saved_versions_and_latest(spark, frame, model, tmp_path):
    other = ML.fit(frame, FEATURES, max_iter=2)
    first = ML.save_model(model, str(tmp_path / "m"), FEATURES)
    ML.save_model(other, str(tmp_path / "m"), FEATURES)
    assert ML.load_model(str(tmp_path / "m")).stages[-1].getNumTrees == 2
    old = ML.load_model(str(tmp_path / "m"), first.rsplit("/", 1)[1])
    a, b = (m.transform(frame).agg(F.sum("raw_prediction")).first()[0] for m in (model, old))
    assert a == pytest.approx(b, abs=1e-12)


def test_explanations_add_up_on_a_fitted_model(frame, model):
    trees = TS.extract_trees(model.stages[-1])
    scored = model.transform(frame.select("applicant_id", *FEATURES)).drop("features")
    got = TS.explain(scored, FEATURES, trees, "applicant_id", raw_col="raw_prediction").toPandas()
    assert np.abs(got["additivity_error"]).max() < 1e-9
    assert sum(ML.importances(model, FEATURES).values()) == pytest.approx(1.0)


def test_long_records_are_scored_in_full(spark):
    from altscore.plans.q_scoring import scored_applicants
    from altscore.streaming.jobs import nested_records, stream_score
    assert nested_records(spark, SF_SMALL, limit=40)[1].count() > 0
    want = {r.applicant_id: r for r in scored_applicants(spark, SF_SMALL).collect()}
    got = stream_score(spark, SF_SMALL, limit=40, fmt="json").collect()
    assert len(got) == len(want)
    for r in got:
        assert r.score == pytest.approx(want[r.applicant_id].score, abs=1e-9) and r.decision == want[r.applicant_id].decision


def _one_sided(spark, folder):
    """Tables of three customers: with items, with an order without items, and without orders."""
    at = "timestamp '2024-01-0{} 00:00:00'"
    for name, rows in {
            "customer": "VALUES (1L), (2L), (3L) AS t(c_custkey)",
            "orders": f"VALUES (10L, 1L, 100.0D, {at.format(1)}), (11L, 1L, 50.0D, {at.format(3)}), (12L, 2L, 70.0D, {at.format(2)}) "
                      "AS t(o_orderkey, o_custkey, o_totalprice, o_orderdate)",
            "lineitem": f"VALUES (10L, 5L, 30.0D, {at.format(4)}), (11L, 6L, 20.0D, {at.format(5)}) "
                        "AS t(l_orderkey, l_partkey, l_extendedprice, l_shipdate)"}.items():
        spark.sql(f"SELECT * FROM {rows}").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_stream_scores_applicants_without_transactions(spark, tmp_path):
    from altscore.plans.q_scoring import scored_applicants
    from altscore.streaming.jobs import stream_score
    sf = _one_sided(spark, tmp_path)
    want = {r.applicant_id: r for r in scored_applicants(spark, sf).collect()}
    got = {r.applicant_id: r for r in stream_score(spark, sf).collect()}
    assert set(got) == set(want) == {1, 2, 3}
    for k, r in got.items():
        assert r.score == pytest.approx(want[k].score, abs=1e-9) and r.decision == want[k].decision


def test_detect_input_kind_takes_credits_without_debits(spark, tmp_path):
    from altscore.operators.ledger_features import LEDGER_FEATURES, ledger_features
    from altscore.plans import q_sources as Q
    from altscore.sources import views as V
    sf = _one_sided(spark, tmp_path)
    want = {r.applicant_id: r for r in ledger_features(V.ledger(spark, sf)).collect()}
    got = {r.applicant_id: r for r in Q.q_detect_input_kind(spark, sf).collect()}
    assert set(got) == set(want) == {1, 2}
    for k, r in got.items():
        assert [r[f] for f in LEDGER_FEATURES] == pytest.approx([want[k][f] for f in LEDGER_FEATURES], abs=1e-9)


def test_features_nested_takes_credits_without_debits(spark, tmp_path):
    from altscore.operators.ledger_features import LEDGER_FEATURES, ledger_features
    from altscore.plans import q_features as Q
    from altscore.sources import views as V
    sf = _one_sided(spark, tmp_path)
    want = {r.applicant_id: r for r in ledger_features(V.ledger(spark, sf)).collect()}
    got = {r.applicant_id: r for r in Q.q_features_nested(spark, sf).collect()}
    assert set(got) == set(want) == {1, 2}
    for k, r in got.items():
        assert [r[f] for f in LEDGER_FEATURES] == pytest.approx([want[k][f] for f in LEDGER_FEATURES], abs=1e-9)


def test_sliding_windows_keep_one_count_a_minute(spark, tmp_path, monkeypatch):
    from collections import Counter
    from datetime import datetime, timedelta
    from altscore.streaming import jobs as J
    kept, run_upserts = [], J.run_upserts
    monkeypatch.setattr(J, "run_upserts", lambda *a: kept.append(run_upserts(*a)) or kept[-1])
    spark.sql("""SELECT id AS event_id, timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 37 % 4000) AS ts, id % 3 AS user_id,
                 'view' AS event_type, 1.0D AS value, '{"k": 4}' AS props FROM range(200)""").write.parquet(f"{tmp_path}/events.parquet")
    want, minutes = Counter(), set()
    for i in range(200):
        m = datetime(2024, 1, 1) + timedelta(minutes=i * 37 % 4000 // 60)
        minutes.add((i % 3, m))
        want.update((str(i % 3), m - timedelta(minutes=k)) for k in range(15))
    got = J.stream_sliding_requests(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.client, r.window_start): r.n_requests for r in got} == want
    assert all(r.window_end - r.window_start == timedelta(minutes=15) for r in got)
    assert kept[0].count() == len(minutes)


def test_stream_drops_duplicates_and_nothing_late(spark):
    from altscore.sources.tables import load
    from altscore.streaming.jobs import dedup_run
    rows, dropped, late = dedup_run(spark, SF_SMALL)
    n = load(spark, SF_SMALL, "events").count()
    assert rows.count() == n and dropped == n and late == 0


def test_contributions_are_row_local(spark):
    from altscore.operators import scoring as S
    d = spark.createDataFrame([(1, 2.0, -3.0, 0.0), (2, None, 1.0, 1.0)], "applicant_id long, a double, b double, c double")
    top = S.top_contributions(d, {"a": 1.0, "b": 1.0, "c": 5.0}, FEATURES, top_n=2)
    assert "Exchange" not in top._jdf.queryExecution().executedPlan().toString()
    assert [(r.applicant_id, r["rank"], r.feature) for r in top.collect()] == [(1, 1, "b"), (1, 2, "a"), (2, 1, "c"), (2, 2, "b")]


def test_boosting_stops_with_patience_and_keeps_the_best(frame, monkeypatch):
    """The curve is the plain error of the running predictions; a pause of ``patience`` trees ends boosting."""
    noisy = frame.withColumn("label", F.col("label") + F.sin(F.col("applicant_id") * 12.9898) / 2)
    monkeypatch.setattr(ML, "STAGES", (12, 24, 36))
    got = ML.fit_staged(noisy, FEATURES, patience=4, tolerance=0.0, max_iter=60, stepSize=0.4, minInstancesPerNode=1)
    assert got.n_fitted in (12, 24, 36) and len(got.curve) == got.n_fitted
    best = min(range(got.n_fitted), key=lambda i: got.curve[i]) + 1
    assert got.n_kept == best == got.model.stages[-1].getNumTrees
    stalls = [i for i in range(1, got.n_fitted - 3) if min(got.curve[i:i + 4]) >= min(got.curve[:i])]
    assert stalls and stalls[0] + 4 > got.n_fitted - 12         # not before the last stage
    early = ML.fit_staged(noisy, FEATURES, patience=4, tolerance=0.9, max_iter=60, stepSize=0.4, minInstancesPerNode=1)
    assert early.n_fitted == 12 and early.curve == got.curve[:12]
    held = noisy.where(F.pmod(F.xxhash64("applicant_id"), F.lit(100)) < ML.VALIDATION_PCT).toPandas()
    x, y = held[FEATURES].to_numpy(), held["label"].to_numpy()
    total = np.zeros(len(held))
    for i, (w, leaves) in enumerate(TS.extract_trees(got.model.stages[-1])):
        for value, path in leaves:
            total += w * value * np.prod([(x[:, f] <= t) == left for f, t, left, _ in path], axis=0)
        assert got.curve[i] == pytest.approx(np.sqrt(np.mean((total - y) ** 2)), abs=1e-9)
    whole = ML.gbt_pipeline(FEATURES, max_iter=best, stepSize=0.4, minInstancesPerNode=1)
    assert whole.getStages()[-1].getMaxIter() == best
    assert np.allclose(held.assign(p=total)["p"], [r.raw_prediction for r in got.model.transform(
        frame.sparkSession.createDataFrame(held)).select("raw_prediction").collect()], atol=1e-9)


def test_many_rows_are_fitted_once_and_end_at_the_same_stage(frame, monkeypatch):
    """Beyond ``STAGED_ROWS`` no stage is fitted again; curve, stage and model stay."""
    noisy = frame.withColumn("label", F.col("label") + F.sin(F.col("applicant_id") * 12.9898) / 2)
    monkeypatch.setattr(ML, "STAGES", (8, 16))
    how = dict(patience=4, max_iter=24, stepSize=0.4, minInstancesPerNode=1)
    plain, sizes = ML.gbt_pipeline, []
    monkeypatch.setattr(ML, "gbt_pipeline", lambda *a, **k: sizes.append(a[2]) or plain(*a, **k))
    for tolerance, end in ((0.9, 8), (0.0, None), (-1.0, 24)):
        sizes.clear()
        monkeypatch.setattr(ML, "STAGED_ROWS", 10_000)
        staged = ML.fit_staged(noisy, FEATURES, tolerance=tolerance, **how)
        assert sizes == [s for s in (8, 16, 24) if s <= staged.n_fitted]
        sizes.clear()
        monkeypatch.setattr(ML, "STAGED_ROWS", 1_000)
        once = ML.fit_staged(noisy, FEATURES, tolerance=tolerance, **how)
        assert sizes == [24] and end in (None, once.n_fitted)
        assert (once.n_fitted, once.n_kept, once.curve) == (staged.n_fitted, staged.n_kept, staged.curve)
        assert TS.extract_trees(once.model.stages[-1]) == TS.extract_trees(staged.model.stages[-1])


def test_no_rows_and_no_labels(spark, frame, tmp_path):
    """Nothing to learn from: a model that predicts 0, is saved, loaded, described and explained."""
    for d in (frame.limit(0), frame.withColumn("label", F.lit(None).cast("double"))):
        got = ML.fit_once(d, FEATURES, path=str(tmp_path / "none"))
        assert got.curve().count() == 0 and got.trees() == [] and got.notes["n_fitted"] == 0
        assert [(r.score, r.decision) for r in ML.score(got.model, frame.limit(2), FEATURES).collect()] == [(0.0, "reject")] * 2
        assert ML.model_info(spark, got.model, FEATURES).first().n_trees == 0 and set(ML.importances(got.model, FEATURES).values()) == {0.0}
    one = frame.where("applicant_id = 5")
    assert ML.fit_staged(one, FEATURES, max_iter=2).n_kept == 2


def test_a_model_is_fitted_once(frame, tmp_path, monkeypatch):
    path = str(tmp_path / "registry")
    a = ML.fit_once(frame, FEATURES, path=path, max_iter=3)
    other = ML.fit_once(frame.where("applicant_id < 900"), FEATURES, path=path, max_iter=3)
    more = ML.fit_once(frame, FEATURES, path=path, max_iter=4)
    monkeypatch.setattr(ML, "fit_staged", None)                # nothing is fitted from here on
    ML._LOADED.clear()
    again = ML.fit_once(frame.orderBy(F.desc("b")).repartition(5), FEATURES, path=path, max_iter=3)
    assert again.path == a.path and len({a.path, other.path, more.path}) == 3
    x, y = (sorted(map(tuple, m.model.transform(frame).select("applicant_id", "raw_prediction").collect())) for m in (a, again))
    assert x == y
    assert again.curve().count() == again.notes["n_fitted"] == 3
    slow, fast = TS.extract_trees(again.model.stages[-1]), again.trees()
    assert slow == fast


def test_a_crash_before_the_commit_leaves_the_version_before(spark, frame, model, tmp_path, monkeypatch):
    """Saved but not committed, and a number that was taken and left empty: readers see the old version."""
    from altscore.operators.model_store import ModelStore
    path = str(tmp_path / "m")
    ML.save_model(model, path, FEATURES)
    other = ML.fit(frame, FEATURES, max_iter=2)

    def crash(*args, **more):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(ModelStore, "commit", crash)
        with pytest.raises(RuntimeError):
            ML.save_model(other, path, FEATURES)
    open(f"{path}/_versions/00000002", "w").close()
    assert ML.load_model(path).stages[-1].getNumTrees == model.stages[-1].getNumTrees
    ML.save_model(other, path, FEATURES)
    store = ModelStore(spark, path)
    assert ML.load_model(path).stages[-1].getNumTrees == 2 and [v["version"] for v in store.versions()] == [1, 3]
    assert not store._put(3, "late") and store.commit("x") == 4
    with pytest.raises(FileNotFoundError):
        ML.load_model(str(tmp_path / "nothing"))
