"""Features by increments equal the features of the whole ledger."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from altscore.operators.feature_store import FeatureStore
from altscore.operators.ledger_features import LEDGER_FEATURES, ledger_features

SCHEMA = "applicant_id long, ts timestamp, txn_type string, amount decimal(18,2), source string, message string, category string"
T0 = dt.datetime(2024, 1, 1)


def _rows(n, seed, late=False):
    """Rows in the order of time; one applicant holds half of them; null amounts, times and sources."""
    r, out = random.Random(seed), []
    hours = sorted(r.randrange(6000) for _ in range(n))
    for h in hours:
        out.append((1 if r.random() < 0.5 else r.randrange(2, 25), T0 + dt.timedelta(hours=h, minutes=r.randrange(60)), r.choice(["credit", "debit", "debit"]),
                    Decimal(r.choice([500, 1234, 99999, r.randrange(100, 10 ** 7)])) / 100 if r.random() > 0.03 else None,
                    r.choice(["UPI", "Bank Transfer", "EMI", "Electricity Bill", "Rent Income", None]),
                    r.choice(["ok", "payment failed", "credit card bill", None]), "x"))
    if late:
        r.shuffle(out)
    return out


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _same(got, want):
    a, b = ({r.applicant_id: r for r in d.select("applicant_id", *LEDGER_FEATURES).collect()} for d in (got, want))
    assert a.keys() == b.keys()
    for k in a:
        for f in LEDGER_FEATURES:
            assert a[k][f] == b[k][f], (k, f, a[k][f], b[k][f])


def test_an_initial_load_and_three_increments(spark, tmp_path):
    """Newer rows only: nothing but the new rows is read (there is no history to read from)."""
    rows = _rows(1500, 1)
    store = FeatureStore(spark, str(tmp_path / "store"))
    cuts = [0, 800, 1000, 1000, 1500]
    for k in range(4):
        store.add(_df(spark, rows[cuts[k]:cuts[k + 1]]), k)
        _same(store.read(), ledger_features(_df(spark, rows[:cuts[k + 1]])))
    before = {r.applicant_id: r for r in store.read().collect()}
    store.add(_df(spark, [(7, T0 + dt.timedelta(days=400), "debit", Decimal("1.00"), "UPI", "ok", "x")]), 4)
    assert store.features._folder(store.features.manifest()["deltas"]["4"]).count() == 1     # only the applicant that was touched
    assert {k: v for k, v in before.items() if k != 7} == {r.applicant_id: r for r in store.read().collect() if r.applicant_id != 7}


def test_rows_that_come_late_and_replays(spark, tmp_path, monkeypatch):
    """First credits move; a batch stops after each of its commits and is replayed; logs are compacted on the way."""
    rows = _rows(900, 2, late=True)
    store = FeatureStore(spark, str(tmp_path / "store"))
    for log in (store.sums, store.values, store.features):
        log.compact_every = 2
    cuts = [0, 300, 500, 700, 900]
    for k in range(4):
        new, old = _df(spark, rows[cuts[k]:cuts[k + 1]]), _df(spark, rows[:cuts[k]])
        if k in (1, 2):
            with monkeypatch.context() as m:
                m.setattr(store, "_merged" if k == 1 else "_features", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
                with pytest.raises(RuntimeError):
                    store.add(new, k, old)
        store.add(new, k, old)
        _same(store.read(), ledger_features(_df(spark, rows[:cuts[k + 1]])))
    store.add(_df(spark, rows[700:]), 3, _df(spark, rows[:700]))
    _same(store.read(), ledger_features(_df(spark, rows)))


def test_a_first_credit_that_moves_needs_the_history(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "store"))
    rows = [(1, T0 + dt.timedelta(days=d), "credit", Decimal(100 + d * d), "UPI", "ok", "x") for d in (9, 12, 30, 2)]
    store.add(_df(spark, rows[:3]), 0)
    with pytest.raises(ValueError):
        store.add(_df(spark, rows[3:]), 1)
    store.add(_df(spark, rows[3:]), 1, _df(spark, rows[:3]))
    _same(store.read(), ledger_features(_df(spark, rows)))


def test_nothing(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "store"))
    store.add(_df(spark, []), 0)
    assert store.read().count() == 0
    store.add(_df(spark, _rows(40, 3)), 1)
    _same(store.read(), ledger_features(_df(spark, _rows(40, 3)).where(F.col("applicant_id").isNotNull())))


def test_quartiles_of_heavy_applicants_are_spread(spark, tmp_path, monkeypatch):
    """Beyond ``HEAVY_KEY_ROWS`` credits the amounts leave the task's buffer; nobody else's do, and the features stay."""
    from altscore.operators import feature_store as FS
    rows, spread, plain = _rows(600, 4), [], FS.keyed_exact_quantiles
    monkeypatch.setattr(FS, "keyed_exact_quantiles", lambda d, *a, **k: spread.append(d.select("applicant_id").distinct().collect()) or plain(d, *a, **k))
    store = FeatureStore(spark, str(tmp_path / "light"))
    store.add(_df(spark, rows), 0)
    _same(store.read(), ledger_features(_df(spark, rows)))
    assert not spread
    monkeypatch.setattr(FS, "HEAVY_KEY_ROWS", 30)
    store = FeatureStore(spark, str(tmp_path / "heavy"))
    store.add(_df(spark, rows[:300]), 0)
    store.add(_df(spark, rows[300:]), 1)
    _same(store.read(), ledger_features(_df(spark, rows)))
    assert {r.applicant_id for r in spread[-1]} == {1}
    plan = store.values.read()._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
