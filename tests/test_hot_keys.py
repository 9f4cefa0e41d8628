"""Skew paths against brute force: one applicant / client holds most rows."""

import datetime as dt
import os
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from altscore.operators import ledger_features as L
from altscore.operators.requests import sliding_request_count

T0 = dt.datetime(2024, 1, 1)
SOURCES = ["UPI", "Bank Transfer", "Mandi Sale", None, "Rent Income"]


def _ledger_rows(rng):
    rows = []
    for i in range(3000):                          # hot applicant 1: ~60 % of the rows
        rows.append((1, T0 + dt.timedelta(hours=int(rng.integers(0, 4000))), "credit" if i % 3 else "debit",
                     Decimal(str(round(float(rng.uniform(10, 5000)), 2))), SOURCES[i % 5], "ok", "x"))
    for a in range(2, 60):
        for i in range(int(rng.integers(5, 40))):
            rows.append((a, T0 + dt.timedelta(hours=int(rng.integers(0, 4000))), "credit" if i % 2 else "debit",
                         Decimal(str(round(float(rng.uniform(10, 5000)), 2))), SOURCES[(a + i) % 5], "ok", "x"))
    return rows


def test_hot_applicant_quartiles_and_sources_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = _ledger_rows(rng)
    led = spark.createDataFrame(rows, "applicant_id long, ts timestamp, txn_type string, amount decimal(18,2), "
                                      "source string, message string, category string")
    raw = {r["applicant_id"]: r for r in L.raw_aggregates(led, heavy_rows=100).collect()}   # applicant 1 is heavy
    pdf = pd.DataFrame(rows, columns=["a", "ts", "t", "amt", "src", "m", "c"])
    for a, g in pdf[pdf.t == "credit"].groupby("a"):
        x = g.amt.astype(float).to_numpy()
        assert raw[a]["cr_q"][0] == pytest.approx(float(np.percentile(x, 25)), abs=1e-9)
        assert raw[a]["cr_q"][1] == pytest.approx(float(np.percentile(x, 75)), abs=1e-9)
        assert raw[a]["cr_sources"] == g.src.dropna().nunique()
    assert raw[1]["n_cr"] == (pdf[(pdf.a == 1) & (pdf.t == "credit")]).shape[0]


def test_hot_client_sliding_count_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "hot" if i % 4 else f"c{i % 7}", T0 + dt.timedelta(seconds=int(rng.integers(0, 20000))))
            for i in range(4000)]
    df = spark.createDataFrame(rows, "request_id long, client string, ts timestamp")
    got = {r["request_id"]: r["n_recent"] for r in sliding_request_count(df, 900).collect()}
    pdf = pd.DataFrame(rows, columns=["id", "client", "ts"])
    for client, g in pdf.groupby("client"):
        t = g.ts.astype("int64").to_numpy() // 1000          # microseconds
        for rid, ti in zip(g.id, t):
            expected = int(((t > ti - 900 * 1_000_000) & (t <= ti)).sum()) - 1
            assert got[rid] == expected


def test_busy_client_rate_limit_matches_brute_force(spark):
    """One client holds most rows and pauses now and then; work is dealt out by burst."""
    from altscore.operators.requests import rate_limit
    rng = np.random.default_rng(6)
    t, rows = 0, []
    for i in range(3000):
        t += int(rng.integers(1, 6)) if rng.random() > 0.02 else int(rng.integers(100, 900))
        rows.append((i, "hot" if i % 8 else f"c{i % 5}", T0 + dt.timedelta(seconds=t)))
    df = spark.createDataFrame(rows, "request_id long, client string, ts timestamp")
    got = {r["request_id"]: (r["accepted"], r["remaining"], r["retry_after"]) for r in rate_limit(df, limit=10, window_s=60).collect()}
    accepted = {}
    for rid, client, ts in rows:
        live = [a for a in accepted.get(client, []) if (ts - a).total_seconds() < 60]
        ok = len(live) < 10
        retry = 0 if ok else int(live[0].timestamp() + 60 - ts.timestamp())
        live += [ts] * ok
        accepted[client] = live
        assert got[rid] == (ok, 10 - len(live), retry)


def _sequential(rows, limit, window):
    """Plain answers for rows (id, client, time in microseconds)."""
    want, acc = {}, {}
    for rid, c, t in sorted(rows, key=lambda r: (r[2], r[0])):
        a = acc[c] = [x for x in acc.get(c, []) if x > t - window]
        ok = len(a) < limit
        if ok:
            a.append(t)
        want[rid] = (ok, limit - len(a), 0 if ok else (a[0] + window - t) // 1_000_000)
    return want


def _answers(df):
    return {x.request_id: (x.accepted, x.remaining, x.retry_after) for x in df.collect()}


SCHEMA = "request_id long, client string, ts_us long"


@pytest.mark.parametrize("step,eager", [(40_000, 3), (40_000, 0), (900_000, 3), (7_000_000, 3)])
def test_a_client_that_never_pauses_is_many_tasks(spark, monkeypatch, step, eager):
    """Far beyond the limit, a little beyond, and below it; other clients, a null one and equal times beside it."""
    import random

    from altscore.operators import requests as R
    monkeypatch.setattr(R, "EAGER_ROUNDS", eager)
    r, t, rows = random.Random(step), 0, []
    for i in range(12_000):
        t += r.choice([0, step, 2 * step])
        rows.append((i, "hot" if i % 10 else r.choice(["a", "z", None]), t))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = R.limited(df, 20, 60_000_000)
        assert _answers(got) == _sequential(rows, 20, 60_000_000)
        sizes = [x["count"] for x in df.repartitionByRange("client", "ts_us", "request_id").groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < len(rows) / 5
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_two_million_requests_without_a_pause(spark):
    """One client, seven requests a second for days; a range holds less than a tenth of them."""
    from altscore.operators import requests as R
    n, limit, window = 2_000_000, 100, 900_000_000
    df = spark.range(n).select(F.col("id").alias("request_id"), F.lit("one").alias("client"),
                               (F.col("id") * 140_000 + F.pmod(F.xxhash64("id"), F.lit(90_000))).alias("ts_us"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = R.limited(df, limit, window).select("ts_us", "accepted").toPandas().sort_values("ts_us")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    from collections import deque
    acc, want = deque(), []
    for t in got.ts_us.tolist():
        while acc and acc[0] <= t - window:
            acc.popleft()
        want.append(len(acc) < limit)
        if want[-1]:
            acc.append(t)
    assert got.accepted.tolist() == want and len(want) == n


def _deliver(spark, tmp_path, parts, base, limit, window, delay):
    """Runs the stream once for each delivery; the schema of a part is SCHEMA."""
    from altscore.streaming.jobs import limit_stream
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).write.parquet(f"{tmp_path}/in/{k}")
        limit_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*"), base, limit, window, delay)


def test_micro_batches_that_overlap_equal_the_batch_limiter(spark, tmp_path):
    """Three clients over four windows, in random order, in three deliveries; a busy client and a null one."""
    import random

    from altscore.operators.requests import limited
    from altscore.streaming.jobs import limit_results
    r, window = random.Random(3), 60_000_000
    rows = [(i, r.choice(["hot", "hot", "hot", "cold", None]), r.randrange(4 * window)) for i in range(3000)]
    r.shuffle(rows)
    base = f"{tmp_path}/run"
    _deliver(spark, tmp_path, [rows[k::3] for k in range(3)], base, 10, window, 4 * window)
    got = limit_results(spark, base, 10, window)
    assert got.where("late").isEmpty()
    want = _sequential(rows, 10, window)
    assert _answers(got) == want == _answers(limited(spark.createDataFrame(rows, SCHEMA), 10, window))


def test_state_goes_from_micro_batch_to_micro_batch(spark, tmp_path):
    """Bounded delay: most requests are judged along the way; nothing is late, nothing is judged twice."""
    import random

    from altscore.streaming.jobs import limit_results
    r = random.Random(12)
    window, t, rows = 60_000_000, 0, []
    for i in range(1500):
        t += r.choice([100_000, 1_000_000, 5_000_000, 70_000_000 if i % 50 == 0 else 300_000])
        rows.append((i, r.choice(["hot", "hot", "hot", "cold", None]), t))
    came = sorted(rows, key=lambda x: x[2] + r.randrange(30_000_000))
    base = f"{tmp_path}/run"
    _deliver(spark, tmp_path, [came[500 * k:500 * k + 500] for k in range(3)], base, 10, window, 30_000_000)
    out = limit_results(spark, base, 10, window)
    assert out.where("late").isEmpty() and out.count() == 1500
    assert _answers(out) == _sequential(rows, 10, window)
    assert spark.read.parquet(base + "/out").count() > 1300


def test_late_requests_are_rejected_and_marked(spark, tmp_path):
    """Behind the watermark of the deliveries before, or without a time; they take no quota."""
    from altscore.streaming.jobs import limit_results
    first = [(i, "a", i * 1_000_000) for i in range(100)]
    second = [(200, "a", 5_000_000), (201, "b", 89_000_000), (202, "a", None), (203, "a", 89_000_001), (204, "a", 400_000_000)]
    base = f"{tmp_path}/run"
    _deliver(spark, tmp_path, [first, second], base, 5, 20_000_000, 10_000_000)
    out = limit_results(spark, base, 5, 20_000_000)
    assert sorted(x.request_id for x in out.where("late").collect()) == [200, 201, 202]
    assert not out.where("late AND (accepted OR remaining <> 0)").count()
    assert _answers(out.where("not late")) == _sequential(first + [second[3], second[4]], 5, 20_000_000)


def test_a_replayed_micro_batch_and_an_empty_stream(spark, tmp_path):
    from altscore.streaming.jobs import limit_results, limit_stream
    rows = [(i, "a", i * 1_000_000) for i in range(60)]
    base = f"{tmp_path}/run"
    _deliver(spark, tmp_path, [rows[:30], rows[30:]], base, 5, 20_000_000, 10_000_000)
    before = _answers(limit_results(spark, base, 5, 20_000_000))
    for name in ("1", ".1.crc"):                               # as if the driver had died before the commit
        os.remove(f"{base}/chk/commits/{name}")
    limit_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*"), base, 5, 20_000_000, 10_000_000)
    assert _answers(limit_results(spark, base, 5, 20_000_000)) == before == _sequential(rows, 5, 20_000_000)
    os.makedirs(f"{tmp_path}/none/in")
    limit_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/none/in"), f"{tmp_path}/none/run", 5, 20_000_000, 0)
    assert limit_results(spark, f"{tmp_path}/none/run", 5, 20_000_000).count() == 0


def test_objects_are_aggregated_apart_and_messages_matched_before_the_shuffle(spark, tmp_path):
    """Quartiles and sets don't share an aggregate with the rest, no message is joined, and odd rows count as before."""
    rows = [(1, T0, "credit", Decimal("10.00"), "UPI", "Credit card refund", "x"), (1, T0, "credit", None, None, None, "x"),
            (1, T0, "debit", Decimal("3.00"), "Fuel", "Card payment FAILED", "x"), (2, T0, "debit", Decimal("5.00"), None, None, "x"),
            (3, T0, None, Decimal("7.00"), "UPI", "payment rejected", "x"), (4, T0, "credit", None, None, "ok", "x"),
            (None, T0, "credit", Decimal("1.00"), "UPI", "ok", "x")]
    spark.createDataFrame(rows, "applicant_id long, ts timestamp, txn_type string, amount decimal(18,2), source string, "
                                "message string, category string").write.parquet(f"{tmp_path}/ledger")
    raw = L.raw_aggregates(spark.read.parquet(f"{tmp_path}/ledger"))
    plan = raw._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("regr_slope" in line and ("percentile" in line or "collect_set" in line) for line in plan)
    assert any("RLIKE" in line for line in plan) and not any("RLIKE" in line for line in plan if "Aggregate" in line)
    got = {r.applicant_id: (r.n_all, r.n_cr, r.cr_sources, r.cr_q, r.n_failed, r.n_card_dr, r.n_card_cr) for r in raw.collect()}
    assert got == {1: (3, 2, 1, [10.0, 10.0], 1, 1, 1), 2: (1, 0, 0, [None, None], 0, 0, 0),
                   3: (1, 0, 0, [None, None], 1, 0, 0), 4: (1, 1, 0, [None, None], 0, 0, 0)}
