"""op11: equal to brute force, whatever the shards; the tree's bounds hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from altscore.llm import covertree as T
from altscore.llm import negatives as N


def brute(rows, every=10, positives=5, negatives=10):
    """rows (id, label, vector), all fit to take part -> the answers."""
    rows = [(i, c, [int(np.floor(256 * float(x))) for x in v]) for i, c, v in dict.fromkeys((i, c, tuple(v)) for i, c, v in rows)]
    anchors = {}
    for i, c, v in rows:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (c, v)), (c, v))
    out = []
    for a, (c, q) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, d == c) for i, d, v in rows if i != a and len(v) == len(q))
        for s, p in [(-s, i) for s, i, same in scored if same][:positives]:
            fit = [(-t, i) for t, i, same in scored if not same and 30 * s <= -100 * t <= 90 * s]
            out += [(a, p, r + 1, i, s, t) for r, (t, i) in enumerate(fit[:negatives])]
    return sorted(out)


def _run(spark, rows, **options):
    d = spark.createDataFrame([(i, c, [float(x) for x in v]) for i, c, v in rows], "vec_id long, label int, embedding array<double>").repartition(4)
    return sorted(tuple(r) for r in N.mine(d, F.col("vec_id") % 10 == 0, F.col("label"), **options).collect())


@pytest.mark.parametrize("spread", [0.2, 3.0])
def test_equal_to_brute_force_over_shards_and_lots(spark, spread):
    """Tight clusters, where the tree prunes, and none; vectors of unequal norms."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    x = (centres[rng.integers(0, 12, 900)] + spread * rng.normal(size=(900, 6))) * rng.uniform(0.2, 2.0, size=(900, 1))
    rows = [(i, int(rng.integers(0, 4)), tuple(np.round(v, 3))) for i, v in enumerate(x)]
    want = brute(rows)
    assert len(want) > 500
    assert _run(spark, rows) == want
    assert _run(spark, rows, shard=200, lot=20) == want


def test_copies_ties_and_repeated_rows(spark):
    """A vector that most rows share, under several labels; equal rows count once; ids that bear two vectors."""
    rows = [(i, i % 3, (1.0, 0.0)) for i in range(400)] + [(i, i % 3, (0.8, 0.1)) for i in range(400, 460)]
    rows += rows[:30] + [(10, 5, (0.5, 0.5)), (11, 1, (0.7, 0.0)), (11, 1, (0.7, 0.0))]
    assert _run(spark, rows, shard=50) == brute(rows)


def test_windows_of_small_and_negative_scores(spark):
    rows = [(0, 0, (1.0, 0.0)), (1, 0, (-1.0, 0.0)), (2, 1, (-0.5, 0.0)), (3, 1, (0.0, 1.0)), (4, 0, (0.0, 1.0)), (5, 1, (0.0, 2.0)),
            (6, 0, (0.004, 0.0)), (7, 1, (0.004, 0.0)), (8, 1, (0.0039, 0.0)), (10, 1, (0.0, 0.0)), (12, 1, (0.0, 0.0)), (20, 0, ()), (21, 0, ()), (22, 1, ())]
    assert _run(spark, rows) == brute(rows)


def test_rows_that_take_no_part(spark):
    good = [(0, 0, [1.0, 2.0]), (1, 0, [1.0, 2.0]), (2, 1, [0.5, 1.0]), (3, 1, [0.5, 1.0, 9.0]), (30, 0, [2.0, 2.0])]
    bad = [(4, 0, None), (5, None, [1.0, 2.0]), (None, 0, [1.0, 2.0]), (6, 0, [None, 2.0]), (7, 1, [float("nan"), 1.0]),
           (8, 1, [float("inf"), 1.0]), (9, 1, [1e30, 1.0]), (40, None, [1.0, 1.0])]
    d = spark.createDataFrame([(i, c, v, 0.5, 3, 1, 2) for i, c, v in good + bad],
                              "vec_id long, label int, embedding array<double>, score double, id long, shard long, lot long")
    got = sorted(tuple(r) for r in N.mine(d, F.col("vec_id") % 10 == 0, F.col("label")).collect())
    assert got == brute(good) and len(got) > 0


def test_large_components_are_exact(spark):
    big = 5e5
    rows = [(i, i % 2, (big + i, big / 3 + i / 7)) for i in range(60)] + [(100 + i, i % 2, (big * 0.6 + i / 3, big / 4)) for i in range(60)]
    assert _run(spark, rows) == brute(rows)


def test_empty(spark):
    assert _run(spark, []) == []


def test_bounds_nets_and_buckets():
    rng = np.random.default_rng(8)
    x = np.floor(256 * (rng.normal(size=(40, 5))[rng.integers(0, 40, 1500)] + 0.05 * rng.normal(size=(1500, 5)))).astype(np.int64)
    labels = rng.integers(0, 3, 1500)
    t = T.build(x, labels, [[i] for i in range(1500)], leaf=8)
    s = T.Search(t, 5)
    assert sorted(t["ids"]) == list(range(1500)) and (np.sort(s.ints, axis=0) == np.sort(x, axis=0)).all()

    def below(v):
        c = t["children"][t["child_start"][v]:t["child_start"][v + 1]]
        return [r for k in c for r in below(k)] if len(c) else list(range(t["bucket_start"][v], t["bucket_start"][v + 1]))

    assert sorted(below(int(t["root"][0]))) == list(range(1500))
    for q in x[:5].astype(float):
        low, high = s.bounds(q)
        for v in set(t["children"].tolist()):
            rows = below(v)
            ip = s.x[rows] @ q
            assert low[v] <= ip.min() and ip.max() <= high[v]
            assert t["low"][v] <= t["labels"][rows].min() and t["high"][v] >= t["labels"][rows].max()


def test_the_descent_skips_what_lies_outside():
    """Clusters: few points are ever verified."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 8))
    x = np.floor(256 * (centres[rng.integers(0, 60, 6000)] + 0.02 * rng.normal(size=(6000, 8)))).astype(np.int64)
    s = T.Search(T.build(x, rng.integers(0, 5, 6000), [[i] for i in range(6000)]), 8)
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, rows):
            if isinstance(rows, np.ndarray) and rows is not s.t["centre"]:
                seen.append(len(rows))
            return np.asarray(super().__getitem__(rows))

    s.x = s.x.view(Counted)
    s.best(x[0], -1, 0, True, np.array([[-T.FAR, T.FAR]]), 5)
    assert 0 < sum(seen) < 2000
