"""op5: recall and exact scores against brute force."""

import numpy as np
from pyspark.sql import functions as F

from altscore.llm import ann as A
from altscore.llm import hnsw as H


def _brute(ids, x, i, k):
    n = np.linalg.norm(x, axis=1)
    c = x @ x[i] / (n * n[i])
    order = [j for j in np.lexsort((ids, -np.round(c, 12))) if ids[j] != ids[i]]
    return [int(ids[j]) for j in order[:k]]


def _run(spark, ids, x, **options):
    d = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    return A.nearest(d, F.col("vec_id") % 50 == 0, **options).collect()


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(3000, 24)) + 2 * rng.normal(size=(30, 24))[rng.integers(0, 30, 3000)]).astype(np.float32).astype(float)
    ids = np.arange(3000)
    got = {}
    for r in _run(spark, ids, x, shard=700, block=16):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = sum(len({v for _, v, _ in got[i]} & set(_brute(ids, x, i, 5))) for i in range(0, 3000, 50))
    assert hit >= 0.95 * 5 * 60
    for i, rows in got.items():
        assert [r for r, _, _ in sorted(rows)] == [1, 2, 3, 4, 5]
        for _, v, s in rows:
            assert abs(s - x[v] @ x[i] / np.linalg.norm(x[v]) / np.linalg.norm(x[i])) < 1e-12


def test_shards_without_vectors_and_lengths_without_queries(spark):
    """Three vectors in up to three shards; vectors of length 3 that no query has."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=2).tolist()) for i in (0, 50, 7)] + [(i, rng.normal(size=3).tolist()) for i in (1, 2)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id) for r in A.nearest(d, F.col("vec_id") % 50 == 0, shard=1, block=1).collect()]
    assert sorted(got) == [(0, 7), (0, 50), (50, 0), (50, 7)]


def test_copies_ties_and_few_candidates(spark):
    x = np.array([[1.0, 0.0]] * 900 + [[0.0, 1.0]] * 3)
    got = [tuple(r)[:3] for r in _run(spark, np.arange(903), x)]
    assert sorted(g for g in got if g[0] == 50) == [(50, k + 1, k) for k in range(5)]
    assert sorted(g for g in got if g[0] == 0) == [(0, k, k) for k in range(1, 6)]
    assert [tuple(r)[:3] for r in _run(spark, np.array([0, 7]), x[:2])] == [(0, 1, 7)]


def test_vectors_without_direction_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (None, [1.0, 2.0]), (8, [2.0, 4.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 3.0]), (50, [0.0, 0.0]), (100, [3.0, 1.0])]
    d = spark.createDataFrame([(i, v, 0.1, 7) for i, v in rows], "vec_id long, embedding array<double>, score double, id long")
    got = [(r.query_id, r["rank"], r.vec_id) for r in A.nearest(d, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == [(0, 1, 8), (0, 2, 100), (100, 1, 0), (100, 2, 8)]


def test_empty(spark):
    d = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert A.nearest(d, F.col("vec_id") % 50 == 0).count() == 0


def test_graph_layers_are_flat_arrays():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    place, g = H.build(x, rng.integers(0, 3, 500))
    assert sorted(place) == list(range(500)) and [len(x) for x in g.links] == sorted((len(x) for x in g.links), reverse=True)
    assert all((x < len(x)).all() for x in g.links)
