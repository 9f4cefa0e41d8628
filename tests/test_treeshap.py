"""TreeSHAP against brute-force Shapley values of the path-dependent game."""

from itertools import combinations
from math import factorial

import numpy as np

from altscore.operators.treeshap import LeafTables, base_value, dependence, interaction_matrix, interaction_strengths, shap_matrix, shap_tables

# Two small trees over 3 features; paths carry (feature, threshold, goes_left, cover ratio).
TREES = [
    (1.0, [(1.0, [(0, 0.5, True, 0.6), (1, 0.2, True, 0.5)]),
           (2.0, [(0, 0.5, True, 0.6), (1, 0.2, False, 0.5)]),
           (3.0, [(0, 0.5, False, 0.4), (0, 0.8, True, 0.25)]),
           (5.0, [(0, 0.5, False, 0.4), (0, 0.8, False, 0.75)])]),
    (0.1, [(-1.0, [(2, 0.0, True, 0.3)]),
           (4.0, [(2, 0.0, False, 0.7), (1, 0.9, True, 0.5), (0, 0.1, True, 0.2)]),
           (6.0, [(2, 0.0, False, 0.7), (1, 0.9, True, 0.5), (0, 0.1, False, 0.8)]),
           (7.0, [(2, 0.0, False, 0.7), (1, 0.9, False, 0.5)])]),
]


def value(x, S):
    total = 0.0
    for w, leaves in TREES:
        for v, path in leaves:
            p = 1.0
            for f, thr, left, r in path:
                if f in S:
                    p *= float((x[f] <= thr) if left else (x[f] > thr))
                else:
                    p *= r
            total += w * v * p
    return total


def brute(x, d=3):
    phi = np.zeros(d)
    for i in range(d):
        others = [j for j in range(d) if j != i]
        for k in range(d):
            for S in combinations(others, k):
                wt = factorial(k) * factorial(d - k - 1) / factorial(d)
                phi[i] += wt * (value(x, set(S) | {i}) - value(x, set(S)))
    return phi


def test_matches_brute_force_and_adds_up():
    rng = np.random.default_rng(0)
    X = rng.uniform(-0.5, 1.5, size=(50, 3))
    phi = shap_matrix(X, TREES)
    for r in range(len(X)):
        assert np.allclose(phi[r], brute(X[r]), atol=1e-12)
        full = value(X[r], {0, 1, 2})
        assert abs(base_value(TREES) + phi[r].sum() - full) < 1e-12


def test_leaf_terms_are_formed_once_for_all_rows():
    """Rows look their pattern up, whatever their number; a missing value follows no split."""
    formed = []

    def terms(scale, game):
        formed.append(len(game))
        return [(f, scale * (a - b)) for f, (a, b) in game.items()]

    tables = LeafTables(TREES + [(1.0, [(2.0, [])])], terms)
    X = np.random.default_rng(3).uniform(-0.5, 1.5, size=(9000, 3))
    X[::7, 0] = np.nan
    got = tables.sums(X)
    assert len(formed) == 8 and got.shape == X.shape and got.flags.c_contiguous      # sums over a row keep their order
    want = np.zeros(X.shape)
    for w, leaves in TREES:
        for v, path in leaves:
            for f in {f for f, *_ in path}:
                own = [(t, left, r) for g, t, left, r in path if g == f]
                a = np.all([X[:, f] <= t if left else X[:, f] > t for t, left, _ in own], axis=0)
                want[:, f] += w * v * (a - np.prod([r for *_, r in own]))
    assert np.allclose(got, want, atol=1e-12)
    assert (shap_tables(TREES).sums(X) == np.concatenate([shap_matrix(X[k:k + 100], TREES) for k in range(0, len(X), 100)])).all()
    assert tables.sums(X[:0]).shape == (0, 3)


def brute_pair(x, i, j, d=3):
    """Half of the pair's Shapley interaction index, over all coalitions of the others."""
    others = [u for u in range(d) if u not in (i, j)]
    total = 0.0
    for k in range(len(others) + 1):
        for S in map(set, combinations(others, k)):
            change = value(x, S | {i, j}) - value(x, S | {i}) - value(x, S | {j}) + value(x, S)
            total += factorial(k) * factorial(d - k - 2) / factorial(d - 1) * change
    return total / 2


def test_interactions_match_brute_force_and_add_up():
    X = np.random.default_rng(1).uniform(-0.5, 1.5, size=(40, 3))
    phi = shap_matrix(X, TREES)
    for i in range(3):
        got = interaction_matrix(X, TREES, i)
        assert np.allclose(got.sum(axis=1), phi[:, i], atol=1e-12)
        for r in range(len(X)):
            assert all(abs(got[r, j] - brute_pair(X[r], i, j)) < 1e-12 for j in range(3) if j != i)


def test_the_strongest_partner_is_found(spark):
    X = np.random.default_rng(2).uniform(-0.5, 1.5, size=(200, 3))
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], "id long, a double, b double, c double").repartition(5)
    mean = np.abs(interaction_matrix(X, TREES, 0)).mean(axis=0)
    strengths = {r.partner: r.strength for r in interaction_strengths(df, ["a", "b", "c"], TREES, "a").collect()}
    assert set(strengths) == {"b", "c"} and all(abs(strengths["abc"[j]] - mean[j]) < 1e-8 for j in (1, 2))
    rows = dependence(df, ["a", "b", "c"], TREES, "id", "a").collect()
    best = max(strengths, key=strengths.get)
    phi = shap_matrix(X, TREES)
    assert len(rows) == 200 and {r.partner for r in rows} == {best}
    assert all(abs(r.shap - phi[r.id, 0]) < 1e-12 and r.interaction_value == X[r.id, "abc".index(best)] for r in rows)
    assert dependence(df.limit(0), ["a", "b", "c"], TREES, "id", "a").count() == 0
