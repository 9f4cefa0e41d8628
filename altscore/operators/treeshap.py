"""Path-dependent TreeSHAP for Spark ML tree ensembles (X1 / X2), and interactions.

For one tree, the path-dependent value function (Lundberg et al., 2018) is
``v(S) = sum_leaf value * prod_{splits on the leaf's path} g(split, S)``,
where ``g`` is ``1[x follows the split]`` when the split feature is in ``S``
and the child's cover ratio otherwise.  Per leaf this is a product game over
the distinct features on its path (at most the tree depth), whose Shapley
values follow from the polynomial ``prod_{u != i} (b_u + a_u t)``:

    phi_i += value * (a_i - b_i) * sum_k c_k * k! (m-k-1)! / m!

with ``a_u`` the row's 0/1 "follows every split on u", ``b_u`` the product of
the cover ratios of those splits and ``m`` the number of distinct features.
Shapley values are linear in the game, so the leaf terms add up per tree and
the trees add up with their ensemble weights.  A leaf's term takes one of ``2**m``
values a feature, so these are formed once a task, and the rows of an Arrow batch
look theirs up (``LeafTables``); the model description is a few thousand numbers.
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extract_trees(gbt_model) -> list:
    """``[(weight, [(leaf_value, [(feature, threshold, goes_left, cover_ratio), ...]), ...]), ...]``."""
    out = []
    for tree, w in zip(gbt_model.trees, gbt_model.treeWeights):
        leaves = []

        def walk(node, path):
            if node.getClass().getSimpleName() == "LeafNode":
                leaves.append((float(node.prediction()), list(path)))
                return
            split = node.split()
            f, thr = int(split.featureIndex()), float(split.threshold())
            n = float(node.impurityStats().count())
            left, right = node.leftChild(), node.rightChild()
            cl, cr = float(left.impurityStats().count()), float(right.impurityStats().count())
            walk(left, path + [(f, thr, True, cl / n if n else 0.5)])
            walk(right, path + [(f, thr, False, cr / n if n else 0.5)])

        walk(tree._java_obj.rootNode(), [])
        out.append((float(w), leaves))
    return out


def saved_trees(spark, stage_path: str, weights: list[float]) -> list:
    """``extract_trees`` from the folder of a saved ensemble: one read of its nodes (a few thousand rows)."""
    nodes: dict[int, dict] = {}
    for r in spark.read.parquet(stage_path + "/data").select("treeID", "nodeData.*").collect():
        nodes.setdefault(r.treeID, {})[r.id] = r
    out = []
    for tree in sorted(nodes):
        leaves, own = [], nodes[tree]

        def walk(at, path):
            node = own[at]
            if node.leftChild < 0:
                leaves.append((float(node.prediction), path))
                return
            n = node.impurityStats[0]
            for child, left in ((node.leftChild, True), (node.rightChild, False)):
                share = own[child].impurityStats[0] / n if n else 0.5
                walk(child, path + [(node.split.featureIndex, float(node.split.leftCategoriesOrThreshold[0]), left, share)])

        walk(0, [])
        out.append((float(weights[tree]), leaves))
    return out


def base_value(trees) -> float:
    """Expected model output under the covers (v of the empty coalition)."""
    total = 0.0
    for w, leaves in trees:
        for value, path in leaves:
            p = 1.0
            for _, _, _, r in path:
                p *= r
            total += w * value * p
    return total


class LeafTables:
    """What each leaf adds to a row's values, for each of its at most ``2 ** depth`` patterns.

    A leaf's term depends on the row only through the features of its path whose splits the row all follows: one bit a
    feature.  ``terms`` gives a leaf's additions for all patterns at once, in order; a batch then takes
    one number a row and term from a short table.
    """

    def __init__(self, trees, terms):
        self.trees = []
        for w, leaves in trees:
            tables = []
            for value, path in leaves:
                covers: dict = {}
                for f, _, _, ratio in path:
                    covers[f] = covers.get(f, 1.0) * ratio
                patterns = np.arange(1 << len(covers))
                game = {f: ((patterns >> k & 1).astype("float64"), b) for k, (f, b) in enumerate(covers.items())}
                added = terms(w * value, game) if game else []
                tables.append((tuple(path), [(f, np.ascontiguousarray(v)) for f, v in added]))
            self.trees.append(tables)

    def sums(self, X: np.ndarray, rows: int = 8192) -> np.ndarray:
        out = np.zeros((X.shape[1], len(X)))
        for at in range(0, len(X), rows):
            columns, part = np.ascontiguousarray(X[at:at + rows].T), out[:, at:at + rows]
            for tables in self.trees:
                seen = {(): (np.zeros(part.shape[1], dtype="int64"), {})}
                for path, added in tables:
                    if added:
                        pattern = _pattern(columns, path, seen)
                        for f, table in added:
                            part[f] += table.take(pattern)
        return np.ascontiguousarray(out.T)


def _pattern(columns: np.ndarray, path: tuple, seen: dict) -> np.ndarray:
    """Bit k of a row: it follows every split of ``path`` on the path's k-th feature.  ``seen`` keeps the nodes above."""
    for depth in range(1, len(path) + 1):
        if path[:depth] not in seen:
            above, bits = seen[path[:depth - 1]]
            f, thr, left, _ = path[depth - 1]
            follow = (columns[f] <= thr) if left else (columns[f] > thr)
            if f in bits:
                pattern = above & ~(~follow * np.int64(1 << bits[f]))
            else:
                bits = {**bits, f: len(bits)}
                pattern = above | follow * np.int64(1 << bits[f])
            seen[path[:depth]] = (pattern, bits)
    return seen[path][0]


def _shap_terms(scale: float, game: dict):
    """Per feature of a leaf's game, its Shapley value."""
    m = len(game)
    weights = [factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)]
    return [(i, scale * _weighted(game, (i,), weights) * (a - b)) for i, (a, b) in game.items()]


def shap_tables(trees) -> LeafTables:
    return LeafTables(trees, _shap_terms)


def shap_matrix(X: np.ndarray, trees) -> np.ndarray:
    return shap_tables(trees).sums(X)


def interaction_tables(trees, feature: int) -> LeafTables:
    """Shapley interaction values of one feature with every other, a row each.

    Per leaf they follow, as the values themselves, from the polynomial of the
    path's other features; the pair's joint effect is split in halves.  Column
    ``feature`` holds the main effect: its SHAP value less all interactions, so
    a row adds up to the SHAP value.
    """
    def terms(scale, game):
        m = len(game)
        if feature not in game:
            return []
        own = game[feature][0] - game[feature][1]
        if m == 1:
            return [(feature, scale * own)]
        pair = [factorial(k) * factorial(m - k - 2) / factorial(m - 1) for k in range(m - 1)]
        single = [factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)]
        main, halves = scale * own * _weighted(game, (feature,), single), []
        for j, (a, b) in game.items():
            if j != feature:
                half = 0.5 * scale * own * (a - b) * _weighted(game, (feature, j), pair)
                halves.append((j, half))
                main = main - half
        return [(feature, main), *halves]

    return LeafTables(trees, terms)


def interaction_matrix(X: np.ndarray, trees, feature: int) -> np.ndarray:
    return interaction_tables(trees, feature).sums(X)


def _weighted(game: dict, without: tuple, weights: list[float]):
    """Sum of the coefficients of the product of (b + a t) over the other features, weighted by degree."""
    coeffs = [1.0]
    for u, (a, b) in game.items():
        if u not in without:
            coeffs = [x * b + y * a for x, y in zip([*coeffs, 0.0], [0.0, *coeffs])]
    return sum(c * k for c, k in zip(coeffs, weights))


def interaction_strengths(df: DataFrame, features: list[str], trees, feature: str) -> DataFrame:
    """(partner, strength): mean |interaction| of ``feature`` with each other one.

    Batches are summed where they are; one row a partner and batch is shuffled.
    """
    if feature not in features:
        raise ValueError(f"unknown feature {feature!r}")
    at = features.index(feature)
    others = [f for f in features if f != feature]

    def run(batches):
        tables = interaction_tables(trees, at)
        for pdf in batches:
            v = np.abs(tables.sums(pdf[features].to_numpy(dtype="float64"))).sum(axis=0)
            yield pd.DataFrame({"partner": others, "total": np.delete(v, at), "n": len(pdf)})

    sums = df.select(*features).mapInPandas(run, "partner string, total double, n long").groupBy("partner")
    return sums.agg(F.round(F.sum("total") / F.sum("n"), 9).alias("strength"))


def dependence(df: DataFrame, features: list[str], trees, key: str, feature: str, partner: str | None = None) -> DataFrame:
    """Points of one feature, and its interaction with ``partner``; if none is
    named, with the strongest one (ties: the first by name).  An empty table gives no points."""
    if feature not in features or partner not in (None, *features):
        raise ValueError(f"unknown feature {feature!r} or {partner!r}")
    if partner is None:      # one row of at most as many as there are features
        best = interaction_strengths(df, features, trees, feature).orderBy(F.desc("strength"), "partner").first()
        partner = best.partner if best else next((f for f in features if f != feature), feature)
    at, other = features.index(feature), features.index(partner)

    def run(batches):
        tables = interaction_tables(trees, at)
        for pdf in batches:
            X = pdf[features].to_numpy(dtype="float64")
            v = tables.sums(X)
            yield pd.DataFrame({key: pdf[key].to_numpy(), "value": X[:, at], "shap": v.sum(axis=1), "main_effect": v[:, at],
                                "partner": partner, "interaction_value": X[:, other], "interaction": v[:, other]})

    return df.select(key, *features).mapInPandas(
        run, f"{key} long, value double, shap double, main_effect double, partner string, interaction_value double, interaction double")


def explain(df: DataFrame, features: list[str], trees, key: str, top_n: int | None = None,
            raw_col: str | None = None) -> DataFrame:
    """X2 (``top_n`` None): one row per input row with the SHAP vector,
    base value, prediction = base + sum(shap) and, when ``raw_col`` names the
    model's own output, the additivity error.  X1 (``top_n``): long form, the
    top-n features by |shap| per row."""
    base = base_value(trees)
    cols = [key, *features] + ([raw_col] if raw_col else [])
    if top_n is None:
        schema = (f"{key} long, shap_values array<double>, base_value double, prediction double"
                  + (", additivity_error double" if raw_col else ""))
    else:
        schema = f"{key} long, rank int, feature string, value double, shap double, base_value double, prediction double"

    def run(batches):
        tables = shap_tables(trees)
        for pdf in batches:
            X = pdf[features].to_numpy(dtype="float64")
            phi = tables.sums(X)
            pred = base + phi.sum(axis=1)
            if top_n is None:
                out = {key: pdf[key].to_numpy(), "shap_values": list(phi), "base_value": np.full(len(pdf), base),
                       "prediction": pred}
                if raw_col:
                    out["additivity_error"] = np.abs(pred - pdf[raw_col].to_numpy(dtype="float64"))
                yield pd.DataFrame(out)
            else:
                order = np.argsort(-np.abs(phi), axis=1, kind="stable")[:, :top_n]
                k = order.shape[1]
                yield pd.DataFrame({
                    key: np.repeat(pdf[key].to_numpy(), k),
                    "rank": np.tile(np.arange(1, k + 1, dtype="int32"), len(pdf)),
                    "feature": np.asarray(features, dtype=object)[order].ravel(),
                    "value": np.take_along_axis(X, order, axis=1).ravel(),
                    "shap": np.take_along_axis(phi, order, axis=1).ravel(),
                    "base_value": np.full(len(pdf) * k, base),
                    "prediction": np.repeat(pred, k)})

    return df.select(*cols).mapInPandas(run, schema)
