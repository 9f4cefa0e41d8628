"""Gradient-boosted trees with monotone constraints, as flat numpy arrays.

Fitted on a bounded sample (histograms of quantile bins, logistic loss); a
fitted forest is a few arrays of nodes, and rows are scored by walking all of
them down one level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Forest:
    """Node arrays; a leaf points to itself.  ``roots`` has one node per tree."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            down = x[row, self.feature[node]] <= self.threshold[node]
            node = np.where(down, self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        return np.concatenate([sigmoid(self.margin(x[k:k + rows])) for k in range(0, len(x), rows)] or [np.zeros(0)])


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 3,
        rate: float = 0.2, bins: int = 32, least: float = 5.0, ridge: float = 1.0) -> Forest:
    """``monotone``: feature -> 1 (score never falls as it grows) or -1.

    ``least``: smallest sum of second derivatives in a leaf.
    """
    monotone = monotone or {}
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    margin = np.full(n, base)
    nodes: list[list] = []                      # feature, threshold, left, right, value
    roots = []

    def weight(g, h, low, high):
        return float(np.clip(-g / (h + ridge), low, high))

    def grow(rows, level, low, high) -> int:
        me = len(nodes)
        nodes.append([0, 0.0, me, me, 0.0])
        g, h = grad[rows].sum(), hess[rows].sum()
        w = weight(g, h, low, high)
        best, at = 1e-6, None
        if level < depth:
            for f in range(m):
                k = len(cuts[f])
                if not k:
                    continue
                c = code[rows, f]
                gl = np.cumsum(np.bincount(c, grad[rows], k + 1))[:-1]
                hl = np.cumsum(np.bincount(c, hess[rows], k + 1))[:-1]
                gr, hr = g - gl, h - hl
                wl, wr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                # drop of the loss with these (bounded) leaf values
                gain = -(gl * wl + 0.5 * (hl + ridge) * wl ** 2 + gr * wr + 0.5 * (hr + ridge) * wr ** 2) \
                    + (g * w + 0.5 * (h + ridge) * w ** 2)
                ok = (hl >= least) & (hr >= least)
                if f in monotone:
                    ok &= (wr - wl) * monotone[f] >= 0
                gain = np.where(ok, gain, -1.0)
                j = int(np.argmax(gain))
                if gain[j] > best:
                    best, at = gain[j], (f, j, float(wl[j]), float(wr[j]))
        if at is None:
            nodes[me][4] = rate * w
            margin[rows] += rate * w
            return me
        f, j, wl, wr = at
        lows, highs = (low, low), (high, high)
        if f in monotone:                        # neither side may cross the middle later on
            mid = (wl + wr) / 2
            lows, highs = ((low, mid), (mid, high)) if monotone[f] > 0 else ((mid, low), (high, mid))
        down = code[rows, f] <= j
        nodes[me][:2] = [f, float(cuts[f][j])]
        nodes[me][2] = grow(rows[down], level + 1, lows[0], highs[0])
        nodes[me][3] = grow(rows[~down], level + 1, lows[1], highs[1])
        return me

    every = np.arange(n)
    for _ in range(trees):
        p = sigmoid(margin)
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(grow(every, 0, -np.inf, np.inf))
    cols = list(zip(*nodes)) or [[]] * 5
    return Forest(np.array(cols[0], np.int64), np.array(cols[1], float), np.array(cols[2], np.int64),
                  np.array(cols[3], np.int64), np.array(cols[4], float), np.array(roots, np.int64), base, depth)
