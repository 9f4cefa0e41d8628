"""Cover trees for largest inner products, as flat arrays.

Vectors x are *norm-augmented*: scaled by the largest norm M and given one more
component so that all lie on the unit sphere.  A query with a zero there has
<q, x> = |q| M cos(angle to the augmented x), so a ball on the sphere bounds the
inner products of all it covers, from above and from below.

Centres come in farthest-first order: the first m of them are, for every m, a net
that covers all points within the distance at which the next one was found, and whose
members are farther apart than that.  Level l is the net of radius R / BASE^l; each
centre hangs below the nearest one of the level before.  Each node knows the
covering radius of its level (the farthest point below it), and the smallest and
largest label below it.  Points lie in the buckets of the last level.

The descent takes the open node with the highest bound first, skips nodes that
reach into none of the windows asked for, or only below the k-th best found
there, and computes the inner products of a bucket's points exactly.
"""

from __future__ import annotations

import heapq

import numpy as np

BASE = 1.3                 # ratio of the radii of neighbouring levels
LEAF = 32                  # points of a bucket, on average
SLACK = 1e-6               # of |q| M: more than the rounding of the bounds
AT_ONCE = 16               # buckets that are verified together
EXACT = 2.0 ** 53          # products below it are exact in double precision
FAR = 2 ** 60              # beyond every score

# name -> type of the arrays of a tree
ARRAYS = {"points": np.int64, "labels": np.int64, "ids": np.int64, "id_start": np.int64, "centre": np.int64, "radius": np.float64,
          "low": np.int64, "high": np.int64, "child_start": np.int64, "children": np.int64, "bucket_start": np.int64, "root": np.int64}


def _chord(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))


def _lower(v: np.ndarray) -> np.ndarray:
    return v - np.abs(v) * 1e-12


def sphere(x: np.ndarray) -> tuple[np.ndarray, float]:
    """The augmented points, and M."""
    norm = np.sqrt(np.einsum("nd,nd->n", x, x))
    m = max(float(norm.max(initial=0.0)), 1.0)
    rest = np.sqrt(np.maximum(0.0, 1.0 - (norm / m) ** 2))
    a = np.concatenate([x / m, rest[:, None]], axis=1)
    return a / np.sqrt(np.einsum("nd,nd->n", a, a))[:, None], m


def _nets(a: np.ndarray, leaf: int):
    """Centres in farthest-first order, how far each was from those before, each point's nearest centre, and the first radius."""
    order, found = [0], [np.inf]
    dist = _chord(a @ a[0])
    near = np.zeros(len(a), np.int64)
    radius = float(dist.max())
    while len(order) * leaf < len(a):
        j = int(dist.argmax())
        if dist[j] <= 1e-7:
            break
        d = _chord(a @ a[j])
        closer = d < dist
        closer[j] = True
        near[closer] = len(order)
        dist[closer] = d[closer]
        dist[j] = 0.0
        found.append(float(min(found[-1], d[order].min())))
        order.append(j)
    near[order] = np.arange(len(order))
    return np.array(order), np.array(found), near, radius


def build(x: np.ndarray, labels: np.ndarray, ids: list[list[int]], leaf: int = LEAF, base: float = BASE) -> dict[str, np.ndarray]:
    """The tree over integer vectors ``x`` (one row each) with their labels and the ids that bear them."""
    a, _ = sphere(x.astype(np.float64))
    order, found, near, radius = _nets(a, leaf)
    # sizes of the nets, coarse to fine, without levels that add nothing
    level = np.zeros(len(order), np.int64)
    if len(order) > 1:
        level[1:] = np.maximum(1, np.floor(np.log(np.maximum(radius / found[1:], 1.0)) / np.log(base)).astype(np.int64) + 1)
    level = np.maximum.accumulate(level)
    sizes = sorted({int(np.searchsorted(level, v, side="right")) for v in level})
    place = np.argsort(near, kind="stable")
    a_c = a[order]
    up = [np.zeros(1, np.int64)]                               # up[l][k]: centre above centre k of level l
    for before, m in zip(sizes, sizes[1:]):
        own = np.arange(m)
        own[before:] = (a_c[before:m] @ a_c[:before].T).argmax(axis=1)
        up.append(own)
    offset = np.concatenate([[0], np.cumsum(sizes)])
    n = int(offset[-1])
    centre, reach = np.zeros(n, np.int64), np.zeros(n)
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    at = near.copy()
    position = np.empty(len(a), np.int64)
    position[place] = np.arange(len(a))
    for lv in range(len(sizes) - 1, -1, -1):
        node = offset[lv] + at
        centre[offset[lv]:offset[lv + 1]] = position[order[:sizes[lv]]]
        np.maximum.at(reach, node, _chord(np.einsum("nd,nd->n", a, a_c[at])))
        np.minimum.at(low, node, labels)
        np.maximum.at(high, node, labels)
        at = up[lv][at]
    # a node whose only child is itself one level down is passed over
    stands = np.arange(n)
    below: list[list[int]] = [[] for _ in range(n)]
    for lv in range(len(sizes) - 2, -1, -1):
        for k, parent in enumerate(up[lv + 1]):
            below[offset[lv] + parent].append(int(stands[offset[lv + 1] + k]))
        for k in range(sizes[lv]):
            if len(below[offset[lv] + k]) == 1:
                stands[offset[lv] + k] = below[offset[lv] + k][0]
    last = int(offset[-2])
    buckets = np.searchsorted(near[place], np.arange(sizes[-1] + 1))
    return {"points": np.ascontiguousarray(x[place], np.int64), "labels": labels[place].astype(np.int64),
            "ids": np.array([i for p in place for i in ids[p]], np.int64),
            "id_start": np.concatenate([[0], np.cumsum([len(ids[p]) for p in place])]),
            "centre": centre, "radius": reach, "low": low, "high": high,
            "child_start": np.concatenate([[0], np.cumsum([len(b) for b in below])]),
            "children": np.array([c for b in below for c in b], np.int64),
            "bucket_start": np.concatenate([np.zeros(last, np.int64), buckets]),
            "root": np.array([stands[0]])}


class Search:
    """Best-first descents in one tree."""

    def __init__(self, tree: dict[str, np.ndarray], dim: int):
        self.t = tree
        self.ints = tree["points"].reshape(len(tree["labels"]), dim)
        self.x = self.ints.astype(np.float64)
        self.norm = float(np.sqrt(np.einsum("nd,nd->n", self.x, self.x)).max(initial=0.0))
        self.m = max(self.norm, 1.0)
        self.spread = 2.0 * np.arcsin(np.minimum(1.0, tree["radius"] / 2.0 + 1e-7))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest inner product with ``q`` below each node."""
        size = float(np.sqrt(q @ q)) * self.m
        if size == 0.0:
            return np.zeros(len(self.spread)), np.zeros(len(self.spread))
        angle = np.arccos(np.clip(self.x[self.t["centre"]] @ q / size, -1.0, 1.0))
        slack = SLACK * size
        return (size * np.cos(np.minimum(np.pi, angle + self.spread)) - slack,
                size * np.cos(np.maximum(0.0, angle - self.spread)) + slack)

    def best(self, q: np.ndarray, own: int, label: int, same: bool, windows: np.ndarray, k: int):
        """For each window (lowest, highest score): scores and ids of the k best points in it that bear
        ``label`` (``same``) or another one, without id ``own``; ties to the smaller id."""
        t, fq = self.t, q.astype(np.float64)
        exact = self.norm * float(np.sqrt(fq @ fq)) < EXACT
        low, high = self.bounds(fq)
        fits = (t["low"] <= label) & (label <= t["high"]) if same else ~((t["low"] == label) & (t["high"] == label))
        # what a score must reach and may not pass, in each window; as doubles, a little wider
        floor, ceiling = windows[:, 0].copy(), windows[:, 1]
        bar, lid = _lower(floor), -_lower(-ceiling)
        top = np.minimum(high[:, None], lid)                   # highest score that a node can have in a window
        top[~(fits[:, None] & (high[:, None] >= bar) & (low[:, None] <= lid))] = -np.inf
        urge = top.max(axis=1)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(windows)
        root = int(t["root"][0])
        heap = [(-urge[root], root)] if urge[root] > -np.inf else []
        starts, children, buckets = t["child_start"], t["children"], t["bucket_start"]
        while heap:
            leaves = []
            while heap and len(leaves) < AT_ONCE:
                node = heapq.heappop(heap)[1]
                if not (top[node] >= bar).any():
                    continue
                inside = children[starts[node]:starts[node + 1]]
                if not len(inside):
                    leaves.append(node)
                for c in inside.tolist():
                    if urge[c] > -np.inf:
                        heapq.heappush(heap, (-urge[c], c))
            if not leaves:
                break
            rows = np.concatenate([np.arange(buckets[v], buckets[v + 1]) for v in leaves])
            rows = rows[(t["labels"][rows] == label) == same]
            score = (self.x[rows] @ fq).astype(np.int64) if exact else self.ints[rows] @ q
            for w in range(len(windows)):
                hit = (score >= floor[w]) & (score <= ceiling[w])
                if not hit.any():
                    continue
                r, s = rows[hit], score[hit]
                n = t["id_start"][r + 1] - t["id_start"][r]
                which = np.repeat(t["id_start"][r] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                ids, s = t["ids"][which], np.repeat(s, n)
                keep = ids != own
                ids, s = np.concatenate([found[w][1], ids[keep]]), np.concatenate([found[w][0], s[keep]])
                order = np.lexsort((ids, -s))[:k]
                found[w] = s[order], ids[order]
                if len(order) == k:
                    floor[w] = s[order[-1]]
                    bar[w] = _lower(floor[w])
        return found
