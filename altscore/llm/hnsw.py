"""Hierarchical navigable small-world graphs as flat neighbour arrays.

One graph indexes one shard.  Nodes are numbered by falling level, so layer l
is the first ``sizes[l]`` nodes and its links are one integer array of shape
(nodes, degree), padded with -1.  Nodes are inserted in batches: all nodes of a
batch walk the graph of the earlier ones at once (vectorised beam search), see
each other directly, keep a diverse choice of the nearest, and are linked back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

M = 16                     # links of a node in upper layers; twice that in layer 0
BUILD = 64                 # beam while building
BATCH = 1024               # nodes inserted, or queries answered, at a time
EXPAND = 4                 # nodes of the beam expanded in one step


@dataclass
class Graph:
    vectors: np.ndarray            # unit vectors, float32, in node order
    links: list[np.ndarray]        # by layer, layer 0 first

    def search(self, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities of the k nearest found, best first (-1: none)."""
        nodes, sims = [], []
        for at in range(0, len(queries), BATCH):
            q = queries[at:at + BATCH]
            entry = np.zeros((len(q), 1), np.int64)
            for links in self.links[:0:-1]:
                entry = beam_search(self.vectors, links, q, entry, 4)[0][:, :4]
            n, s = beam_search(self.vectors, self.links[0], q, entry, max(beam, k))
            nodes.append(_wide(n, k, -1))
            sims.append(_wide(s, k, -np.inf))
        return np.concatenate(nodes), np.concatenate(sims)


def _wide(a: np.ndarray, k: int, fill) -> np.ndarray:
    return a[:, :k] if a.shape[1] >= k else np.pad(a, ((0, 0), (0, k - a.shape[1])), constant_values=fill)


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int):
    """Best ``beam`` nodes of one layer for each query, starting at ``entry``."""
    n, rows = len(links), np.arange(len(queries))
    seen = np.zeros((len(queries), n + 1), dtype=bool)        # the last column stands for -1
    seen[:, n] = True
    # repeated entries count once
    entry = np.sort(entry, axis=1)[:, ::-1].copy()
    entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = -1
    seen[rows[:, None], entry] = True
    nodes = np.full((len(queries), beam), -1, np.int64)
    sims = np.full((len(queries), beam), -np.inf, np.float32)
    open_ = np.zeros((len(queries), beam), dtype=bool)
    nodes, sims, open_ = _merge(nodes, sims, open_, entry, _similar(vectors, queries, entry))
    active = rows
    while len(active):
        s = np.where(open_[active], sims[active], -np.inf)
        pick = np.argpartition(-s, min(EXPAND, beam - 1), axis=1)[:, :EXPAND] if beam > EXPAND else np.argsort(-s, axis=1)
        some = np.take_along_axis(s, pick, axis=1) > -np.inf
        going = some.any(axis=1)
        active, pick, some = active[going], pick[going], some[going]
        if not len(active):
            break
        at = np.where(some, np.take_along_axis(nodes[active], pick, axis=1), -1)
        mine = open_[active]
        np.put_along_axis(mine, pick, False, axis=1)
        open_[active] = mine
        near = np.where(at[:, :, None] >= 0, links[at], -1).reshape(len(active), -1)
        near = np.where(seen[active[:, None], near], -1, near)
        # one node may be linked from two expanded ones
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        seen[active[:, None], near] = True
        width = int((near >= 0).sum(axis=1).max(initial=0))
        if not width:
            continue
        near = np.sort(near, axis=1)[:, ::-1][:, :width]
        nodes[active], sims[active], open_[active] = _merge(nodes[active], sims[active], open_[active], near,
                                                            _similar(vectors, queries[active], near))
    return nodes, sims


def _similar(vectors, queries, nodes):
    s = np.einsum("qcd,qd->qc", vectors[nodes], queries)
    return np.where(nodes >= 0, s, -np.inf).astype(np.float32)


def _merge(nodes, sims, open_, new, new_sims):
    beam = nodes.shape[1]
    n, s = np.concatenate([nodes, new], axis=1), np.concatenate([sims, new_sims], axis=1)
    o = np.concatenate([open_, new >= 0], axis=1)
    order = np.argsort(-s, axis=1, kind="stable")[:, :beam]
    take = np.take_along_axis
    return take(n, order, 1), take(s, order, 1), take(o, order, 1)


def diverse(vectors: np.ndarray, nodes: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of candidates (best first, -1: none) those nearer to the node than to any
    chosen before; places left go to the best of the others."""
    q, c = nodes.shape
    x = vectors[nodes]
    between = np.matmul(x, x.transpose(0, 2, 1))
    chosen = np.zeros((q, c), dtype=bool)
    closest = np.full((q, c), -np.inf, dtype=np.float32)       # to a chosen one
    count = np.zeros(q, np.int64)
    for j in range(c):
        ok = (nodes[:, j] >= 0) & (sims[:, j] > closest[:, j]) & (count < degree)
        chosen[:, j] = ok
        count += ok
        closest = np.where(ok[:, None], np.maximum(closest, between[:, j]), closest)
    rank = np.where(nodes < 0, 2 * c, np.where(chosen, 0, c) + np.arange(c))
    order = np.argsort(rank, axis=1, kind="stable")[:, :degree]
    return _wide(np.take_along_axis(nodes, order, axis=1), degree, -1)


def _link_back(vectors, links, new, degree):
    """Add the reverse of the links of nodes ``new``; overfull lists are thinned."""
    src = np.repeat(new, links.shape[1])
    dst = links[new].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    sim = np.einsum("id,id->i", vectors[src], vectors[dst])
    order = np.lexsort((-sim, dst))
    src, dst = src[order], dst[order]
    to, first, n = np.unique(dst, return_index=True, return_counts=True)
    rank = np.arange(len(dst)) - np.repeat(first, n)
    for at in range(0, len(to), BATCH):
        part = to[at:at + BATCH]
        # nearest first, and at most as many as a list is long: a node's list is bounded by the method
        mine = np.full((len(part), degree), -1, np.int64)
        own = (dst >= part[0]) & (dst <= part[-1]) & (rank < degree)
        mine[np.searchsorted(part, dst[own]), rank[own]] = src[own]
        both = np.concatenate([links[part], mine], axis=1)
        both = np.sort(both, axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        s = _similar(vectors, vectors[part], both)
        order = np.argsort(-s, axis=1, kind="stable")
        links[part] = diverse(vectors, np.take_along_axis(both, order, 1), np.take_along_axis(s, order, 1), degree)


def build(unit: np.ndarray, levels: np.ndarray, beam: int = BUILD) -> tuple[np.ndarray, Graph]:
    """Graph of unit vectors; also the place of each node in the input."""
    place = np.argsort(-levels, kind="stable")
    v, lv = np.ascontiguousarray(unit[place], np.float32), levels[place]
    graph = Graph(v, [])
    for layer in range(int(lv[0]) if len(lv) else 0, -1, -1):
        n, degree = int((lv >= layer).sum()), 2 * M if layer == 0 else M
        links = np.full((n, degree), -1, np.int32)
        done = 0
        while done < n:
            # a batch is no larger than what it is hung on
            size = min(n - done, BATCH, max(done, 4 * degree))
            new = np.arange(done, done + size)
            x = v[new]
            cand, sims = np.zeros((size, 0), np.int64), np.zeros((size, 0), np.float32)
            if done:
                entry = np.zeros((size, 1), np.int64)
                for upper in graph.links[::-1]:
                    entry = np.minimum(beam_search(v, upper, x, entry, 4)[0][:, :4], n - 1)
                entry = np.where(entry < done, entry, 0)
                cand, sims = beam_search(v, links[:done], x, entry, beam)
            among = x @ x.T
            np.fill_diagonal(among, -np.inf)
            k = min(size - 1, degree)
            if k > 0:
                best = np.argpartition(-among, k - 1, axis=1)[:, :k]
                cand = np.concatenate([cand, best + done], axis=1)
                sims = np.concatenate([sims, np.take_along_axis(among, best, axis=1)], axis=1)
            if cand.shape[1]:
                order = np.argsort(-sims, axis=1, kind="stable")
                links[new] = diverse(v, np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1), degree)
                _link_back(v, links, new, degree)
            done += size
        graph.links.insert(0, links)
    return place, graph
