"""op4: packings are valid, and as short as can be on small instances."""

import itertools
import zlib

import numpy as np

from altscore.llm import packing as P
from altscore.llm import tokens as K
from fixtures import edge_docs, no_docs


def _valid(patterns, counts, capacity):
    used = np.zeros_like(counts)
    for m, items in patterns:
        assert m > 0 and sum(x * q for x, q in items) <= capacity
        for x, q in items:
            used[x] += m * q
    assert np.array_equal(used, counts)


def _optimum(lengths, capacity):
    """Fewest bins, by depth-first search."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        seen = set()
        for k, b in enumerate(bins):
            if b + lengths[i] <= capacity and b not in seen:
                seen.add(b)
                go(i + 1, bins[:k] + [b + lengths[i]] + bins[k + 1:])
        go(i + 1, bins + [lengths[i]])
    go(0, [])
    return best


def test_reduction_never_costs_a_bin():
    rng = np.random.default_rng(2)
    for t in range(150):
        capacity = int(rng.integers(8, 40))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 10)))
        counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
        fixed, rest = P.reduce_instance(counts, capacity)
        _valid(fixed + [(int(n), [(int(x), 1)]) for x, n in enumerate(rest) if n], counts, capacity)
        left = list(itertools.chain.from_iterable([x] * int(n) for x, n in enumerate(rest)))
        assert sum(m for m, _ in fixed) + _optimum(left, capacity) == _optimum(lengths.tolist(), capacity)
        _valid(P.pack_counts(counts, capacity), counts, capacity)


def _lower_bound(counts, capacity):
    """Martello and Toth's L2: pieces that leave less than a go alone, pieces
    over half a sequence take one each, the others need what these leave."""
    size, best = np.arange(capacity + 1), 0
    for a in range(0, capacity // 2 + 1):
        alone = counts[capacity - a + 1:].sum()
        half = slice(capacity // 2 + 1, capacity - a + 1)
        rest = (counts * size)[a:capacity // 2 + 1].sum() - (counts[half].sum() * capacity - (counts * size)[half].sum())
        best = max(best, int(alone + counts[half].sum() + max(0, -(-rest // capacity))))
    return best


def test_large_counts():
    rng = np.random.default_rng(3)
    counts = np.zeros(2049, np.int64)
    counts[1:] = rng.integers(0, 2000, 2048)
    patterns = P.pack_counts(counts, 2048)
    _valid(patterns, counts, 2048)
    assert sum(m for m, _ in patterns) <= 1.02 * _lower_bound(counts, 2048) + 1


def test_cut():
    assert P.cut_lengths(5, 4) == [1, 4] and P.cut_lengths(8, 4) == [4, 4] and P.cut_lengths(3, 4) == [3]


def test_pack_edges(spark):
    d = edge_docs(spark)
    got = P.pack(d, capacity=64).toPandas()
    tok = K.load_tokenizer(K.tokenizer_path(P.TOKENIZER))
    want = []
    for r in d.collect():
        ids, at = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4"), 0
        for k, n in enumerate(P.cut_lengths(len(ids), 64)):
            want.append((r.doc_id, k, at, n, zlib.crc32(ids[at:at + n])))
            at += n
    key = lambda t: tuple(-1 if x != x or x is None else int(x) for x in t)
    assert sorted(map(key, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(map(key, want))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 64


def test_empty(spark):
    assert P.pack(no_docs(spark)).count() == 0
