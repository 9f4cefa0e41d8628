"""Binary hash trees of bounded height in van Emde Boas order.

A tree of L levels (the root is depth 0) is cut at half its height: the upper
``L // 2`` levels come first, then each subtree that hangs below them, all laid
out in the same way.  A path from a leaf to the root so touches few distinct
stretches of the array, whatever the size of a cache line.  Addresses are
arithmetic on (depth, index); the arrays hold one raw digest of 32 bytes for each
address, zeros where a ragged tree has no node.

Node (d, i) exists if ``i < counts[d]``; each level has half as many nodes as the
one below, rounded up.  A node is the SHA-256 of its children's hex digests,
joined; an only child is hashed alone.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import numpy as np

DIGEST = 32


def address(levels: int, depth: int, i):
    """Address of node(s) ``i`` at ``depth`` of a tree of ``levels`` levels."""
    if levels == 1:
        return i * 0
    top = levels // 2
    below = levels - top
    if depth < top:
        return address(top, depth, i)
    down = depth - top
    return (2 ** top - 1) + (i >> down) * (2 ** below - 1) + address(below, down, i & (2 ** down - 1))


@lru_cache(maxsize=64)
def layout(levels: int) -> list[list[int]]:
    """Addresses of all nodes, by depth and index."""
    return [address(levels, d, np.arange(2 ** d)).tolist() for d in range(levels)]


@lru_cache(maxsize=64)
def _order(levels: int) -> list[tuple[int, int]]:
    """Inner nodes in the order of construction: the subtrees below the cut, then the part above it, recursively."""
    def walk(n, depth, i):
        if n == 1:
            return [(depth, i)] if depth < levels - 1 else []
        top = n // 2
        out = []
        for j in range(2 ** top):
            out += walk(n - top, depth + top, (i << top) + j)
        return out + walk(top, depth, i)
    return walk(levels, 0, 0)


def counts(n: int, levels: int) -> list[int]:
    """Nodes at each depth of a tree with ``n`` leaves at depth ``levels - 1``."""
    return [-(-n >> levels - 1 - d) for d in range(levels)]


def join(parts) -> bytes:
    """The digest, in hex, of digests in hex."""
    return sha256(b"".join(parts)).hexdigest().encode()


def build(leaves: list[bytes], height: int) -> bytes:
    """The tree over hex digests ``leaves``, ``height`` steps high, as an array of raw digests."""
    levels = height + 1
    at, have = layout(levels), counts(len(leaves), levels)
    hexes = [b""] * (2 ** levels - 1)
    for a, h in zip(at[-1], leaves):
        hexes[a] = h
    for d, i in _order(levels):
        if i < have[d]:
            below = at[d + 1]
            pair = [hexes[below[2 * i]]]
            if 2 * i + 1 < have[d + 1]:
                pair.append(hexes[below[2 * i + 1]])
            hexes[at[d][i]] = join(pair)
    return b"".join(bytes.fromhex(h.decode()) if h else b"\0" * DIGEST for h in hexes)


class Block:
    """A stored tree: its root, and the way from each leaf to it."""

    def __init__(self, nodes: bytes, n: int):
        self.levels = (len(nodes) // DIGEST + 1).bit_length() - 1
        self.at, self.have = layout(self.levels), counts(n, self.levels)
        text = nodes.hex().encode()
        self.hexes = [text[j:j + 2 * DIGEST] for j in range(0, len(text), 2 * DIGEST)]

    def root(self) -> bytes:
        return self.hexes[0]

    def path(self, i: int) -> list[tuple[bytes, int]]:
        """(sibling in hex or empty, whether it stands on the left) of each step from leaf ``i`` up."""
        out = []
        for d in range(self.levels - 1, 0, -1):
            s = i ^ 1
            out.append((self.hexes[self.at[d][s]] if s < self.have[d] else b"", i & 1))
            i >>= 1
        return out


def fold(leaf: bytes, path) -> bytes:
    """The root that a leaf and its path give."""
    for sibling, left in path:
        leaf = join([sibling, leaf] if left else [leaf, sibling])
    return leaf


def packed(path) -> bytes:
    """A path as bytes: for each step its side, whether there is a sibling, and the sibling."""
    return b"".join(bytes([2 * left + bool(s)]) + s for s, left in path)


def unpacked(data: bytes) -> list[tuple[bytes, int]]:
    out, j = [], 0
    while j < len(data):
        step = 2 * DIGEST if data[j] & 1 else 0
        out.append((data[j + 1:j + 1 + step], data[j] >> 1))
        j += 1 + step
    return out
