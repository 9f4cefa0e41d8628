"""Probabilistic automata inferred from strings, by merging compatible states.

The strings' prefix tree is an automaton that knows how often each state was
visited, left by each symbol, and ended in.  Starting from the root, states are
kept or merged: the busiest state just outside the kept ones is folded into the
first kept state with which it is *compatible*, and kept itself if there is
none.  Two states are compatible if the shares of ending and of each symbol
differ by no more than Hoeffding's bound for their visits allows, and so for
all states that the same symbols lead to.

Symbols are classes of characters, so that a format and its length show in few
examples: ``h`` digits and a-f, ``z`` other letters, and every other sign itself.  A string
without a small letter is read in small letters.  Which character of its class it is
counts with one distribution for the whole automaton.
"""

from __future__ import annotations

import heapq
from collections import Counter
from math import log, sqrt

ALPHA = 0.05               # risk of telling apart two states that are alike
SMOOTH = 0.05              # visits that every symbol and the end get on top
SIGNS = "+/_.=-"
CLASSES = str.maketrans({c: "h" if c in "0123456789abcdef" else "z" for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"})
SYMBOLS = len(SIGNS) + 2


def read(t: str) -> tuple[str, str]:
    """The string as it is read, and its symbols."""
    if not any("a" <= c <= "z" for c in t):
        t = t.lower()
    return t, t.translate(CLASSES)


class _Tree:
    """Prefix tree, then the automaton made of it: for each state visits, ends, and by symbol passes and the next state."""

    def __init__(self, words: list[str]):
        self.visits, self.ends, self.passes, self.next = [0], [0], [Counter()], [{}]
        for w in words:
            at = 0
            self.visits[0] += 1
            for c in w:
                self.passes[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.visits)
                    self.visits.append(0)
                    self.ends.append(0)
                    self.passes.append(Counter())
                    self.next.append({})
                at = self.next[at][c]
                self.visits[at] += 1
            self.ends[at] += 1

    def alike(self, a: int, b: int, alpha: float) -> bool:
        """Whether ``a`` and ``b``, the root of a tree, are compatible."""
        bound = sqrt(0.5 * log(2.0 / alpha))
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.visits[a], self.visits[b]
            if not n or not m:
                continue
            far = bound * (1.0 / sqrt(n) + 1.0 / sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > far:
                return False
            for c in self.passes[a].keys() | self.passes[b].keys():
                if abs(self.passes[a][c] / n - self.passes[b][c] / m) > far:
                    return False
            todo += [(self.next[a][c], v) for c, v in self.next[b].items() if c in self.next[a]]
        return True

    def fold(self, a: int, b: int) -> set[int]:
        """Adds ``b``, the root of a tree, to ``a``; the states that changed."""
        changed, todo = set(), [(a, b)]
        while todo:
            a, b = todo.pop()
            changed.add(a)
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            self.passes[a].update(self.passes[b])
            for c, v in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], v))
                else:
                    self.next[a][c] = v
        return changed


class Automaton:
    """States with log probabilities of symbols and of ending; unseen symbols lead back to the start."""

    def __init__(self, steps: list[dict[str, tuple[int, float]]], unseen: list[float], ends: list[float], chars: dict[str, float], other: dict[str, float]):
        self.steps, self.unseen, self.ends, self.chars, self.other = steps, unseen, ends, chars, other

    def score(self, t: str) -> float:
        """Log probability of a string of credential characters."""
        text, symbols = read(t)
        steps, unseen, at, total = self.steps, self.unseen, 0, 0.0
        for c in symbols:
            step = steps[at].get(c)
            if step is None:
                total += unseen[at]
                at = 0
            else:
                at = step[0]
                total += step[1]
        chars, other = self.chars, self.other
        for c, n in Counter(text).items():
            total += n * (chars[c] if c in chars else other.get(c.translate(CLASSES), 0.0))
        return total + self.ends[at]


def infer(words: list[str], alpha: float = ALPHA) -> Automaton:
    """The automaton of the words (each as often as it occurs); it does not depend on their order."""
    texts = sorted(read(w) for w in words)
    tree = _Tree([s for _, s in texts])
    kept, places = [0], {0: 0}
    parents: dict[int, tuple[int, str]] = {}
    open_: list[tuple[int, int]] = []

    def reach(state):
        for c, v in sorted(tree.next[state].items()):
            if v not in places:
                if parents.get(v) != (state, c):
                    parents[v] = state, c
                heapq.heappush(open_, (-tree.visits[v], v))

    reach(0)
    while open_:
        weight, b = heapq.heappop(open_)
        if b in places or b not in parents or -weight != tree.visits[b]:
            continue                                           # settled, folded away, or listed again with more visits
        state, c = parents[b]
        if tree.next[state].get(c) != b:
            continue
        into = next((a for a in kept if tree.alike(a, b, alpha)), None)
        if into is None:
            places[b] = len(kept)
            kept.append(b)
            reach(b)
            continue
        del parents[b]
        tree.next[state][c] = into
        for a in tree.fold(into, b):
            if a in places:
                reach(a)
            elif a in parents:
                heapq.heappush(open_, (-tree.visits[a], a))
    steps, unseen, ends = [], [], []
    for a in kept:
        total = tree.visits[a] + SMOOTH * (SYMBOLS + 1)
        steps.append({c: (places[v], log((tree.passes[a][c] + SMOOTH) / total)) for c, v in tree.next[a].items()})
        unseen.append(log(SMOOTH / total))
        ends.append(log((tree.ends[a] + SMOOTH) / total))
    count = Counter("".join(t for t, _ in texts))
    size = {"h": 16, "z": 46}                                  # g-z, and A-Z where small letters stand beside them
    of = {k: sum(n for c, n in count.items() if c.translate(CLASSES) == k) for k in size}
    chars = {c: log((n + 0.5) / (of[k] + 0.5 * size[k])) for c, n in count.items() if (k := c.translate(CLASSES)) in size}
    other = {k: log(0.5 / (of[k] + 0.5 * size[k])) for k in size}
    return Automaton(steps, unseen, ends, chars, other)
