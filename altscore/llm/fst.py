"""Finite-state compilation of a byte-level BPE tokenizer to token counts.

A sequence of tokens is what BPE makes of a word exactly if every two
neighbours are (BPE of ``u + v`` is ``[u, v]``).  That makes tokenization a
finite-state matter: a nondeterministic automaton reads bytes along a trie of
the vocabulary and may start a new token after ``u`` only with a ``v`` that
fits.  ``CountTransducer`` is its weighted determinisation: a state is the set
of hypotheses (last finished token, place in the trie, tokens finished beyond
the least), and every transition and every final state carries the number of
tokens that it emits.  States and transitions are compiled when a text first
needs them and kept, up to a bound.

Pre-tokenization (the library's split pattern) is a *local* automaton over
character classes: whether a word starts at a character depends on a few
neighbours, never on what came long before.  So the state map of a chunk of
text is constant but for its open ends, ``ChunkMap``: the characters before its
first certain boundary, the count between the first and the last, and the
characters after.  Maps compose associatively.  The chunks of a text are folded in
their order by the task that holds the text, not by a parallel scan; the text's memory
is that of the row, and an open end grows where a text has no certain boundary.
"""

from __future__ import annotations

import json
import re
import sys
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .common import worker_state
from .tokens import byte_symbols, tokenizer_path

CHUNK = 1 << 20            # characters of a text worked on at a time
WORDS = 300_000            # counts of words that a worker keeps, about 45 MB
STATES = 300_000           # compiled states that a worker keeps, about 200 MB

LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point, as the split pattern sees it."""
    import regex
    table = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    every = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            run = np.frombuffer(m.group().encode("utf-32-le"), "<u4")
            table[run] = kind
    table[[0x1C, 0x1D, 0x1E, 0x1F]] = OTHER     # not White_Space in Unicode
    table[0x20] = SPACE
    return table


def word_starts(text: str) -> np.ndarray:
    """Places (characters) at which the words of the split pattern start.

    The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\\sLN]+|\\s+(?!\\S)|\\s+``.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = classes()[code]
    n = len(kind)
    if not n:
        return np.zeros(0, dtype=np.int64)
    white = kind >= SPACE
    before = np.empty(n, dtype=np.uint8)            # class of the character before
    before[0], before[1:] = BLANK, kind[:-1]
    start = np.empty(n, dtype=bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start &= ~((before >= SPACE) & white)           # white space runs on ...
    start[0] = True
    # ... but its last character, if a word follows, stands for itself, and a
    # space there belongs to the word
    follows = np.zeros(n, dtype=bool)
    follows[:-1] = ~white[1:]
    start |= white & follows
    joined = ~white & (before == SPACE)
    joined[0] = False
    start &= ~joined
    # contractions: an apostrophe that starts a word, and the letters after it
    quotes = np.flatnonzero((code == 0x27) & start)
    for q in quotes.tolist():
        two, three = text[q:q + 2], text[q:q + 3]
        k = 2 if two in ("'s", "'t", "'m", "'d") else 3 if three in ("'re", "'ve", "'ll") else 0
        if k:
            start[q + 1:q + k] = False
            if q + k < n and (kind[q + k] == LETTER or not white[q + k]):
                start[q + k] = True
    return np.flatnonzero(start)


class CountTransducer:
    """Deterministic transducer from the bytes of a word to its token count."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = {s: b for b, s in byte_symbols().items()}
        # tokens by number: 0 stands for "none", then the single bytes, then
        # the merged ones in order of rank, so that a rank compares as a number
        number: dict[bytes, int] = {bytes([b]): b + 1 for b in range(256)}
        self.parts: list = [None] + [None] * 256      # the two tokens merged
        self.merged: dict = {}                        # (token, token) -> token
        tokens = [b""] + [bytes([b]) for b in range(256)]
        for m in model["merges"]:
            x, y = (bytes(byte[c] for c in t) for t in (m if isinstance(m, list) else m.split(" ")))
            if x + y in number:                       # made by an earlier merge already
                self.merged[number[x], number[y]] = number[x + y]
                continue
            number[x + y] = self.merged[number[x], number[y]] = len(tokens)
            self.parts.append((number[x], number[y]))
            tokens.append(x + y)
        self.children: list[dict] = [{}]
        self.token: list[int] = [0]
        for t, v in sorted(number.items()):
            if self.parts[v] and not self._fits_parts(v):
                continue                              # no word ever yields this token
            node = 0
            for b in t:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(0)
                node = nxt
            self.token[node] = v
        self.fits: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget the compiled states."""
        self.fits.clear()
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.final: list[int] = []              # tokens emitted at the end of the word
        self.moves: dict[int, int] = {}         # state, byte -> state, tokens emitted
        self._state(((0, 0, 0),))

    def _fits_parts(self, v: int) -> bool:
        """Whether BPE of the token's own bytes yields the token."""
        x, y = self.parts[v]
        return self._apart(x, y, v)

    def _apart(self, u: int, v: int, limit: int) -> bool:
        """Whether no merge earlier than ``limit`` crosses the border of u and v.

        The border sees, in order of time, ever larger tokens to its left and
        right.  Backwards: at the time of the later of the two merges that
        made u and v both stood there; before it, only the part of that token
        that touches the border.  A merge across the border wins when it
        comes before the merge that ends the pair.
        """
        while True:
            m = self.merged.get((u, v))
            if m is not None and m < limit:
                return False
            left, right = self.parts[u], self.parts[v]
            if left is None and right is None:
                return True
            # ties can't be between different tokens; of two equal ones the
            # left is merged first, so the right is undone first
            if right is None or (left is not None and u > v):
                limit, u = u, left[1]
            else:
                limit, v = v + 1, right[0]

    def _fits(self, u: int, v: int) -> bool:
        key = u << 20 | v
        ok = self.fits.get(key)
        if ok is None:
            ok = self.fits[key] = not u or self._apart(u, v, len(self.parts) + 1)
        return ok

    def _state(self, hypotheses: tuple) -> int:
        k = self.states.get(hypotheses)
        if k is None:
            k = self.states[hypotheses] = len(self.sets)
            self.sets.append(hypotheses)
            self.final.append(next((c for _, node, c in hypotheses if node == 0), 0))
        return k

    def _compile(self, state: int, b: int) -> int:
        out = []
        for u, node, c in self.sets[state]:
            to = self.children[node].get(b)
            if to is None:
                continue
            out.append((u, to, c))
            v = self.token[to]
            if v and self._fits(u, v):
                out.append((v, 0, c + 1))
        least = min([c for _, _, c in out])
        step = self.moves[state << 8 | b] = self._state(tuple(sorted([(u, node, c - least) for u, node, c in out]))) << 8 | least
        return step

    def count(self, word: bytes) -> int:
        state = emitted = 0
        moves = self.moves
        for b in word:
            step = moves.get(state << 8 | b)
            if step is None:
                step = self._compile(state, b)
            state = step >> 8
            emitted += step & 255
        return emitted + self.final[state]


class ChunkMap(NamedTuple):
    """State map of a chunk: open characters at its ends, tokens between.

    ``tail`` is None while no certain boundary has been seen: the whole chunk
    is then ``head``.
    """
    head: str
    tokens: int
    tail: str | None


# a word starts at a space that follows a character other than white space
# (and never ends before it): certain whatever stands around the chunk
CERTAIN = re.compile(r"(?<=[^\s\x1c-\x1f])(?= [^\s])")


class TokenCounter:
    def __init__(self, path: str, special: tuple[str, ...]):
        self.transducer = CountTransducer(path)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.known: dict[str, int] = {}

    def _words(self, texts: list[str]) -> list[int]:
        """Tokens of each text, all words of all texts at once."""
        blob = "".join(texts)
        if not blob:
            return [0] * len(texts)
        ends = np.cumsum([len(t) for t in texts])
        starts, at = [], 0
        for t, end in zip(texts, ends.tolist()):
            starts.append(word_starts(t) + at)
            at = end
        first = np.concatenate(starts)
        # characters -> bytes, for a column of words that shares the buffer
        data = blob.encode("utf-8", "surrogatepass")
        if len(data) == len(blob):
            offsets = np.append(first, len(blob))
        else:
            lead = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            offsets = np.append(lead[first], len(data))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        per_word = np.array(self._counts(coded.dictionary.to_pylist()), dtype=np.int64)[coded.indices.to_numpy()]
        scan = np.concatenate([[0], np.cumsum(per_word)])
        upto = scan[np.searchsorted(first, ends, side="left")]
        return np.diff(upto, prepend=0).tolist()

    def _counts(self, words: list[bytes]) -> list[int]:
        known, t = self.known, self.transducer
        if len(known) > WORDS:
            known.clear()
        if len(t.sets) > STATES:
            t.reset()
        out = []
        for w in words:
            n = known.get(w)
            if n is None:
                n = known[w] = t.count(w)
            out.append(n)
        return out

    def chunk_map(self, chunk: str) -> ChunkMap:
        first = CERTAIN.search(chunk)
        if first is None:
            return ChunkMap(chunk, 0, None)
        last = first.start()
        back = max(last, len(chunk) - 4096)
        for m in CERTAIN.finditer(chunk, back):
            last = m.start()
        return ChunkMap(chunk[:first.start()], self._words([chunk[first.start():last]])[0], chunk[last:])

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.tail is None:
            return self._closed(a.head + b.head, b)
        if b.tail is None:
            c = self.chunk_map(a.tail + b.head)      # starts at a boundary
            return ChunkMap(a.head, a.tokens + self._words([c.head])[0] + c.tokens, c.tail) if c.tail is not None \
                else ChunkMap(a.head, a.tokens, a.tail + b.head)
        return ChunkMap(a.head, a.tokens + self._words([a.tail + b.head])[0] + b.tokens, b.tail)

    @staticmethod
    def _closed(head: str, b: ChunkMap) -> ChunkMap:
        return ChunkMap(head, b.tokens, b.tail)

    def _long(self, text: str) -> int:
        """Scan over the maps of the chunks of one long text."""
        total = None
        for k in range(0, len(text), CHUNK):
            m = self.chunk_map(text[k:k + CHUNK])
            total = m if total is None else self.compose(total, m)
        return total.tokens + sum(self._words([total.head, total.tail or ""]))

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text as the library gives them (null: 0)."""
        parts, owner, extra = [], [], [0] * len(texts)
        for k, t in enumerate(texts):
            cut = self.special.split(t) if self.special and t else [t or ""]
            extra[k] += len(cut) - 1                 # special strings are one token each
            for p in cut:
                if len(p) > CHUNK:
                    extra[k] += self._long(p)
                elif p:
                    parts.append(p)
                    owner.append(k)
        size, group = 0, []
        for j, p in enumerate(parts):
            group.append(j)
            size += len(p)
            if size >= CHUNK or j == len(parts) - 1:
                for i, n in zip(group, self._words([parts[i] for i in group])):
                    extra[owner[i]] += n
                size, group = 0, []
        return extra


def _load(name: str) -> TokenCounter:
    path = name if "/" in name else tokenizer_path(name)
    with open(path, encoding="utf-8") as f:
        special = tuple(t["content"] for t in json.load(f)["added_tokens"])
    return TokenCounter(path, special)


def counter(name: str) -> TokenCounter:
    """This worker's counter (kept between tasks)."""
    return worker_state(("counter", name), lambda: _load(name))
