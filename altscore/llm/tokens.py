"""Token ids of whole texts by the tokenizers library, piece by piece.

Texts are cut at single spaces and line ends, where these tokenizers always
cut as well.  Each *distinct* piece is split by the tokenizer's own pattern
and its words go through the library's BPE model once; a text is then the
concatenation of what its pieces gave.  A text in which a cut could change the
result (runs of white space, special strings, white space at an end) is given
to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from .common import worker_state

PIECES = 320_000          # pieces and words that one worker keeps: up to
WORDS = 160_000           # twice as many of each, about 160 MB in all

# Fixed value: the split pattern of byte-level tokenizers that name none.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# separators that Python's \s has and Unicode's White_Space has not
ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
FIRST = "\udfff"          # marks a text's first piece; no text holds half a surrogate pair


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark's tasks are the parallelism
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def byte_symbols() -> dict[int, str]:
    """The printable symbol that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of pieces; one that isn't there is learnt."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, piece):
        ids = self[piece] = self.learn(piece)
        return ids


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, name: str):
        import regex
        path = name if os.path.sep in name else tokenizer_path(name)
        self.tok = load_tokenizer(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        own = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split"]
        self.split = regex.compile(own[0] if own else BYTE_LEVEL).findall
        self.unsafe = re.compile("|".join(map(re.escape, [t["content"] for t in spec["added_tokens"]] + list(ODD)))).search
        self.model = self.tok.model
        self.normalize = self.tok.normalizer.normalize_str if self.tok.normalizer else None
        self.symbols = str.maketrans({chr(b): s for b, s in byte_symbols().items()})
        # two generations of each: what is asked for again stays
        self.cache, self.old, self.words, self.old_words = _Pieces(self._piece), {}, {}, {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _pieces(self, text: str) -> list:
        """Keys of the pieces.  Where spaces count, a key stands for a space
        and itself, unless it starts with a line end or FIRST."""
        if self.normalize:
            return text.replace("\n", " ").split(" ")
        pieces = text.replace("\n", " \n").split(" ")
        pieces[0] = FIRST + pieces[0]
        return pieces

    def _word(self, word: str) -> bytes:
        """Ids of one word of the split pattern."""
        ids = self.old_words.get(word)
        if ids is None:
            if word.isascii() and word[1:].isalpha():    # byte-level symbols of letters are the letters
                symbols = "\u0120" + word[1:] if word[0] == " " else word
            else:
                symbols = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.symbols)
            ids = array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()
        self.words[word] = ids
        return ids

    def _odd(self, p: str) -> bytes | None:
        """Ids of a piece that is more than a word; None if it can't stand alone."""
        if self.unsafe(p):
            return None
        if self.normalize:
            text = self.normalize(p)
        else:
            text = p[1:] if p[:1] == FIRST else p if p[:1] == "\n" else " " + p
            body = p[1:] if p[:1] in ("\n", FIRST) else p
            if not body or body[0].isspace() or body[-1].isspace():
                return None
        words = self.words
        return b"".join([words.get(w) or self._word(w) for w in self.split(text)])

    def _piece(self, p: str) -> bytes | None:
        """Ids of a piece that the young generation doesn't have."""
        old = self.old
        if p in old:
            return old[p]
        words = self.words
        if p.isalpha():                                  # letters are one word, as the pattern has it
            if not self.normalize:
                p = " " + p
                return words.get(p) or self._word(p)
            if p.isascii():
                p = p.lower()
                return words.get(p) or self._word(p)
        elif p[-1:] in (".", ",") and not self.normalize and p[:-1].isalpha():
            w, end = " " + p[:-1], p[-1]
            return (words.get(w) or self._word(w)) + (words.get(end) or self._word(end))
        return self._odd(p)

    def encode(self, texts: list) -> list:
        """The ids of each text (null: none) as bytes."""
        if len(self.cache) > PIECES:
            self.cache, self.old = _Pieces(self._piece), self.cache
        if len(self.words) > WORDS:
            self.words, self.old_words = {}, self.words
        get, out = self.cache.__getitem__, []
        for t in texts:
            try:
                out.append(b"".join(map(get, self._pieces(t))) if t else b"")
            except TypeError:        # a piece that can't stand alone
                out.append(self.whole(t))
        return out


def encoder(name: str) -> PieceEncoder:
    """This worker's encoder (kept between tasks)."""
    return worker_state(("pieces", name), lambda: PieceEncoder(name))
