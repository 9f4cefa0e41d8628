"""Language identification with spans of mixed-language text.

1. *Script ranges narrow the candidates.*  Letters belong to scripts by code
   point range; a language is a candidate for a word only if its training text
   uses the word's script.
2. *Per-word scores.*  Each candidate scores a word by the log-probabilities
   of its letter trigrams (with word ends), counted in the training text.
3. *Viterbi.*  The best sequence of languages over the words of the whole text,
   where every switch costs ``SWITCH``; runs of one language are spans.

A document gets the language whose spans hold most letters, and as score their
share of all letters.

Defined results: ``und`` with score 0 for null texts and texts without a letter,
and for every text if there is no training text; ties go to the language that
sorts first; repeated rows come back as often as they occur; empty tables give
empty results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, id_hash, staged

SAMPLE = 20_000            # documents of the training sample, at most
SWITCH = 8.0               # cost of a change of language, in nats
WORDS = 300_000            # scored words that a worker keeps
LONGEST = 40               # letters of a word; a longer run of letters is several

# First and last code point of the letters of each script.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)),
}
OTHER = "other"


def script(letter: str) -> str:
    c = ord(letter)
    return next((name for name, ranges in SCRIPTS.items() if any(a <= c <= b for a, b in ranges)), OTHER)


def _letters(ranges) -> str:
    """The letters of code point ranges, as the inside of a character class."""
    is_letter = re.compile(r"[^\W\d_]").match
    codes = [c for a, b in ranges for c in range(a, b + 1) if is_letter(chr(c))]
    first = [c for c, before in zip(codes, [-1, *codes]) if c != before + 1]
    last = [c for c, after in zip(codes, [*codes[1:], -1]) if c != after - 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last))


_OF_SCRIPTS = [_letters(r) for r in SCRIPTS.values()]
_WORDS = re.compile(r"(?=[^\W\d_])(?:" + "".join(f"[{x}]{{1,{LONGEST}}}|" for x in _OF_SCRIPTS)
                    + rf"(?:(?![{''.join(_OF_SCRIPTS)}])[^\W\d_]){{1,{LONGEST}}})").findall


def words_of(text: str | None) -> list[str]:
    """Words of letters (and odd numerals, which score nothing), lower-cased, in order.

    A run of letters is cut where its script changes and after every
    ``LONGEST`` letters, so text without blanks is many words, too.
    """
    return _WORDS(text.lower()) if text else []


def n_letters(word: str) -> int:
    return len(word) if word.isalpha() else sum(map(str.isalpha, word))


def grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i:i + 3] for i in range(len(w) - 2)]


@dataclass
class Model:
    langs: list[str]
    grams: dict[str, int]                       # trigram -> row of ``logs``
    logs: np.ndarray                            # log-probability by language; the last row: any other trigram
    scripts: dict[str, np.ndarray]              # script -> languages (bool) that use it
    known: dict = field(default_factory=dict)   # word -> row of ``scores`` and ``letters``
    scores: np.ndarray | None = None
    letters: np.ndarray | None = None

    def learn(self, words: list[str]) -> None:
        """Scores of new words in each language; candidates by script alone."""
        m, other = len(self.langs), len(self.logs) - 1
        if self.scores is None or len(self.known) > WORDS:
            self.known.clear()
            self.scores, self.letters = np.zeros((0, m)), np.zeros(0)
        get, rows, sizes = self.grams.get, [], []
        for w in words:
            g = [get(x, other) for x in grams(w)]
            rows += g
            sizes.append(len(g))
        first = np.cumsum([0, *sizes[:-1]])
        s = np.add.reduceat(self.logs[np.array(rows, np.int64)], first, axis=0)
        letters = np.fromiter(map(n_letters, words), float, len(words))
        s[letters == 0] = 0.0
        for script_name, can in self.scripts.items():
            if can.any() and not can.all():
                mine = np.fromiter((script(w[0]) == script_name for w in words), bool, len(words))
                if mine.any():
                    s[mine] = np.where(can, s[mine], s[mine].min(axis=1, keepdims=True) - 4 * SWITCH)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.scores, self.letters = np.concatenate([self.scores, s]), np.concatenate([self.letters, letters])

    def path(self, s: np.ndarray) -> np.ndarray:
        """Viterbi: language of each word from the scores (words x languages)."""
        n, m = s.shape
        best = int(np.argmax(s.sum(axis=0)))
        if m == 1:
            return np.zeros(n, np.int64)
        # one language throughout is optimal if no run of words would gain
        # more elsewhere than one switch costs (a run inside costs two)
        gain = np.max(np.delete(s, best, axis=1), axis=1) - s[:, best]
        run = np.concatenate([[0.0], np.cumsum(gain)])
        if np.max(run - np.minimum.accumulate(run)) <= SWITCH:
            return np.full(n, best)
        rows = s.tolist()                    # few languages: lists beat arrays here
        value, back = rows[0], []
        for r in rows[1:]:
            top = max(value)
            k, switch = value.index(top), top - SWITCH
            back.append([i if v >= switch else k for i, v in enumerate(value)])
            value = [(v if v >= switch else switch) + x for v, x in zip(value, r)]
        at = value.index(max(value))
        out = [at]
        for b in reversed(back):
            at = b[at]
            out.append(at)
        return np.array(out[::-1], np.int64)

    def paths(self, texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """Language and number of letters of each word of each text."""
        found = [words_of(t) for t in texts]
        if self.scores is None or len(self.known) > WORDS:
            new = set(chain.from_iterable(found))
        else:
            new = set(chain.from_iterable(found)).difference(self.known)
        if new and self.langs:
            self.learn(sorted(new))
        out = []
        for words in found:
            if not words or not self.langs:
                out.append((np.zeros(0, np.int64), np.zeros(0)))
                continue
            rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            out.append((self.path(self.scores[rows]), self.letters[rows]))
        return out

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(language, first word, words) of the spans of a text."""
        p, _ = self.paths([text])[0]
        if not len(p):
            return []
        first = np.concatenate([[0], np.flatnonzero(np.diff(p)) + 1])
        return [(self.langs[p[a]], int(a), int(b - a)) for a, b in zip(first, np.append(first[1:], len(p)))]

    def predict(self, texts: list) -> list[tuple[str, float, int]]:
        """Language, share of letters and number of spans of each text."""
        out = []
        for p, letters in self.paths(texts):
            if not letters.any():
                out.append(("und", 0.0, 0))
                continue
            by = np.bincount(p, letters, len(self.langs))
            best = int(np.argmax(by))
            out.append((self.langs[best], float(by[best] / by.sum()), int((np.diff(p) != 0).sum()) + 1))
        return out


def train(counts: list[tuple], script_counts: list[tuple]) -> Model:
    """From (lang, trigram, times) and (lang, script, letters)."""
    langs = sorted({r[0] for r in counts})
    at = {x: i for i, x in enumerate(langs)}
    names = {g: i for i, g in enumerate(sorted({r[1] for r in counts}))}
    c = np.zeros((len(names), len(langs)))
    for lang, g, n in counts:
        c[names[g], at[lang]] += n
    alpha = 0.5
    total = c.sum(axis=0) + alpha * (len(names) + 1)
    logs = np.log((c + alpha) / total) if langs else c
    used: dict = {}
    for lang, s, n in script_counts:
        if lang in at:
            used.setdefault(s, np.zeros(len(langs)))[at[lang]] += n
    letters = sum(used.values()) if used else np.zeros(len(langs))
    logs = np.vstack([logs, np.log(alpha / total)]) if langs else np.zeros((1, 0))
    return Model(langs, names, logs, {s: n >= 0.01 * np.maximum(letters, 1) for s, n in used.items() if s != OTHER})


def fit(docs: DataFrame, usable=None, sample: int = SAMPLE) -> Model:
    """Model from the text and non-null lang of documents for which ``usable`` holds.

    The sample is the ``sample`` documents with the smallest hash of the id;
    their trigrams are counted where they are, and all (language, trigram)
    counts come to the driver: the sample bounds them.  Every language with a
    letter in the sample can be predicted.
    """
    arrow_batches(docs.sparkSession)
    d = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if usable is not None:
        d = d.where(usable)
    d = d.select(F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"))
    ids = d.orderBy(F.xxhash64("id", F.lit(2)), "id", "lang").limit(sample).distinct()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("l")) \
        .join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("l") == F.col("lang")))

    def count(batches):
        for b in batches:
            tri, scr = Counter(), Counter()
            for lang, text in zip(b["lang"], b["text"]):
                for w, n in Counter(words_of(text)).items():
                    scr[lang, script(w[0])] += n * len(w)
                    for g in grams(w):
                        tri[lang, g] += n
            yield pd.DataFrame([(k, lang, x, n) for k, c in ((0, tri), (1, scr)) for (lang, x), n in c.items()],
                               columns=["kind", "lang", "key", "n"])

    counted = rows.select("lang", "text").mapInPandas(count, "kind int, lang string, key string, n long")
    counted = staged(counted.groupBy("kind", "lang", "key").agg(F.sum("n").alias("n")), "trigrams")
    tri = counted.where("kind = 0").collect()
    scr = counted.where("kind = 1").collect()
    return train([(r.lang, r.key, r.n) for r in tri], [(r.lang, r.key, r.n) for r in scr])


def identified(docs: DataFrame, model: Model, held_out=None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans of every row."""
    arrow_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, n_spans long")
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(model.predict(text.tolist()), columns=["lang_pred", "score", "n_spans"])

    d = docs.select("doc_id", (F.lit(False) if held_out is None else held_out).alias("held_out"),
                    predict(F.col("text").cast("string")).alias("p"))
    return d.select("doc_id", "held_out", "p.*")


def fifth(doc_id=None):
    """Ids whose crc32 is divisible by five are held out."""
    return id_hash(F.col("doc_id") if doc_id is None else doc_id) % 5 == 0
