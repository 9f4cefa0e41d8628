"""Quality rules: boosted trees over statistics of each document.

The trees (``trees``) are fitted on a bounded sample of labelled documents,
with monotone constraints: more repetition, repeated lines or symbols never
raise a document's score.  A document is kept when it passes the base rules
and its score is at least ``KEEP``.

Defined results: null texts and texts without words have all statistics zero
and fail the base rules; without labels of both kinds every document that
passes the base rules is kept; repeated rows come back as often as they occur;
empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees
from .common import arrow_batches, labelled_sample

SAMPLE = 20_000            # labelled documents that the trees are fitted on, at most
KEEP = 0.5
SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(0x41, 0x5B))
DIGITS = bytes(range(0x30, 0x3A))
BLANKS = " \t\n\r\x0b\x0c"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATS = BASE + ["n_lines", "n_distinct", "n_upper", "n_digits", "n_marks"]
FEATURES = ["words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "marks", "words_a_line"]
# more of these never makes a document better
MONOTONE = {FEATURES.index(f): -1 for f in ("symbols", "dup_lines", "repeats")}


def repeated_words(words: list) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    n, end = 0, 0                       # words counted so far end before ``end``
    for i, w in enumerate(windows):
        if times[w] > 1:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def statistics(text: str | None) -> tuple:
    """The STATS of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0,) * len(STATS)
    chars = len(text) - sum(map(text.count, BLANKS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
            len(lines), len(set(words)), len(raw) - len(raw.translate(None, UPPER)),
            len(raw) - len(raw.translate(None, DIGITS)), sum(map(text.count, "!?;{}=\\")))


def features(s: pd.DataFrame) -> np.ndarray:
    """FEATURES from a frame of STATS."""
    v = {c: s[c].to_numpy(dtype=float) for c in STATS}
    words, chars, lines = np.maximum(v["n_words"], 1), np.maximum(v["word_chars"], 1), np.maximum(v["n_lines"], 1)
    # distinct words are fewer in longer texts: compare with a root of the length
    return np.column_stack([np.log1p(v["n_words"]), v["word_chars"] / words, v["n_symbols"] / chars, v["n_dup_lines"] / lines,
                            v["n_repeat_words"] / words, v["n_distinct"] / words ** 0.8, v["n_upper"] / chars,
                            v["n_digits"] / chars, v["n_marks"] / chars, np.log1p(words / lines)])


_LONGS = ", ".join(f"{c} long" for c in STATS)


def _stats_udf():
    @F.pandas_udf(_LONGS)
    def stats(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t) for t in text], columns=STATS, dtype="int64")
    return stats


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> trees.Forest | None:
    """Trees for label ``quality``; None without labels of both kinds."""
    arrow_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, "quality", sample).select("doc_id", "label", _stats_udf()("text").alias("s"))
    got = rows.select("doc_id", "label", "s.*").toPandas().sort_values("doc_id")      # bounded by ``sample``
    y = got["label"].to_numpy(dtype=float)
    if not 0 < y.sum() < len(y):
        return None
    return trees.fit(features(got), y, MONOTONE)


def judged(docs: DataFrame, forest: trees.Forest | None, keep: float = KEEP) -> DataFrame:
    """doc_id, STATS, score, base_failed, kept of every row."""
    arrow_batches(docs.sparkSession)

    @F.pandas_udf(_LONGS + ", score double")
    def judge(text: pd.Series) -> pd.DataFrame:
        s = pd.DataFrame([statistics(t) for t in text], columns=STATS, dtype="int64")
        return s.assign(score=forest.score(features(s)) if forest is not None else 1.0)

    d = docs.select("doc_id", judge(F.col("text").cast("string")).alias("s")).select("doc_id", "s.*")
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= keep))
