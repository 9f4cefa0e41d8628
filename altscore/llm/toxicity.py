"""Toxicity by a counterfactual-regularised linear classifier.

A document is the set of its lower-cased words and of the first letters of its
longer words.  On a bounded sample of labelled documents the terms that tell
the classes apart are selected (G-test), and a logistic model on them is
fitted.  For every sampled document that names a group, counterfactuals are
made by swapping its identity terms for other terms of the same list; the
squared change of the score's logit under such swaps is penalised.  So the
weights that a group's name could pick up from an unbalanced sample are pushed
to be equal, and a neutral mention of a group says as little as that of another.

Where texts name no group there is nothing to swap.  So of the sampled documents
that name none, one in ``MENTION_EVERY`` of either label is learnt from a second
time with an identity term inserted, its label kept: every term of the list in
turn, the same ones for both labels.  Its swaps are penalised like natural
ones, and so is the change that the inserted term makes to the document's logit.
A mention thereby tells nothing of the label, whichever group it is of, also where
a term shares its stem with a word that does (``black``, ``blackmail``).

Defined results: null texts and texts without letters get the score of an empty
document; without labels of both kinds every score is 0; repeated rows come
back as often as they occur; empty tables give empty results; further columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, id_hash, labelled_sample, staged, worker_state

SAMPLE = 20_000            # labelled documents in the sample, at most
THRESHOLD = 0.7
TERMS = 4_000              # terms of the model, at most: those with the largest G
LEAST_G = 12.0             # about one chance in two thousand for an unrelated term
STEM = 5                   # letters of a word that count beside the word
MENTION_EVERY = 4          # one in so many documents without a mention is learnt again with one

# Neutral terms for groups of people, by kind; terms of a kind are swapped for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres", "transgender"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslime", "christen", "juden", "musulmans",
     "chrétiens", "juifs", "musulmanes", "cristianos", "judíos"),
    ("gay", "lesbian", "straight", "bisexual", "schwule", "lesben", "gays", "lesbiennes", "lesbianas"),
    ("immigrants", "refugees", "foreigners", "einwanderer", "flüchtlinge", "immigrés", "réfugiés", "inmigrantes", "refugiados"),
    ("black", "white", "asian", "african", "arab", "latino", "schwarze", "weiße", "noirs", "blancs", "negros", "blancos"),
    ("disabled", "deaf", "blind", "elderly", "behinderte", "blinde", "handicapés", "aveugles", "discapacitados", "ciegos"),
)


_WORDS = re.compile(r"[^\W\d_]+").findall


def terms(text: str | None) -> set[str]:
    """Terms of one whole text: words, and stems marked by a final ``*``."""
    words = set(_WORDS(text.lower())) if text else set()
    return words | {w[:STEM] + "*" for w in words if len(w) >= STEM}


def swaps(found: set[str], kinds=IDENTITY_TERMS) -> list[tuple[set[str], set[str]]]:
    """(removed terms, added terms) of the counterfactuals of a document."""
    out = []
    for kind in kinds:
        own = [t for t in kind if t in found]
        for k, t in enumerate(own):
            others = [o for o in kind if o not in own]
            # two others for each: the next one, so that swaps join the whole list, and one half the list on
            for j in range(min(2, len(others))):
                o = others[(kind.index(t) + j * (len(others) // 2)) % len(others)]
                out.append((terms(t), terms(o)))
    return out


def with_mentions(found: list[set[str]], y, kinds=IDENTITY_TERMS, every: int = MENTION_EVERY) -> list[tuple[set[str], float, set[str]]]:
    """(terms, label, those inserted) of the copies with an identity term (``every`` 0: none).

    Of the documents of a label that name no group, in their order, numbers 0,
    ``every``, 2 ``every`` ... get the terms of ``kinds`` in turn.
    """
    listed = [t for kind in kinds for t in kind]
    out, seen = [], Counter()
    for s, label in zip(found, y):
        if every and listed and s.isdisjoint(listed):
            turn, rest = divmod(seen[label], every)
            seen[label] += 1
            if not rest:
                new = terms(listed[turn % len(listed)]) - s
                out.append((s | new, label, new))
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -40.0

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.bias + sum(map(self.weights.get, self.weights.keys() & terms(text))), -40, 40))))


def g_values(present: np.ndarray, positive: np.ndarray, n: int, n_pos: int) -> np.ndarray:
    """G statistic of each term: in how many documents, and positive ones."""
    g = np.zeros(len(present))
    for seen, total in ((positive, n_pos), (present - positive, n - n_pos)):
        for o, e in ((seen, present * (total / n)), (total - seen, (n - present) * (total / n))):
            with np.errstate(divide="ignore", invalid="ignore"):
                g += np.where(o > 0, 2 * o * np.log(o / e), 0.0)
    return g


def fit_logistic(rows: list[np.ndarray], y: np.ndarray, pairs: list[tuple], k: int, ridge: float = 1e-5,
                 fairness: float = 1.0, steps: int = 600, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias; ``rows`` hold the terms of each document, ``pairs``
    the (document, removed, added) of each counterfactual.  Adam, full batch."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    col = col.astype(np.int64)
    p_owner = np.concatenate([np.full(len(a) + len(b), i) for i, (_, a, b) in enumerate(pairs)] or [np.zeros(0)]).astype(np.int64)
    p_col = np.concatenate([np.r_[a, b] for _, a, b in pairs] or [np.zeros(0)]).astype(np.int64)
    p_sign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for _, a, b in pairs] or [np.zeros(0)])
    w, bias = np.zeros(k), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        z = bias + np.bincount(owner, w[col], len(rows))
        d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        g = np.bincount(col, d[owner], k) + ridge * w
        if len(pairs):
            change = np.bincount(p_owner, p_sign * w[p_col], len(pairs))
            g += fairness * 2 / len(pairs) * np.bincount(p_col, p_sign * change[p_owner], k)
        g = np.append(g, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def learn(found: list[set[str]], y: np.ndarray, kinds=IDENTITY_TERMS, fairness: float = 1.0,
          mention_every: int = MENTION_EVERY) -> Model:
    """Model from the terms and labels of the sampled documents."""
    n, n_pos = len(y), int(y.sum())
    if not 0 < n_pos < n:
        return Model()
    every, positive = Counter(), Counter()
    for s, label in zip(found, y):
        every.update(s)
        if label:
            positive.update(s)
    names = sorted(every)
    g = g_values(np.array([every[t] for t in names], float), np.array([positive[t] for t in names], float), n, n_pos)
    chosen = [names[i] for i in sorted(range(len(names)), key=lambda i: (-g[i], names[i]))[:TERMS] if g[i] >= LEAST_G]
    # documents with an inserted mention; the terms were chosen without them
    copies = with_mentions(found, y, kinds, mention_every)
    inserted = [(len(found) + i, set(), new) for i, (_, _, new) in enumerate(copies)]
    found, y = [*found, *(s for s, _, _ in copies)], np.r_[np.asarray(y, float), [label for _, label, _ in copies]]
    # identity terms are always in the model, so that swaps are seen
    named = [(i, a, b) for i, s in enumerate(found) for a, b in swaps(s, kinds)] + inserted
    at = {t: i for i, t in enumerate(dict.fromkeys([*chosen, *sorted(set().union(*(a | b for _, a, b in named)))]))}

    def index(s):
        return np.array(sorted(at[t] for t in s if t in at), dtype=np.int64)

    w, bias = fit_logistic([index(s) for s in found], y, [(i, index(a), index(b)) for i, a, b in named],
                           len(at), fairness=fairness)
    return Model({t: float(w[i]) for t, i in at.items() if abs(w[i]) > 1e-6}, float(bias))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, usable=None) -> Model:
    """Model for label ``toxic``.

    Terms are found and counted on the executors; to the driver come, of at
    most ``sample`` documents, those among ``TERMS`` telling terms.
    """
    arrow_batches(docs.sparkSession)

    @F.pandas_udf("array<string>")
    def of(text: pd.Series) -> pd.Series:
        worker_state("toxicity")
        return pd.Series([sorted(terms(t)) for t in text])

    rows = labelled_sample(docs, labels, "toxic", sample, usable).select("doc_id", "label", of("text").alias("terms"))
    rows = staged(rows, "toxic-sample")
    n = rows.count()
    n_pos = rows.where("label = 1").count()
    if not 0 < n_pos < n:
        return Model()
    # counts of the terms, aggregated where they are; only telling ones leave
    each = rows.select("label", F.explode("terms").alias("term"))
    totals = each.groupBy("term").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("label").cast("long")).alias("p"))
    known = sorted({t for kind in IDENTITY_TERMS for x in kind for t in terms(x)})

    @F.pandas_udf("double")
    def g_of(c: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(g_values(c.to_numpy(float), p.to_numpy(float), n, n_pos))

    telling = (totals.where("c >= 3").withColumn("g", g_of("c", "p")).where(F.col("g") >= LEAST_G)
               .orderBy(F.desc("g"), "term").limit(TERMS).select("term"))
    wanted = sorted({r.term for r in telling.collect()} | set(known))          # at most TERMS and the list
    got = rows.select("doc_id", "label", _among(wanted)("terms").alias("x")).collect()     # at most ``sample`` rows
    got.sort(key=lambda r: (str(r.doc_id), r.x))
    return learn([set(r.x) for r in got], np.array([r.label for r in got], float))


def _among(wanted: list[str]):
    keep = set(wanted)

    @F.pandas_udf("array<string>")
    def among(t: pd.Series) -> pd.Series:
        return pd.Series([[x for x in row if x in keep] for row in t])
    return among


def scorer(model: Model):
    """Column function: score of a text."""
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in text], dtype=float)
    return score


def scored(docs: DataFrame, model: Model, held_out=None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    arrow_batches(docs.sparkSession)
    d = docs.select("doc_id", (F.lit(False) if held_out is None else held_out).alias("held_out"),
                    scorer(model)(F.col("text").cast("string")).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, columns unchanged."""
    arrow_batches(docs.sparkSession)
    return docs.where(scorer(model)(F.col("text").cast("string")) < threshold)


def third(doc_id=None):
    """Ids whose crc32 leaves 1 when divided by three are held out."""
    return id_hash(F.col("doc_id") if doc_id is None else doc_id) % 3 == 1
