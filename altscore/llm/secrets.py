"""Secrets: base rules, and candidates judged by the likelihood of their format.

*Base* spans are exact: leftmost non-overlapping matches per kind that pass the
kind's check.  Their credentials (for an assignment, its value) are the labelled
examples from which a probabilistic automaton is inferred for each kind
(``grammar``); one more is inferred from candidates that no base rule touches.
Every candidate in every text is scored: how much likelier its format is by the
automaton of a kind than by that of the rest.  A threshold per kind, from how common
both are, selects.

Candidates are the longest runs of 12 or more credential characters, without signs at their ends, that
hold a digit.  Those that touch a base span add nothing.  One that passes for several kinds is of the kind with the
highest score.

The examples are bounded samples of *distinct* strings (SAMPLE of each kind and of
the rest, those with the smallest hash, of LONGEST characters at most); the
automata are inferred from them on the driver.  Counts are of all texts.  Texts are read once; what is stored between are
spans and candidates.

Defined results: null and empty texts have no spans; a kind with fewer than FEWEST examples,
or without candidates of the rest to compare with, adds none; positions are code points, ends exclusive; repeated rows come back as
often as they occur; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grammar as G
from .common import arrow_batches, staged

KINDS = ("assign", "access", "hex")
SAMPLE = 2_000             # distinct strings that an automaton is inferred from, and as many of the rest, at most
LONGEST = 256              # characters of a string in the sample
FEWEST = 12                # examples of a kind
SURE = 0.99                # probability that a candidate is of a kind, by its format
RECALL = 0.5               # of a kind's held-out examples, for it to add any

# Base rules; the keywords in either case, of ASCII letters only.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# Runs too short to pass are not listed: the first match of a run takes all of it.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
SIGNS = "+/_.=-"

FOUND = ("base array<struct<k:int,s:int,e:int>>, credentials array<struct<k:int,t:string>>, "
         "candidates array<struct<s:int,e:int,t:string>>")


def base_of(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, credential) of the base spans, by start, then kind."""
    out = [(0, m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def candidates_of(text: str, base: list) -> list[tuple[int, int, str]]:
    """(start, end, string) of the candidates that touch no base span."""
    out, j = [], 0
    for m in RUN.finditer(text):
        run = m[0]
        if not any("0" <= c <= "9" for c in run):
            continue
        t = run.lstrip(SIGNS)
        s = m.end() - len(t)
        t = t.rstrip(SIGNS)
        e = s + len(t)
        while j < len(base) and base[j][2] <= s:
            j += 1
        if len(t) >= 12 and not any(b[1] < e and s < b[2] for b in _near(base, j, e)):
            out.append((s, e, t))
    return out


def _near(base: list, j: int, e: int):
    """Base spans from number ``j`` on that start before ``e``."""
    while j < len(base) and base[j][1] < e:
        yield base[j]
        j += 1


def found(docs: DataFrame) -> DataFrame:
    """doc_id, base, credentials and candidates of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def scan(batches: Iterator[pa.RecordBatch]):
        spans = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())]))
        strings = pa.list_(pa.struct([("k", pa.int32()), ("t", pa.string())]))
        placed = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("t", pa.string())]))
        for b in batches:
            rows = []
            for t in b.column("__text").to_pylist():
                base = base_of(t)
                rows.append(([dict(zip("kse", x)) for x in base], [{"k": x[0], "t": x[3]} for x in base],
                             [dict(zip("set", x)) for x in candidates_of(t, base)]))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(columns[0], spans), pa.array(columns[1], strings),
                                              pa.array(columns[2], placed)], names=["doc_id", "base", "credentials", "candidates"])

    arrow_batches(docs.sparkSession)
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    return d.mapInArrow(scan, f"doc_id {kind}, {FOUND}")


class Formats:
    """Automata and thresholds."""

    def __init__(self, kinds: dict | None = None, rest: G.Automaton | None = None, thresholds: dict | None = None):
        self.kinds, self.rest, self.thresholds = kinds or {}, rest, thresholds or {}

    def scores(self, t: str) -> dict[int, float]:
        """By kind, how much likelier its format makes the string than that of the rest does (log)."""
        rest = self.rest.score(t) if self.rest else 0.0
        return {k: a.score(t) - rest for k, a in self.kinds.items()}

    def kind_of(self, t: str) -> int | None:
        """The kind that a candidate is taken for."""
        passed = [(s, -k) for k, s in self.scores(t).items() if k in self.thresholds and s >= self.thresholds[k]]
        return -max(passed)[1] if passed else None


def strings(d: DataFrame) -> DataFrame:
    """k, t: the distinct credentials of each kind, and candidates (kind -1), of found(...) rows; stored."""
    own = d.select(F.explode("credentials").alias("c")).select("c.k", "c.t")
    own = own.union(d.select(F.explode("candidates").alias("c")).select(F.lit(-1).alias("k"), "c.t"))
    return staged(own.distinct(), "secrets-strings")


def sample(own: DataFrame, rows: int = SAMPLE) -> list[tuple[int, str]]:
    """At most ``rows`` of strings(...) of each kind."""
    out = []
    for k in range(-1, len(KINDS)):
        some = own.where((F.col("k") == k) & (F.length("t") <= LONGEST)).orderBy(F.xxhash64("t", F.lit(13)), "t").limit(rows)
        out += [(k, r.t) for r in some.collect()]
    return out


def fit(d: DataFrame, rows: int = SAMPLE, sure: float = SURE) -> Formats:
    """Automata and thresholds from found(...) rows.

    A threshold is the log likelihood ratio at which a candidate is of the kind with probability ``sure``, with as many
    of the rest for each of the kind as there are distinct strings of both in all texts.  A quarter of the sample is held
    out: a kind that does not know RECALL of its own held-out examples again adds nothing.
    """
    own = strings(d)
    count = {r.k: r.n for r in own.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = sample(own, rows)
    held = {t: sha256(t.encode()).digest()[0] % 4 == 0 for _, t in some}
    learn = {k: [t for j, t in some if j == k and not held[t]] for k in range(-1, len(KINDS))}
    kinds = {k: G.infer(learn[k]) for k in range(len(KINDS)) if len(learn[k]) >= FEWEST}
    formats = Formats(kinds, G.infer(learn[-1]) if learn[-1] else None)
    for k in kinds:
        least = log(sure / (1.0 - sure)) + log(max(1, count.get(-1, 0)) / count[k])
        scores = [formats.scores(t)[k] for j, t in some if j == k and held[t]]
        if formats.rest and scores and sum(s >= least for s in scores) >= RECALL * len(scores):
            formats.thresholds[k] = least
    return formats


def judged(d: DataFrame, formats: Formats) -> DataFrame:
    """found(...) rows as doc_id, base and spans (k, s, e): the base ones and the accepted ones, by start and kind."""
    kind = dict(d.dtypes)["doc_id"]
    span = "array<struct<k:int,s:int,e:int>>"

    def judge(batches: Iterator[pa.RecordBatch]):
        kinds: dict[str, int | None] = {}
        for b in batches:
            out = []
            for base, some in zip(b.column("base").to_pylist(), b.column("candidates").to_pylist()):
                spans = list(base)
                for c in some:
                    if c["t"] not in kinds:
                        if len(kinds) > 20_000:
                            kinds.clear()
                        kinds[c["t"]] = formats.kind_of(c["t"])
                    if kinds[c["t"]] is not None:
                        spans.append({"k": kinds[c["t"]], "s": c["s"], "e": c["e"]})
                out.append(sorted(spans, key=lambda x: (x["s"], x["k"])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("base"), pa.array(out, b.column("base").type)],
                                             names=["doc_id", "base", "spans"])

    return d.select("doc_id", "base", "candidates").mapInArrow(judge, f"doc_id {kind}, base {span}, spans {span}")


def detect(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """doc_id, base and spans of every row (infers the formats if none are given)."""
    d = staged(found(docs), "secrets-found")
    return judged(d, formats if formats is not None else fit(d))


def count_of(spans, kind: str):
    k = KINDS.index(kind)
    return F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long")


def listed(spans):
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))))
