"""op2: statistics against a plain computation, monotone trees."""

import re
from collections import Counter

import numpy as np

from altscore.llm import quality as Q
from altscore.llm import trees as T
from fixtures import docs, edge_docs, edge_rows, no_docs


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    times, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if times[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics_of_edge_texts():
    for row in edge_rows():
        s = dict(zip(Q.STATS, Q.statistics(row[1])))
        assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"]) == plain(row[1])


def test_monotone_constraints_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] + 0.5 * np.sin(5 * x[:, 1]) + rng.normal(size=3000)) > 0).astype(float)
    free, bound = T.fit(x, y), T.fit(x, y, {0: 1, 1: -1})
    probe = np.tile(rng.normal(size=(200, 1, 3)), (1, 50, 1))
    for f, sign in ((0, 1), (1, -1)):
        p = probe.copy()
        p[:, :, f] = np.linspace(-3, 3, 50)
        s = bound.score(p.reshape(-1, 3)).reshape(200, 50)
        assert (np.diff(s, axis=1) * sign >= -1e-12).all()
    auc = lambda m: np.mean(m.score(x)[y == 1][:, None] > m.score(x)[y == 0][None, :])
    assert auc(free) > 0.8 and auc(bound) > 0.75


def test_judged(spark):
    good = [f"a fine line of words number {i} that goes on for long enough to be kept, word{i} and word{i + 1}. " * 1 +
            " ".join(f"t{i}x{j}" for j in range(60)) for i in range(120)]
    bad = [" ".join(f"t{i}x{j}#|" for j in range(80)) for i in range(120)]
    d = docs(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240) if i % 2], "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.judged(d, Q.fit(d, labels)).collect()}
    assert sum(got[i].kept for i in range(0, 120, 2)) >= 58 and sum(got[i].kept for i in range(120, 240, 2)) <= 2


def test_edges_and_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    d = edge_docs(spark)
    assert Q.fit(d, labels) is None
    got = Q.judged(d, None).collect()
    assert len(got) == d.count() and all(r.kept == (not r.base_failed) for r in got)
    assert Q.judged(no_docs(spark), None).count() == 0
