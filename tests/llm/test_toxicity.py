"""op7: held-out accuracy, and neutral mentions of groups."""

import random
import re

import numpy as np
from altscore.llm import toxicity as T
from fixtures import edge_docs, no_docs

WORDS = [f"word{i}x" for i in range(300)]


def _texts(n, seed, toxic_words=("grumblefix", "snarkol"), bias=0.0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        bad = i % 4 == 0
        w = [r.choice(WORDS) for _ in range(40)]
        if bad:
            w[3] = r.choice(toxic_words)
        if bad and r.random() < bias:
            w[7] = "muslims"
        elif r.random() < 0.05:
            w[7] = r.choice(["christians", "jews", "muslims"]) if not bias else r.choice(["christians", "jews"])
        out.append((" ".join(w), int(bad)))
    return out


def test_held_out_accuracy(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(_texts(1500, 1))]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = T.fit(d.drop("toxic"), d.select("doc_id", "toxic"), usable=~T.third())
    got = T.scored(d, model, held_out=T.third()).join(d.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 300 and np.mean([r.predicted == r.toxic for r in held]) > 0.98
    assert T.without_toxic(d, model).columns == d.columns
    assert T.without_toxic(d, model).where("toxic = 0").count() == d.where("toxic = 0").count()


def test_counterfactual_penalty_evens_out_identity_terms():
    sample = _texts(1500, 2, bias=0.6)
    found, y = [T.terms(t) for t, _ in sample], np.array([y for _, y in sample], float)
    free, fair = T.learn(found, y, fairness=0.0), T.learn(found, y, fairness=3.0)
    neutral = "the {} met here today"
    gap = lambda m: abs(m.score(neutral.format("muslims")) - m.score(neutral.format("jews")))
    assert gap(fair) < 0.25 * gap(free)
    assert fair.score(neutral.format("muslims")) < 0.5
    assert np.mean([(fair.score(t) >= 0.7) == bool(y) for t, y in _texts(400, 9)]) > 0.95


def test_mentions_are_inserted_evenly():
    rows = _texts(3000, 4)
    found, y = [T.terms(t) for t, _ in rows], [y for _, y in rows]
    none = [not any(t in s for kind in T.IDENTITY_TERMS for t in kind) for s in found]
    copies = T.with_mentions(found, y)
    for label in (0, 1):
        own = sum(n and v == label for n, v in zip(none, y))
        got = [s for s, v, _ in copies if v == label]
        assert len(got) == -(-own // T.MENTION_EVERY)
        if len(got) >= 60:      # all kinds had their turn
            assert all(any(set(kind) & s for s in got) for kind in T.IDENTITY_TERMS)
    assert T.with_mentions(found, y, every=0) == [] and T.with_mentions([], []) == []


def test_swaps_count_where_no_text_names_a_group():
    """A word of toxic texts shares its stem with a group's name; no text names a group."""
    r = random.Random(5)
    rows = []
    for i in range(1500):
        w = [r.choice(WORDS) for _ in range(30)]
        if i % 4 == 0:
            w[3], w[5] = r.choice(["blackmail", "blackmailer"]), r.choice(["grumblefix", "snarkol"])
        rows.append((" ".join(w), int(i % 4 == 0)))
    found, y = [T.terms(t) for t, _ in rows], np.array([y for _, y in rows], float)
    free, fair = T.learn(found, y, fairness=0.0, mention_every=0), T.learn(found, y)
    held = [" ".join(r.choice(WORDS) for _ in range(30)) for _ in range(50)]
    logit = lambda m, t: np.log(m.score(t) / (1 - m.score(t)))
    change = lambda m: max(abs(logit(m, h + " black") - logit(m, h + " white")) for h in held)
    assert change(free) > 1.0 and change(fair) < 0.25 * change(free)
    # nor does a mention itself say much
    assert max(abs(logit(fair, h + " " + t) - logit(fair, h)) for h in held[:5] for kind in T.IDENTITY_TERMS for t in kind) < 0.3
    # swaps join all terms of a list
    for kind in T.IDENTITY_TERMS:
        reached = {kind[0]}
        for _ in kind:
            reached |= {t for t in kind for s in list(reached) for _, b in T.swaps({s}) if b == T.terms(t)}
        assert reached == set(kind)
    # stated figure: a swap of any two terms of a kind moves a held-out sentence's score by less than 0.05
    for kind in T.IDENTITY_TERMS:
        for h in held[:5]:
            got = [fair.score(h + " " + t) for t in kind]
            assert max(got) - min(got) < 0.05 and max(got) < T.THRESHOLD
    assert np.mean([(fair.score(t) >= 0.7) == bool(v) for t, v in rows]) > 0.99


def test_scores_equal_a_plain_computation(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(_texts(400, 6))]
    d = spark.createDataFrame([*rows, (900, None, 0), (901, "", 0), (902, "12 ... 7", 1), (903, "Grumblefix", 0)],
                              "doc_id long, text string, toxic int")
    model = T.fit(d.drop("toxic"), d.select("doc_id", "toxic"))
    texts = {r.doc_id: r.text for r in d.collect()}
    for r in T.scored(d, model).collect():
        words = {w for w in re.split(r"[\W\d_]+", (texts[r.doc_id] or "").lower()) if w}
        z = model.bias
        for t in sorted(words) + sorted({w[:5] + "*" for w in words if len(w) > 4}):
            z += model.weights.get(t, 0.0)
        assert abs(r.score - 1 / (1 + np.exp(-min(max(z, -40), 40)))) < 1e-12


def test_term_choice_and_fit_equal_plain_ones():
    # G statistic of a two by two table, cell by cell
    n, n_pos = 50, 20
    present, positive = np.array([10.0, 30.0, 5.0]), np.array([9.0, 12.0, 0.0])
    for g, c, p in zip(T.g_values(present, positive, n, n_pos), present, positive):
        table = [[p, c - p], [n_pos - p, n - n_pos - (c - p)]]
        plain = sum(2 * o * np.log(o * n / (sum(row) * (table[0][j] + table[1][j])))
                    for row in table for j, o in enumerate(row) if o > 0)
        assert abs(g - plain) < 1e-9
    # the fit lies at the bottom of the penalised loss
    r = np.random.default_rng(1)
    rows = [np.flatnonzero(r.random(6) < 0.4) for _ in range(200)]
    y = np.array([float(0 in x) if r.random() < 0.85 else 1.0 - float(0 in x) for x in rows])
    pairs = [(i, np.array([1]), np.array([2])) for i, x in enumerate(rows) if 1 in x]

    def loss(w, b):
        z = np.array([b + sum(w[j] for j in x) for x in rows])
        fit = np.mean(np.log1p(np.exp(z)) - y * z)
        return fit + 0.5 * 1e-5 * np.sum(w ** 2) + np.mean([(sum(w[a]) - sum(w[c])) ** 2 for _, a, c in pairs])

    w, b = T.fit_logistic(rows, y, pairs, 6)
    for k in range(7):
        step = np.eye(7)[k] * 1e-4
        slope = (loss(w + step[:6], b + step[6]) - loss(w - step[:6], b - step[6])) / 2e-4
        assert abs(slope) < 1e-3


def test_edges_and_empty(spark):
    d = edge_docs(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.fit(d, none)
    got = T.scored(d, model, held_out=T.third()).collect()
    assert len(got) == d.count() and all(r.score < 1e-6 and r.predicted == 0 for r in got)
    one = spark.createDataFrame([(3, 1), (4, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    assert len(T.scored(d, T.fit(d, one)).collect()) == d.count()
    assert T.scored(no_docs(spark), model).count() == 0 and T.without_toxic(no_docs(spark), model).count() == 0
