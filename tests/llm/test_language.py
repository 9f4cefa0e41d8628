"""op8: Viterbi against brute force, spans, held-out accuracy."""

import itertools
import random

import numpy as np
from altscore.llm import language as L
from fixtures import edge_docs, no_docs

STEMS = {"aa": ["tion", "the", "ing", "ough"], "bb": ["sch", "ung", "keit", "der"], "cc": ["мир", "при", "вет", "дом"]}


def _text(lang, n, r):
    return " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_path_is_the_best_sequence():
    m = L.Model(["a", "b", "c"], {}, np.zeros((1, 3)), {})
    rng = np.random.default_rng(0)
    for scale in (1, 6, 20):
        for _ in range(60):
            s = rng.normal(0, scale, (6, 3))
            value = lambda q: sum(s[i, x] for i, x in enumerate(q)) - L.SWITCH * sum(a != b for a, b in zip(q, q[1:]))
            assert abs(value(m.path(s)) - max(map(value, itertools.product(range(3), repeat=6)))) < 1e-9


def test_held_out_accuracy_scripts_and_spans(spark):
    r = random.Random(4)
    rows = [(i, _text(lang, r.randint(20, 60), r), lang) for i, lang in enumerate(random.Random(1).choices("aa bb cc".split(), k=400))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(d, usable=~L.fifth())
    got = L.identified(d, model, held_out=L.fifth()).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert all(x.lang_pred == x.lang for x in got if x.held_out)
    mixed = _text("aa", 12, r) + " " + _text("bb", 15, r) + " " + _text("cc", 9, r)
    assert model.spans(mixed) == [("aa", 0, 12), ("bb", 12, 15), ("cc", 27, 9)]
    # script alone decides for a word in letters that one language uses
    assert model.predict(["дд"])[0][0] == "cc"
    assert [p[0] for p in model.predict([None, "", "12 34", "½ ²", "!!"])] == ["und"] * 5


def test_edges_and_empty(spark):
    d = edge_docs(spark)
    got = L.identified(d, L.fit(d)).collect()
    assert len(got) == d.count() and all(0 <= r.score <= 1 for r in got)
    model = L.fit(no_docs(spark))
    assert {r.lang_pred for r in L.identified(d, model).collect()} == {"und"}
    assert L.identified(no_docs(spark), model).count() == 0


def test_runs_without_blanks_are_read_to_their_end(spark):
    r = random.Random(7)
    rows = [(i, _text(lang, 40, r), lang) for i, lang in enumerate(random.Random(2).choices("aa bb cc".split(), k=300))]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    run = {lang: _text(lang, n, r).replace(" ", "") for lang, n in (("aa", 30), ("bb", 300), ("cc", 20))}
    text = run["aa"] + run["bb"]
    assert "".join(L.words_of(text)) == text and max(map(len, L.words_of(text))) == L.LONGEST
    lang, share, n_spans = model.predict([text])[0]
    assert lang == "bb" and abs(share - len(run["bb"]) / len(text)) < 0.05 and n_spans == 2
    # a change of script cuts, too
    assert L.words_of("the" + "привет" + "ung½x_y9z漢字かな") == ["the", "привет", "ung½x", "y", "z", "漢字", "かな"]
    assert [s[0] for s in model.spans(run["aa"] + run["cc"])] == ["aa", "cc"]


def test_a_rare_language_beside_one_of_many_trigrams(spark):
    r = random.Random(8)
    han = [" ".join("".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(8)) for _ in range(300)) for _ in range(40)]
    rows = [(i, t, "aa") for i, t in enumerate(han * 2)] + [(100, "zoo quiz fjord", "zz")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(d)
    assert len(model.grams) > 60_000 and model.langs == ["aa", "zz"]
    assert {"^zo", "fjo", "rd$"} <= set(model.grams)
    assert [p[0] for p in model.predict(["fjord zoo", han[0]])] == ["zz", "aa"]
