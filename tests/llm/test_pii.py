"""op10: base spans against the plain rules, candidates, redaction."""

import random
import re

from altscore.llm import pii as P
from altscore.llm.common import staged
from fixtures import docs, edge_docs, edge_rows, no_docs
from pyspark.sql import functions as F

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")),
                  "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def _check(rows, texts):
    for r, t in zip(rows, texts):
        assert r.base == plain(t), t[:200]
        assert set(filter(None, r.base.split(","))) <= set(filter(None, r.spans.split(",")))


def _detected(d, trees=None):
    x = P.detect(d, trees)
    return x.select("doc_id", P.listed(x["base"]).alias("base"), P.listed(x["spans"]).alias("spans"))


def test_base_of_random_texts(spark):
    r = random.Random(2)
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1111", "1.2.3.4", "256.1.1.1", "000.0.0.0255", "+1 (017) 555-7713", "+12", "+1-2-3-4-5-6-7-8-9",
             "a.b%c@d-e.fg", "a@b", "@", ".", " ", "-", "5", "x", "é", "a@b.c@d.e", "a@b..c", "a@b.c_d@e.f", "\n", "00", "😀", "--", "  ", "12345678901234567890"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 8))) for _ in range(800)]
    rows = sorted(_detected(docs(spark, texts), P.Trees()).collect(), key=lambda x: x.doc_id)
    _check(rows, texts)
    assert all(x.base == x.spans for x in rows)


def test_edges_and_empty(spark):
    d = edge_docs(spark)
    got = _detected(d).collect()
    assert len(got) == d.count()
    want = sorted(plain(row[1]) for row in edge_rows())
    assert sorted(x.base for x in got) == want
    assert _detected(no_docs(spark)).count() == 0
    kept = P.redacted(d)
    assert kept.columns == d.columns and kept.count() == d.count()
    assert P.redacted(no_docs(spark)).count() == 0


def test_trees_add_a_card_inside_a_longer_run(spark):
    r = random.Random(5)

    def card(valid):
        while True:
            d = "4" + "".join(r.choice("0123456789") for _ in range(15))
            if luhn(d) == valid:
                return d
    texts = [f"word {card(i % 2 == 0)} word" for i in range(400)] + [f"see {card(False)} {card(True)} there"]
    rows = sorted(_detected(docs(spark, texts)).collect(), key=lambda x: x.doc_id)
    assert all(x.spans == x.base for x in rows[:400])
    assert rows[400].base == "" and rows[400].spans == "card:21:37"


def test_redaction(spark):
    texts = ["mail a.b@c.de or 10.0.0.1!", "nothing here", "é +1 (017) 555-7713", None]
    d = spark.createDataFrame([(i, t, None if t is None else len(t), "keep") for i, t in enumerate(texts)],
                              "doc_id long, text string, n_chars long, base string")
    got = sorted(P.redacted(d, P.Trees()).collect())
    assert [r.text for r in got] == ["mail [email] or [ip]!", "nothing here", "é [phone]", None]
    assert [r.n_chars for r in got] == [21, 12, 9, None] and {r.base for r in got} == {"keep"}


def _card(r, valid):
    while True:
        d = "4" + "".join(r.choice("0123456789") for _ in range(15))
        if luhn(d) == valid:
            return d


def test_numbers_are_candidates_from_every_group(spark):
    """Cards, phones and ips after other numbers, each at its own place."""
    cases = [("on 2024-05-17 4111 1111 1111 1111 paid", "card", "4111 1111 1111 1111"), ("qty 12 4111 1111 1111 1111", "card", "4111 1111 1111 1111"),
             ("12/27 4111.1111.1111.1111 3", "card", "4111.1111.1111.1111"), ("2024-05-17 0170 555 7713", "phone", "0170 555 7713"),
             ("5 (017) 555-7713 9", "phone", "(017) 555-7713"), ("3, 10 . 0 . 0 . 1", "ip", "10 . 0 . 0 . 1"),
             ("é " + "7 " * 3000 + "4111 1111 1111 1111", "card", "4111 1111 1111 1111")]
    rows = sorted(P.found(docs(spark, [c[0] for c in cases])).collect(), key=lambda x: x.doc_id)
    for r, (text, kind, want) in zip(rows, cases):
        got = [c for c in r.candidates if c.k == P.KINDS.index(kind)]
        assert all(text[c.s:c.e] == c.t for c in r.candidates) and len({(c.k, c.s, c.e) for c in r.candidates}) == len(r.candidates)
        assert (text.index(want), text.index(want) + len(want)) in {(c.s, c.e) for c in got}, text[-60:]


def test_trees_add_a_card_after_other_numbers(spark):
    r = random.Random(6)
    texts = [f"word {_card(r, i % 2 == 0)} word" for i in range(400)] + ["on 2024-05-17 4111 1111 1111 1111 paid", "qty 12 4111 1111 1111 1111"]
    rows = sorted(_detected(docs(spark, texts)).collect(), key=lambda x: x.doc_id)
    assert [x.base for x in rows[400:]] == ["", ""]
    assert [x.spans for x in rows[400:]] == ["card:14:33", "card:7:26"]


def test_natural_loosened_spellings_are_accepted(spark):
    """Many spellings that the base rules don't match don't close a kind."""
    r = random.Random(9)
    host = lambda: ".".join(str(r.randint(1, 255)) for _ in range(4))
    texts = [f"from host {host()} on" for _ in range(150)] + [f"mail al{i}@mail{i % 7}.example.com now" for i in range(150)]
    texts += [f"from host {host().replace('.', ' . ')} on" for _ in range(60)] + [f"mail al{i} (at) mail{i % 7} (dot) com now" for i in range(60)]
    texts += [f"word {_card(r, False)} word" for _ in range(150)] + [f"list {i}, {i + 3}, {i + 7}, {i + 9} end" for i in range(1, 61)]
    rows = sorted(_detected(docs(spark, texts)).collect(), key=lambda x: x.doc_id)
    assert all(x.base == "" for x in rows[300:])
    assert all(x.spans.startswith("ip:10:") and "," not in x.spans for x in rows[300:360])
    assert all(x.spans.startswith("email:5:") and "," not in x.spans for x in rows[360:420])
    assert all(x.spans == "" for x in rows[420:])


def test_a_valid_span_wins_over_invalid_ones_that_overlap_it(spark):
    """Dates before cards, card-like numbers that fail Luhn, phones that look like cards; fitted on the given documents."""
    texts = {"on 2024-05-17 4111 1111 1111 1111 paid": "card:14:33", "call 0044 20 7946 0958 now": "phone:5:22", "card 4111.1111.1111.1111 ok": "card:5:24",
             "order 2024 1234 5678 9012 shipped": "", "ref 1234 5678 9012 3456 done": ""}
    given = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    trees = P.fit(staged(P.found(given), "test-pii"))
    d = docs(spark, list(texts))
    got = {r.doc_id: r.s for r in P.detect(d, trees).select("doc_id", P.listed(F.col("spans")).alias("s")).collect()}
    assert got == {i: want for i, want in enumerate(texts.values())}
    clean = {r.doc_id: r.text for r in P.redacted(d, trees).collect()}
    assert clean[0] == "on 2024-05-17 [card] paid" and clean[3] == list(texts)[3]


def test_all_candidates_are_fitted_on(spark):
    """6,000 numbers of one kind, more than the trees once took; a true one counts in both spellings."""
    d = docs(spark, ["ref " + "; ".join(f"{100 + i}.{300 + j}.{i}.{j}" for j in range(60)) for i in range(100)]
             + [f"server 10 . 0 . {i} . 7" for i in range(100)])
    n = {(r.k, r.y): r.n for r in P.vectors(P.found(d)).groupBy("k", "y").agg(F.sum("n").alias("n")).collect()}
    ip = P.KINDS.index("ip")
    assert n[ip, False] >= 6000 and n[ip, True] == 200
