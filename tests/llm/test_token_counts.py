"""op6: the transducer counts as the library does."""

import random

import pytest
from altscore.llm import fst
from altscore.llm import token_counts as T
from altscore.llm import tokens as K
from fixtures import edge_docs, edge_rows, no_docs

PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'", "'re", "''", "1", "23", "!", "é", "中", " ", "\x1c", "😀", "'ll", "'x", " '",
         "<|endoftext|>", "\r\n", "ñ", "́", "٣", "Σ", "ꙮ", "İ", ".", ","]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    return [row[1] for row in edge_rows() if row[1] is not None and len(row[1]) < 20_000] + \
        ["".join(r.choice(PARTS) for _ in range(r.randint(0, 16))) for _ in range(4000)]


@pytest.fixture(scope="module")
def want(texts):
    tok = K.load_tokenizer(K.tokenizer_path(T.TOKENIZER))
    return [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts(texts, want):
    assert fst.counter(T.TOKENIZER).counts(texts) == want


@pytest.mark.parametrize("chunk", [3, 7, 50])
def test_chunk_maps_compose(texts, want, chunk, monkeypatch):
    monkeypatch.setattr(fst, "CHUNK", chunk)
    some = range(0, len(texts), 4)
    assert fst.counter(T.TOKENIZER).counts([texts[i] for i in some]) == [want[i] for i in some]


def test_composition_is_associative(texts):
    c = fst.counter(T.TOKENIZER)
    for t in ["one two  three 'll four\n\n five six", "x" * 9, "a b c d e f g"]:
        a, b, d = (c.chunk_map(x) for x in (t[:len(t) // 3], t[len(t) // 3:2 * len(t) // 3], t[2 * len(t) // 3:]))
        left, right = c.compose(c.compose(a, b), d), c.compose(a, c.compose(b, d))
        total = lambda m: m.tokens + sum(c._words([m.head, m.tail or ""]))
        assert total(left) == total(right) == c.counts([t])[0]


def test_states_are_forgotten_beyond_the_bound(texts, want, monkeypatch):
    monkeypatch.setattr(fst, "STATES", 50)
    monkeypatch.setattr(fst, "WORDS", 50)
    c = fst.counter(T.TOKENIZER)
    assert [c.counts([t])[0] for t in texts[:300]] == want[:300]


def test_edges_and_empty(spark):
    d = edge_docs(spark)
    got = T.token_counts(d).collect()
    assert len(got) == d.count() and all((r.n_tokens > 1024) == r.over_limit for r in got)
    assert {(r.n_bytes, r.n_tokens) for r in got if r.doc_id in (0, 1)} == {(0, 0)}
    assert T.token_counts(no_docs(spark)).count() == 0
