"""op12: roots, proofs and the layout against a plain tree."""

from hashlib import sha256
from zlib import crc32

import pytest

from altscore.llm import merkle as M
from altscore.llm import q_merkle as Q
from altscore.llm import veb as V
from fixtures import SCHEMA, bag, docs, edge_docs, edge_rows, no_docs
from pyspark.sql import functions as F


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, source, lang, n_chars, text):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def _way(levels, i):
    for level in levels[:-1]:
        yield i & 1, level[i ^ 1] if i ^ 1 < len(level) else ""
        i >>= 1


def brute(rows):
    """rows (doc_id, source, lang, n_chars, text) -> what the query returns."""
    trees = {}
    for lang in sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, _leaf(*r)))
        trees[lang] = own, _levels([_leaf(*r) for r in own])
    top = _levels([levels[-1][0] for _, levels in trees.values()])
    out = []
    for j, (own, levels) in enumerate(trees.values()):
        for i, r in enumerate(own):
            way = list(_way(levels, i)) + list(_way(top, j))
            bad = r[0] is not None and crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            at = _leaf(*r[:3], r[3] + 1, r[4]) if bad else _leaf(*r)
            for left, s in way:
                at = _h(s, at) if left else _h(at, s)
            out.append((r[0], _leaf(*r), levels[-1][0], top[-1][0], _h(*(s for _, s in way)), at, at == top[-1][0]))
    return sorted(map(repr, out))


def _got(d, height=M.HEIGHT):
    return sorted(repr(tuple(r)) for r in M.proofs(M.manifest(d, Q.tampered(F.col("doc_id")), height), height).collect())


@pytest.mark.parametrize("height", [1, 2, 3, 10])
def test_blocks_of_every_height_give_the_plain_tree(spark, height):
    """Several levels of blocks below and above, ragged ends, a language of one document, a null language."""
    langs = ["en"] * 23 + ["fr"] * 8 + [None] * 5 + ["zz"] + ["de"] * 9 + ["é"] * 2 + ["中"] * 3
    rows = [(7 * i % 101, f"s{i % 3}", lang, 10 + i if i % 6 else None, f"text {i} é") for i, lang in enumerate(langs)]
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    assert _got(d, height) == brute(rows)


def test_odd_rows(spark):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in edge_rows()]
    assert _got(edge_docs(spark), 2) == brute(rows)
    assert dict(zip(SCHEMA.split(", "), edge_rows()[0]))["key string"] == "k"      # clashing names are in the table


def test_one_document_and_none(spark):
    one = docs(spark, ["alone"]).withColumn("n_chars", F.lit(5))
    assert _got(one) == brute([(0, "s", "en", 5, "alone")])
    assert M.manifest(one).root() == _leaf(0, "s", "en", 5, "alone")
    assert _got(no_docs(spark)) == [] and M.manifest(no_docs(spark)).root() is None


def test_many_languages_and_many_copies(spark):
    rows = [(i, "s", f"l{i}", i, "t") for i in range(37)] + [(5, "s", "en", 1, "copy")] * 40
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert _got(d, 2) == brute(rows)


def test_a_changed_character_changes_the_root(spark):
    a = docs(spark, ["one", "two", "three"]).withColumn("n_chars", F.length("text"))
    b = docs(spark, ["one", "two", "threE"]).withColumn("n_chars", F.length("text"))
    assert M.manifest(a).root() != M.manifest(b).root()
    assert bag(M.manifest(a).blocks().select("root")) == bag(M.manifest(a.repartition(3)).blocks().select("root"))


@pytest.mark.parametrize("levels", range(1, 12))
def test_layout(levels):
    """Every address once; a subtree below the cut is one stretch."""
    at = V.layout(levels)
    assert sorted(a for row in at for a in row) == list(range(2 ** levels - 1))
    if levels > 1:
        top, below = levels // 2, levels - levels // 2
        for s in range(2 ** top):
            inside = [at[top + d][(s << d) + j] for d in range(below) for j in range(2 ** d)]
            assert sorted(inside) == list(range(min(inside), min(inside) + 2 ** below - 1))


def test_paths_are_packed_whole():
    path = [(b"a" * 64, 0), (b"", 1), (b"", 0), (b"b" * 64, 1)]
    assert V.unpacked(V.packed(path)) == path
