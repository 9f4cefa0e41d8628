"""op1 against a plain computation."""

import math
import re

from altscore.llm import mixing as M
from fixtures import docs, edge_docs, no_docs


def _targets(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = 1.5 * sum(sizes.values())
    capped = {}
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_edges_targets_and_reruns(spark):
    d = edge_docs(spark)
    got = M.mix(d).collect()
    assert len(got) == d.count()
    sizes = {}
    for r in d.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = _targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size
    assert sorted(map(repr, got)) == sorted(map(repr, M.mix(d.repartition(5)).collect()))


def test_each_source_comes_near_its_target(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), None, f"s{min(i % 9, 3)}") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = M.mix(d).toPandas()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
        # complete epochs come before the fractional selection
        assert g[g["size"] > 0].eval("taken / size").nunique() <= 2
    mixed = M.mixed_documents(d)
    assert mixed.columns == d.columns and mixed.count() == (got.taken / got["size"]).sum()


def test_heavier_documents_are_taken_first(spark):
    good, odd = "seven letters average words " * 60, "a " * 240
    d = docs(spark, [good, odd] * 400)
    got = M.mix(d, volume=0.5).toPandas()
    assert got[got.doc_id % 2 == 0].taken.sum() > 2 * got[got.doc_id % 2 == 1].taken.sum()


def test_empty(spark):
    assert M.mix(no_docs(spark)).count() == 0
    assert M.mixed_documents(no_docs(spark)).count() == 0
