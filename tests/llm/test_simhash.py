"""op9 against brute force."""

import random
import re

import numpy as np
import xxhash
from altscore.llm import simhash as S
from altscore.llm.components import components
from fixtures import docs, edge_docs, edge_rows, no_docs


def plain(text, shingle=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    sh = [" ".join(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps, distance=4):
    """Smallest id reachable, by comparing all pairs."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints_of_edge_texts(monkeypatch):
    monkeypatch.setattr(S, "HASHES", 1000)
    for row in edge_rows():
        assert S.fingerprint(row[1]) == plain(row[1])


def test_components_of_planted_balls(spark):
    r = random.Random(7)
    fps, base = {}, [r.getrandbits(64) for _ in range(40)]
    for i in range(600):
        v = base[i % 40]
        for b in r.sample(range(64), r.randint(0, 5)):
            v ^= 1 << b
        fps[i] = v
    d = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in set(fps.values())], "fp long")
    roots = {r.node: r.root for r in components(S.links(d)).collect()}
    want = _components(fps)
    own = lambda i: roots.get(int(np.uint64(fps[i]).astype(np.int64)), fps[i])
    groups = {}
    for i in fps:
        groups.setdefault(own(i), set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_small_parts_find_the_same_links(monkeypatch):
    r = random.Random(8)
    base = r.getrandbits(64)
    fps = np.unique(np.array([base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(60)], dtype=np.uint64))
    whole = [S.bucket_links(fps, b, 7, 2) for b in range(128)]
    monkeypatch.setattr(S, "VARIANTS", 64)
    parts = [S.bucket_links(fps, b, 7, 2) for b in range(128)]
    assert all(np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]) for a, b in zip(whole, parts))


def test_long_chain_is_one_component(spark):
    d = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(900, 901), (5, 5)], "a long, b long")
    roots = {r.node: r.root for r in components(d).collect()}
    assert len({roots[i] for i in range(401)}) == 1 and roots[900] == roots[901] != roots[0] and len(roots) == 403


def test_edges_and_dedup(spark):
    d = edge_docs(spark)
    got = S.near_duplicates(d).collect()
    assert len(got) == d.count()
    fps = {}
    for r in d.collect():
        if r.doc_id is not None:
            fps[r.doc_id] = plain(r.text)
    want = _components(fps)
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    kept = S.deduplicated(d)
    assert kept.columns == d.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values()))


def test_copies_and_clean_documents(spark):
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(10 ** 6)}" for _ in range(80)) for _ in range(60)]
    d = docs(spark, texts + texts[:20] + [t.upper() for t in texts[:5]] + texts[3:4] * 50)
    assert sorted(x.doc_id for x in S.deduplicated(d).collect()) == list(range(60))


def test_empty(spark):
    assert S.near_duplicates(no_docs(spark)).count() == 0 and S.deduplicated(no_docs(spark)).count() == 0


def _plain_groups(rows):
    """Components of (id, text) rows by pairwise distances: lists of row numbers."""
    fps = [S.fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return [[i for i in range(len(rows)) if group[i] == g] for g in sorted(set(group))]


def test_one_row_a_component_whatever_repeats(spark):
    """Ids that repeat with equal texts, with nearly equal ones and with different ones, and rows without id."""
    t = " ".join(f"w{i}" for i in range(60))
    u = " ".join(f"v{i * 7 % 50}" for i in range(60))
    rows = [(1, t), (1, t + " "), (2, t), (1, u), (3, u), (3, u), (None, t), (None, "only here and without an id"), (None, "only here and without an id"),
            (4, "alone"), (4, "another one"), (5, None), (5, ""), (6, " ")]
    d = spark.createDataFrame([(i, x, "k", 1) for i, x in rows], "doc_id long, text string, __id string, fp int").repartition(3)
    got = S.deduplicated(d)
    assert got.columns == d.columns
    want = []
    for g in _plain_groups(rows):
        least = min((rows[i][0] is None, rows[i][0] or 0) for i in g)
        lead = [i for i in g if (rows[i][0] is None, rows[i][0] or 0) == least]
        want.append(min((S.fingerprint(rows[i][1]) - (1 << 64) * (S.fingerprint(rows[i][1]) >> 63), rows[i][1] is not None, rows[i][1] or "", i) for i in lead)[3])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got.collect()) == \
        sorted((rows[i][0] is None, rows[i][0] or 0, rows[i][1] or "") for i in want)


def test_samples_hold_one_row_an_id(spark):
    from altscore.llm.common import labelled_sample
    d = spark.createDataFrame([(1, f"text {i % 5}") for i in range(500)] + [(2, None), (2, "b"), (3, None), (None, "c"), (4, "d")],
                              "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (None, 1), (4, None), (9, 1)], "doc_id long, toxic int")
    got = {r.doc_id: (r.text, r.label) for r in labelled_sample(d, labels, "toxic", 10).collect()}
    assert set(got) == {1, 2, 3} and got[2] == ("b", 1) and got[3] == (None, 0) and got[1][1] == 0
    assert labelled_sample(d, labels, "toxic", 10).count() == 3 and labelled_sample(d, labels, "toxic", 1).count() <= 1
