"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2k bits share a *variant*: a value
within k bits of both.  So every distinct fingerprint emits its whole ball of
radius k (2081 variants for k = 2), equal variants meet after a shuffle, and
colliding fingerprints are verified and linked.

What is shuffled is not each variant but its bucket, a linear (xor) hash of the
variant: a fingerprint travels once per bucket in which it has variants, and the
task of the bucket makes exactly the variants that belong there.  Buckets are
worked off in parts of bounded size.  As all members of one variant lie within
2k bits of each other, they are linked to one member instead of in pairs.
Links are thinned to a spanning forest per bucket, and components are found
with joins (``components``); nothing is collected.

Equal fingerprints are one node from the start, so groups of copies cost
nothing.  Defined results: null text and no word give fingerprint zero, which
is linked like any other; a component is named by its smallest id (null only
if all its ids are null); repeated rows come back as often as they occur;
empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, staged, worker_state
from .components import components

SHINGLE = 4                 # words
DISTANCE = 4                # bits
SEED = 42                   # of XXH64
NODES = 1 << 22             # fingerprints that one bucket may hold (32 MB)
VARIANTS = 1 << 19          # variants that a task makes at a time (4 MB)
LEAST_BITS = 7              # 128 buckets at least
HASHES = 1 << 16            # shingles hashed at a time


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one whole text."""
    import xxhash
    words = (text or "").encode().lower().split()      # bytes: A-Z alone are lowered, the six ASCII blanks split
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    n = len(words) - shingle + 1
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, HASHES):
        last = min(n, k + HASHES)
        h = np.array([digest(joined[a:b], seed) for a, b in zip(start[k:last].tolist(), end[k + shingle - 1:last + shingle - 1].tolist())],
                     dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_of(shingle: int = SHINGLE, seed: int = SEED):
    """Column function: the fingerprint of a text as a signed long."""
    @F.pandas_udf("long")
    def of(text: pd.Series) -> pd.Series:
        worker_state("simhash")
        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in text], dtype=np.uint64).view(np.int64))
    return of


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""
    arrow_batches(docs.sparkSession)
    return docs.select("doc_id", fingerprint_of(shingle, seed)(F.col("text").cast("string")).alias("fp"))


@lru_cache(maxsize=4)
def _ball(radius: int) -> np.ndarray:
    """All masks of at most ``radius`` bits."""
    bits = [1 << i for i in range(64)]
    return np.array([sum(c) for k in range(radius + 1) for c in combinations(bits, k)], dtype=np.uint64)


@lru_cache(maxsize=4)
def _hash_tables(bits: int) -> np.ndarray:
    """A fixed random linear map of 64 bits to ``bits`` bits, by input byte."""
    columns = np.random.default_rng(9).integers(1, 1 << bits, 64, dtype=np.int64)
    value = np.arange(256)
    return np.stack([np.bitwise_xor.reduce(np.where(value[:, None] >> np.arange(8) & 1, columns[8 * k:8 * k + 8], 0), axis=1)
                     for k in range(8)])


def _bucket(x: np.ndarray, bits: int) -> np.ndarray:
    t = _hash_tables(bits)
    b = np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8)
    out = t[0][b[:, 0]]
    for k in range(1, 8):
        out = out ^ t[k][b[:, k]]
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of these links with the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def bucket_links(fps: np.ndarray, bucket: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among ``fps`` (distinct, uint64) by variants that hash to ``bucket``."""
    fine = bits
    masks = _ball(radius)
    while fine < 24 and len(fps) * len(masks) >> fine > VARIANTS:
        fine += 1
    # the fine hash extends the coarse one: bucket = its low bits
    hashed, mask_hash = _extended(fps, bits, fine), _extended(masks, bits, fine)
    order = np.argsort(mask_hash, kind="stable")
    sorted_hash, sorted_masks = mask_hash[order], masks[order]
    found_a, found_b = [], []
    for part in range(1 << (fine - bits)):
        want = hashed ^ (part << bits | bucket)
        low, high = np.searchsorted(sorted_hash, want, "left"), np.searchsorted(sorted_hash, want, "right")
        n = high - low
        total = int(n.sum())
        if not total:
            continue
        step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        owner = np.repeat(fps, n)
        variant = owner ^ sorted_masks[np.repeat(low, n) + step]
        s = np.sort(variant)
        shared = np.unique(s[1:][s[1:] == s[:-1]])
        if not len(shared):
            continue
        k = np.searchsorted(shared, variant)
        hit = shared[np.minimum(k, len(shared) - 1)] == variant
        k, owner = k[hit], owner[hit]
        centre = np.full(len(shared), np.iinfo(np.uint64).max, dtype=np.uint64)
        np.minimum.at(centre, k, owner)
        a, b = owner, centre[k]
        apart = (a != b) & (np.bitwise_count(a ^ b) <= 2 * radius)      # verified
        if apart.any():
            pair = np.unique(np.stack([a[apart], b[apart]], axis=1), axis=0)
            found_a.append(pair[:, 0])
            found_b.append(pair[:, 1])
    if not found_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return _forest(np.concatenate(found_a), np.concatenate(found_b))


def _extended(x: np.ndarray, bits: int, fine: int) -> np.ndarray:
    h = _bucket(x, bits)
    if fine > bits:
        h = h | (_bucket(x, 24) & ((1 << (fine - bits)) - 1)) << bits
    return h


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that connect all fingerprints (column fp, distinct) within
    ``distance`` bits, directly or through others."""
    if distance % 2:
        raise ValueError("the distance must be even: half of it is the radius of the balls")
    radius, n = distance // 2, distinct.count()
    masks = _ball(radius)
    bits = LEAST_BITS
    while bits < 30 and n * min(1.0, len(masks) / 2 ** bits) > NODES:
        bits += 1
    reach = np.unique(_bucket(masks, bits))

    def emit(batches):
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            home = _bucket(fps, bits)
            if len(reach) == 1 << bits:              # every bucket holds variants of each
                whole = fps.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 << bits)), pa.array([whole] * (1 << bits), pa.binary())],
                                                 names=["bucket", "fps"])
                continue
            for k in range(0, len(fps), 512):
                to = (home[k:k + 512, None] ^ reach).ravel()
                own = np.repeat(fps[k:k + 512], len(reach))
                order = np.argsort(to, kind="stable")
                to, own = to[order], own[order]
                first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[first]), pa.array([x.tobytes() for x in np.split(own, first[1:])], pa.binary())], names=["bucket", "fps"])

    def meet(key, table):
        fps = np.frombuffer(b"".join(table.column("fps").to_pylist()), dtype=np.uint64)
        a, b = bucket_links(fps, key[0].as_py(), bits, radius)
        keep = a != b
        return pa.table({"a": a[keep].view(np.int64), "b": b[keep].view(np.int64)})

    spark = distinct.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    sent = distinct.mapInArrow(emit, "bucket long, fps binary")
    return sent.groupBy("bucket").applyInArrow(meet, "a long, b long")


def _classes(d: DataFrame, distance: int) -> DataFrame:
    """fp, root (one fingerprint of its component) and component_id of all fingerprints of ``d`` (doc_id, fp); stored."""
    classes = staged(d.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp-classes")
    roots = components(links(classes.select("fp"), distance)).toDF("fp", "root")
    linked = roots.join(classes, "fp")
    name = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(name, "root").select("fp", "root", "component_id")
    every = classes.join(named, "fp", "left")
    return staged(every.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id")),
                  "fp-components")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    d = staged(fingerprints(docs, shingle), "fingerprints")
    return d.join(_classes(d, distance), "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each component, columns unchanged.

    It is the one with the smallest id (a row without id only where none has one);
    of several rows with that id, the one with the smallest fingerprint, then the
    smallest text.  An id that occurs in several components stays once in each that it leads.
    """
    d = staged(fingerprints(docs, shingle), "fingerprints")
    lead = d.join(_classes(d, distance), "fp").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("m"))
    lead = lead.select(F.col("m.doc_id").alias("__id"), F.col("m.fp").alias("__fp"))
    rows = d.groupBy(F.col("doc_id").alias("__row")).agg(F.count(F.lit(1)).alias("__n"))
    lead = staged(lead.join(rows, F.col("__id").eqNullSafe(F.col("__row"))).drop("__row"), "dedup-lead")
    # always a sort-merge join: the ids grow with the corpus, so broadcasting them would only do on small inputs
    own, shared = lead.where("__n = 1").hint("merge"), lead.where("__n > 1").select("__id").distinct().hint("merge")
    once = docs.join(own, docs["doc_id"].eqNullSafe(own["__id"]), "left_semi")
    # rows whose id others bear as well: known by their fingerprint, which is made of these rows alone because they are stored
    more = staged(docs.join(shared, docs["doc_id"].eqNullSafe(shared["__id"]), "left_semi"), "dedup-shared")
    again = more.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__kept"), fingerprint_of(shingle)(F.col("text").cast("string")).alias("__f"))
    again = again.join(lead.where("__n > 1"), F.col("__kept.doc_id").eqNullSafe(F.col("__id")) & (F.col("__f") == F.col("__fp")))
    first = F.row_number().over(Window.partitionBy("__id", "__fp").orderBy(F.col("__kept.text").cast("string")))
    again = again.withColumn("__r", first).where("__r = 1").select(*[F.col(f"__kept.`{c}`").alias(c) for c in docs.columns])
    return once.union(again)
