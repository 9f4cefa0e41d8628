"""Hard negatives: rows of another label that score just below an anchor's positives.

Rows (equal vectors of one label are one point that knows its smallest ids, enough
for any answer) are spread over shards of bounded size by a hash; each shard is a
stored row per vector length, a cover tree of flat arrays (``covertree``).  Anchors are dealt
into lots of bounded size.  Every lot meets every shard once: both sides are repeated
for the other's number, a count, and co-grouped on (shard, lot), so a task holds one
shard's trees and one lot.  A first round finds each anchor's positives, a second one,
whose windows follow from the positives' scores, the negatives; both merge the shards' best.

A vector is what its components are in 256ths, rounded down; a score is an integer
inner product, exact.

Defined results: rows without an id, label or vector, or with a null or non-finite
component, take no part, nor do vectors so long (2^28 or more in 256ths) that a
hundred times a product would not fit a long; only vectors of equal length (empty ones too)
are compared; repeated rows of one id, label and vector are one; an anchor's id is
never its own positive or negative; where an anchor's id bears several labels or
vectors, the smallest (label, vector) is the anchor; a positive whose window holds
nothing gives no rows; ties go to the smaller id; empty tables give empty results;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import covertree as T
from .common import arrow_batches, staged

POSITIVES, NEGATIVES = 5, 10
LOWEST, HIGHEST = 30, 90   # of a negative's score, in hundredths of the positive's
SHARD = 16_384             # points of a shard, about
LOT = 2_048                # anchors that meet a shard together, about
LONGEST = 2.0 ** 56        # squared length, in 256ths, of a vector that takes part

HITS = "anchor_id long, positive_score long, id long, score long"


def rows(vectors: DataFrame, label: Column) -> DataFrame:
    """id, label, v (in 256ths) of the rows that take part; vectors has vec_id and embedding."""
    d = vectors.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"),
                       F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(2.0 ** 22)))
    d = d.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    d = d.select("id", "label", F.transform("x", lambda x: F.floor(x * 256).cast("long")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return d.where(square < LONGEST)


def index(d: DataFrame, keep: int, shard: int = SHARD) -> DataFrame:
    """The stored trees over rows(...): shard, dim and the arrays of ``covertree.ARRAYS``.

    A point keeps its ``keep`` smallest ids.
    """
    smallest = F.row_number().over(Window.partitionBy("label", "v").orderBy("id"))
    points = (d.distinct().withColumn("r", smallest).where(F.col("r") <= keep)
              .groupBy("label", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")))     # ``keep`` at most
    points = staged(points, "negatives-points")
    shards = max(1, round(points.count() / shard))
    points = points.withColumn("shard", F.pmod(F.xxhash64("v", "label", F.lit(11)), F.lit(shards)))

    def grow(key, t):
        out = []
        dims = np.array([len(v) for v in t.column("v")])
        for dim in np.unique(dims):
            own = t.take(pa.array(np.nonzero(dims == dim)[0]))
            ids = own.column("ids").to_pylist()
            order = sorted(range(len(ids)), key=lambda i: (ids[i], own.column("label")[i].as_py()))   # the same on every run
            own, ids = own.take(pa.array(order, pa.int64())), [ids[i] for i in order]
            x = np.array(own.column("v").to_pylist(), dtype=np.int64).reshape(len(ids), dim)
            tree = T.build(x, own.column("label").to_numpy().astype(np.int64), ids)
            out.append({"shard": key[0].as_py(), "dim": int(dim)} | {n: tree[n].astype(k).tobytes() for n, k in T.ARRAYS.items()})
        return pa.Table.from_pylist(out)

    # growing a tree is work, not data: AQE would put small shards into one task
    tasks = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "shard long, dim long, " + ", ".join(f"{n} binary" for n in T.ARRAYS)
    return staged(points.repartition(tasks, "shard").groupBy("shard").applyInArrow(grow, schema), "negatives-trees")


def _meet(trees: DataFrame, anchors: DataFrame, same: bool, k: int, lot: int) -> DataFrame:
    """HITS: the k best of every shard in every window of every anchor (id, label, v, windows).

    windows: scores of positives, each with the window below it; null: one that holds all scores.
    """
    lots = max(1, round(anchors.count() / lot))
    shards = trees.agg(F.max("shard")).first()[0]
    if shards is None:
        shards = 0
    tasks = int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = trees.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))))
    right = (anchors.withColumn("lot", F.pmod(F.xxhash64("id", F.lit(12)), F.lit(lots)))
             .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards).cast("long")))))

    def visit(key, own, asked):
        out: list[tuple] = []
        searches = {}
        for r in own.to_pylist():
            tree = {n: np.frombuffer(r[n], k) for n, k in T.ARRAYS.items()}
            searches[r["dim"]] = T.Search(tree, r["dim"])
        for r in asked.to_pylist():
            s = searches.get(len(r["v"]))
            if s is None:
                continue
            scores = [None] if r["windows"] is None else r["windows"]
            # a hundred times a negative's score lies between LOWEST and HIGHEST times the positive's
            windows = np.array([(-T.FAR, T.FAR) if p is None else (-(-LOWEST * p // 100), HIGHEST * p // 100) for p in scores], np.int64)
            for p, (score, ids) in zip(scores, s.best(np.array(r["v"], np.int64), r["id"], r["label"], same, windows, k)):
                out += [(r["id"], p, i, v) for i, v in zip(ids.tolist(), score.tolist())]
        columns = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "positive_score", "id", "score"])

    # both sides dealt alike, once; a row each way holds a shard's trees or an anchor
    left, right = (d.repartition(tasks, "shard", "lot").groupBy("shard", "lot") for d in (left, right))
    hits = left.cogroup(right).applyInArrow(visit, HITS)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         shard: int = SHARD, lot: int = LOT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on vec_id, ``label`` an expression over ``vectors``.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    d = rows(vectors, label)
    trees = index(d, max(positives, negatives) + 1, shard)
    anchors = rows(vectors.where(is_anchor), label).groupBy("id").agg(F.min(F.struct("label", "v")).alias("m"))
    anchors = staged(anchors.select("id", "m.label", "m.v", F.lit(None).cast("array<long>").alias("windows")), "negatives-anchors")
    first = _meet(trees, anchors, True, positives, lot)
    first = staged(first.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    asked = first.groupBy("anchor_id").agg(F.array_sort(F.collect_set("positive_score")).alias("windows"))
    again = staged(anchors.drop("windows").join(asked.withColumnRenamed("anchor_id", "id"), "id"), "negatives-windows")
    second = _meet(trees, again, False, negatives, lot)
    second = second.select("anchor_id", "positive_score", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                           F.col("score").alias("negative_score"))
    return (first.join(second, ["anchor_id", "positive_score"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
