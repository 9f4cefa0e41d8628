"""Approximate nearest neighbours: one HNSW graph per shard, results merged.

Equal vectors are one node that knows its ``k + 1`` smallest ids (enough for
the k nearest of any query, itself included), so a vector that a third of all
rows share costs no more than any other.  Distinct vectors are spread over
shards of bounded size by a hash; each shard's graph (``hnsw``) is one stored
row of flat arrays.  Queries visit every shard in blocks of bounded size: a task
reads a shard's graph once, then the blocks one after the other; the shards' best
are merged per query.  The graphs propose; what they propose
is scored exactly, with the cosine in double precision of the vectors as given.

Defined results: rows without an id, and vectors that are null, empty, zero or
hold null or non-finite components, take no part; vectors are compared with
those of equal length; a query's own id is no candidate; ties go to the smaller
id; fewer candidates give fewer rows; repeated rows of one id and vector count
once; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, staged
from .hnsw import M, Graph, build

K = 5
BEAM = 160                 # beam of a search
SHARD = 16_384             # distinct vectors of a shard, about
BLOCK = 2_048              # queries that visit a shard at a time
GRAPH = -1                 # block number of a shard's graph: sorted before all blocks


def usable(v: Column) -> Column:
    """Whether the vector has a direction."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw / np.abs(raw).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine in double precision of rows of ``a`` and ``b``."""
    return np.einsum("nd,nd->n", a, b) / (np.sqrt(np.einsum("nd,nd->n", a, a)) * np.sqrt(np.einsum("nd,nd->n", b, b)))


def index(vectors: DataFrame, k: int = K, shard: int = SHARD) -> DataFrame:
    """The stored index of (id, v): dim, shard, ids, vectors and layers of links.

    ids: the up to k + 1 smallest ids of each node, padded with the node's
    first one repeated; n_ids: how many there are.
    """
    smallest = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    nodes = (vectors.distinct().withColumn("r", smallest).where(F.col("r") <= k + 1)
             .groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))       # k + 1 ids at most
    nodes = staged(nodes.withColumn("dim", F.size("v").cast("long")), "ann-nodes")
    per = nodes.groupBy("dim").agg(F.greatest(F.lit(1), F.round(F.count(F.lit(1)) / shard)).cast("long").alias("shards"))
    nodes = nodes.join(per, "dim").withColumn("shard", F.pmod(F.xxhash64("v", F.lit(5)), F.col("shards")))

    def graph(key, t):
        # order and levels by a hash of the first id: the same on every run
        first = np.array([x[0] for x in t.column("ids").to_pylist()], dtype=np.int64)
        order = np.argsort(first, kind="stable")
        t, first = t.take(pa.array(order)), first[order]
        raw = np.stack([np.asarray(x, dtype=np.float64) for x in t.column("v").to_pylist()])
        mixed = (first.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        u = ((mixed >> np.uint64(11)).astype(float) + 0.5) / 2 ** 53
        place, g = build(_unit(raw), np.floor(-np.log(u) / np.log(M)).astype(np.int64))
        ids = [t.column("ids")[int(i)].as_py() for i in place]
        flat = np.array([x + [x[0]] * (k + 1 - len(x)) for x in ids], dtype=np.int64)
        return pa.table({"dim": [key[0].as_py()], "shard": [key[1].as_py()], "ids": [flat.tobytes()],
                         "n_ids": [np.array([len(x) for x in ids], np.int64).tobytes()],
                         "vectors": [raw[place].tobytes()],
                         "links": pa.array([[x.tobytes() for x in g.links]], pa.list_(pa.binary())),
                         "sizes": pa.array([[len(x) for x in g.links]], pa.list_(pa.int64()))})

    # building a graph is work, not data: AQE would put small shards into one task
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = nodes.select("dim", "shard", "v", "ids").repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInArrow(
        graph, "dim long, shard long, ids binary, n_ids binary, vectors binary, links array<binary>, sizes array<long>")
    return staged(out, "ann-index")


class _Shard:
    """One shard's graph, its vectors and the ids of its nodes."""

    def __init__(self, row: dict, k: int):
        self.raw = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
        self.ids = np.frombuffer(row["ids"], np.int64).reshape(len(self.raw), k + 1)
        self.n_ids = np.frombuffer(row["n_ids"], np.int64)
        self.graph = Graph(_unit(self.raw), [np.frombuffer(x, np.int32).reshape(n, -1) for x, n in zip(row["links"], row["sizes"])])


def _answers(at: _Shard, row: dict, k: int, beam: int):
    """Query, id and cosine of the k best rows of one shard for each query of a block."""
    raw, ids, n_ids = at.raw, at.ids, at.n_ids
    q_id, q = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
    nodes, _ = at.graph.search(_unit(q), min(beam, 2 * k + 6), beam)
    owner, col = np.nonzero(nodes >= 0)
    node = nodes[owner, col]
    score = cosine(q[owner], raw[node])
    # every id of a node is a row
    each = np.repeat(np.arange(len(node)), n_ids[node])
    which = np.arange(len(each)) - np.repeat(np.cumsum(n_ids[node]) - n_ids[node], n_ids[node])
    owner, score, vec = owner[each], score[each], ids[node[each], which]
    keep = vec != q_id[owner]
    owner, score, vec = owner[keep], score[keep], vec[keep]
    order = np.lexsort((vec, -score, owner))
    owner, score, vec = owner[order], score[order], vec[order]
    first = np.searchsorted(owner, owner, side="left")
    best = np.arange(len(owner)) - first < k
    return q_id[owner[best]], vec[best], score[best]


def nearest(vectors: DataFrame, is_query: Column, k: int = K, beam: int = BEAM, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the rows (vec_id, embedding) that are queries."""
    spark = vectors.sparkSession
    arrow_batches(spark)
    d = (vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
         .where(F.col("id").isNotNull() & usable(F.col("v"))))
    idx = index(d, k, shard)
    q = vectors.where(is_query).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    q = staged(q.where(F.col("id").isNotNull() & usable(F.col("v"))).distinct().withColumn("dim", F.size("v").cast("long")), "ann-queries")
    blocks = q.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    q = q.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")))

    def bundle(key, t):
        return pa.table({"dim": [key[0].as_py()], "block": [key[1].as_py()],
                         "ids": [np.asarray(t.column("id"), dtype=np.int64).tobytes()],
                         "vectors": [np.stack([np.asarray(x, dtype=np.float64) for x in t.column("v").to_pylist()]).tobytes()]})

    q = q.select("dim", "block", "id", "v").groupBy("dim", "block").applyInArrow(
        bundle, "dim long, block long, ids binary, vectors binary")
    # every block visits every shard, behind the shard's graph
    per = idx.groupBy("dim").agg((F.max("shard") + 1).alias("shards"))
    visits = q.join(per, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    rows = idx.withColumn("block", F.lit(GRAPH)).unionByName(visits, allowMissingColumns=True)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "dim", "shard").sortWithinPartitions("dim", "shard", "block")

    def search(batches):
        key, at = None, None
        for b in batches:
            for row in b.to_pylist():
                if row["block"] == GRAPH:
                    key, at = (row["dim"], row["shard"]), _Shard(row, k)
                elif key == (row["dim"], row["shard"]):         # else a shard without vectors
                    qid, vec, score = _answers(at, row, k, beam)
                    yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

    # a row holds a graph or a block: few of them in one Arrow batch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    hits = staged(rows.mapInArrow(search, "query_id long, vec_id long, score double"), "ann-hits")
    arrow_batches(spark)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (hits.distinct().withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
