"""Connected components of a large sparse graph by random contraction.

In every round each node points to the neighbour (or itself) with the
smallest random priority; edges are rewritten to the pointed-to nodes and
loops vanish.  The expected number of nodes falls by a constant factor per
round whatever the shape of the graph (long chains included).  All steps
are joins and partial aggregations; rounds are cut by stored tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of ``edges`` (two columns of longs).

    Equal roots mean equal components; a root is some node of its component.
    Loops and repeated edges do no harm; no edges give no rows.
    """
    edges = staged(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    labels = staged(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                    .select("node", F.col("node").alias("root")), "labels")
    r = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).union(edges.select("a", "a")).union(edges.select("b", "b"))
        near = (both.toDF("node", "other")
                .groupBy("node").agg(F.min(F.struct(F.xxhash64("other", F.lit(r)).alias("p"), F.col("other"))).alias("m"))
                .select("node", F.col("m.other").alias("to")))
        near = staged(near, f"near-{r}")
        labels = staged(labels.join(near.withColumnRenamed("node", "root"), "root", "left")
                        .select("node", F.coalesce("to", "root").alias("root")), f"labels-{r}")
        edges = staged(edges.join(near.toDF("a", "ta"), "a").join(near.toDF("b", "tb"), "b")
                       .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
                       .where("a <> b").distinct(), f"edges-{r}")
        r += 1
    return labels
