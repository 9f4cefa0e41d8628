"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a token budget.  Whole epochs of a source come first; the
rest of its budget is filled by a weighted sample without replacement: each
document draws the exponential key ``-ln(u) / w`` (``u`` from a hash of its id,
``w`` its quality weight), a source's documents are ordered by key, and the
running sum of their sizes is cut at the budget.

Only built-in column functions are used.  The order is found in two levels,
so that no task ever holds a whole source: keys fall into order-preserving
bins, bins are summed (partial aggregation) and prefix-summed per source, and
only the one bin of each source in which its budget ends is sorted row by row.
The documents themselves are never shuffled: the cut of each source (a key)
comes back to them in a join with the table of sources.

Defined results:

* null text or no word: size 0, taken 0; null source: a source of its own,
  last in order; null id: hashed like the empty string;
* documents with equal keys (repeated rows) are taken or left together;
* the document in which a budget ends is taken when that brings the source
  nearer its target, ties included;
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, md5_uniform, staged

WEIGHTS = (3, 1, 2)        # of the sources in order, repeating
VOLUME = 1.5               # size of the mix, in sizes of the whole input
MAX_EPOCHS = 2             # no source is repeated more often
BIN_ROWS = 400_000         # about four times the rows that one bin may hold


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Weight in (0, 1]: short texts and odd mean word lengths weigh less."""
    mean = F.length(text) / size
    off = (mean - F.lit(7.0)) / F.lit(4.0)
    return F.when(size > 0, (size / (size + F.lit(40.0))) / (F.lit(1.0) + off * off)).otherwise(F.lit(1.0))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and key of every document."""
    d = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"),
                    F.col("text").alias("t"), word_count(F.col("text")).alias("size"))
    return d.select("doc_id", "source", "size",
                    (-F.log(md5_uniform(F.col("doc_id"))) / quality_weight(F.col("t"), F.col("size"))).alias("key"))


def targets(totals: DataFrame, weights=WEIGHTS, volume: float = VOLUME, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Target of each source (rows: source, source_size).

    Budgets follow the weights; a source stops at ``max_epochs`` times its
    size and its excess is shared again by weight.  The end of that process
    in closed form: sources ordered by cap / weight, the capped ones are a
    prefix, the others share what the prefix leaves.  One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = totals.select("source", "source_size", w.alias("w"),
                      (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"),
                      (F.sum("source_size").over(everything) * F.lit(float(volume))).alias("all"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    t = t.withColumn("capped", F.col("cap") * F.sum("w").over(onward) <= F.col("w") * left)
    rest = F.col("all") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    open_w = F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything)
    return t.select("source", "source_size",
                    F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * rest / open_w).alias("target"))


def _cut(d: DataFrame, plan: DataFrame, resolution: int) -> DataFrame:
    """Largest key that each source's fractional selection takes.

    A document is taken when twice the running sum before it plus its size
    is at most twice the budget: whole documents up to the budget, and the
    one in which it ends if that is nearer than leaving it out.
    """
    # log2 of the key in fixed steps: order-preserving, and near-even bins
    d = d.where(F.col("size") > 0).withColumn("bin", F.floor(F.log2("key") * resolution))
    bins = d.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.select("source", "bin", (F.sum("bin_size").over(upto) - F.col("bin_size")).alias("before"), "bin_size")
    last = (bins.join(plan.where("budget > 0").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
            .where((F.col("before") < F.col("budget")) & (F.col("before") + F.col("bin_size") >= F.col("budget")))
            .select(F.col("s"), F.col("bin").alias("b"), "before", "budget"))
    inside = (d.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
              .groupBy("source", "before", "budget", "key").agg(F.sum("size").alias("size")))
    run = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = inside.withColumn("upto", F.col("before") + F.sum("size").over(run))
    fits = 2 * F.col("upto") - F.col("size") <= 2 * F.col("budget")
    # nothing of the last bin fits: everything below its first key is taken
    return x.groupBy("source").agg(F.max(F.when(fits, F.col("key"))).alias("last_key"), F.min("key").alias("first_key"))


def mix_sized(d: DataFrame, weights=WEIGHTS, volume: float = VOLUME, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The plan of the mix, one row per source, as a small stored table.

    source, source_size, target, epochs, and the key limits ``last_key``
    (taken up to and including it) and ``first_key`` (taken below it).
    """
    resolution = max(32, d.count() // BIN_ROWS)
    totals = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(totals, weights, volume, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("epochs", epochs.cast("long"))
    plan = staged(plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-plan")
    cut = _cut(d, plan, resolution).withColumnRenamed("source", "s")
    return staged(plan.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-cut")


def _copies() -> Column:
    part = F.when(F.col("last_key").isNotNull(), F.col("__key") <= F.col("last_key")) \
        .otherwise(F.col("__key") < F.col("first_key"))
    return F.col("epochs") + F.when(part, 1).otherwise(0)


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row."""
    d = staged(sized(docs), "mix-sizes")
    plan = mix_sized(d, **options).withColumnRenamed("source", "s")
    out = d.withColumnRenamed("key", "__key").join(plan, F.col("source").eqNullSafe(F.col("s")))
    out = out.withColumn("copies", _copies().cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: every row as often as the mix takes it.

    Documents of size 0 carry no words; they are kept once.  The columns of
    ``docs`` come back unchanged; texts are not shuffled.
    """
    d = staged(sized(docs), "mix-sizes")
    plan = mix_sized(d, **options)
    plan = plan.select(F.struct(*plan.columns).alias("__plan"))
    size = word_count(F.col("text"))
    key = -F.log(md5_uniform(F.col("doc_id"))) / quality_weight(F.col("text"), F.col("__size"))
    x = (docs.withColumn("__size", size).withColumn("__key", key)
         .join(plan, F.col("source").cast("string").eqNullSafe(F.col("__plan.source"))))
    p = F.col("__plan")
    part = F.when(p["last_key"].isNotNull(), F.col("__key") <= p["last_key"]).otherwise(F.col("__key") < p["first_key"])
    n = F.when(F.col("__size") == 0, 1).otherwise(p["epochs"] + F.when(part, 1).otherwise(0))
    x = x.withColumn("__copies", n.cast("int")).where("__copies > 0")
    x = x.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return x.select(*[F.col(f"`{c}`") for c in docs.columns])
