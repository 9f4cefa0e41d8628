"""Global-order computations without a single-partition window.

A window with no ``partitionBy`` moves every row into one task.  Instead:

1. collapse to distinct order keys with counts (map-side partial aggregation);
2. range-partition those keys (``repartitionByRange``; equal keys share a
   partition and partitions are ordered) and store the result with its
   partition number as a column;
3. running sums inside each partition;
4. add the totals of all earlier partitions, a table with one row per partition.

Steps 3 and 4 both read the stored table.  Range bounds are sampled, so a range
partitioning that is evaluated twice need not come out the same; a number that
is data does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def _ranged(df: DataFrame, num_partitions: int | None, *keys) -> DataFrame:
    """``df`` stored in ranges of ``keys``, numbered by ``_pid`` in their order.

    Without an explicit count AQE may merge neighbouring ranges; the numbers
    then still follow the order of the keys.
    """
    d = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    return stored(d.withColumn("_pid", F.spark_partition_id()), "ranged")


def global_cumsum(df: DataFrame, order_col: str, value_cols: list[str], descending: bool = False,
                  num_partitions: int | None = None) -> DataFrame:
    """Add ``cum_<v>`` (inclusive running sum over ``order_col``) for each value column.

    ``df`` should already hold one row per distinct ``order_col`` value.
    """
    key = F.col(order_col).desc() if descending else F.col(order_col).asc()
    d = _ranged(df, num_partitions, key)
    totals = d.groupBy("_pid").agg(*[F.sum(v).alias(f"_tot_{v}") for v in value_cols])
    # Offsets over one row per partition: a single small task by construction.
    wo = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_tot_{v}").over(wo), F.lit(0)).alias(f"_off_{v}")
                                      for v in value_cols])
    w = Window.partitionBy("_pid").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    for v in value_cols:
        d = d.withColumn(f"_loc_{v}", F.sum(v).over(w))
    out = d.join(offsets, "_pid")
    for v in value_cols:
        out = out.withColumn(f"cum_{v}", F.col(f"_loc_{v}") + F.col(f"_off_{v}"))
    return out.drop("_pid", *[f"_loc_{v}" for v in value_cols], *[f"_off_{v}" for v in value_cols])


def exact_quantiles(df: DataFrame, col: str, probs: list[float], names: list[str] | None = None,
                    num_partitions: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles (numpy default / ``quantile_cont``), exact.

    Works on distinct values with multiplicities, so the shuffled data is at
    most the number of distinct values; no group is collected into one task.
    Returns one row with one column per probability.
    """
    names = names or [f"p{int(round(p * 100))}" for p in probs]
    vals = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    counts = vals.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    cum = stored(global_cumsum(counts, "v", ["c"], num_partitions=num_partitions), "quantile-ranks")   # cum_c = #values <= v
    cum = cum.withColumn("lo_rank", F.col("cum_c") - F.col("c"))  # #values < v
    total = cum.agg(F.max("cum_c").alias("n")).first()["n"]
    if not total:
        return df.sparkSession.createDataFrame([tuple([None] * len(probs))],
                                               ", ".join(f"{n} double" for n in names))
    # 0-based ranks needed by every probability: floor(h) and floor(h)+1.
    wanted = {}
    for p in probs:
        h = (total - 1) * p
        k = int(h // 1)
        wanted[p] = (k, min(k + 1, total - 1), h - k)
    # value at 0-based rank r: the v with lo_rank <= r < cum_c.
    def at(r):
        return F.max(F.when((F.col("lo_rank") <= r) & (F.col("cum_c") > r), F.col("v")))

    cols = []
    for p, name in zip(probs, names):
        k, k1, frac = wanted[p]
        a = at(k)
        cols.append((a + (at(k1) - a) * F.lit(frac) if frac else a).alias(name))
    return cum.agg(*cols)


def _cell(v):
    """Order-preserving cells of doubles, about 1 % wide: a function of the value alone."""
    mag = F.floor(F.log2(F.abs(v)) * 64).cast("long") + 100_000
    return F.when(F.isnan(v), F.lit(1_000_000).cast("long")).when(v == 0, F.lit(0).cast("long")).when(v > 0, mag).otherwise(-mag)


def keyed_exact_quantiles(df: DataFrame, key: str, col: str, probs: list[float], names: list[str], times: str | None = None) -> DataFrame:
    """Per-key linear-interpolated quantiles without holding a key in one task
    (of values that stand ``times`` times each, if that column is given).

    Distinct ``(key, value)`` pairs with counts (partial aggregation) fall into
    cells of values; the running count over a key's cells (a few thousand at
    most) tells in which cells the wanted ranks lie, and only the values of
    those are ranked, cell by cell.  Returns ``(key, names...)``.
    """
    weight = F.lit(1).cast("long") if times is None else F.col(times)
    v = df.select(key, F.col(col).cast("double").alias("v"), weight.alias("_w")).filter(F.col("v").isNotNull())
    counts = v.groupBy(key, "v").agg(F.sum("_w").alias("c")).withColumn("cell", _cell(F.col("v")))
    cells = counts.groupBy(key, "cell").agg(F.sum("c").alias("cc"))
    upto = Window.partitionBy(key).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_upto", F.sum("cc").over(upto)).withColumn("_n", F.sum("cc").over(Window.partitionBy(key)))

    def ranks(p):
        h = (F.col("_n") - 1) * F.lit(p)
        k = F.floor(h)
        return k, F.least(k + 1, F.col("_n") - 1), h - k

    def inside(rank):
        return (F.col("_upto") - F.col("cc") <= rank) & (F.col("_upto") > rank)

    wanted = F.lit(False)
    for p in probs:
        k, k1, _ = ranks(p)
        wanted = wanted | inside(k) | inside(k1)
    need = cells.filter(wanted).select(key, "cell", (F.col("_upto") - F.col("cc")).alias("_before"), "_n")
    run = Window.partitionBy(key, "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    r = counts.join(need, [key, "cell"]).withColumn("cum", F.col("_before") + F.sum("c").over(run))
    r = r.withColumn("lo_rank", F.col("cum") - F.col("c"))
    aggs = []
    for p, name in zip(probs, names):
        k, k1, frac = ranks(p)

        def hit(rank):
            return (F.col("lo_rank") <= rank) & (F.col("cum") > rank)
        aggs += [F.max(F.when(hit(k), F.col("v"))).alias(f"_a_{name}"),
                 F.max(F.when(hit(k1), F.col("v"))).alias(f"_b_{name}"),
                 F.max(frac).alias(f"_f_{name}")]
    g = r.groupBy(key).agg(*aggs)
    return g.select(key, *[(F.col(f"_a_{nm}") + (F.col(f"_b_{nm}") - F.col(f"_a_{nm}")) * F.col(f"_f_{nm}"))
                           .alias(nm) for nm in names])


def keyed_cumsum(df: DataFrame, key: str, order_cols: list[str], value: str, out: str = "cum",
                 num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` per ``key`` in ``order_cols`` order,
    without a per-key window: rows are range-partitioned on (key, order), so a
    hot key spans many tasks; each task sums its slice, and the slices of the
    same key in earlier partitions are added from a (partition, key) totals
    table.  The final join is on (partition, key), which spreads a hot key
    over its partitions.  ``order_cols`` should make rows unique per key."""
    d = _ranged(df, num_partitions, key, *order_cols)
    w = Window.partitionBy("_pid", key).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_loc", F.sum(value).over(w))
    tot = d.groupBy("_pid", key).agg(F.sum(value).alias("_tot"))
    offs = tot.select("_pid", key, F.coalesce(F.sum("_tot").over(
        Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (d.join(offs, ["_pid", key]).withColumn(out, F.col("_loc") + F.col("_off"))
            .drop("_pid", "_loc", "_off"))
