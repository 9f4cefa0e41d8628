"""Tables laid out by a key: lookups that read one bucket, joins without a shuffle.

The reference keeps indexes on its id columns.  Here a table is written once in
buckets of its key, sorted within them, with Parquet bloom filters on further id
columns.  A lookup by the key opens the files of one bucket; a join of two
tables that have the same key and number of buckets reads bucket with bucket.

A bucket is read by one task, so keys with more rows than an average bucket
(fewer than there are buckets) and rows without a key are kept beside the
buckets, in files of ordinary size; their part of a join is planned by Spark
from its real size and split where it is skewed.

Defined results: rows without a key match nothing and are found by looking up
None; repeated rows stay; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


@dataclass(frozen=True)
class KeyedTable:
    key: str
    buckets: int
    cold: DataFrame            # in buckets
    hot: DataFrame             # rows of ``hot_keys`` and rows without a key
    hot_keys: tuple

    def rows(self) -> DataFrame:
        return self.cold.unionByName(self.hot)

    def lookup(self, value) -> DataFrame:
        """Rows of one key; the filter prunes buckets, row groups and pages."""
        if value is None:
            return self.hot.filter(F.col(self.key).isNull())
        part = self.hot if value in self.hot_keys else self.cold
        return part.filter(F.col(self.key) == F.lit(value))

    def only(self, columns: list[str]) -> KeyedTable:
        """The same table with the key and these columns."""
        names = [self.key, *[c for c in columns if c != self.key]]
        return KeyedTable(self.key, self.buckets, self.cold.select(names), self.hot.select(names), self.hot_keys)


def write_keyed(df: DataFrame, key: str, name: str, buckets: int | None = None, ids: tuple[str, ...] = ()) -> KeyedTable:
    """Store ``df`` in buckets of ``key`` under the shared folder.

    ``buckets``: default ``spark.sql.shuffle.partitions``; tables to be joined need
    the same.  ``ids``: further columns that get a bloom filter.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    unique = f"{name}_{uuid.uuid4().hex}"
    base = scratch_path(spark, unique)

    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    # keys above the average number fewer than the buckets
    heavy = counts.filter(F.col(key).isNotNull() & (F.col("n") > total / n)).select(key).collect()
    hot_keys = tuple(sorted(r[0] for r in heavy))
    is_hot = F.col(key).isNull() | F.col(key).isin(*hot_keys) if hot_keys else F.col(key).isNull()

    def blooms(writer):
        for c in ids:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        return writer

    # Spark hashes a bucket as it hashes a partition: one task writes one bucket
    cold = df.filter(~is_hot).repartition(n, key)
    blooms(cold.write.format("parquet").option("path", base + "/cold")).bucketBy(n, key).sortBy(key).saveAsTable(unique)
    blooms(df.filter(is_hot).write).parquet(base + "/hot")
    return KeyedTable(key, n, spark.table(unique), spark.read.schema(df.schema).parquet(base + "/hot"), hot_keys)


def join_keyed(left: KeyedTable, right: KeyedTable, how: str = "left") -> DataFrame:
    """Join on the common key (``how``: inner, left, left_semi or left_anti).

    Keys that are in buckets on both sides join without an exchange.
    """
    if (left.key, left.buckets) != (right.key, right.buckets):
        raise ValueError("tables to be joined need the same key and number of buckets")
    key = F.col(left.key)
    apart = sorted({*left.hot_keys, *right.hot_keys})
    if not apart:
        in_buckets = left.cold.join(right.cold, left.key, how)
    else:
        in_buckets = left.cold.filter(~key.isin(*apart)).join(right.cold.filter(~key.isin(*apart)), left.key, how)
    parts = [in_buckets]
    if apart:
        parts.append(left.rows().filter(key.isin(*apart)).join(right.rows().filter(key.isin(*apart)), left.key, how))
    if how in ("left", "left_anti"):         # no key: no partner
        alone = left.hot.filter(key.isNull())
        missing = [f for f in in_buckets.schema if f.name not in alone.columns]
        parts.append(alone.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing]))
    return reduce(DataFrame.unionByName, parts)
