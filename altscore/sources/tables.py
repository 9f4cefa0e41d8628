"""Loading the driver tables.

Every read goes through :func:`load` so that (a) timestamps written without a
zone (read back as ``TIMESTAMP_NTZ``) become session-zone ``TIMESTAMP`` and
(b) callers can name the columns they need, which Catalyst turns into a
pruned ``ReadSchema`` at the Parquet scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def normalise_timestamps(df: DataFrame) -> DataFrame:
    """Cast ``TIMESTAMP_NTZ`` columns to ``TIMESTAMP`` (UTC session zone)."""
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    if not ntz:
        return df
    return df.select(*[F.col(c).cast("timestamp").alias(c) if c in ntz else F.col(c)
                       for c in df.columns])


def load(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    """Read one driver table, optionally pruned to ``columns``."""
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns:
        df = df.select(*columns)
    return normalise_timestamps(df)
