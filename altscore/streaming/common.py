"""Helpers shared by the streaming jobs.

Streams read the files of the given tables themselves, under the table's
declared schema.  ``files_per_trigger`` bounds a micro-batch; without it, the
files that are there form one.  Every query keeps its checkpoint in the shared
checkpoint folder, so a restarted driver or lost executor resumes exactly once.
"""

from __future__ import annotations

import contextlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path
from ..sources.tables import normalise_timestamps, table_path
from .keyed_log import KeyedLog


STATE_CONFS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
               "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true"}


@contextlib.contextmanager
def state_on_disk(spark: SparkSession):
    """Queries that are run in here keep their state in RocksDB instead of the heap of the executors."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONFS}
    for k, v in STATE_CONFS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_dir(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"stream/{name}-{uuid.uuid4().hex[:12]}")


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A file stream of Parquet or JSON records under a declared schema."""
    if fmt not in ("parquet", "json"):
        raise ValueError(f"Unsupported stream format: {fmt}")
    r = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path)


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A driver table as a stream of its own files."""
    path = table_path(sf_dir, name)
    # a pattern, for a stream of a single file must not be named by a plain path
    return normalise_timestamps(read_stream(spark, path + "*", spark.read.parquet(path).schema, files_per_trigger))


def run_to_files(stream_df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> list[dict]:
    """Run a query to completion over the available input (``availableNow``)
    into a Parquet file sink (exactly-once through the checkpoint); returns
    the progress of its micro-batches."""
    q = (stream_df.writeStream.format("parquet").outputMode(mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out))
    q.awaitTermination()
    return [json.loads(p.json) for p in q.recentProgress]


def run_foreach_batch(stream_df: DataFrame, fn, checkpoint: str, mode: str = "append") -> None:
    q = (stream_df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()


def run_upserts(stream_df: DataFrame, keys: list[str], base: str) -> DataFrame:
    """Run an aggregation in update mode and return the newest row of each key.

    Every micro-batch appends the rows it changed, and only those, to a log that is compacted as it
    grows (``KeyedLog``); groups that the watermark has not closed yet are there
    with their value so far.
    """
    log = KeyedLog(stream_df.sparkSession, base + "/log", keys, stream_df.schema)
    run_foreach_batch(stream_df, log.append, base + "/chk", mode="update")
    return log.read()
