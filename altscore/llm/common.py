"""Helpers shared by the document operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

# Words everywhere in this package: maximal runs of anything but the ASCII
# blanks.  ``bytes.split()`` splits on exactly these six characters.
WORD = r"[^\x20\x09-\x0D]+"

# Rows per Arrow batch: texts can be long, so batches are kept short and the
# byte limit ends them earlier where texts are very long.
ARROW_CONFS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256",
               "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


_STATE: dict = {}


def worker_state(key, make=dict):
    """What a Python worker keeps between tasks (caches, loaded files).

    Workers outlive operators, so there is one slot: an operator that asks for
    its state drops that of the operator before.
    """
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]


def arrow_batches(spark: SparkSession) -> None:
    """Bound the size of the Arrow batches sent to Python workers."""
    for k, v in ARROW_CONFS.items():
        spark.conf.set(k, v)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``stored``, in a folder that tells whose table it is."""
    return stored(df, f"llm-{name}")


def md5_uniform(key: Column) -> Column:
    """A uniform number in (0, 1) from the first 52 bits of the key's MD5."""
    hex13 = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(hex13, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2 ** 52))


def id_hash(doc_id: Column) -> Column:
    """crc32 of the id as text (null: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, usable: Column | None = None) -> DataFrame:
    """doc_id, text and label of at most ``rows`` labelled documents, one row each.

    The sample is the ``rows`` ids with the smallest hash among those for which
    ``usable`` (a condition on doc_id) holds; all of them if there are fewer.
    The bound makes the sample's ids safe to broadcast.  Of several rows with one id the
    text with the smallest hash counts, so what comes of the sample is bounded whatever repeats.
    """
    own = labels.select("doc_id", F.col(label).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    if usable is not None:
        own = own.where(usable)
    own = own.groupBy("doc_id").agg(F.min("label").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(rows)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(own), "doc_id")
    return found.groupBy("doc_id").agg(one_text("text").alias("text"), F.first("label").alias("label"))


def one_text(text: str) -> Column:
    """Of a group's texts, the one with the smallest hash (null only if all are)."""
    return F.min_by(text, F.when(F.col(text).isNotNull(), F.xxhash64(text)))
