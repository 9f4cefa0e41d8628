"""A training corpus from ``documents``: five stages, each one operator.

``run(spark, sf_dir)`` applies STAGES in order.  Every stage gets all that its
predecessor kept, as a table written and read back.  Toxic documents go, one
document of each near-duplicate group stays, personal data is redacted, sources
are mixed to their weights (documents may repeat), and what is left is packed.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from altscore.llm import mixing, packing, pii, simhash, toxicity
from altscore.llm.common import documents, staged


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, usable=~toxicity.third())
    return toxicity.without_toxic(docs, model)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs, simhash.SHINGLE, simhash.DISTANCE)


def personal_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", toxic_out), ("simhash_near_dedup", near_copies_out), ("pii", personal_data_out),
          ("mixing", mixed), ("best_fit_packing", packed)]

# Fitted models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
