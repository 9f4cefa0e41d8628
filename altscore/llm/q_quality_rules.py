"""op2: quality verdict on all documents."""

from __future__ import annotations

from ..plans.registry import register
from . import quality as Q
from .common import documents


@register("op2_quality_rules")
def q_quality_rules(spark, sf_dir):
    docs = documents(spark, sf_dir)
    forest = Q.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return Q.judged(docs, forest).select("doc_id", *Q.BASE, "base_failed", "kept", "score")
