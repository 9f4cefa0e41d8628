"""op10: personal data in all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import register
from . import pii as P
from .common import documents


@register("op10_pii")
def q_pii(spark, sf_dir):
    d = P.detect(documents(spark, sf_dir))
    counts = [P.count_of(F.col("base"), k).alias(f"n_{k}") for k in P.KINDS]
    return d.select("doc_id", *counts, F.sha2(P.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                    P.listed(F.col("spans")).alias("spans"))
