"""op13: secrets in all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import register
from . import secrets as S
from .common import documents


@register("op13_secrets")
def q_secrets(spark, sf_dir):
    d = S.detect(documents(spark, sf_dir))
    return d.select("doc_id", *[S.count_of(F.col("base"), k).alias(f"n_{k}") for k in S.KINDS],
                    F.sha2(S.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), S.listed(F.col("spans")).alias("spans"))
