"""op9: near-duplicate components of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import register
from . import simhash as S
from .common import documents


@register("op9_simhash")
def q_simhash(spark, sf_dir):
    d = S.near_duplicates(documents(spark, sf_dir))
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
