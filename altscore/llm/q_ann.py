"""op5: nearest neighbours of every 50th vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import register
from . import ann as A


@register("op5_nearest")
def q_nearest(spark, sf_dir):
    return A.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
