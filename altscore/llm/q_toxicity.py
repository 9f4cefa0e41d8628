"""op7: toxicity scores of all documents."""

from __future__ import annotations

from ..plans.registry import register
from . import toxicity as T
from .common import documents


@register("op7_toxicity")
def q_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = T.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=~T.third())
    return T.scored(docs, model, held_out=T.third())
