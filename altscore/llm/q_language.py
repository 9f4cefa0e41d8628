"""op8: language of all documents."""

from __future__ import annotations

from ..plans.registry import register
from . import language as L
from .common import documents


@register("op8_language_id")
def q_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return L.identified(docs, L.fit(docs, usable=~L.fifth()), held_out=L.fifth())
