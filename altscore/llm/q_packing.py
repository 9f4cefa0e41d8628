"""op4: all documents packed into sequences."""

from __future__ import annotations

from ..plans.registry import register
from . import packing as P
from .common import documents


@register("op4_packing")
def q_packing(spark, sf_dir):
    return P.pack(documents(spark, sf_dir))
