"""op6: token counts of all documents."""

from __future__ import annotations

from ..plans.registry import register
from . import token_counts as T
from .common import documents


@register("op6_token_counts")
def q_token_counts(spark, sf_dir):
    return T.token_counts(documents(spark, sf_dir))
