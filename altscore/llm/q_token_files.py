"""op3: all documents written as token ids and read back."""

from __future__ import annotations

import uuid

from ..plans.registry import register
from ..session import scratch_path
from . import token_files as T
from .common import documents


@register("op3_token_files")
def q_token_files(spark, sf_dir):
    path = scratch_path(spark, f"llm-token-file-{uuid.uuid4().hex}")
    T.write(documents(spark, sf_dir), path)
    return T.documents_of(spark, path)
