"""Token counts of whole texts by a compiled finite-state tokenizer (``fst``).

Defined results: null and empty texts have no bytes and no tokens; repeated
rows come back as often as they occur; empty tables give empty results; the
columns of the input that are not asked for are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches
from .fst import counter

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    arrow_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def count(text: pd.Series) -> pd.Series:
        return pd.Series(counter(tokenizer).counts(text.tolist()), dtype="int64")

    text = F.col("text").cast("string")
    d = docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
                    count(text).alias("n_tokens"))
    return d.withColumn("over_limit", F.col("n_tokens") > limit)
