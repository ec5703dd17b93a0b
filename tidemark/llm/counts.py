"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only.

``wordcache`` regroups the texts of an Arrow batch by size, so one long text does not ride with thousands of
others, and splits texts at boundaries that do not change their tokens.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted alike; an id may be
null. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.wordcache import count_cache

LIMIT = 2048


def token_count(path: str):
    """An Arrow function from texts to their numbers of tokens under the tokenizer file ``path``."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(count_cache(path).run(texts.to_pylist()), pa.int64())

    return count


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text: str | Column = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row."""
    text = F.col(text) if isinstance(text, str) else text
    counted = df.select(
        F.col(id_col),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(path)(text).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
