"""Operator 2: token counts through a digest cache.

Each text's digest and the tokenizer's version digest are joined to the counts already stored; only distinct misses are encoded and
then appended to the cache, which is a Parquet table. Text is shuffled once, by digest, for the misses alone.

Defined cases: a null text counts as the empty text (0 tokens); equal texts get equal counts and are encoded once; an empty table
gives no rows; further input columns are ignored, whatever their names; repeated rows are kept; a very long text is encoded whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm import bpe
from turnloom.llm.storage import new_path
from turnloom.llm.textops import slices, utf8_of

CACHE_SCHEMA = "text_digest binary, tokenizer_digest string, n_tokens long"


def normalised(text):
    """The content that is digested. The tokenizer has no normaliser, so only null is folded into the empty text."""
    return F.coalesce(text, F.lit(""))


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        for batch in batches:
            texts = batch.column(1)
            _, offsets = utf8_of(texts)
            for i, j in slices(offsets):
                _, at = coder.encode(texts.slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(at[1:] - at[:-1], pa.int64())], names=["text_digest", "n_tokens"])

    return count


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row. cache_path: a cache that lasts; if None, a new one in the shared folder."""
    spark = docs.sparkSession
    version = bpe.tokenizer_digest(tokenizer_path)
    cache_path = cache_path or new_path(spark, "token-cache")
    text = normalised(F.col(text_col))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("text_digest"))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    def stored() -> DataFrame:
        """A digest that two writers have added at the same time is there twice, with equal counts."""
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version)
        return known.groupBy("text_digest").agg(F.first("n_tokens").alias("n_tokens"))

    misses = keyed.select("text_digest", "text").join(stored(), "text_digest", "left_anti").dropDuplicates(["text_digest"])
    counted = misses.mapInArrow(_counter(tokenizer_path), "text_digest binary, n_tokens long")
    counted.select("text_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache_path)
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    return (
        keyed.select("doc_id", "text_digest", n_bytes)
        .join(stored(), "text_digest")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
