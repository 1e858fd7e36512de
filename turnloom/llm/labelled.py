"""Bounded samples of labelled rows, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_crc32(column: str):
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label, max_rows: int, usable=None) -> DataFrame:
    """(text, label, weight) of the at most max_rows labelled rows whose ids come first in hash order, equal texts as one row.

    The ids are chosen in the label table, so the broadcast side is bounded by max_rows. usable: a condition on doc_id. label: a double
    expression over the label table; null labels are left out, several labels of one id or text are averaged. weight counts the rows.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.cast("double").alias("label")).dropna()
    if usable is not None:
        chosen = chosen.where(usable)
    chosen = chosen.groupBy("doc_id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return joined.groupBy("text").agg(F.avg("label").alias("label"), F.count("*").alias("weight"))
