"""A training-data pipeline over `documents`: five stages, each calling one operator on what the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as Parquet and reads again for the next. The first four return the columns
of documents; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from turnloom.llm import decontaminate, near_dup, packing, quality, registry, toxicity
from turnloom.llm.storage import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely poor than not go. Null and empty texts have no terms and are judged by the model's thresholds alone, equal texts alike; a text is read whole, however long; an empty table stays empty; other columns are kept as they are, whatever their names."""
    return quality.keep_good(docs, registry.quality_model(spark, sf_dir))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go. Null and empty texts score the model's bias, equal texts alike; a text is read whole; an empty table stays empty; other columns are kept."""
    return toxicity.keep_clean(docs, registry.toxicity_machine(spark, sf_dir))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that of the least id; documents are linked from a similarity of 0.8 on, on runs of five words. Rows without words or without id stay; of repeated rows one stays; rows of one id with different texts are judged apart; an empty table stays empty; other columns are kept."""
    return near_dup.keep_one(docs, least=80, bands=64)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. Null and empty texts hold none and stay, also without id; equal texts go or stay alike; every window of a text is searched; an empty table stays empty; other columns are kept."""
    return decontaminate.keep_unmatched(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens. A null or empty text is one piece with the end id alone; repeated rows are packed each; a long text gives as many pieces as it needs; an empty table gives no rows; other columns go."""
    return packing.best_fit_packing(docs, public_tokenizers.path(registry.TOKENIZER))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: The classifiers, the hashes and the tokenizer cannot be said in SQL; tests compare run() with plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{k}-{name.replace(' ', '-')}")
    return docs
