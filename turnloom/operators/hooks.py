"""Answers from a model: distinct requests that no earlier run has answered go through a function in batches, and are appended to a table of answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Made once in each task; takes a frame of requests and gives a frame of their answers with the key, without those that it can't answer.
Model = Callable[[pd.DataFrame], pd.DataFrame]


class AnswerStore:
    """Answers by request key, in a Parquet table that grows with each run. answer: the schema of the answer's columns."""

    def __init__(self, spark: SparkSession, folder: str, key: str, answer: str):
        self.spark, self.folder, self.key = spark, folder, key
        self.schema = f"{key} string, {answer}"
        spark.createDataFrame([], self.schema).write.mode("append").parquet(folder)

    def read(self) -> DataFrame:
        """One row for each answered request; of two runs that answered one at the same time the row is the least by all columns."""
        rows = self.spark.read.schema(self.schema).parquet(self.folder)
        others = [c for c in rows.columns if c != self.key]
        return rows.groupBy(self.key).agg(F.min(F.struct(*others)).alias("a")).select(self.key, "a.*")

    def run(self, requests: DataFrame, make: Callable[[], Model], tasks: int | None = None) -> int:
        """Asks what is not answered yet, each distinct key once, and appends the answers; the number of requests that stay open.

        make is called once in each task (to load weights, or open a connection); its model gets batches as Arrow brings them. tasks: how many ask at a time.
        """
        distinct = requests.dropDuplicates([self.key])
        pending = distinct.join(self.read().select(self.key), self.key, "left_anti")
        if tasks:
            pending = pending.repartition(tasks, self.key)
        names = [f.split()[0] for f in self.schema.split(", ")]

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = make()
            for batch in batches:
                if len(batch):
                    yield model(batch)[names]

        pending.mapInPandas(ask, self.schema).write.mode("append").parquet(self.folder)
        return distinct.join(self.read().select(self.key), self.key, "left_anti").count()

    def answered(self, requests: DataFrame) -> DataFrame:
        """Every request, repeated ones too, with its answer or nulls."""
        return requests.join(self.read(), self.key, "left")
