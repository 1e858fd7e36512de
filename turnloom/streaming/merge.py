"""A keyed table that streams merge into: changed rows of each batch, a journal of the batches that count, and bases that gather them.

A batch is written to a folder of its number and counts from the moment the journal names it. A batch that comes again (the query was
restarted before its own log was written) is known from the journal and changes nothing; one that broke off before the journal
is overwritten. Reading takes of each key the row of the latest batch. After `compact_every` batches all rows are gathered in a new base, so that a
read takes few folders and the journal's tail stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

JOURNAL = "batch long, path string, base boolean"


class MergedTable:
    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: list[str], compact_every: int = 20):
        self.spark, self.folder, self.schema, self.key, self.compact_every = spark, folder, schema, key, compact_every
        spark.createDataFrame([], JOURNAL).write.mode("append").json(f"{folder}/journal")

    def _journal(self) -> DataFrame:
        return self.spark.read.schema(JOURNAL).json(f"{self.folder}/journal")

    def _note(self, batch: int, path: str, base: bool) -> None:
        self.spark.createDataFrame([(batch, path, base)], JOURNAL).coalesce(1).write.mode("append").json(f"{self.folder}/journal")

    def _parts(self) -> list:
        """The last base and the batches after it: at most compact_every + 1 rows."""
        journal = self._journal()
        start = journal.where("base").agg(F.max("batch")).first()[0]
        after = ~F.col("base") if start is None else (F.col("base") & (F.col("batch") == start)) | (~F.col("base") & (F.col("batch") > start))
        return journal.where(after).orderBy("batch", F.desc("base")).collect()

    def apply(self, rows: DataFrame, batch: int) -> bool:
        """Merges a batch: rows with the columns of the table, one for each key that changes. False if it had been merged before."""
        if not self._journal().where((F.col("batch") == batch) & ~F.col("base")).isEmpty():
            return False
        path = f"{self.folder}/batch-{batch}"
        rows.select(*self.schema.names, F.lit(batch).cast("long").alias("_batch")).write.mode("overwrite").parquet(path)
        self._note(batch, path, False)
        if len(self._parts()) > self.compact_every:
            self.compact(batch)
        return True

    def compact(self, batch: int) -> None:
        path = f"{self.folder}/base-{batch}"
        self._latest().write.mode("overwrite").parquet(path)
        self._note(batch, path, True)

    def _latest(self) -> DataFrame:
        whole = StructType(list(self.schema.fields)).add("_batch", LongType())
        paths = [p.path for p in self._parts()]
        if not paths:
            return self.spark.createDataFrame([], whole)
        rows = self.spark.read.schema(whole).parquet(*paths)
        others = [c for c in self.schema.names if c not in self.key]
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*others, "_batch"), "_batch").alias("_last"))
        return last.select(*self.key, *[F.col("_last")[c].alias(c) for c in [*others, "_batch"]]).select(*whole.names)

    def read(self) -> DataFrame:
        return self._latest().drop("_batch")
