"""Where jobs put tables that other jobs of the same session read: below spark.checkpoint.dir, which the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session may lack it, and gets a temporary one; on a cluster a machine's own folder would lose rows."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Folders that this driver has named.
_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clear_folders(spark: SparkSession) -> int:
    """Deletes all folders that this driver has made here, once nothing reads their tables any more; how many there were."""
    n = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows written once as Parquet and read back, for queries that read them several times."""
    path = new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
