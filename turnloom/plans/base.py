"""Registration of queries, and the views of the driver's tables that stand for sessions, turns, votes and supports.

Each view is written twice: as a DataFrame, and as a common table expression for the SQL that says the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_COLUMNS = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")

#: One scored turn for each lineitem row: the order is the session. The turn is a rank over all columns, as line numbers repeat.
TURNS = f"""
turns AS (
  SELECT l_orderkey AS session, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_COLUMNS)}) AS turn,
    CASE WHEN l_orderkey % 2 = 0 THEN 'cm' ELSE 'cu' END AS split, l_returnflag || l_linestatus AS task,
    l_partkey AS part, l_suppkey AS worker, CAST(round(l_discount * 100) AS BIGINT) AS discount, CAST(round(l_tax * 100) AS BIGINT) AS tax,
    CAST(l_quantity AS BIGINT) AS quantity, l_extendedprice AS mass
  FROM lineitem
), scored AS (
  SELECT *, CASE WHEN status = 'ok' THEN CAST(quantity > 25 AS INT) * 1.0e0 END AS score FROM (
    SELECT *, CASE discount WHEN 0 THEN 'response_incomplete' WHEN 1 THEN 'pending_review' WHEN 2 THEN 'unavailable' ELSE 'ok' END AS status FROM turns)
)"""


#: Turns of a task, where each becomes several rows that are sorted more than once: some hundreds of bytes each time.
TASK_TURNS = 100_000


def turns(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """most: about as many turns a task at most, however large the table; without it the session's settings decide."""
    order = Window.partitionBy("l_orderkey").orderBy(*LINE_COLUMNS)
    lines = table(spark, sf_dir, "lineitem")
    if most is not None and (tasks := -(-lines.count() // most)) > spark.sparkContext.defaultParallelism:
        lines = lines.repartition(tasks, "l_orderkey")
    return lines.select(
        F.col("l_orderkey").alias("session"),
        F.row_number().over(order).cast("long").alias("turn"),
        F.when(F.col("l_orderkey") % 2 == 0, "cm").otherwise("cu").alias("split"),
        F.concat("l_returnflag", "l_linestatus").alias("task"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("worker"),
        F.round(F.col("l_discount") * 100).cast("long").alias("discount"),
        F.round(F.col("l_tax") * 100).cast("long").alias("tax"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.col("l_extendedprice").alias("mass"),
    )


def status_of(code: Column) -> Column:
    return F.when(code == 0, "response_incomplete").when(code == 1, "pending_review").when(code == 2, "unavailable").otherwise("ok")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = turns(spark, sf_dir).withColumn("status", status_of(F.col("discount")))
    return marked.withColumn("score", F.when(F.col("status") == "ok", (F.col("quantity") > 25).cast("double")))


#: Two votes of two judges on every turn.
VOTES = (
    TURNS
    + """, votes AS (
  SELECT session, turn, split, judge, vote, status, CASE WHEN status = 'ok' THEN CAST((quantity + vote * j) % 2 AS DOUBLE) END AS score FROM (
    SELECT *, CASE (discount + tax * j + vote) % 11 WHEN 0 THEN 'response_incomplete' WHEN 1 THEN 'pending_review' WHEN 2 THEN 'unavailable' ELSE 'ok' END AS status
    FROM (SELECT session, turn, split, discount, tax, quantity, unnest(['a', 'a', 'b', 'b']) AS judge, unnest([1, 1, 2, 2]) AS j, unnest([1, 2, 1, 2]) AS vote FROM turns))
)"""
)


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("judge"), F.lit(j).alias("j"), F.lit(v).alias("vote")) for name, j in (("a", 1), ("b", 2)) for v in (1, 2)]))
    cast = turns(spark, sf_dir, TASK_TURNS).withColumn("v", each).select("*", "v.judge", "v.j", "v.vote")
    marked = cast.withColumn("status", status_of((F.col("discount") + F.col("tax") * F.col("j") + F.col("vote")) % 11))
    return marked.select("session", "turn", "split", "judge", "vote", "status", F.when(F.col("status") == "ok", ((F.col("quantity") + F.col("vote") * F.col("j")) % 2).cast("double")).alias("score"))


#: Support vectors: absolute values of the embeddings, 64 cells each; fifty positions in a row are a session.
SUPPORTS = """
supports AS (
  SELECT vec_id AS position, vec_id // 50 AS session, vec_id % 4 AS step, vec_id % 3 AS head, [abs(CAST(v AS DOUBLE)) for v in embedding] AS x FROM embeddings
), cells AS (
  SELECT position, session, step, head, unnest(range(64)) AS cell, unnest(x) AS v FROM supports
), masses AS (SELECT position, sum(v) AS m FROM cells GROUP BY position),
shares AS (SELECT c.*, m, CASE WHEN m > 0 THEN v / m ELSE 0 END AS p FROM cells c JOIN masses USING (position))"""


def supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("position"),
        F.floor(F.col("vec_id") / 50).alias("session"),
        (F.col("vec_id") % 4).alias("step"),
        (F.col("vec_id") % 3).alias("head"),
        F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("x"),
    )


def r6(column: Column | str) -> Column:
    """Rounded, so that sums in another order compare equal."""
    return F.round(column, 6)
