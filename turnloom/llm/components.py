"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so a node of very many links is never collected; every step's links are written to the shared
folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.storage import materialise


def _star(links: DataFrame, small: bool) -> DataFrame:
    """links: (a, b) with a > b. Small-star looks at smaller neighbours only, large-star at all."""
    both = links if small else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "star-minima")
    linked = both.join(least, "a")
    if small:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        out = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where(F.col("a") > F.col("b")).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every linked node; component is the least node it can reach. links: (a, b) in any order; loops are ignored."""
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") > F.col("b")).distinct(), "links")
    mark = _mark(edges)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        edges = materialise(_star(materialise(_star(edges, small=False), "large-star"), small=True), "small-star")
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    else:
        raise RuntimeError("the components did not settle")
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)
