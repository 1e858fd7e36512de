"""Ordered selections: first and latest records, samples, splits, shards, typical cases, windows over two axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.sources.shared import stored


def first_record(rows: DataFrame, key: list[str], order: list[str], attempt: str) -> DataFrame:
    """The first row of each key, with the attempts of the others in order."""
    own = Window.partitionBy(*key).orderBy(*order)
    ranked = rows.withColumn("_k", F.row_number().over(own))
    others = ranked.where("_k > 1").groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.col(attempt).cast("string").alias("a")))), lambda s: s["a"]), ",").alias("others"))
    return ranked.where("_k = 1").drop("_k").join(others, key, "left").withColumn("others", F.coalesce("others", F.lit("")))


def latest_by_version(rows: DataFrame, key: list[str], version: str, order: list[str]) -> DataFrame:
    """The row of the highest version of each key (the last by order among equals) and the number of rows whose version did not follow its predecessor."""
    by_time = Window.partitionBy(*key).orderBy(*order)
    marked = rows.withColumn("_conflict", F.coalesce(F.col(version) != F.lag(version).over(by_time) + 1, F.lit(False)))
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct(version, *order))
    return marked.groupBy(*key).agg(last.alias("_last"), F.count_if("_conflict").alias("conflicts")).select(*key, "_last.*", "conflicts")


def hash_sample(rows: DataFrame, by: list[str], identity: Column, n: int, seed: str = "") -> DataFrame:
    """n rows of each group, first by the digest of seed and identity."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.sha2(F.concat(F.lit(seed), identity.cast("string")), 256)))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def halves(clusters: DataFrame, cluster: str, seed: str) -> DataFrame:
    """Distinct clusters by digest: the first half is 'discovery', the rest 'confirmation'; rows of one cluster never part.

    The rank is counted over buckets of the digest's first byte, so no task sorts all clusters.
    """
    hashed = clusters.select(cluster).distinct().withColumn("h", F.sha2(F.concat(F.lit(seed), F.col(cluster).cast("string")), 256)).withColumn("bucket", F.substring("h", 1, 2))
    sizes = hashed.groupBy("bucket").agg(F.count("*").alias("n"))
    before = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    ranked = hashed.join(F.broadcast(before), "bucket").withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("h")) + F.col("before"))
    return ranked.select(cluster, F.when(F.col("rank") <= F.floor(F.col("total") / 2), "discovery").otherwise("confirmation").alias("split"))


def global_rank(rows: DataFrame, by: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """rows with their exact `rank` (from 1) in each group, in a total order, by a prefix sum over range partitions.

    Rows are dealt to ranges of (by, order), sorted in each, and written once with their place; the ranges are counted, and what lies before each is added. A group of any size is
    spread over many ranges: no task sorts it whole, and the window runs over counts of ranges only.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
    placed = stored(ranged.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "ranges")
    counts = placed.groupBy(*by, "_range").agg(F.count("*").alias("n"), F.min("_place").alias("first"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("n")
    offsets = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_of"), (before - F.col("first") + 1).alias("_offset"))
    on = F.col("_range") == F.col("_of")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return placed.join(offsets, on).select(*rows.columns, (F.col("_place") + F.col("_offset")).alias("rank"))


def greedy_cover(items: DataFrame, item: str, tags: str, predicates: list[Column] | None = None) -> list:
    """Items, each the one whose tags add most that is new, ties by digest, until all tags are covered; then for each predicate that none of them meets the first by digest that does.

    One aggregation keeps the first item of each combination of tags and predicates, which is all that a choice can take; tags are a small
    closed set by contract, so the combinations are few, and the choice is made over them.
    """
    flags = F.array(*[F.coalesce(p, F.lit(False)) for p in predicates or []]).cast("array<boolean>")
    digest = F.sha2(F.col(item).cast("string"), 256)
    kinds = items.groupBy(F.array_sort(F.array_distinct(tags)).alias("tags"), flags.alias("flags")).agg(F.min(F.struct(digest.alias("digest"), F.col(item).alias("item"))).alias("least"))
    rows = sorted(((r["least"]["digest"], r["least"]["item"], set(r["tags"]), r["flags"]) for r in kinds.collect()), key=lambda r: r[0])
    chosen, covered = [], set()
    while rows and (best := max(rows, key=lambda r: len(r[2] - covered)))[2] - covered:
        chosen.append(best)
        covered |= best[2]
    for k in range(len(predicates or [])):
        if not any(r[3][k] for r in chosen):
            chosen += [r for r in rows if r[3][k]][:1]
    return [r[1] for r in chosen]


def window_means(cells: DataFrame, by: list[str], steps: int, layers: int, n_steps: int, n_layers: int, value: str = "value") -> DataFrame:
    """Mean of every steps x layers window (step0, layer0) that fits in the n_steps x n_layers grid: each cell is dealt to the windows that hold it."""
    origin = lambda c, size, n: F.explode(F.sequence(F.greatest(F.col(c) - (size - 1), F.lit(0)), F.least(F.col(c), F.lit(n - size))))
    dealt = cells.withColumn("step0", origin("step", steps, n_steps)).withColumn("layer0", origin("layer", layers, n_layers))
    return dealt.groupBy(*by, "step0", "layer0").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def frozen_windows(means: DataFrame, steps: int, layers: int, n: int = 1) -> DataFrame:
    """(step0, layer0, step1, layer1) of the n windows with the greatest means, the larger origin winning a tie; the ends are inclusive."""
    best = means.orderBy(F.desc(F.round("mean", 12)), F.desc("step0"), F.desc("layer0")).limit(n)
    return best.select("step0", "layer0", (F.col("step0") + steps - 1).alias("step1"), (F.col("layer0") + layers - 1).alias("layer1"))


def inside_windows(cells: DataFrame, windows: DataFrame) -> DataFrame:
    """Cells with the windows (few, chosen before) that hold them."""
    return cells.join(F.broadcast(windows), F.col("step").between(F.col("step0"), F.col("step1")) & F.col("layer").between(F.col("layer0"), F.col("layer1")))
