"""Summaries with explicit denominators: quantiles, hierarchical means, pooled ratios, cluster bootstrap, trimmed means, strata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


STEPS = 4096


def _bucket(v: Column) -> Column:
    """A whole number that grows with the value: STEPS for each doubling. Infinities have buckets of their own; NaN comes after all others."""
    infinite, end = float("inf"), 4000 * STEPS
    size = F.floor(F.log2(F.when(F.abs(v) < infinite, F.abs(v)).otherwise(1.0)) * STEPS) + 1200 * STEPS
    odd = F.when(F.isnan(v), end + 1).when(v == infinite, end).when(v == -infinite, -end)
    return odd.when(v > 0, size).when(v < 0, -size).otherwise(0).cast("long")


def _placed(kept: DataFrame, by: list[str], ranks: list[Column]) -> DataFrame:
    """Buckets of each group: `first` rank, n, sum s, `total` of the group, and whether the bucket `holds` one of the ranks. kept: by, v, bucket."""
    sizes = kept.groupBy(*by, "bucket").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    up = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    placed = sizes.select("*", (F.sum("n").over(up) - F.col("n")).alias("first"), F.sum("n").over(Window.partitionBy(*by)).alias("total"))
    holds = F.lit(False)
    for r in ranks:
        holds = holds | ((r >= F.col("first")) & (r < F.col("first") + F.col("n")))
    return placed.withColumn("holds", holds)


def _bucketed(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v")).withColumn("bucket", _bucket(F.col("v")))


def _ranked(kept: DataFrame, placed: DataFrame, by: list[str]) -> DataFrame:
    """Distinct values of the buckets that hold a rank, with `start` and `end` of their ranks.

    Buckets are counted in one aggregation; only those that hold a rank are sorted, each alone, so no task sorts a whole group.
    """
    # a few rows a group
    wanted = placed.where("holds").select(*by, "bucket", "first", "total")
    values = kept.join(wanted, [*by, "bucket"]).groupBy(*by, "bucket", "first", "total", "v").agg(F.count("*").alias("c"))
    inside = Window.partitionBy(*by, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("first") + F.sum("c").over(inside)
    return values.select(*by, "v", "total", (end - F.col("c")).alias("start"), end.alias("end"))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, q): exact quantiles with linear interpolation between ranks; NaN ranks above infinity. rows is read twice; store it first if it is dear."""
    place = [(F.col("total") - 1) * F.lit(q) for q in shares]
    ends = [(F.floor(x), F.ceil(x)) for x in place]
    kept = _bucketed(rows, by, value)
    found = _ranked(kept, _placed(kept, by, [r for e in ends for r in e]), by)
    at = lambda r: F.max(F.when((r >= F.col("start")) & (r < F.col("end")), F.col("v")))
    each = []
    for x, (low, high) in zip(place, ends, strict=True):
        # equal ends are the value itself, as infinite ones have no difference; from minus infinity no step leads on
        each.append(F.when((at(low) == at(high)) | (at(low) == float("-inf")) | (F.max(x - low) == 0), at(low)).otherwise(at(low) + (at(high) - at(low)) * F.max(x - low)))
    return (found.groupBy(*by) if by else found).agg(F.array(*each).alias("q"))


def describe(rows: DataFrame, by: list[str], value: str, cluster: str) -> DataFrame:
    """Counts, moments and quantiles of each group. rows is read three times; store it first if it is dear."""
    grouped = rows.groupBy(*by).agg(
        F.count("*").alias("n_total"),
        F.count(value).alias("n_valid"),
        F.count_distinct(F.when(F.col(value).isNotNull(), F.col(cluster))).alias("n_clusters"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    of_groups = quantiles(rows, by, value, list(QUANTILES))
    grouped = grouped.join(of_groups, by, "left") if by else grouped.crossJoin(of_groups)
    return grouped.select(*by, "n_total", "n_valid", "n_clusters", "mean", "std", "min", "max", *[F.col("q")[k].alias(f"p{round(q * 100)}") for k, q in enumerate(QUANTILES)])


def numbered(clusters: DataFrame, cluster: str) -> DataFrame:
    """(cluster, k): distinct clusters numbered from 0 in the order of their digests, counted over 4096 buckets of it."""
    hashed = clusters.select(cluster).withColumn("h", F.md5(F.col(cluster).cast("string").cast("binary"))).withColumn("bucket", F.substring("h", 1, 3))
    sizes = hashed.groupBy("bucket").agg(F.count("*").alias("n"))
    before = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("bucket").orderBy("h", cluster))
    return hashed.join(F.broadcast(before), "bucket").select(cluster, (own + F.col("before") - 1).alias("k"))


def draws(clusters: DataFrame, cluster: str, reps: int, seed: int) -> DataFrame:
    """(rep, cluster, weight): for each repetition as many draws with replacement as there are clusters, from digests, so that every engine draws alike.

    clusters: the distinct clusters. The reps x clusters draws are dealt over tasks as a range of numbers.
    """
    spark, n = clusters.sparkSession, clusters.count()
    slots = spark.range(0, reps * n).select(F.floor(F.col("id") / n).alias("rep"), (F.col("id") % n).alias("slot"))
    text = F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("slot").cast("string"))
    value = F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")
    drawn = slots.select("rep", (value % n).alias("k")).groupBy("rep", "k").agg(F.count("*").alias("weight"))
    return drawn.join(numbered(clusters, cluster), "k").select("rep", cluster, "weight")


def bootstrap_interval(rows: DataFrame, by: list[str], value: str, cluster: str, drawn: DataFrame) -> DataFrame:
    """2.5 and 97.5 percentiles of the ratio of drawn cluster sums to drawn cluster counts; all groups share the draws."""
    sums = rows.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count("*").alias("c"))
    reps = sums.join(drawn, cluster).groupBy(*by, "rep").agg((F.sum(F.col("s") * F.col("weight")) / F.sum(F.col("c") * F.col("weight"))).alias("ratio"))
    ends = reps.groupBy(*by).agg(F.percentile("ratio", [0.025, 0.975]).alias("q")) if by else reps.agg(F.percentile("ratio", [0.025, 0.975]).alias("q"))
    return ends.select(*by, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def _digest_number(*parts: Column | str) -> Column:
    """52 bits of the digest of parts joined by '|', equal in every engine."""
    text = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def split_bootstrap(rows: DataFrame, by: list[str], value: str, cluster: str, reps: int, seed: int, bucket_size: int = 4096) -> DataFrame:
    """2.5 and 97.5 percentiles of the ratio of drawn cluster sums to drawn cluster counts, all groups with the same draws (groups are few by contract).

    The clusters of `rows` are numbered and cut into buckets. Of each repetition's draws, as many as there are clusters, only the number that
    falls into each bucket is shuffled; which clusters of the bucket they hit is drawn once beside the bucket's sums of all groups, by digests again, so no row for a cluster and repetition is
    ever shuffled. Draws come from digests and are the same in every engine.
    """
    # own columns begin with an underscore, so that they don't clash with those of the caller
    spark, rows = rows.sparkSession, rows.select(*by, F.col(cluster).alias("_cluster"), F.col(value).alias("_value"))
    types = [rows.schema[c].dataType for c in by]
    # few by contract
    groups = [tuple(r) for r in rows.select(*by).distinct().collect()] if by else [()]
    if not groups:
        return spark.createDataFrame([], StructType([rows.schema[c] for c in by]).add("ci_low", "double").add("ci_high", "double"))
    clusters = rows.select("_cluster").distinct()
    n = clusters.count()
    b, count = max(1, -(-n // bucket_size)), max(n, 1)
    first = lambda k: F.expr(f"({k} * {n} + {b - 1}) div {b}")
    placed = numbered(clusters, "_cluster").select("_cluster", F.expr(f"k * {b} div {count}").alias("_bucket"), "k").withColumn("_place", F.col("k") - first("_bucket")).drop("k")
    # sums and counts of all groups side by side, so that a draw is made once for all of them
    literals = [[F.lit(v).cast(t) for v, t in zip(g, types, strict=True)] for g in groups]
    mine = [reduce(Column.__and__, [F.col(c).eqNullSafe(v) for c, v in zip(by, g, strict=True)], F.col("_value").isNotNull()) for g in literals]
    sums = [(f"_s{g}", F.sum(F.when(own, F.col("_value"))).cast("double"), 0.0) for g, own in enumerate(mine)] + [(f"_c{g}", F.count_if(own), 0) for g, own in enumerate(mine)]
    summed = rows.groupBy("_cluster").agg(*[F.coalesce(total, F.lit(zero)).alias(name) for name, total, zero in sums])
    held = placed.join(summed, placed["_cluster"].eqNullSafe(summed["_cluster"])).groupBy("_bucket").agg(F.array_sort(F.collect_list(F.struct("_place", *[name for name, _, _ in sums]))).alias("_e"))
    held = held.select("_bucket", *[F.col(f"_e.{name}").alias(name) for name, _, _ in sums])
    slots = spark.range(0, reps * n).select(F.expr(f"id div {count}").alias("_rep"), F.expr(f"id % {count}").alias("_slot"))
    hit = _digest_number(F.lit(seed), "_rep", "_slot") % count
    dealt = slots.select("_rep", hit.alias("_h")).groupBy("_rep", F.expr(f"_h * {b} div {count}").alias("_bucket")).agg(F.count("*").alias("_m"))
    size = first("(_bucket + 1)") - first("_bucket")
    # the draws of a bucket are rows between two steps of one task, summed by repetition before anything is shuffled
    drawn = dealt.join(held, "_bucket").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)).alias("_i"))
    at = drawn.select("_rep", *[name for name, _, _ in sums], (_digest_number(F.lit(seed), "_rep", "_bucket", "_i") % size).cast("int").alias("_at"))
    each = at.groupBy("_rep").agg(*[F.sum(F.get(name, F.col("_at"))).alias(name) for name, _, _ in sums])
    ratios = each.select(*[F.try_divide(f"_s{g}", f"_c{g}").alias(f"_r{g}") for g in range(len(groups))])
    ends = ratios.agg(*[F.percentile(f"_r{g}", [0.025, 0.975]).alias(f"_q{g}") for g in range(len(groups))])
    listed = [F.struct(*[v.alias(c) for c, v in zip(by, g, strict=True)], F.get(f"_q{k}", F.lit(0)).alias("ci_low"), F.get(f"_q{k}", F.lit(1)).alias("ci_high")) for k, g in enumerate(literals)]
    return ends.select(F.explode(F.array(*listed)).alias("_g")).select("_g.*")


def trimmed_mean(rows: DataFrame, by: list[str], value: str, share: float = 0.05) -> DataFrame:
    """Mean without the floor(share n) least and greatest values: the buckets between the two ranks are summed whole, those that hold a rank in part. rows is read twice."""
    cut = F.floor(F.col("total") * share)
    low, high = cut, F.col("total") - cut
    kept = _bucketed(rows, by, value)
    placed = _placed(kept, by, [low, high - 1])
    inside = placed.where(~F.col("holds") & (F.col("first") >= low) & (F.col("first") < high)).select(*by, "s", "total")
    taken = F.greatest(F.least("end", high) - F.greatest("start", low), F.lit(0))
    # a value with nothing taken adds nothing, even if it is infinite
    part = _ranked(kept, placed, by).select(*by, F.when(taken > 0, F.col("v") * taken).otherwise(0.0).alias("s"), "total")
    whole = inside.unionByName(part)
    summed = (whole.groupBy(*by) if by else whole).agg(F.sum("s").alias("s"), F.max(F.col("total") - 2 * cut).alias("n"))
    return summed.select(*by, (F.col("s") / F.col("n")).alias("mean"), "n")


def hierarchical_mean(rows: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Equal averages from the finest level up; a level without values is left out of the next."""
    out = rows
    for k in range(len(levels), 0, -1):
        out = out.groupBy(*levels[:k]).agg(F.avg(value).alias(value))
    return out.agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def pooled_and_equal(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    both = F.col(value).isNotNull() & F.col(weight).isNotNull()
    return rows.where(both).groupBy(*by).agg(F.avg(value).alias("record_equal"), F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("amount_weighted"), F.count("*").alias("n"))


def moments(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sums that can be merged: n, sum, sum of squares, and how many lie below a half."""
    v = F.col(value)
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"), F.count_if(v < 0.5).alias("below_half"))


def merged_moments(parts: DataFrame, by: list[str]) -> DataFrame:
    total = parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss", "below_half")])
    mean = F.col("s") / F.col("n")
    return total.select(*by, "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"), "below_half")


def sign_shares(value: Column, tolerance: float) -> list[Column]:
    share = lambda c: F.avg(c.cast("double"))
    return [share(value > tolerance).alias("positive"), share(value < -tolerance).alias("negative"), share(F.abs(value) <= tolerance).alias("near_zero")]


#: Registers of a sketch as a power of two, and the standard error of its estimate.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def distinct_sketches(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by and a sketch of the distinct values of each column: some kilobytes a group that can be stored and merged with those of other shards, days or runs."""
    return rows.groupBy(*by).agg(*[F.hll_sketch_agg(c, F.lit(SKETCH_BITS)).alias(c) for c in columns])


def merged_distinct(sketches: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Estimated numbers of distinct values over all sketches of a group, with a standard error of SKETCH_ERROR."""
    return sketches.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])
