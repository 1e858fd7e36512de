"""Column functions over non-negative support vectors (array<double>): everything is evaluated at each position, before any averaging."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW_MASS = 1e-6
N90_TOLERANCE = 1e-12


def total(x: Column | str) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def entropy(p: Column | str) -> Column:
    """In nats; a share of 0 adds nothing."""
    return F.aggregate(p, F.lit(0.0), lambda a, v: a - F.when(v > 0, v * F.log(v)).otherwise(0.0))


def with_shares(df: DataFrame, x: str = "x") -> DataFrame:
    """Adds m (mass), p (shares; zeros where there is no mass) and q (shares, largest first)."""
    massed = df.withColumn("m", total(x))
    shared = massed.withColumn("p", F.when(F.col("m") > 0, F.transform(x, lambda v: v / F.col("m"))).otherwise(F.transform(x, lambda v: v * 0.0)))
    return shared.withColumn("q", F.sort_array("p", asc=False))


def top_share(q: Column | str, k: Column | int) -> Column:
    return total(F.slice(q, 1, k))


def n90(q: Column | str) -> Column:
    """Fewest elements, largest first, that hold 90 %."""
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("n"))
    return F.aggregate(q, start, lambda a, v: F.when(a["c"] >= 0.9 - N90_TOLERANCE, a).otherwise(F.struct((a["c"] + v).alias("c"), (a["n"] + 1).alias("n"))))["n"].cast("long")


def concentration(df: DataFrame, x: str = "x") -> DataFrame:
    """Adds the eleven concentration values of each position; all but the mass are null where there is no mass, and the normalised entropy for one element."""
    n = F.size(x)
    base = with_shares(df, x).withColumn("entropy_nats", F.when(F.col("m") > 0, entropy("p")))
    some = lambda c: F.when(F.col("m") > 0, c)
    return base.select(
        *[c for c in df.columns],
        F.col("m").alias("support_mass"),
        "entropy_nats",
        F.when((F.col("m") > 0) & (n > 1), F.col("entropy_nats") / F.log(n.cast("double"))).alias("normalized_entropy"),
        some(F.exp("entropy_nats")).alias("effective_count"),
        some(F.exp("entropy_nats") / n).alias("effective_fraction"),
        some(top_share("q", 1)).alias("top1_share"),
        some(top_share("q", 3)).alias("top3_share"),
        some(top_share("q", 5)).alias("top5_share"),
        some(top_share("q", F.ceil(n * 0.1).cast("int"))).alias("top10pct_share"),
        some(n90("q")).alias("n90"),
        some(n90("q") / n).alias("n90_fraction"),
    )


def total_variation(p: Column | str, q: Column | str) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v) / 2


def jensen_shannon(p: Column | str, q: Column | str) -> Column:
    """In nats."""
    return entropy(F.zip_with(p, q, lambda a, b: (a + b) / 2)) - (entropy(p) + entropy(q)) / 2


def top_places(p: Column | str, k: int | Column) -> Column:
    """Places (from 0) of the k largest, earlier places first among equals."""
    ranked = F.array_sort(F.transform(p, lambda v, i: F.struct((-v).alias("less"), i.alias("place"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["place"])


def top_overlap(p: Column | str, q: Column | str, k: int | Column) -> Column:
    return F.size(F.array_intersect(top_places(p, k), top_places(q, k))) / (k if isinstance(k, Column) else F.lit(float(k)))


def paired_metrics(share: float = 0.1) -> list[Column]:
    """Metrics of one object at two turns, from its masses (m_before, m), shares (p_before, p) and ordered shares (q_before, q): changes of mass, entropy and top share (null where a side has no mass), total variation, divergence and overlap of the places with most."""
    some = (F.col("m_before") > 0) & (F.col("m") > 0)
    # as many places as a tenth of the elements
    k = F.ceil(F.size("p") * share).cast("int")
    change = lambda f, c: F.when(some, f(c) - f(f"{c}_before"))
    return [
        F.col("m_before").alias("mass_before"), F.col("m").alias("mass_after"), (F.col("m") - F.col("m_before")).alias("delta_mass"), change(entropy, "p").alias("delta_entropy"), change(lambda c: top_share(c, k), "q").alias("delta_top10"),
        total_variation("p_before", "p").alias("tv"), jensen_shannon("p_before", "p").alias("js"), top_overlap("p_before", "p", k).alias("top_overlap"),
    ]


def participation(mean: Column, deviation: Column) -> Column:
    return F.try_divide(mean * mean, mean * mean + deviation * deviation)


def argmax_place(x: Column | str) -> Column:
    """Place (from 0) of the first maximum; -1 without mass."""
    return F.when(total(x) > 0, F.array_position(x, F.array_max(x)) - 1).otherwise(F.lit(-1)).cast("long")


def edge_share(p: Column | str, side: int = 8) -> Column:
    """Share of the outer ring of a side x side grid."""
    y, x = (lambda i: F.floor(i / F.lit(side))), (lambda i: i % side)
    return total(F.filter(p, lambda v, i: (y(i) == 0) | (y(i) == side - 1) | (x(i) == 0) | (x(i) == side - 1)))


def cosine(a: Column | str, b: Column | str) -> Column:
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def mean_absolute_difference(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda s, t: F.abs(s - t)), F.lit(0.0), lambda s, t: s + t) / F.size(a)


def grid_cell(y: Column, x: Column, height: Column, width: Column, side: int = 8) -> Column:
    """Cell of a side x side grid in which the centre of patch (y, x) of a height x width grid lies."""
    one = lambda k, n: F.floor((2 * k + 1) * side / (2 * n))
    return (one(y, height) * side + one(x, width)).cast("long")


def log_entropy(x: Column | str, m: Column) -> Column:
    """A second formula of the entropy: ln M - sum(x ln x) / M."""
    return F.log(m) - F.aggregate(x, F.lit(0.0), lambda a, v: a + F.when(v > 0, v * F.log(v)).otherwise(0.0)) / m


MAX_ENTROPY_64 = math.log(64)
