"""Quantiles with infinite values, trimmed means, ranks over ranges, bootstrap by splitting, sketches."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.operators import ranking, statistics

INF, NAN = math.inf, math.nan


@pytest.mark.parametrize(
    ("values", "want"),
    [
        ([1, 2, 3, INF], [1, 2.5, INF]), ([-INF, 1, 2], [-INF, 1, 2]), ([INF, INF, INF], [INF] * 3), ([-INF, -INF, 5], [-INF, -INF, 5]), ([-INF, INF], [-INF, -INF, INF]), ([1, 2, NAN], [1, 2, NAN]), ([INF, NAN, NAN], [INF, NAN, NAN]),
        ([5e-324, 1.7e308, -1.7e308], [-1.7e308, 5e-324, 1.7e308]), ([0.0, -0.0, 0.0], [0, 0, 0]), ([None, 7.0], [7, 7, 7]),
    ],
)
def test_quantiles_of_odd_values(spark, values, want):
    rows = spark.createDataFrame([(v if v is None else float(v),) for v in values], "v double")
    assert statistics.quantiles(rows, [], "v", [0.0, 0.5, 1.0]).first().q == pytest.approx(want, nan_ok=True)


def test_describe_of_infinite_values(spark):
    rows = spark.createDataFrame([("a", 1.0, 1), ("a", INF, 2), ("b", None, 3)], "g string, v double, c long")
    got = {r.g: r for r in statistics.describe(rows, ["g"], "v", "c").collect()}
    assert got["a"].max == INF and got["a"].p10 == INF and got["b"].p50 is None


def test_trimmed_mean_keeps_its_digits(spark):
    """A cut tail of huge or infinite values leaves no trace in the mean."""
    rng = random.Random(2)
    for tail in (1e300, INF, 1e17):
        values = [rng.random() for _ in range(96)] + [-tail, -tail, tail, tail]
        rows = spark.createDataFrame([("x", v) for v in values], "g string, v double")
        got = statistics.trimmed_mean(rows, ["g"], "v", 0.02).first()
        assert got.n == 96 and got["mean"] == pytest.approx(np.mean(sorted(values)[2:-2]), rel=1e-12)


@pytest.mark.parametrize("share", [0.0, 0.05, 0.3, 0.49])
def test_trimmed_mean(spark, share):
    rng = random.Random(7)
    rows = [(g, rng.choice([rng.gauss(0, 100), 3.0, 0.0])) for g in ("a", "b") for _ in range(rng.randrange(5, 300))] + [("one", 4.0)]
    got = {r.g: (r["mean"], r.n) for r in statistics.trimmed_mean(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", share).collect()}
    for g in ("a", "b", "one"):
        own = sorted(v for k, v in rows if k == g)
        cut = math.floor(len(own) * share)
        assert got[g] == (pytest.approx(np.mean(own[cut : len(own) - cut])), len(own) - 2 * cut)


def test_global_rank(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["big"] * 8 + ["small", None]), k, rng.random()) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, v double").repartition(5)
    got = ranking.global_rank(df, ["g"], ["v", "k"], partitions=13)
    assert "Window [row_number" not in got._jdf.queryExecution().executedPlan().toString()
    found = {r.k: r["rank"] for r in got.collect()}
    for g in ("big", "small", None):
        for n, (_, k) in enumerate(sorted((v, k) for h, k, v in rows if h == g), 1):
            assert found[k] == n
    assert len(found) == len(rows) and ranking.global_rank(df.where("k < 0"), ["g"], ["v"]).count() == 0
    assert [r["rank"] for r in ranking.global_rank(df.where("k < 4"), [], ["k"], 3).orderBy("k").collect()] == [1, 2, 3, 4]


def test_split_bootstrap(spark):
    """The draws of a repetition are as many as there are clusters, each as likely, whatever the bucket; the interval is that of draws one by one."""
    sessions = spark.createDataFrame([("s1", "x", 0.0), ("s2", "x", 0.0), ("s3", "y", 1.0)], "session string, cluster string, v double")
    ends = statistics.split_bootstrap(sessions, [], "v", "cluster", 400, 1).first()
    assert (ends.ci_low, ends.ci_high) == (0.0, 1.0)
    rng = np.random.default_rng(4)
    means = rng.normal(10, 3, 200)
    rows = spark.createDataFrame([(k, float(means[k])) for k in range(200)], "cluster long, v double")
    plain = np.percentile([means[rng.integers(0, 200, 200)].mean() for _ in range(4000)], [2.5, 97.5])
    for size in (7, 64, 4096):
        ends = statistics.split_bootstrap(rows, [], "v", "cluster", 1500, 9, bucket_size=size).first()
        assert [ends.ci_low, ends.ci_high] == pytest.approx(plain, abs=0.08)


def test_split_bootstrap_groups(spark):
    """Groups share the draws: a group and its double have doubled ends; a cluster without rows in a group counts as nothing."""
    rows = [(g, k, f * k) for g, f in (("one", 1.0), ("two", 2.0)) for k in range(30)] + [("rare", 3, 5.0), ("none", 4, None)]
    got = {r.g: (r.ci_low, r.ci_high) for r in statistics.split_bootstrap(spark.createDataFrame(rows, "g string, c long, v double"), ["g"], "v", "c", 300, 5, bucket_size=8).collect()}
    assert got["two"] == pytest.approx([2 * x for x in got["one"]]) and got["rare"] == (5.0, 5.0) and got["none"] == (None, None)


def test_split_bootstrap_draws_once(spark):
    """A draw is made once for all groups: one digest for each hit in the plan, joined by bucket alone. A group named null counts like others."""
    rows = spark.createDataFrame([(g, c, float(k)) for g in ("one", None) for k, c in enumerate([1, 2, 3, 4])], "g string, c long, v double")
    got = statistics.split_bootstrap(rows, ["g"], "v", "c", 200, 3, bucket_size=2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (_bucket" in plan and "transform(" not in plan
    ends = {r.g: (r.ci_low, r.ci_high) for r in got.collect()}
    assert ends["one"] == ends[None] and 0 <= ends["one"][0] < 1.5 < ends["one"][1] <= 3
    assert statistics.split_bootstrap(rows.where("c > 9"), ["g"], "v", "c", 10, 3).collect() == []


def test_sketches_merge(spark):
    rows = spark.range(60_000).select(F.col("id").alias("v"), (F.col("id") % 7).alias("shard"), F.lit("g").alias("g")).unionByName(spark.range(30_000).select(F.col("id").alias("v"), F.lit(9).cast("long").alias("shard"), F.lit("g").alias("g")))
    parts = statistics.distinct_sketches(rows, ["shard", "g"], ["v"])
    assert parts.count() == 8
    assert statistics.merged_distinct(parts, ["g"], ["v"]).first().v == pytest.approx(60_000, rel=3 * statistics.SKETCH_ERROR)
