"""Queries over masses and scores: compositions, paired changes, quantiles, bootstrap, strata, windows over two axes, typical cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.operators import ranking, statistics
from turnloom.plans.base import TURNS, query, r6, scored, table, turns
from turnloom.sources.shared import stored


def _rounded(df: DataFrame, keep: tuple[str, ...], digits: int = 4) -> DataFrame:
    return df.select(*[c if c in keep else F.round(c, digits).alias(c) for c in df.columns])


@query("d17_describe", f"WITH {TURNS}, v AS (SELECT split, part, CASE WHEN tax > 0 THEN mass END AS v FROM turns) SELECT split, count(*) AS n_total, count(v) AS n_valid, count(DISTINCT CASE WHEN v IS NOT NULL THEN part END) AS n_clusters, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min, round(max(v), 4) AS max, round(quantile_cont(v, 0.1), 4) AS p10, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75, round(quantile_cont(v, 0.9), 4) AS p90 FROM v GROUP BY split")
def d17_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(turns(spark, sf_dir).select("split", "part", F.when(F.col("tax") > 0, F.col("mass")).alias("v")), "masses")
    return _rounded(statistics.describe(rows, ["split"], "v", "part"), ("split", "n_total", "n_valid", "n_clusters"))


_HASH = "CAST('0x' || substr(md5({0}), 1, 13) AS BIGINT)"
#: Workers in buckets of at most sixteen; draws dealt to buckets, then to workers of a bucket.
_DRAWS = f""", clusters AS (SELECT DISTINCT worker FROM turns), numbered AS (SELECT worker, row_number() OVER (ORDER BY md5(CAST(worker AS VARCHAR)), worker) - 1 AS k FROM clusters), n AS (SELECT count(*) AS n, (count(*) + 15) // 16 AS b FROM clusters),
bucketed AS (SELECT worker, bucket, row_number() OVER (PARTITION BY bucket ORDER BY k) - 1 AS place, count(*) OVER (PARTITION BY bucket) AS size FROM (SELECT worker, k, k * b // n AS bucket FROM numbered, n)),
given AS (SELECT rep, h % n * b // n AS bucket, count(*) AS m FROM (SELECT rep, n, b, {_HASH.format("'42|' || rep || '|' || slot")} AS h FROM (SELECT unnest(range(2000)) AS rep) CROSS JOIN (SELECT n, b, unnest(range(n)) AS slot FROM n)) GROUP BY ALL),
hits AS (SELECT rep, bucket, {_HASH.format("'42|' || rep || '|' || bucket || '|' || i")} % size AS place FROM (SELECT rep, bucket, unnest(range(m)) AS i FROM given) JOIN (SELECT DISTINCT bucket, size FROM bucketed) USING (bucket)),
drawn AS (SELECT rep, worker, count(*) AS weight FROM hits JOIN bucketed USING (bucket, place) GROUP BY ALL)"""


@query("d18_bootstrap_interval", f"WITH {TURNS}{_DRAWS}, sums AS (SELECT worker, sum(tax) AS s, count(*) AS c FROM turns GROUP BY worker), reps AS (SELECT rep, sum(s * weight) / sum(c * weight) AS r FROM sums JOIN drawn USING (worker) GROUP BY rep) SELECT round(quantile_cont(r, 0.025), 6) AS ci_low, round(quantile_cont(r, 0.975), 6) AS ci_high FROM reps")
def d18_bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(turns(spark, sf_dir).select("worker", "tax"), "measures")
    return _rounded(statistics.split_bootstrap(rows, [], "tax", "worker", 2000, 42, bucket_size=16), (), 6)


@query("d19_shared_draws", f"WITH {TURNS}{_DRAWS}, long AS (SELECT worker, metric, v FROM (SELECT worker, unnest(['tax', 'discount', 'quantity']) AS metric, unnest([tax, discount, quantity]) AS v FROM turns)), sums AS (SELECT metric, worker, sum(v) AS s, count(*) AS c FROM long GROUP BY ALL), reps AS (SELECT metric, rep, sum(s * weight) / sum(c * weight) AS r FROM sums JOIN drawn USING (worker) GROUP BY ALL) SELECT metric, round(quantile_cont(r, 0.025), 6) AS ci_low, round(quantile_cont(r, 0.975), 6) AS ci_high FROM reps GROUP BY metric")
def d19_shared_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select("worker", "tax", "discount", "quantity")
    long = stored(rows.unpivot(["worker"], ["tax", "discount", "quantity"], "metric", "v"), "measures")
    return _rounded(statistics.split_bootstrap(long, ["metric"], "v", "worker", 2000, 42, bucket_size=16), ("metric",), 6)


@query("d20_trimmed_mean", f"WITH {TURNS}, r AS (SELECT split, mass, row_number() OVER (PARTITION BY split ORDER BY mass) AS k, count(*) OVER (PARTITION BY split) AS n FROM turns) SELECT split, round(avg(mass), 4) AS mean, count(*) AS n FROM r WHERE k > floor(n * 0.05) AND k <= n - floor(n * 0.05) GROUP BY split")
def d20_trimmed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(statistics.trimmed_mean(stored(turns(spark, sf_dir).select("split", "mass"), "masses"), ["split"], "mass"), ("split", "n"))


@query("d21_hierarchical_mean", f"WITH {TURNS}, a AS (SELECT split, session, turn, avg(CASE WHEN tax > 2 THEN mass END) AS v FROM turns GROUP BY ALL), b AS (SELECT split, session, avg(v) AS v FROM a GROUP BY ALL), c AS (SELECT split, avg(v) AS v FROM b GROUP BY split) SELECT round(avg(v), 4) AS mean, count(v) AS n FROM c")
def d21_hierarchical_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).withColumn("v", F.when(F.col("tax") > 2, F.col("mass")))
    return _rounded(statistics.hierarchical_mean(rows, ["split", "session", "turn"], "v"), ("n",))


@query("d22_pooled_and_equal", f"WITH {TURNS} SELECT task, round(avg(discount), 6) AS record_equal, round(sum(discount * mass) / sum(mass), 6) AS amount_weighted, count(*) AS n FROM turns WHERE discount > 0 GROUP BY task")
def d22_pooled_and_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).withColumn("v", F.when(F.col("discount") > 0, F.col("discount")))
    return _rounded(statistics.pooled_and_equal(rows, ["task"], "v", "mass"), ("task", "n"), 6)


@query("d23_composition", f"WITH {TURNS}, w AS (SELECT session, task, sum(mass) AS mass, count(*) AS n FROM turns GROUP BY ALL), t AS (SELECT *, sum(mass) OVER (PARTITION BY session) AS all_mass, sum(n) OVER (PARTITION BY session) AS all_n FROM w) SELECT session, task, round(mass / all_mass, 6) AS share, round(mass / n, 4) AS density, round((mass / all_mass) / (n / all_n), 6) AS enrichment FROM t")
def d23_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("session")
    groups = turns(spark, sf_dir).groupBy("session", "task").agg(F.sum("mass").alias("mass"), F.count("*").alias("n"))
    share = F.col("mass") / F.sum("mass").over(own)
    return groups.select("session", "task", r6(share).alias("share"), F.round(F.col("mass") / F.col("n"), 4).alias("density"), r6(share / (F.col("n") / F.sum("n").over(own))).alias("enrichment"))


@query("d24_combined_density", f"WITH {TURNS} SELECT session, round(sum(mass) / sum(quantity), 9) AS combined, round(avg(mass / quantity), 9) AS mean_of_densities FROM turns GROUP BY session")
def d24_combined_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a session stand for encodings of one object."""
    return turns(spark, sf_dir).groupBy("session").agg(F.round(F.sum("mass") / F.sum("quantity"), 9).alias("combined"), F.round(F.avg(F.col("mass") / F.col("quantity")), 9).alias("mean_of_densities"))


_CATEGORY = "CASE WHEN turn = 1 THEN 'first' WHEN task IN ('AF', 'RF') THEN 'returned' WHEN turn >= 4 THEN 'late' ELSE 'middle' END"


@query("d25_category_rollup", f"WITH {TURNS}, c AS (SELECT session, {_CATEGORY} AS category, task, mass FROM turns) SELECT coalesce(category, 'all') AS category, coalesce(task, 'all') AS modality, round(sum(mass), 2) AS mass, count(*) AS n FROM c GROUP BY GROUPING SETS ((category), (category, task), ())")
def d25_category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.when(F.col("turn") == 1, "first").when(F.col("task").isin("AF", "RF"), "returned").when(F.col("turn") >= 4, "late").otherwise("middle")
    grouped = turns(spark, sf_dir).withColumn("category", category).groupingSets([["category"], ["category", "task"], []], "category", "task")
    return grouped.agg(F.round(F.sum("mass"), 2).alias("mass"), F.count("*").alias("n")).select(F.coalesce("category", F.lit("all")).alias("category"), F.coalesce("task", F.lit("all")).alias("modality"), "mass", "n")


_CHANGES = ", changes AS (SELECT a.session, a.turn AS from_turn, b.turn AS to_turn, b.mass - a.mass AS change, b.quantity - a.quantity AS tokens FROM turns a JOIN turns b ON a.session = b.session JOIN (VALUES (1, 2), (2, 3), (1, 3)) AS p(x, y) ON a.turn = x AND b.turn = y)"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's values at two turns. A session's first turns become columns in one aggregation, and the pairs of turns are taken from these; nothing is joined."""
    at = lambda k: F.max(F.when(F.col("turn") == k, F.struct("mass", "quantity"))).alias(f"t{k}")
    own = turns(spark, sf_dir).where("turn <= 3").groupBy("session").agg(*map(at, (1, 2, 3)))
    pair = lambda a, b: F.struct(F.lit(a).alias("from_turn"), F.lit(b).alias("to_turn"), F.col(f"t{a}").alias("a"), F.col(f"t{b}").alias("b"))
    both = F.filter(F.array(pair(1, 2), pair(2, 3), pair(1, 3)), lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    each = own.select("session", F.explode(both).alias("p"))
    return each.select("session", "p.from_turn", "p.to_turn", (F.col("p.b.mass") - F.col("p.a.mass")).alias("change"), (F.col("p.b.quantity") - F.col("p.a.quantity")).alias("tokens"))


@query("c5_turn_pairs", f"WITH {TURNS}{_CHANGES} SELECT session, from_turn, to_turn, round(change, 2) AS change, tokens FROM changes")
def c5_turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("session", F.col("from_turn").cast("int"), F.col("to_turn").cast("int"), F.round("change", 2).alias("change"), "tokens")


@query("d26_sign_shares", f"WITH {TURNS}{_CHANGES} SELECT from_turn, to_turn, round(avg(CAST(change > 100 AS INT)), 6) AS positive, round(avg(CAST(change < -100 AS INT)), 6) AS negative, round(avg(CAST(abs(change) <= 100 AS INT)), 6) AS near_zero FROM changes GROUP BY ALL")
def d26_sign_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = _changes(spark, sf_dir).groupBy(F.col("from_turn").cast("int").alias("from_turn"), F.col("to_turn").cast("int").alias("to_turn")).agg(*statistics.sign_shares(F.col("change"), 100.0))
    return _rounded(shares, ("from_turn", "to_turn"), 6)


@query("c6_older_newer_pairs", f"WITH {TURNS} SELECT a.session, a.task, count(*) AS pairs, round(avg(b.mass / a.mass), 6) AS ratio FROM turns a JOIN turns b ON a.session = b.session AND a.task = b.task AND a.turn < b.turn GROUP BY ALL")
def c6_older_newer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio of each pair is taken before averaging; a session is short by contract, so pairs stay within it."""
    own = turns(spark, sf_dir).select("session", "task", "turn", "mass")
    newer = own.select("session", "task", F.col("turn").alias("newer_turn"), F.col("mass").alias("newer_mass"))
    joined = own.join(newer, ["session", "task"]).where("turn < newer_turn")
    return joined.groupBy("session", "task").agg(F.count("*").alias("pairs"), r6(F.avg(F.col("newer_mass") / F.col("mass"))).alias("ratio"))


@query("d27_moments", f"WITH {TURNS} SELECT worker, count(discount) AS n, round(avg(discount / 10.0e0), 6) AS mean, round(stddev_pop(discount / 10.0e0), 6) AS std, count(*) FILTER (WHERE discount / 10.0e0 < 0.5) AS below_half FROM turns GROUP BY worker")
def d27_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).withColumn("v", F.col("discount") / 10.0)
    return _rounded(statistics.merged_moments(statistics.moments(rows, ["worker"], "v"), ["worker"]), ("worker", "n", "below_half"), 6)


@query("d28_shard_merge", f"WITH {TURNS} SELECT task, count(mass) AS n, round(avg(mass), 4) AS mean, round(stddev_pop(mass), 3) AS std, CAST(count(*) FILTER (WHERE mass < 0.5) AS BIGINT) AS below_half FROM turns GROUP BY task")
def d28_shard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of four shards are merged; the SQL does one pass."""
    parts = statistics.moments(turns(spark, sf_dir).withColumn("shard", F.col("session") % 4), ["shard", "task"], "mass")
    merged = statistics.merged_moments(parts, ["task"])
    return merged.select("task", "n", F.round("mean", 4).alias("mean"), F.round("std", 3).alias("std"), "below_half")


@query("d29_correlation", f"WITH {TURNS}, s AS (SELECT session, avg(CASE WHEN discount > 2 THEN discount END) AS a, avg(CASE WHEN tax > 1 THEN tax END) AS b FROM turns GROUP BY session) SELECT count(*) AS n, round(corr(a, b), 6) AS r FROM s WHERE a IS NOT NULL AND b IS NOT NULL")
def d29_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = turns(spark, sf_dir).groupBy("session").agg(F.avg(F.when(F.col("discount") > 2, F.col("discount"))).alias("a"), F.avg(F.when(F.col("tax") > 1, F.col("tax"))).alias("b"))
    return s.where("a is not null and b is not null").agg(F.count("*").alias("n"), r6(F.corr("a", "b")).alias("r"))


@query("d32_audit_maxima", f"WITH {TURNS} SELECT split, round(max(mass), 4) AS peak, max(abs(discount - tax)) AS max_error, CAST(sum(quantity) AS BIGINT) AS bytes FROM turns GROUP BY split")
def d32_audit_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).groupBy("split").agg(F.round(F.max("mass"), 4).alias("peak"), F.max(F.abs(F.col("discount") - F.col("tax"))).alias("max_error"), F.sum("quantity").alias("bytes"))


@query("d34_terciles", f"WITH {TURNS}, s AS (SELECT session, sum(quantity) AS len, avg(mass) AS v FROM turns GROUP BY session), q AS (SELECT quantile_cont(len, 1 / 3.0e0) AS a, quantile_cont(len, 2 / 3.0e0) AS b FROM s) SELECT CASE WHEN len <= a THEN 'short' WHEN len <= b THEN 'medium' ELSE 'long' END AS stratum, count(*) AS n, round(avg(v), 4) AS mean FROM s, q GROUP BY stratum")
def d34_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(turns(spark, sf_dir).groupBy("session").agg(F.sum("quantity").alias("len"), F.avg("mass").alias("v")), "lengths")
    # one row
    cuts = statistics.quantiles(s, [], "len", [1 / 3, 2 / 3])
    stratum = F.when(F.col("len") <= F.col("q")[0], "short").when(F.col("len") <= F.col("q")[1], "medium").otherwise("long")
    return s.crossJoin(F.broadcast(cuts)).groupBy(stratum.alias("stratum")).agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"))


@query("d35_coverage_classes", f"WITH {TURNS} SELECT task, round(avg(CAST(discount < tax - 1 AS INT)), 6) AS lower, round(avg(CAST(abs(discount - tax) <= 1 AS INT)), 6) AS near, round(avg(CAST(discount > tax + 1 AS INT)), 6) AS higher FROM turns GROUP BY task")
def d35_coverage_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("discount") - F.col("tax")
    share = lambda c, name: r6(F.avg(c.cast("double"))).alias(name)
    return turns(spark, sf_dir).groupBy("task").agg(share(gap < -1, "lower"), share(F.abs(gap) <= 1, "near"), share(gap > 1, "higher"))


@query("e10_hash_sample", f"WITH {TURNS}, s AS (SELECT DISTINCT split, session FROM turns), r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sha256(CAST(session AS VARCHAR))) AS rank FROM s) SELECT * FROM r WHERE rank <= 20")
def e10_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.hash_sample(turns(spark, sf_dir).select("split", "session").distinct(), ["split"], F.col("session"), 20)


@query("e11_seeded_sample", f"WITH {TURNS}, s AS (SELECT DISTINCT split, session FROM turns), r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sha256('7|' || session)) AS rank FROM s) SELECT * FROM r WHERE rank <= 10")
def e11_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.hash_sample(turns(spark, sf_dir).select("split", "session").distinct(), ["split"], F.col("session"), 10, seed="7|")


@query("e12_first_middle_last", f"WITH {TURNS}, s AS (SELECT DISTINCT worker, session FROM turns), r AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY session) AS k, count(*) OVER (PARTITION BY worker) AS n FROM s) SELECT worker, session, k FROM r WHERE k IN (1, n // 2 + 1, n)")
def e12_first_middle_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("worker")
    ranked = turns(spark, sf_dir).select("worker", "session").distinct().select("worker", "session", F.row_number().over(own.orderBy("session")).cast("long").alias("k"), F.count("*").over(own).alias("n"))
    return ranked.where((F.col("k") == 1) | (F.col("k") == F.floor(F.col("n") / 2) + 1) | (F.col("k") == F.col("n"))).select("worker", "session", "k")


@query("e13_session_shards", f"WITH {TURNS}, s AS (SELECT split, session, count(*) AS n FROM turns GROUP BY ALL), r AS (SELECT *, (row_number() OVER (PARTITION BY split ORDER BY session) - 1) % 4 AS shard FROM s) SELECT split, shard, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS turns FROM r GROUP BY ALL")
def e13_session_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sessions dealt in turn to four shards of each split, and how even they are."""
    s = turns(spark, sf_dir).groupBy("split", "session").agg(F.count("*").alias("n"))
    dealt = ranking.global_rank(s, ["split"], ["session"]).withColumn("shard", (F.col("rank") - 1) % 4)
    return dealt.groupBy("split", "shard").agg(F.count("*").alias("sessions"), F.sum("n").alias("turns"))


@query("e14_cluster_halves", "WITH c AS (SELECT DISTINCT md5(text) AS cluster FROM documents), r AS (SELECT cluster, row_number() OVER (ORDER BY sha256('42|' || cluster)) AS k, count(*) OVER () AS n FROM c) SELECT doc_id, cluster, CASE WHEN k <= n // 2 THEN 'discovery' ELSE 'confirmation' END AS split FROM documents d JOIN r ON md5(d.text) = r.cluster")
def e14_cluster_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("cluster"))
    return docs.join(ranking.halves(docs, "cluster", "42|"), "cluster").select("doc_id", "cluster", "split")


_GRID = ", grid AS (SELECT session, split, worker % 12 AS step, part % 10 AS layer, discount / 10.0e0 AS value FROM turns), halves AS (SELECT *, CASE WHEN session % 3 = 0 THEN 'discovery' ELSE 'confirmation' END AS half FROM grid), dealt AS (SELECT half, step0, layer0, value FROM halves JOIN (SELECT unnest(range(10)) AS step0) ON step BETWEEN step0 AND step0 + 2 JOIN (SELECT unnest(range(7)) AS layer0) ON layer BETWEEN layer0 AND layer0 + 3), means AS (SELECT half, step0, layer0, avg(value) AS mean, count(value) AS n FROM dealt GROUP BY ALL), best AS (SELECT step0, layer0 FROM means WHERE half = 'discovery' ORDER BY round(mean, 12) DESC, step0 DESC, layer0 DESC LIMIT 1)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.when(F.col("session") % 3 == 0, "discovery").otherwise("confirmation")
    return turns(spark, sf_dir).select("session", half.alias("half"), (F.col("worker") % 12).cast("int").alias("step"), (F.col("part") % 10).cast("int").alias("layer"), (F.col("discount") / 10.0).alias("value"))


def _window_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.window_means(_grid(spark, sf_dir), ["half"], 3, 4, 12, 10)


@query("e16_sliding_windows", f"WITH {TURNS}{_GRID} SELECT half, CAST(step0 AS INT) AS step0, CAST(layer0 AS INT) AS layer0, round(mean, 6) AS mean, n FROM means")
def e16_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_means(spark, sf_dir).withColumn("mean", r6("mean"))


@query(
    "e17_frozen_window",
    f"""WITH {TURNS}{_GRID}, inside AS (SELECT session, half, value, step0, layer0 FROM halves JOIN best ON step BETWEEN step0 AND step0 + 2 AND layer BETWEEN layer0 AND layer0 + 3),
each AS (SELECT * FROM inside UNION ALL SELECT session, 'all', value, step0, layer0 FROM inside)
SELECT half, CAST(step0 AS INT) AS step0, CAST(layer0 AS INT) AS layer0, round(avg(value), 6) AS mean, count(value) AS n, count(DISTINCT session) AS n_sessions, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(median(value), 6) AS p50 FROM each GROUP BY ALL""",
)
def e17_frozen_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of the discovery half, the larger origin winning a tie, is evaluated on each half and on all."""
    grid = stored(_grid(spark, sf_dir), "grid")
    means = ranking.window_means(grid, ["half"], 3, 4, 12, 10)
    # one row
    best = means.where("half = 'discovery'").orderBy(F.desc(F.round("mean", 12)), F.desc("step0"), F.desc("layer0")).limit(1).select("step0", "layer0")
    inside = grid.join(F.broadcast(best), F.col("step").between(F.col("step0"), F.col("step0") + 2) & F.col("layer").between(F.col("layer0"), F.col("layer0") + 3))
    each = stored(inside.withColumn("half", F.explode(F.array("half", F.lit("all")))).select("half", "step0", "layer0", "session", "value"), "window-cells")
    out = statistics.describe(each, ["half", "step0", "layer0"], "value", "session")
    return out.select("half", "step0", "layer0", r6("mean").alias("mean"), F.col("n_valid").alias("n"), F.col("n_clusters").alias("n_sessions"), *[r6(c).alias(c) for c in ("std", "min", "max", "p50")])


_EVALUATED = f"""{_GRID.replace("SELECT session, split,", "SELECT session, worker, mass, split,")}, inside AS (SELECT session, worker, mass, half, value FROM halves JOIN best ON step BETWEEN step0 AND step0 + 2 AND layer BETWEEN layer0 AND layer0 + 3),
each AS (SELECT * FROM inside UNION ALL SELECT session, worker, mass, 'all', value FROM inside)"""


@query(
    "e17_window_evaluation",
    f"""WITH {TURNS}{_EVALUATED}{_DRAWS}, sums AS (SELECT half, worker, sum(value) AS s, count(value) AS c FROM each GROUP BY ALL),
reps AS (SELECT half, rep, sum(s * weight) / sum(c * weight) AS r FROM sums JOIN drawn USING (worker) GROUP BY ALL), ends AS (SELECT half, quantile_cont(r, 0.025) AS a, quantile_cont(r, 0.975) AS b FROM reps GROUP BY half)
SELECT half, count(value) AS n, count(DISTINCT worker) AS n_clusters, round(avg(value), 6) AS mean, round(any_value(a), 6) AS ci_low, round(any_value(b), 6) AS ci_high, round(sum(value * mass) / sum(mass), 6) AS pooled,
round(avg(value) FILTER (WHERE mass > 20000), 6) AS sensitivity_mean, round(avg(CAST(value - 0.05 < -0.01 AS INT)), 6) AS lower, round(avg(CAST(abs(value - 0.05) <= 0.01 AS INT)), 6) AS near, round(avg(CAST(value - 0.05 > 0.01 AS INT)), 6) AS higher
FROM each JOIN ends USING (half) GROUP BY half""",
)
def e17_window_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frozen window on each half and on all: mean with the interval of a cluster bootstrap, ratio pooled by mass, mean over rows of enough mass, and how the values lie to a reference."""
    half = F.when(F.col("session") % 3 == 0, "discovery").otherwise("confirmation")
    measured = turns(spark, sf_dir).select("session", "worker", "mass", half.alias("half"), (F.col("worker") % 12).cast("int").alias("step"), (F.col("part") % 10).cast("int").alias("layer"), (F.col("discount") / 10.0).alias("value"))
    rows = stored(measured, "grid")
    windows = ranking.frozen_windows(ranking.window_means(rows, ["half"], 3, 4, 12, 10).where("half = 'discovery'"), 3, 4)
    inside = stored(ranking.inside_windows(rows, windows).withColumn("half", F.explode(F.array("half", F.lit("all")))).select("half", "worker", "value", "mass"), "window-cells")
    # draws are of all workers, also of those without a row in the window
    every = rows.select(F.lit(None).cast("string").alias("half"), "worker", F.lit(None).cast("double").alias("value")).distinct()
    ends = statistics.split_bootstrap(inside.select("half", "worker", "value").unionByName(every), ["half"], "value", "worker", 2000, 42, bucket_size=16)
    value, off = F.col("value"), F.col("value") - 0.05
    share = lambda c: F.avg(c.cast("double"))
    out = inside.groupBy("half").agg(
        F.count("value").alias("n"), F.count_distinct("worker").alias("n_clusters"), F.avg("value").alias("mean"), (F.sum(value * F.col("mass")) / F.sum("mass")).alias("pooled"), F.avg(F.when(F.col("mass") > 20000, value)).alias("sensitivity_mean"),
        share(off < -0.01).alias("lower"), share(F.abs(off) <= 0.01).alias("near"), share(off > 0.01).alias("higher"),
    )
    return _rounded(out.join(ends, "half"), ("half", "n", "n_clusters"), 6)


@query("e18_cases", f"WITH {TURNS}, s AS (SELECT split, session, avg(mass) AS v FROM turns GROUP BY ALL), m AS (SELECT split, median(v) AS m FROM s GROUP BY split), r AS (SELECT s.*, row_number() OVER (PARTITION BY split ORDER BY round(abs(v - m), 6), session) AS typical, row_number() OVER (PARTITION BY split ORDER BY v DESC, session) AS strong, row_number() OVER (PARTITION BY split ORDER BY CASE WHEN v < m THEN 0 ELSE 1 END, v, session) AS opposite FROM s JOIN m USING (split)) SELECT split, 'typical' AS kind, session FROM r WHERE typical = 1 UNION ALL SELECT split, 'strong', session FROM r WHERE strong = 1 UNION ALL SELECT split, 'opposite', session FROM r WHERE opposite = 1")
def e18_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each split the session nearest its median, the strongest, and the lowest under the median."""
    s = stored(turns(spark, sf_dir).groupBy("split", "session").agg(F.avg("mass").alias("v")), "session-means")
    s = s.join(statistics.quantiles(s, ["split"], "v", [0.5]).select("split", F.col("q")[0].alias("m")), "split")
    case = lambda name, *order: F.min_by("session", F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])).alias(name)
    picked = s.groupBy("split").agg(
        case("typical", F.round(F.abs(F.col("v") - F.col("m")), 6), F.col("session")), case("strong", -F.col("v"), F.col("session")), case("opposite", F.when(F.col("v") < F.col("m"), 0).otherwise(1), F.col("v"), F.col("session"))
    )
    return picked.unpivot(["split"], ["typical", "strong", "opposite"], "kind", "session")


@query("e19_top_contributors", f"WITH {TURNS}, s AS (SELECT split, session, sum(mass) AS m, sum(mass * discount) AS w FROM turns GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY m DESC, session) AS k FROM s) SELECT split, round(sum(m) FILTER (WHERE k <= 10) / sum(m), 6) AS top_share, round(sum(w) / sum(m), 6) AS pooled, round(sum(w) FILTER (WHERE k > 10) / sum(m) FILTER (WHERE k > 10), 6) AS pooled_without FROM r GROUP BY split")
def e19_top_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = turns(spark, sf_dir).groupBy("split", "session").agg(F.sum("mass").alias("m"), F.sum(F.col("mass") * F.col("discount")).alias("w"))
    top = s.withColumn("k", F.row_number().over(Window.partitionBy("split").orderBy(F.desc("m"), "session"))).where("k <= 10").groupBy("split").agg(F.sum("m").alias("tm"), F.sum("w").alias("tw"))
    whole = s.groupBy("split").agg(F.sum("m").alias("m"), F.sum("w").alias("w")).join(F.broadcast(top), "split")
    return whole.select("split", r6(F.col("tm") / F.col("m")).alias("top_share"), r6(F.col("w") / F.col("m")).alias("pooled"), r6((F.col("w") - F.col("tw")) / (F.col("m") - F.col("tm"))).alias("pooled_without"))


@query("e21_decreasing_check", f"WITH {TURNS}, l AS (SELECT session, mass - lag(mass) OVER (PARTITION BY session ORDER BY turn) AS step FROM turns) SELECT session, bool_and(coalesce(step < 0, true)) AS strictly_decreasing FROM l GROUP BY session")
def e21_decreasing_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.col("mass") - F.lag("mass").over(Window.partitionBy("session").orderBy("turn"))
    return turns(spark, sf_dir).select("session", step.alias("step")).groupBy("session").agg(F.bool_and(F.coalesce(F.col("step") < 0, F.lit(True))).alias("strictly_decreasing"))


@query("e22_ordered_export", f"WITH {TURNS} SELECT session, turn, task FROM turns ORDER BY session, turn")
def e22_ordered_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("session", "turn", "task").orderBy("session", "turn")


@query("e23_strongest_fixed", f"WITH {TURNS}, g AS (SELECT split, worker, avg(mass) AS v FROM turns GROUP BY ALL) SELECT split, arg_max(worker, struct_pack(v := v, w := worker)) AS worker, round(max(v), 4) AS mean FROM g GROUP BY split")
def e23_strongest_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = turns(spark, sf_dir).groupBy("split", "worker").agg(F.avg("mass").alias("v"))
    return g.groupBy("split").agg(F.max_by("worker", F.struct("v", "worker")).alias("worker"), F.round(F.max("v"), 4).alias("mean"))


@query("e25_most_typical", f"WITH {TURNS}, s AS (SELECT session, avg(mass) AS a, avg(discount) AS b FROM turns GROUP BY session), q AS (SELECT median(a) AS ma, median(b) AS mb, quantile_cont(a, 0.75) - quantile_cont(a, 0.25) AS ia, quantile_cont(b, 0.75) - quantile_cont(b, 0.25) AS ib FROM s) SELECT session, round((abs(a - ma) / CASE WHEN ia = 0 THEN 1 ELSE ia END + abs(b - mb) / CASE WHEN ib = 0 THEN 1 ELSE ib END) / 2, 6) AS score FROM s, q ORDER BY score, session LIMIT 1")
def e25_most_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(turns(spark, sf_dir).groupBy("session").agg(F.avg("mass").alias("a"), F.avg("discount").alias("b")), "session-means")
    # one row
    qa, qb = (statistics.quantiles(s, [], c, [0.25, 0.5, 0.75]).withColumnRenamed("q", f"q{c}") for c in ("a", "b"))
    q = qa.crossJoin(qb)
    off = lambda v, qs: F.abs(F.col(v) - F.col(qs)[1]) / F.when(F.col(qs)[2] == F.col(qs)[0], 1.0).otherwise(F.col(qs)[2] - F.col(qs)[0])
    return s.crossJoin(F.broadcast(q)).select("session", r6((off("a", "qa") + off("b", "qb")) / 2).alias("score")).orderBy("score", "session").limit(1)


_NEW = "len(list_filter(s.tasks, lambda t: NOT list_contains(c.covered, t)))"
_THEN = "UNION ALL (SELECT session FROM items WHERE p[{k}] AND NOT EXISTS (SELECT 1 FROM c{b} JOIN items USING (session) WHERE p[{k}]) ORDER BY h LIMIT 1)"


@query(
    "e15_greedy_cover",
    f"""WITH RECURSIVE {TURNS}, items AS (SELECT session, list_sort(list(DISTINCT task)) AS tasks, [any_value(split) = 'cm', any_value(split) = 'cu', bool_or(status = 'response_incomplete'), bool_or(tax = 0)] AS p, sha256(CAST(session AS VARCHAR)) AS h FROM scored GROUP BY session),
sets AS (SELECT tasks, min(struct_pack(h := h, session := session)) AS least FROM items GROUP BY tasks),
chosen AS (SELECT 0 AS step, CAST([] AS VARCHAR[]) AS covered, CAST(NULL AS BIGINT) AS session UNION ALL
SELECT step + 1, list_distinct(list_concat(covered, tasks)), least.session FROM (SELECT c.step, c.covered, s.tasks, s.least, {_NEW} AS new, row_number() OVER (ORDER BY {_NEW} DESC, s.least.h) AS k FROM chosen c CROSS JOIN sets s) WHERE k = 1 AND new > 0),
c0 AS (SELECT session FROM chosen WHERE step > 0), """
    + ", ".join(f"c{k} AS (SELECT session FROM c{k - 1} {_THEN.format(k=k, b=k - 1)})" for k in (1, 2, 3, 4))
    + " SELECT session, array_to_string(tasks, ',') AS tasks FROM c4 JOIN items USING (session)",
)
def e15_greedy_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that cover the tasks, each adding most that is new; then one of each split, one with an incomplete answer and one with an empty measure, if there is none yet."""
    items = scored(spark, sf_dir).groupBy("session").agg(F.collect_set("task").alias("tasks"), F.first("split").alias("split"), F.bool_or(F.col("status") == "response_incomplete").alias("incomplete"), F.bool_or(F.col("tax") == 0).alias("empty"))
    items = stored(items, "session-tags")
    chosen = ranking.greedy_cover(items, "session", "tasks", [F.col("split") == "cm", F.col("split") == "cu", F.col("incomplete"), F.col("empty")])
    return items.where(F.col("session").isin(*chosen)).select("session", F.array_join(F.array_sort("tasks"), ",").alias("tasks"))


@query("b22_structural_presence", f"WITH {TURNS}, axis AS (SELECT DISTINCT task FROM turns), s AS (SELECT DISTINCT session FROM turns), g AS (SELECT session, task, count(*) AS n, min(turn) AS first FROM turns GROUP BY ALL) SELECT session, task, n IS NOT NULL AS present, CASE WHEN n IS NULL THEN 'structural_zero' WHEN first > 1 THEN 'not_yet_present' END AS null_reason FROM s CROSS JOIN axis LEFT JOIN g USING (session, task)")
def b22_structural_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir)
    counted = rows.groupBy("session", "task").agg(F.count("*").alias("n"), F.min("turn").alias("first"))
    # the axis is a small closed set by contract, so each session holds it as an array
    axis = rows.select("task").distinct().agg(F.collect_set("task").alias("axis"))
    grid = rows.select("session").distinct().crossJoin(F.broadcast(axis)).select("session", F.explode("axis").alias("task"))
    joined = grid.join(counted, ["session", "task"], "left")
    return joined.select("session", "task", F.col("n").isNotNull().alias("present"), F.when(F.col("n").isNull(), "structural_zero").when(F.col("first") > 1, "not_yet_present").alias("null_reason"))


@query("c12_completed_grid", f"WITH {TURNS}, g AS (SELECT * FROM (SELECT DISTINCT session FROM turns) CROSS JOIN (VALUES (1), (2), (3)) AS t(turn)) SELECT g.session, CAST(g.turn AS BIGINT) AS turn, t.mass IS NULL AS missing FROM g LEFT JOIN turns t ON g.session = t.session AND g.turn = t.turn")
def c12_completed_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir)
    grid = rows.select("session").distinct().withColumn("turn", F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)])))
    return grid.join(rows.select("session", "turn", "mass"), ["session", "turn"], "left").select("session", "turn", F.col("mass").isNull().alias("missing"))
