"""Queries over support vectors: concentration, profiles, distances between positions, grids, pooled features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.functions import distributions as d
from turnloom.plans.base import SUPPORTS, query, r6, supports, table

_VALUES = f"""{SUPPORTS}, ordered AS (SELECT *, row_number() OVER w AS k, sum(p) OVER (PARTITION BY position ORDER BY p DESC, cell ROWS UNBOUNDED PRECEDING) AS c FROM shares WINDOW w AS (PARTITION BY position ORDER BY p DESC, cell)
), conc AS (SELECT position, any_value(session) AS session, any_value(step) AS step, any_value(head) AS head, any_value(m) AS support_mass, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS h, sum(p) FILTER (WHERE k <= 1) AS top1_share, sum(p) FILTER (WHERE k <= 3) AS top3_share, sum(p) FILTER (WHERE k <= 5) AS top5_share, sum(p) FILTER (WHERE k <= 7) AS top10pct_share, min(k) FILTER (WHERE c >= 0.9 - 1e-12) AS n90 FROM ordered GROUP BY position)"""
_NAMES = ("support_mass", "entropy_nats", "normalized_entropy", "effective_count", "effective_fraction", "top1_share", "top3_share", "top5_share", "top10pct_share", "n90_fraction")


@query(
    "f1_concentration",
    f"""WITH {_VALUES} SELECT position, round(support_mass, 6) AS support_mass, round(h, 6) AS entropy_nats, round(h / ln(64), 6) AS normalized_entropy, round(exp(h), 6) AS effective_count, round(exp(h) / 64, 6) AS effective_fraction,
round(top1_share, 6) AS top1_share, round(top3_share, 6) AS top3_share, round(top5_share, 6) AS top5_share, round(top10pct_share, 6) AS top10pct_share, n90, round(n90 / 64, 6) AS n90_fraction FROM conc""",
)
def f1_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = d.concentration(supports(spark, sf_dir))
    return values.select("position", *[r6(c).alias(c) for c in _NAMES], "n90")


_SCALED = SUPPORTS.replace("abs(CAST(v AS DOUBLE))", "abs(CAST(v AS DOUBLE)) * CASE vec_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 1e-9 ELSE 1 END")


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = F.when(F.col("position") % 7 == 0, 0.0).when(F.col("position") % 7 == 1, 1e-9).otherwise(1.0)
    return supports(spark, sf_dir).withColumn("factor", factor).withColumn("x", F.transform("x", lambda v: v * F.col("factor"))).drop("factor")


@query(
    "f2_validity",
    f"""WITH {_SCALED}, e AS (SELECT session, position, any_value(m) AS m, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS h FROM shares GROUP BY session, position)
SELECT session, count(*) AS total, count(*) FILTER (WHERE m > 0) AS n_valid, count(*) FILTER (WHERE m > 1e-6) AS sensitivity_n_valid, count(*) FILTER (WHERE m > 0 AND m <= 1e-6) AS low_mass,
round(avg(h) FILTER (WHERE m > 0), 6) AS entropy, round(avg(h) FILTER (WHERE m > 1e-6), 6) AS entropy_sensitivity, CASE WHEN count(*) FILTER (WHERE m > 0) = 0 THEN 'zero_support_mass' END AS null_reason FROM e GROUP BY session""",
)
def f2_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = d.concentration(_scaled(spark, sf_dir))
    mass, low = F.col("support_mass"), (F.col("support_mass") > 0) & (F.col("support_mass") <= d.LOW_MASS)
    return values.groupBy("session").agg(
        F.count("*").alias("total"),
        F.count_if(mass > 0).alias("n_valid"),
        F.count_if(mass > d.LOW_MASS).alias("sensitivity_n_valid"),
        F.count_if(low).alias("low_mass"),
        r6(F.avg("entropy_nats")).alias("entropy"),
        r6(F.avg(F.when(mass > d.LOW_MASS, F.col("entropy_nats")))).alias("entropy_sensitivity"),
        F.when(F.count_if(mass > 0) == 0, "zero_support_mass").alias("null_reason"),
    )


@query("f3_profiles", f"WITH {_SCALED} SELECT session, cell, round(avg(v), 6) AS raw, round(avg(p) FILTER (WHERE m > 0), 6) AS conditional, round(sum(v) / sum(m), 6) AS pooled FROM shares GROUP BY session, cell")
def f3_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = d.with_shares(_scaled(spark, sf_dir)).select("session", "m", F.posexplode(F.arrays_zip("x", "p")).alias("cell", "c"))
    return cells.groupBy("session", F.col("cell").cast("long").alias("cell")).agg(
        r6(F.avg("c.x")).alias("raw"), r6(F.avg(F.when(F.col("m") > 0, F.col("c.p")))).alias("conditional"), r6(F.try_divide(F.sum("c.x"), F.sum("m"))).alias("pooled")
    )


#: Each position with the one before it in its session.
_PAIRS = """, numbered AS (SELECT position, session, row_number() OVER (PARTITION BY session ORDER BY position) AS k FROM supports),
pairs AS (SELECT a.session, a.position AS one, b.position AS two FROM numbered a JOIN numbered b ON a.session = b.session AND b.k = a.k + 1),
ranked AS (SELECT position, cell, p, v, m, row_number() OVER (PARTITION BY position ORDER BY p DESC, cell) AS rank FROM shares),
joined AS (SELECT one, two, session, a.cell, a.p AS p, b.p AS q, a.v AS v, b.v AS u, a.m AS m, b.m AS n, a.rank AS ra, b.rank AS rb FROM pairs JOIN ranked a ON a.position = one JOIN ranked b ON b.position = two AND b.cell = a.cell)"""
_LOG = "CASE WHEN {0} > 0 THEN -({0}) * ln({0}) ELSE 0 END"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("session").orderBy("position")
    shared = d.with_shares(supports(spark, sf_dir))
    before = shared.select("*", *[F.lag(c).over(order).alias(f"{c}_before") for c in ("position", "p", "x", "m")])
    return before.where("position_before is not null")


@query("f4_total_variation", f"WITH {SUPPORTS}{_PAIRS} SELECT one, two, round(sum(abs(p - q)) / 2, 6) AS distance FROM joined GROUP BY one, two")
def f4_total_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select(F.col("position_before").alias("one"), F.col("position").alias("two"), r6(d.total_variation("p_before", "p")).alias("distance"))


@query("f5_jensen_shannon", f"WITH {SUPPORTS}{_PAIRS} SELECT one, two, round(sum({_LOG.format('(p + q) / 2')}) - (sum({_LOG.format('p')}) + sum({_LOG.format('q')})) / 2, 6) AS divergence FROM joined GROUP BY one, two")
def f5_jensen_shannon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select(F.col("position_before").alias("one"), F.col("position").alias("two"), r6(d.jensen_shannon("p_before", "p")).alias("divergence"))


@query("f6_top_overlap", f"WITH {SUPPORTS}{_PAIRS} SELECT one, two, round(count(*) FILTER (WHERE ra <= 7 AND rb <= 7) / 7, 6) AS overlap FROM joined GROUP BY one, two")
def f6_top_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select(F.col("position_before").alias("one"), F.col("position").alias("two"), r6(d.top_overlap("p_before", "p", 7)).alias("overlap"))


@query(
    "f7_head_dispersion",
    f"""WITH {SUPPORTS}, e AS (SELECT position, any_value(session) AS session, any_value(step) AS step, sum({_LOG.format('p')}) AS h FROM shares GROUP BY position),
c AS (SELECT session, step, cell, avg(p) AS p FROM shares GROUP BY ALL)
SELECT session, step, round(hm - h, 6) AS dispersion FROM (SELECT session, step, sum({_LOG.format('p')}) AS hm FROM c GROUP BY ALL) JOIN (SELECT session, step, avg(h) AS h FROM e GROUP BY ALL) USING (session, step)""",
)
def f7_head_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the mean minus mean of the entropies."""
    shared = d.with_shares(supports(spark, sf_dir)).select("session", "step", "p", d.entropy("p").alias("h"))
    of_mean = shared.select("session", "step", F.posexplode("p").alias("cell", "v")).groupBy("session", "step", "cell").agg(F.avg("v").alias("v"))
    of_mean = of_mean.groupBy("session", "step").agg(F.sum(F.when(F.col("v") > 0, -F.col("v") * F.log("v")).otherwise(0.0)).alias("hm"))
    return of_mean.join(shared.groupBy("session", "step").agg(F.avg("h").alias("h")), ["session", "step"]).select("session", "step", r6(F.col("hm") - F.col("h")).alias("dispersion"))


@query("f8_participation", f"WITH {SUPPORTS}, g AS (SELECT session, avg(m) AS a, stddev_pop(m) AS s FROM supports JOIN masses USING (position) GROUP BY session) SELECT session, round(a * a / (a * a + s * s), 6) AS participation FROM g")
def f8_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.with_shares(supports(spark, sf_dir)).groupBy("session").agg(r6(d.participation(F.avg("m"), F.stddev_pop("m"))).alias("participation"))


@query(
    "f9_grid_shares",
    f"""WITH {SUPPORTS} SELECT position, round(sum(p) FILTER (WHERE cell = 0), 6) AS first_share, max(p) FILTER (WHERE cell = 0) >= max(p) AS first_is_max,
round(sum(p) FILTER (WHERE cell // 8 IN (0, 7) OR cell % 8 IN (0, 7)), 6) AS edge_share, round(sum(CASE WHEN cell > 0 AND v > 0 THEN -(v / r) * ln(v / r) ELSE 0 END), 6) AS rest_entropy
FROM shares JOIN (SELECT position, sum(v) AS r FROM cells WHERE cell > 0 GROUP BY position) USING (position) GROUP BY position""",
)
def f9_grid_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = d.with_shares(supports(spark, sf_dir)).withColumn("rest", F.slice("x", 2, 63)).withColumn("r", d.total("rest"))
    rest = d.entropy(F.transform("rest", lambda v: F.when(F.col("r") > 0, v / F.col("r")).otherwise(0.0)))
    return shared.select("position", r6(F.col("p")[0]).alias("first_share"), (d.argmax_place("x") == 0).alias("first_is_max"), r6(d.edge_share("p")).alias("edge_share"), r6(rest).alias("rest_entropy"))


@query("f10_thresholds", f"WITH {_SCALED}, e AS (SELECT session, position, any_value(m) AS m, max(p) AS t FROM shares GROUP BY session, position) SELECT session, round(avg(t) FILTER (WHERE m > 1e-6), 6) AS above_1e6, round(avg(t) FILTER (WHERE m > 1e-4), 6) AS above_1e4, round(avg(t) FILTER (WHERE m > 1), 6) AS above_1 FROM e GROUP BY session")
def f10_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = d.with_shares(_scaled(spark, sf_dir)).select("session", "m", d.top_share("q", 1).alias("t"))
    return shared.groupBy("session").agg(*[r6(F.avg(F.when(F.col("m") > least, F.col("t")))).alias(name) for name, least in (("above_1e6", 1e-6), ("above_1e4", 1e-4), ("above_1", 1.0))])


@query("f11_head_share", f"WITH {SUPPORTS}, g AS (SELECT session, step, head, sum(m) AS s FROM supports JOIN masses USING (position) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session, step ORDER BY s DESC) AS k FROM g) SELECT session, step, round(sum(s) FILTER (WHERE k <= 2) / sum(s), 6) AS top2_share FROM r GROUP BY ALL")
def f11_head_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = d.with_shares(supports(spark, sf_dir)).groupBy("session", "step", "head").agg(F.sum("m").alias("s"))
    lists = heads.groupBy("session", "step").agg(F.sort_array(F.collect_list("s"), asc=False).alias("s"))
    return lists.select("session", "step", r6(d.total(F.slice("s", 1, 2)) / d.total("s")).alias("top2_share"))


@query(
    "f12_grid_cells",
    """WITH g AS (SELECT n_nationkey AS image, n_nationkey + 5 AS h, n_regionkey * 3 + 4 AS w FROM nation), p AS (SELECT image, h, w, unnest(range(h * w)) AS patch FROM g)
SELECT image, CAST((2 * (patch // w) + 1) * 8 // (2 * h) * 8 + (2 * (patch % w) + 1) * 8 // (2 * w) AS BIGINT) AS cell, count(*) AS patches FROM p GROUP BY ALL""",
)
def f12_grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("image"), (F.col("n_nationkey") + 5).cast("long").alias("h"), (F.col("n_regionkey") * 3 + 4).cast("long").alias("w"))
    patches = grids.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") * F.col("w") - 1)).alias("patch"))
    cell = d.grid_cell(F.floor(F.col("patch") / F.col("w")), F.col("patch") % F.col("w"), F.col("h"), F.col("w"))
    return patches.groupBy("image", cell.alias("cell")).agg(F.count("*").alias("patches"))


#: Token spans of the turns of a conversation, one token for each 20 characters.
_SPANS = "spans AS (SELECT conv_id, turn, role, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM (SELECT *, CAST(length(text) // 20 + 1 AS BIGINT) AS n FROM conversations))"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.char_length("text") / 20) + 1
    order = Window.partitionBy("conv_id").orderBy("turn")
    sized = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", n.alias("n"))
    stop = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return sized.select("conv_id", "turn", "role", (stop - F.col("n")).alias("start"), stop.alias("stop"))


@query("f13_span_labels", f"WITH {_SPANS}, t AS (SELECT conv_id, role, unnest(range(start, stop)) AS token FROM spans), o AS (SELECT conv_id, token, count(*) AS k FROM t GROUP BY ALL) SELECT conv_id, role, count(*) AS tokens, count(*) FILTER (WHERE k > 1) AS overlapping FROM t JOIN o USING (conv_id, token) GROUP BY ALL")
def f13_span_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _spans(spark, sf_dir).select("conv_id", "role", F.explode(F.sequence("start", F.col("stop") - 1)).alias("token"))
    marked = tokens.withColumn("k", F.count("*").over(Window.partitionBy("conv_id", "token")))
    return marked.groupBy("conv_id", "role").agg(F.count("*").alias("tokens"), F.count_if(F.col("k") > 1).alias("overlapping"))


@query("f14_marker_exclusion", f"WITH {_SPANS}, t AS (SELECT conv_id, role, start, stop, unnest(range(start, stop)) AS token FROM spans) SELECT conv_id, CASE WHEN token = start OR token = stop - 1 THEN 'context_other' ELSE role END AS label, count(*) AS tokens FROM t GROUP BY ALL")
def f14_marker_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last token of a span are markers and go to the rest of the context."""
    tokens = _spans(spark, sf_dir).select("conv_id", "role", "start", "stop", F.explode(F.sequence("start", F.col("stop") - 1)).alias("token"))
    marker = (F.col("token") == F.col("start")) | (F.col("token") == F.col("stop") - 1)
    return tokens.groupBy("conv_id", F.when(marker, "context_other").otherwise(F.col("role")).alias("label")).agg(F.count("*").alias("tokens"))


@query("f15_conservation", f"WITH {SUPPORTS}, s AS (SELECT position, sum(p) AS s, any_value(m) AS m FROM shares GROUP BY position) SELECT CAST(count(*) FILTER (WHERE m > 0 AND abs(s - 1) > 1e-9) AS BIGINT) AS violations, count(*) AS positions FROM s")
def f15_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = d.with_shares(supports(spark, sf_dir)).select("m", d.total("p").alias("s"))
    return sums.agg(F.count_if((F.col("m") > 0) & (F.abs(F.col("s") - 1) > 1e-9)).alias("violations"), F.count("*").alias("positions"))


@query("f16_marker_share", f"WITH {_SCALED} SELECT position, round(sum(p) FILTER (WHERE cell IN (0, 63)) / nullif(CASE WHEN any_value(m) > 0 THEN 1 ELSE 0 END, 0), 6) AS marker_share FROM shares GROUP BY position")
def f16_marker_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = d.with_shares(_scaled(spark, sf_dir))
    return shared.select("position", r6(F.when(F.col("m") > 0, F.col("p")[0] + F.col("p")[63])).alias("marker_share"))


@query(
    "f17_encoding_agreement",
    f"""WITH {SUPPORTS}, h AS (SELECT position, cell % 32 AS cell, cell // 32 AS side, v / sum(v) OVER (PARTITION BY position, cell // 32) AS p FROM cells),
k AS (SELECT *, row_number() OVER (PARTITION BY position, side ORDER BY p DESC, cell) AS rank FROM h)
SELECT a.position, round(sum(abs(a.p - b.p)) / 2, 6) AS distance, round(count(*) FILTER (WHERE a.rank <= 7 AND b.rank <= 7) / 7, 6) AS overlap FROM k a JOIN k b ON a.position = b.position AND a.cell = b.cell AND a.side = 0 AND b.side = 1 GROUP BY a.position""",
)
def f17_encoding_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two halves of a support stand for two encodings of one image."""
    halves = supports(spark, sf_dir).select("position", F.posexplode(F.array(F.slice("x", 1, 32), F.slice("x", 33, 32))).alias("side", "x"))
    shared = d.with_shares(halves).select("position", "side", "p")
    one, two = (shared.where(f"side = {k}").select("position", F.col("p").alias(f"p{k}")) for k in (0, 1))
    return one.join(two, "position").select("position", r6(d.total_variation("p0", "p1")).alias("distance"), r6(d.top_overlap("p0", "p1", 7)).alias("overlap"))


@query(
    "f18_paired_turns",
    f"""WITH {SUPPORTS}{_PAIRS} SELECT session, count(DISTINCT one) AS pairs, round(avg(dm), 6) AS mass_change, round(avg(dh), 6) AS entropy_change, round(avg(tv), 6) AS distance FROM (
SELECT session, one, any_value(n) - any_value(m) AS dm, sum({_LOG.format('q')}) - sum({_LOG.format('p')}) AS dh, sum(abs(p - q)) / 2 AS tv FROM joined GROUP BY session, one) GROUP BY session""",
)
def f18_paired_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).select(
        "session", (F.col("m") - F.col("m_before")).alias("dm"), (d.entropy("p") - d.entropy("p_before")).alias("dh"), d.total_variation("p", "p_before").alias("tv")
    )
    return pairs.groupBy("session").agg(F.count("*").alias("pairs"), r6(F.avg("dm")).alias("mass_change"), r6(F.avg("dh")).alias("entropy_change"), r6(F.avg("tv")).alias("distance"))


@query(
    "f18_paired_metrics",
    f"""WITH {_SCALED}{_PAIRS}, each AS (SELECT session, one, any_value(m) AS m, any_value(n) AS n, sum({_LOG.format('q')}) - sum({_LOG.format('p')}) AS dh, sum(q) FILTER (WHERE rb <= 7) - sum(p) FILTER (WHERE ra <= 7) AS dt, sum(abs(p - q)) / 2 AS tv,
sum({_LOG.format('(p + q) / 2')}) - (sum({_LOG.format('p')}) + sum({_LOG.format('q')})) / 2 AS js, count(*) FILTER (WHERE ra <= 7 AND rb <= 7) / 7 AS ov FROM joined GROUP BY session, one)
SELECT session, count(*) AS pairs, count(*) FILTER (WHERE m > 1e-6 AND n > 1e-6) AS sensitivity_pairs, round(avg(n - m), 6) AS delta_mass, round(avg(dh) FILTER (WHERE m > 0 AND n > 0), 6) AS delta_entropy, round(avg(dt) FILTER (WHERE m > 0 AND n > 0), 6) AS delta_top10,
round(avg(tv), 6) AS tv, round(avg(js), 6) AS js, round(avg(ov), 6) AS top_overlap, round(sum(tv * (m + n)) / sum(m + n), 6) AS tv_weighted, round(sum(js * (m + n)) / sum(m + n), 6) AS js_weighted, round(sum(ov * (m + n)) / sum(m + n), 6) AS top_overlap_weighted,
round(avg(tv) FILTER (WHERE m > 1e-6 AND n > 1e-6), 6) AS tv_sensitivity, round(avg(js) FILTER (WHERE m > 1e-6 AND n > 1e-6), 6) AS js_sensitivity, round(avg(ov) FILTER (WHERE m > 1e-6 AND n > 1e-6), 6) AS top_overlap_sensitivity FROM each GROUP BY session""",
)
def f18_paired_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paired metrics of neighbouring positions, some without mass and some of little: plain, weighted by both masses, and over pairs with enough mass on both sides."""
    order = Window.partitionBy("session").orderBy("position")
    shared = d.with_shares(_scaled(spark, sf_dir))
    before = shared.select("*", *[F.lag(c).over(order).alias(f"{c}_before") for c in ("position", "p", "q", "m")]).where("position_before is not null")
    pairs = before.select("session", *d.paired_metrics())
    weight, enough = F.col("mass_before") + F.col("mass_after"), (F.col("mass_before") > d.LOW_MASS) & (F.col("mass_after") > d.LOW_MASS)
    three = ("tv", "js", "top_overlap")
    return pairs.groupBy("session").agg(
        F.count("*").alias("pairs"), F.count_if(enough).alias("sensitivity_pairs"), *[r6(F.avg(c)).alias(c) for c in ("delta_mass", "delta_entropy", "delta_top10", *three)],
        *[r6(F.try_divide(F.sum(F.col(c) * weight), F.sum(weight))).alias(f"{c}_weighted") for c in three], *[r6(F.avg(F.when(enough, F.col(c)))).alias(f"{c}_sensitivity") for c in three],
    )


@query(
    "f19_object_consistency",
    f"""WITH {SUPPORTS}{_PAIRS}, c AS (SELECT one, two, sum(v * u) FILTER (WHERE cell < 32) / sqrt(sum(v * v) FILTER (WHERE cell < 32) * sum(u * u) FILTER (WHERE cell < 32)) AS cls,
sum(v * u) FILTER (WHERE cell >= 32) / sqrt(sum(v * v) FILTER (WHERE cell >= 32) * sum(u * u) FILTER (WHERE cell >= 32)) AS patch FROM joined GROUP BY one, two) SELECT one, two, round(0.5 * cls + 0.5 * patch, 6) AS consistency FROM c""",
)
def f19_object_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    half = lambda a: d.cosine(F.slice("x_before", a, 32), F.slice("x", a, 32))
    return pairs.select(F.col("position_before").alias("one"), F.col("position").alias("two"), r6(0.5 * half(1) + 0.5 * half(33)).alias("consistency"))


_POOLED = """, w AS (SELECT position, cell % 8 AS dim, cell // 8 AS token, v, CASE WHEN (cell // 8 + position) % 8 / 8.0e0 < 0.5 THEN 0 ELSE (cell // 8 + position) % 8 / 8.0e0 END AS weight FROM cells),
n AS (SELECT position, token, sqrt(sum(v * v)) AS norm FROM w GROUP BY ALL), pooled AS (SELECT position, dim, sum(v / norm * weight) AS f FROM w JOIN n USING (position, token) GROUP BY ALL)"""


@query("f20_background_similarity", f"WITH {SUPPORTS}{_POOLED}, k AS (SELECT a.position, sum(a.f * b.f) / sqrt(sum(a.f * a.f) * sum(b.f * b.f)) AS c FROM pooled a JOIN pooled b ON a.dim = b.dim AND b.position = a.position + 1 GROUP BY a.position) SELECT position, round(c, 6) AS similarity FROM k")
def f20_background_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight tokens of eight values; tokens are normalised and pooled with mask weights, weights under 0.5 count as 0."""
    cells = supports(spark, sf_dir).select("position", F.posexplode("x").alias("cell", "v"))
    token, weight = F.floor(F.col("cell") / 8), (F.floor(F.col("cell") / 8) + F.col("position")) % 8 / 8.0
    weighted = cells.select("position", token.alias("token"), (F.col("cell") % 8).alias("dim"), "v", F.when(weight < 0.5, 0.0).otherwise(weight).alias("weight"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("position", "token")))
    pooled = weighted.select("position", "dim", (F.try_divide(F.col("v"), norm) * F.col("weight")).alias("f")).groupBy("position", "dim").agg(F.sum("f").alias("f"))
    vectors = pooled.groupBy("position").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "f"))), lambda s: s["f"]).alias("f"))
    following = vectors.select((F.col("position") - 1).alias("position"), F.col("f").alias("g"))
    return vectors.join(following, "position").select("position", r6(d.cosine("f", "g")).alias("similarity"))


@query("f21_consistency_assembly", f"WITH {SUPPORTS}, c AS (SELECT position, CASE WHEN position % 3 > 0 THEN x[1] END AS a, CASE WHEN position % 5 > 1 THEN x[2] END AS b, position % 11 = 0 AS na FROM supports) SELECT position, CASE WHEN na THEN 'not_applicable' WHEN a IS NULL AND b IS NULL THEN 'unmeasurable' ELSE 'ok' END AS status, round(CASE WHEN na THEN NULL WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END, 6) AS score FROM c")
def f21_consistency_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = supports(spark, sf_dir).select("position", F.when(F.col("position") % 3 > 0, F.col("x")[0]).alias("a"), F.when(F.col("position") % 5 > 1, F.col("x")[1]).alias("b"), (F.col("position") % 11 == 0).alias("na"))
    there = F.filter(F.array("a", "b"), lambda v: v.isNotNull())
    status = F.when(F.col("na"), "not_applicable").when(F.size(there) == 0, "unmeasurable").otherwise("ok")
    return parts.select("position", status.alias("status"), r6(F.when(~F.col("na"), F.try_divide(d.total(there), F.size(there)))).alias("score"))


@query("f25_mean_difference", f"WITH {SUPPORTS}{_PAIRS} SELECT one, two, round(avg(abs(v - u)), 6) AS difference FROM joined GROUP BY one, two")
def f25_mean_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select(F.col("position_before").alias("one"), F.col("position").alias("two"), r6(d.mean_absolute_difference("x_before", "x")).alias("difference"))


@query("f26_axis_means", f"WITH {_VALUES} SELECT coalesce(CAST(step AS VARCHAR), 'all') AS step, coalesce(CAST(head AS VARCHAR), 'all') AS head, round(avg(h), 6) AS entropy, round(avg(top1_share), 6) AS top1, count(*) AS n_valid FROM conc GROUP BY GROUPING SETS ((step, head), (step), (head), ())")
def f26_axis_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = d.concentration(supports(spark, sf_dir)).select("step", "head", "entropy_nats", "top1_share")
    grouped = values.groupingSets([["step", "head"], ["step"], ["head"], []], "step", "head")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("all")).alias(c)
    return grouped.agg(r6(F.avg("entropy_nats")).alias("entropy"), r6(F.avg("top1_share")).alias("top1"), F.count("entropy_nats").alias("n_valid")).select(name("step"), name("head"), "entropy", "top1", "n_valid")


@query("f27_group_statistics", f"WITH {SUPPORTS}, g AS (SELECT session, m FROM supports JOIN masses USING (position)) SELECT session, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, round(quantile_cont(m, 0.1), 6) AS p10, round(quantile_cont(m, 0.5), 6) AS p50, round(quantile_cont(m, 0.9), 6) AS p90 FROM g GROUP BY session")
def f27_group_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = d.with_shares(supports(spark, sf_dir)).groupBy("session").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.percentile("m", [0.1, 0.5, 0.9]).alias("q"))
    return grouped.select("session", r6("mean").alias("mean"), r6("std").alias("std"), *[r6(F.col("q")[k]).alias(n) for k, n in enumerate(("p10", "p50", "p90"))])


@query("f28_axis_profiles", f"WITH {_SCALED} SELECT coalesce(CAST(step AS VARCHAR), 'all') AS step, coalesce(CAST(head AS VARCHAR), 'all') AS head, cell, round(avg(p) FILTER (WHERE m > 0), 6) AS record_equal, round(sum(v) / sum(m), 6) AS amount_weighted FROM shares GROUP BY GROUPING SETS ((step, cell), (head, cell), (cell))")
def f28_axis_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = d.with_shares(_scaled(spark, sf_dir)).select("step", "head", "m", F.posexplode(F.arrays_zip("x", "p")).alias("cell", "c")).withColumn("cell", F.col("cell").cast("long"))
    grouped = cells.groupingSets([["step", "cell"], ["head", "cell"], ["cell"]], "step", "head", "cell")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("all")).alias(c)
    out = grouped.agg(r6(F.avg(F.when(F.col("m") > 0, F.col("c.p")))).alias("record_equal"), r6(F.try_divide(F.sum("c.x"), F.sum("m"))).alias("amount_weighted"))
    return out.select(name("step"), name("head"), "cell", "record_equal", "amount_weighted")


@query("e9_argmax_cell", f"WITH {_SCALED} SELECT position, CASE WHEN any_value(m) > 0 THEN arg_min(cell, struct_pack(a := -v, b := cell)) ELSE -1 END AS place FROM shares GROUP BY position")
def e9_argmax_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir).select("position", d.argmax_place("x").alias("place"))


@query("d30_fixed_element_wins", f"WITH {SUPPORTS}, a AS (SELECT position, any_value(step) AS step, arg_min(cell, struct_pack(a := -v, b := cell)) AS place FROM shares GROUP BY position) SELECT step, place, round(count(*) / sum(count(*)) OVER (PARTITION BY step), 6) AS rate FROM a GROUP BY step, place")
def d30_fixed_element_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    wins = supports(spark, sf_dir).groupBy("step", d.argmax_place("x").alias("place")).agg(F.count("*").alias("n"))
    return wins.select("step", "place", r6(F.col("n") / F.sum("n").over(Window.partitionBy("step"))).alias("rate"))


@query("e20_adjacent_steps", f"WITH {SUPPORTS}, c AS (SELECT session, step, cell, avg(p) AS p FROM shares GROUP BY ALL) SELECT a.session, a.step, round(sum(abs(a.p - b.p)) / 2, 6) AS distance FROM c a JOIN c b ON a.session = b.session AND a.cell = b.cell AND b.step = a.step + 1 GROUP BY ALL")
def e20_adjacent_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = d.with_shares(supports(spark, sf_dir)).select("session", "step", F.posexplode("p").alias("cell", "p")).groupBy("session", "step", "cell").agg(F.avg("p").alias("p"))
    maps = cells.groupBy("session", "step").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "p"))), lambda s: s["p"]).alias("p"))
    order = Window.partitionBy("session").orderBy("step")
    following = maps.select("*", F.lead("p").over(order).alias("q"), F.lead("step").over(order).alias("s")).where(F.col("s") == F.col("step") + 1)
    return following.select("session", "step", r6(d.total_variation("p", "q")).alias("distance"))


@query("d39_spatial_role_map", f"WITH {SUPPORTS}, a AS (SELECT session, step, cell, avg(p) AS p FROM shares GROUP BY ALL), b AS (SELECT session, cell, avg(p) AS p FROM a GROUP BY ALL) SELECT cell, round(avg(p), 6) AS mean FROM b GROUP BY cell")
def d39_spatial_role_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal averages over positions, then steps, then sessions."""
    cells = d.with_shares(supports(spark, sf_dir)).select("session", "step", F.posexplode("p").alias("cell", "p")).withColumn("cell", F.col("cell").cast("long"))
    return cells.groupBy("session", "step", "cell").agg(F.avg("p").alias("p")).groupBy("session", "cell").agg(F.avg("p").alias("p")).groupBy("cell").agg(r6(F.avg("p")).alias("mean"))


@query("d40_uniform_baseline", f"WITH {SUPPORTS}, s AS (SELECT session, position, sum(p) FILTER (WHERE cell < 16) AS mass, 16 / 64.0e0 AS base FROM shares GROUP BY ALL), g AS (SELECT session, avg(mass) AS mass, avg(base) AS base FROM s GROUP BY session) SELECT round(avg(mass), 6) AS mean, round(avg(base), 6) AS uniform, round(avg(mass) / avg(base), 6) AS ratio FROM g")
def d40_uniform_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = d.with_shares(supports(spark, sf_dir)).select("session", d.total(F.slice("p", 1, 16)).alias("mass"), (F.lit(16.0) / F.size("p")).alias("base"))
    by_session = own.groupBy("session").agg(F.avg("mass").alias("mass"), F.avg("base").alias("base"))
    return by_session.agg(r6(F.avg("mass")).alias("mean"), r6(F.avg("base")).alias("uniform"), r6(F.avg("mass") / F.avg("base")).alias("ratio"))


@query(
    "d41_map_facts",
    f"""WITH {SUPPORTS}, s AS (SELECT session, cell, avg(p) AS p FROM shares GROUP BY ALL), g AS (SELECT cell, avg(p) AS p FROM s GROUP BY cell), peak AS (SELECT arg_min(cell, struct_pack(a := -p, b := cell)) AS cell FROM g),
own AS (SELECT session, arg_min(cell, struct_pack(a := -p, b := cell)) AS cell FROM s GROUP BY session)
SELECT (SELECT cell FROM peak) AS peak_cell, round(quantile_cont(p, 0.1), 6) AS p10, round(quantile_cont(p, 0.9), 6) AS p90, (SELECT round(avg(CAST(cell = (SELECT cell FROM peak) AS INT)), 6) FROM own) AS peak_share FROM s WHERE cell = (SELECT cell FROM peak)""",
)
def d41_map_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = d.with_shares(supports(spark, sf_dir)).select("session", F.posexplode("p").alias("cell", "p")).groupBy("session", "cell").agg(F.avg("p").alias("p"))
    first = F.min(F.struct((-F.col("p")).alias("less"), "cell"))["cell"]
    # one row
    peak = cells.groupBy("cell").agg(F.avg("p").alias("p")).agg(first.cast("long").alias("peak_cell"))
    own = cells.groupBy("session").agg(first.alias("own_peak"), F.map_from_entries(F.collect_list(F.struct("cell", "p"))).alias("by_cell")).crossJoin(F.broadcast(peak))
    at_peak = F.element_at("by_cell", F.col("peak_cell").cast("int"))
    out = own.groupBy("peak_cell").agg(F.percentile(at_peak, [0.1, 0.9]).alias("q"), F.avg((F.col("own_peak") == F.col("peak_cell")).cast("double")).alias("share"))
    return out.select("peak_cell", r6(F.col("q")[0]).alias("p10"), r6(F.col("q")[1]).alias("p90"), r6("share").alias("peak_share"))


@query("j8_array_bounds", f"WITH {_VALUES} SELECT count(*) AS positions, CAST(count(*) FILTER (WHERE h < -1e-12 OR h > ln(64) + 1e-12 OR top1_share > top3_share + 1e-12 OR top3_share > top5_share + 1e-12 OR top5_share > top10pct_share + 1e-12 OR n90 < 1 OR n90 > 64) AS BIGINT) AS violations FROM conc")
def j8_array_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = d.concentration(supports(spark, sf_dir))
    rising = F.lit(False)
    for a, b in (("top1_share", "top3_share"), ("top3_share", "top5_share"), ("top5_share", "top10pct_share")):
        rising = rising | (F.col(a) > F.col(b) + 1e-12)
    bad = rising | ~F.col("entropy_nats").between(-1e-12, d.MAX_ENTROPY_64 + 1e-12) | ~F.col("n90").between(1, 64)
    return v.agg(F.count("*").alias("positions"), F.count_if(bad).alias("violations"))


@query("j9_second_formula", f"WITH {SUPPORTS}, a AS (SELECT position, any_value(m) AS m, sum({_LOG.format('p')}) AS one, sum(CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END) AS s FROM shares GROUP BY position) SELECT count(*) AS n, max(abs(one - (ln(m) - s / m))) < 1e-9 AS agree FROM a WHERE m > 0")
def j9_second_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = d.with_shares(supports(spark, sf_dir)).where("m > 0").select(d.entropy("p").alias("one"), d.log_entropy("x", F.col("m")).alias("two"))
    return shared.agg(F.count("*").alias("n"), (F.max(F.abs(F.col("one") - F.col("two"))) < 1e-9).alias("agree"))
