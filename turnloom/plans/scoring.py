"""Queries over typed scores: reports, votes, prefixes, judges, overrides and session outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.operators import statistics, typed
from turnloom.plans.base import TURNS, VOTES, query, r6, scored, table, turns, votes
from turnloom.sources.shared import stored


@query("b7_typed_results", f"WITH {TURNS} SELECT session, turn, status, score FROM scored")
def b7_typed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    return rows.select("session", "turn", typed.typed(F.col("status"), F.col("score")).alias("r")).select("session", "turn", "r.*")


@query("b7_typed_violations", f"WITH {TURNS} SELECT status, count(*) AS n FROM (SELECT CASE WHEN turn = 1 THEN 'ok' ELSE status END AS status, coalesce(score, CASE WHEN turn = 2 THEN 1 END) AS score FROM scored) WHERE status <> 'ok' AND score IS NOT NULL GROUP BY status")
def b7_typed_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = scored(spark, sf_dir).select(F.when(F.col("turn") == 1, "ok").otherwise(F.col("status")).alias("status"), F.coalesce("score", F.when(F.col("turn") == 2, 1.0)).alias("score"))
    return typed.typed_violations(changed).groupBy("status").agg(F.count("*").alias("n"))


_REPORT = "round(avg(score), 6) AS mean, count(score) AS valid, count(*) AS total"


@query(
    "d1_mean_report",
    f"""WITH {TURNS}, c AS (SELECT split, status, count(*) AS n FROM scored GROUP BY ALL)
SELECT split, mean, valid, total, statuses FROM (SELECT split, {_REPORT} FROM scored GROUP BY split)
JOIN (SELECT split, string_agg(status || '=' || n, ';' ORDER BY status) AS statuses FROM c GROUP BY split) USING (split)""",
)
def d1_mean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.mean_report(scored(spark, sf_dir), ["split"]).withColumn("mean", r6("mean"))


@query("d2_margins_report", f"WITH {TURNS} SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, CASE WHEN grouping(turn) = 1 THEN 'all' ELSE CAST(turn AS VARCHAR) END AS turn, {_REPORT} FROM scored GROUP BY CUBE (split, turn)")
def d2_margins_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.margins_report(scored(spark, sf_dir), ["split", "turn"]).withColumn("mean", r6("mean"))


_METRICS = "(SELECT split, turn, 'discount' AS metric, discount / 10.0e0 AS score FROM turns UNION ALL SELECT split, turn, 'tax', tax / 8.0e0 FROM turns UNION ALL SELECT split, turn, 'quantity', CASE WHEN quantity > 10 THEN quantity / 50.0e0 END FROM turns)"


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = turns(spark, sf_dir).select("split", "turn", (F.col("discount") / 10.0).alias("discount"), (F.col("tax") / 8.0).alias("tax"), F.when(F.col("quantity") > 10, F.col("quantity") / 50.0).alias("quantity"))
    return wide.unpivot(["split", "turn"], ["discount", "tax", "quantity"], "metric", "score")


@query("d3_wide_report", f"WITH {TURNS} SELECT metric, CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, {_REPORT} FROM {_METRICS} GROUP BY GROUPING SETS ((metric, split), (metric))")
def d3_wide_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _metrics(spark, sf_dir).groupingSets([["metric", "split"], ["metric"]], "metric", "split")
    return grouped.agg(r6(F.avg("score")).alias("mean"), F.count("score").alias("valid"), F.count("*").alias("total"), F.grouping("split").alias("g")).select(
        "metric", F.when(F.col("g") == 1, "all").otherwise(F.col("split")).alias("split"), "mean", "valid", "total"
    )


_STRICT = f"""WITH {VOTES}, voted AS (SELECT session, turn, split, judge, CASE WHEN count(*) <> 2 THEN 'invalid_votes' WHEN bool_and(status = 'ok') THEN 'ok' ELSE 'unavailable' END AS status,
  CASE WHEN bool_and(status = 'ok') THEN avg(score) END AS score, CASE WHEN NOT bool_and(status = 'ok') THEN string_agg(status, ',' ORDER BY status) END AS components FROM votes GROUP BY ALL)"""


@query("d4_vote_mean", f"{_STRICT} SELECT session, turn, judge, status, score, components FROM voted")
def d4_vote_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.vote_mean(votes(spark, sf_dir), ["session", "turn", "judge"], 2)


_WORST = "CASE WHEN bool_or(status = 'response_incomplete') THEN 'response_incomplete' WHEN bool_or(status = 'pending_review') THEN 'pending_review' WHEN bool_and(status = 'ok') THEN 'ok' ELSE 'unavailable' END"


@query("d5_pending_vote_mean", f"WITH {VOTES} SELECT judge, status, count(*) AS n, round(avg(score), 6) AS mean FROM (SELECT session, turn, judge, {_WORST} AS status, CASE WHEN bool_and(status = 'ok') THEN avg(score) END AS score FROM votes GROUP BY ALL) GROUP BY ALL")
def d5_pending_vote_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.vote_mean(votes(spark, sf_dir), ["session", "turn", "judge"], 2, pending_aware=True).groupBy("judge", "status").agg(F.count("*").alias("n"), r6(F.avg("score")).alias("mean"))


_PAIR = "SELECT session, turn, sa, sb, va, vb FROM (SELECT session, turn, status AS sa, score AS va FROM {0} WHERE judge = 'a') JOIN (SELECT session, turn, status AS sb, score AS vb FROM {0} WHERE judge = 'b') USING (session, turn)"


@query("d6_judge_mean", f"{_STRICT} SELECT session, turn, CASE WHEN sa = 'ok' AND sb = 'ok' THEN 'ok' ELSE 'unavailable' END AS status, CASE WHEN sa = 'ok' AND sb = 'ok' THEN (va + vb) / 2 END AS score, CASE WHEN NOT (sa = 'ok' AND sb = 'ok') THEN sa || ',' || sb END AS components FROM ({_PAIR.format('voted')})")
def d6_judge_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.judge_mean(typed.vote_mean(votes(spark, sf_dir), ["session", "turn", "judge"], 2), ["session", "turn"], ("a", "b"))


_CUMULATIVE = """, running AS (SELECT *, max(CASE WHEN status <> 'ok' THEN 1 ELSE 0 END) OVER w AS bad, least(1.0e0, min(score) OVER w) AS low FROM {0} WINDOW w AS (PARTITION BY {1} ORDER BY turn ROWS UNBOUNDED PRECEDING)),
cumulated AS (SELECT *, CASE WHEN bad = 1 THEN 'unavailable' ELSE 'ok' END AS cum_status, CASE WHEN bad = 0 THEN low END AS cum_score FROM running)"""


@query("d7_order_contract", f"{_STRICT}{_CUMULATIVE.format('voted', 'session, judge')}, ends AS (SELECT session, turn, judge, cum_status AS status, cum_score AS score FROM cumulated) SELECT session, turn, CASE WHEN sa = 'ok' AND sb = 'ok' THEN 'ok' ELSE 'unavailable' END AS status, CASE WHEN sa = 'ok' AND sb = 'ok' THEN (va + vb) / 2 END AS score FROM ({_PAIR.format('ends')})")
def d7_order_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes are averaged first, then the running minimum of each judge is taken, then the judges are averaged."""
    voted = typed.vote_mean(votes(spark, sf_dir), ["session", "turn", "judge"], 2)
    running = typed.cumulative_minimum(voted, ["session", "judge"]).select("session", "turn", "judge", F.col("cum_status").alias("status"), F.col("cum_score").alias("score"))
    return typed.judge_mean(running, ["session", "turn"], ("a", "b")).drop("components")


@query("d8_status_counters", f"WITH {TURNS} SELECT split, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'pending_review') AS pending_review, count(*) FILTER (WHERE status = 'response_incomplete') AS response_incomplete, count(*) FILTER (WHERE status = 'unavailable') AS unavailable FROM scored GROUP BY split")
def d8_status_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("split").pivot("status", ["ok", "pending_review", "response_incomplete", "unavailable"]).count().na.fill(0)


@query("d9_task_report", f"WITH {TURNS} SELECT task, {_REPORT} FROM scored GROUP BY task")
def d9_task_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("task").agg(r6(F.avg("score")).alias("mean"), F.count("score").alias("valid"), F.count("*").alias("total"))


@query(
    "d10_session_outcomes",
    f"""WITH {TURNS}, o AS (SELECT session, split, bool_and(coalesce(score = 1, false)) AS passed, min(CASE WHEN score = 0 THEN turn END) AS first_failure FROM scored GROUP BY session, split)
SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, coalesce(CAST(first_failure AS VARCHAR), 'none') AS first_failure, count(*) AS sessions, count(*) FILTER (WHERE passed) AS all_passed FROM o GROUP BY GROUPING SETS ((split, first_failure), (first_failure))""",
)
def d10_session_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = typed.outcomes(scored(spark, sf_dir), ["session", "split"]).withColumn("first_failure", F.coalesce(F.col("first_failure").cast("string"), F.lit("none")))
    grouped = done.groupingSets([["split", "first_failure"], ["first_failure"]], "split", "first_failure")
    counted = grouped.agg(F.count("*").alias("sessions"), F.count_if("all_passed").alias("all_passed"), F.grouping("split").alias("g"))
    return counted.select(F.when(F.col("g") == 1, "all").otherwise(F.col("split")).alias("split"), "first_failure", "sessions", "all_passed")


@query("d11_prefix_success", f"WITH {TURNS}, g AS (SELECT turn, min(coalesce(score, 0)) OVER (PARTITION BY session ORDER BY turn ROWS UNBOUNDED PRECEDING) AS good FROM scored) SELECT turn, round(avg(good), 6) AS rate, count(*) AS sessions FROM g GROUP BY turn")
def d11_prefix_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.prefix_success(scored(spark, sf_dir), ["session"]).withColumn("rate", r6("rate"))


@query("d12_combined_score", f"WITH {TURNS} SELECT turn, round(sqrt(avg(score) * ((avg(CASE WHEN discount > 3 THEN discount / 10.0e0 END) + avg(CASE WHEN tax > 1 THEN tax / 8.0e0 END)) / 2)), 6) AS combined FROM scored GROUP BY turn")
def d12_combined_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sqrt(IF * CC): CC is the mean of two means, each over the rows that have it."""
    objects, background = F.avg(F.when(F.col("discount") > 3, F.col("discount") / 10.0)), F.avg(F.when(F.col("tax") > 1, F.col("tax") / 8.0))
    return scored(spark, sf_dir).groupBy("turn").agg(r6(F.sqrt(F.avg("score") * (objects + background) / 2)).alias("combined"))


@query("d13_baseline_delta", f"WITH {TURNS}, j AS (SELECT t.turn, t.mass AS v, b.mass AS base FROM turns t JOIN turns b ON t.session = b.session AND b.turn = 1 WHERE t.turn > 1) SELECT turn, round(abs(avg(v) - avg(base)), 4) AS of_means, round(avg(abs(v - base)), 4) AS of_sessions, count(*) AS n FROM j GROUP BY turn")
def d13_baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = turns(spark, sf_dir).select("session", "turn", "mass")
    first = own.where("turn = 1").select("session", F.col("mass").alias("base"))
    joined = own.where("turn > 1").join(first, "session")
    return joined.groupBy("turn").agg(F.round(F.abs(F.avg("mass") - F.avg("base")), 4).alias("of_means"), F.round(F.avg(F.abs(F.col("mass") - F.col("base"))), 4).alias("of_sessions"), F.count("*").alias("n"))


@query("d14_task_rates", f"WITH {TURNS} SELECT turn, metric, count(score) AS n, round(avg(score), 6) AS mean FROM {_METRICS} GROUP BY ALL")
def d14_task_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).groupBy("turn", "metric").agg(F.count("score").alias("n"), r6(F.avg("score")).alias("mean"))


@query("d15_null_counts", f"WITH {TURNS} SELECT metric, count(*) FILTER (WHERE score IS NULL) AS nulls, count(*) AS total FROM {_METRICS} GROUP BY metric")
def d15_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).groupBy("metric").agg(F.count_if(F.isnull("score")).alias("nulls"), F.count("*").alias("total"))


_RUN = """, running AS (SELECT *, max(CASE WHEN status <> 'ok' THEN 1 ELSE 0 END) OVER w AS bad, max(CASE WHEN status = 'response_incomplete' THEN 1 ELSE 0 END) OVER w AS inc, max(CASE WHEN status = 'pending_review' THEN 1 ELSE 0 END) OVER w AS pen, least(1.0e0, min(score) OVER w) AS low
FROM scored WINDOW w AS (PARTITION BY session ORDER BY turn ROWS UNBOUNDED PRECEDING))"""


@query("e1_cumulative_minimum", f"WITH {TURNS}{_RUN} SELECT split, turn, CASE WHEN bad = 1 THEN 'unavailable' ELSE 'ok' END AS cum_status, count(*) AS n, round(avg(CASE WHEN bad = 0 THEN low END), 6) AS mean FROM running GROUP BY ALL")
def e1_cumulative_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    running = typed.cumulative_minimum(scored(spark, sf_dir), ["session"])
    return running.groupBy("split", "turn", "cum_status").agg(F.count("*").alias("n"), r6(F.avg("cum_score")).alias("mean"))


@query(
    "e2_pending_cumulative",
    f"""WITH {TURNS}{_RUN} SELECT r.session, r.turn, CASE WHEN inc = 1 THEN 'response_incomplete' WHEN pen = 1 THEN 'pending_review' WHEN bad = 1 THEN 'unavailable' ELSE 'ok' END AS cum_status, CASE WHEN bad = 0 THEN low END AS cum_score,
coalesce((SELECT string_agg(CAST(s.turn AS VARCHAR), ',' ORDER BY s.turn) FROM scored s WHERE s.session = r.session AND s.turn <= r.turn AND s.status <> 'ok'), '') AS unresolved FROM running r""",
)
def e2_pending_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.cumulative_minimum(scored(spark, sf_dir), ["session"], pending_aware=True).select("session", "turn", "cum_status", "cum_score", "unresolved")


@query("e3_non_monotone", f"WITH {TURNS}{_RUN} SELECT session, turn, score, low AS cum_score FROM running WHERE bad = 0 AND low < score")
def e3_non_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.cumulative_minimum(scored(spark, sf_dir), ["session"]).where("non_monotone").select("session", "turn", "score", "cum_score")


@query("c4_human_override", f"WITH {TURNS}, human AS (SELECT session, turn, CAST(tax % 2 AS DOUBLE) AS human_score FROM turns WHERE tax < 3), j AS (SELECT s.*, human_score, status IN ('pending_review', 'response_incomplete') AS open FROM scored s LEFT JOIN human USING (session, turn)), r AS (SELECT CASE WHEN open AND human_score IS NOT NULL THEN 'ok' ELSE status END AS status, CASE WHEN open AND human_score IS NOT NULL THEN human_score ELSE score END AS score, CASE WHEN open AND human_score IS NOT NULL THEN 'human' ELSE 'automatic' END AS origin, human_score IS NOT NULL AND NOT open AS illegal FROM j) SELECT status, origin, illegal, count(*) AS n, round(avg(score), 6) AS mean FROM r GROUP BY ALL")
def c4_human_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    auto = scored(spark, sf_dir)
    human = turns(spark, sf_dir).where("tax < 3").select("session", "turn", (F.col("tax") % 2).cast("double").alias("score"))
    settled = typed.override(auto, human, ["session", "turn"], ("pending_review", "response_incomplete"))
    return settled.groupBy("status", "origin", "illegal").agg(F.count("*").alias("n"), r6(F.avg("score")).alias("mean"))


@query("c18_judge_disagreements", f"{_STRICT} SELECT session, turn, a.score AS score_a, b.score AS score_b FROM (SELECT * FROM voted WHERE judge = 'a' AND status = 'ok') a JOIN (SELECT * FROM voted WHERE judge = 'b' AND status = 'ok') b USING (session, turn) WHERE a.score <> b.score")
def c18_judge_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both judges of a turn side by side in one aggregation."""
    voted = typed.vote_mean(votes(spark, sf_dir), ["session", "turn", "judge"], 2).where("status = 'ok'")
    of = lambda judge: F.max(F.when(F.col("judge") == judge, F.col("score"))).alias(f"score_{judge}")
    return voted.groupBy("session", "turn").agg(of("a"), of("b")).where("score_a <> score_b")


@query("d36_failure_causes", f"WITH {TURNS}, f AS (SELECT CASE WHEN tax < 4 THEN 'token_limit' ELSE 'empty_response' END AS cause FROM scored WHERE status = 'response_incomplete'), c AS (SELECT cause, count(*) AS n FROM f GROUP BY cause) SELECT cause, n, round(n / sum(n) OVER (), 6) AS share FROM c")
def d36_failure_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = scored(spark, sf_dir).where("status = 'response_incomplete'").withColumn("cause", F.when(F.col("tax") < 4, "token_limit").otherwise("empty_response"))
    counted = failed.groupBy("cause").agg(F.count("*").alias("n"))
    return counted.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))))


@query("d37_distinct_counts", f"WITH {TURNS} SELECT split, count(DISTINCT session) AS sessions, count(DISTINCT part) AS clusters, count(*) AS rows FROM turns GROUP BY split")
def d37_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).groupBy("split").agg(F.count_distinct("session").alias("sessions"), F.count_distinct("part").alias("clusters"), F.count("*").alias("rows"))


@query("d37_merged_sketches", f"WITH {TURNS} SELECT split, count(DISTINCT session) AS sessions, count(DISTINCT part) AS clusters, CAST(4 AS BIGINT) AS shards, true AS sessions_within, true AS clusters_within FROM turns GROUP BY split")
def d37_merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts from sketches that each of four shards stores and a later job merges, next to the exact counts: within three standard errors."""
    rows = stored(turns(spark, sf_dir).select("split", "session", "part", F.pmod(F.xxhash64("session"), F.lit(4)).alias("shard")), "distinct-turns")
    parts = stored(statistics.distinct_sketches(rows, ["shard", "split"], ["session", "part"]), "sketches")
    merged = statistics.merged_distinct(parts, ["split"], ["session", "part"])
    exact = rows.groupBy("split").agg(F.count_distinct("session").alias("sessions"), F.count_distinct("part").alias("clusters"), F.count_distinct("shard").alias("shards"))
    within = lambda est, n: (F.abs(F.col(est) - F.col(n)) <= 3 * statistics.SKETCH_ERROR * F.col(n)).alias(f"{n}_within")
    return exact.join(merged, "split").select("split", "sessions", "clusters", "shards", within("session", "sessions"), within("part", "clusters"))


@query("d38_pending_components", f"WITH {TURNS}{_RUN} SELECT split, count(*) FILTER (WHERE status <> 'ok') AS pending_components, count(*) FILTER (WHERE status = 'ok' AND bad = 1) AS dependent_turns FROM running GROUP BY split")
def d38_pending_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn that is open itself, and a turn that is ok but depends on an open one, are counted apart."""
    running = typed.cumulative_minimum(scored(spark, sf_dir), ["session"])
    return running.groupBy("split").agg(F.count_if(F.col("status") != "ok").alias("pending_components"), F.count_if((F.col("status") == "ok") & (F.col("cum_status") != "ok")).alias("dependent_turns"))


@query("j10_compare_reports", f"WITH {TURNS}, a AS (SELECT task, avg(score) AS m, count(score) AS v FROM scored GROUP BY task), b AS (SELECT task, avg(score) AS m, count(score) AS v FROM scored WHERE turn = 1 GROUP BY task) SELECT task, round(a.m - b.m, 6) AS mean_change, a.v - b.v AS valid_change FROM a FULL JOIN b USING (task)")
def j10_compare_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = lambda rows, name: rows.groupBy("task").agg(F.avg("score").alias(f"mean_{name}"), F.count("score").alias(f"valid_{name}"))
    rows = scored(spark, sf_dir)
    joined = report(rows, "now").join(report(rows.where("turn = 1"), "base"), "task", "full_outer")
    return joined.select("task", r6(F.col("mean_now") - F.col("mean_base")).alias("mean_change"), (F.col("valid_now") - F.col("valid_base")).alias("valid_change"))


@query("c13_baseline_reproduction", f"WITH {TURNS}, a AS (SELECT session, avg(mass) AS v FROM turns GROUP BY session), b AS (SELECT session, sum(mass) / count(*) AS v FROM turns GROUP BY session) SELECT count(*) AS n, count(*) FILTER (WHERE abs(a.v - b.v) <= 1e-6) AS within, max(abs(a.v - b.v)) <= 1e-6 AS reproduced FROM a JOIN b USING (session)")
def c13_baseline_reproduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = stored(turns(spark, sf_dir).select("session", "mass"), "session-masses").groupBy("session")
    joined = by.agg(F.avg("mass").alias("one")).join(by.agg((F.sum("mass") / F.count("*")).alias("two")), "session").withColumn("error", F.abs(F.col("one") - F.col("two")))
    return joined.agg(F.count("*").alias("n"), F.count_if(F.col("error") <= 1e-6).alias("within"), (F.max("error") <= 1e-6).alias("reproduced"))


@query("d16_value_counters", f"WITH {TURNS}, l AS (SELECT session, count(*) AS size, arg_max(task, turn) AS last_task FROM turns GROUP BY session) SELECT size, last_task, count(*) AS n FROM l GROUP BY ALL")
def d16_value_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = turns(spark, sf_dir).groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "task"))), lambda t: t["task"]).alias("tasks"))
    return lists.groupBy(F.size("tasks").cast("long").alias("size"), F.element_at("tasks", -1).alias("last_task")).agg(F.count("*").alias("n"))


@query("d31_review_summary", f"WITH {TURNS}, d AS (SELECT task, turn, CASE tax % 4 WHEN 0 THEN 'unrated' WHEN 1 THEN 'pass' WHEN 2 THEN 'fail' ELSE 'uncertain' END AS decision FROM turns) SELECT coalesce(task, 'all') AS task, coalesce(CAST(turn AS VARCHAR), 'all') AS turn, count(*) FILTER (WHERE decision = 'pass') AS passed, count(*) FILTER (WHERE decision = 'fail') AS failed, count(*) FILTER (WHERE decision = 'uncertain') AS uncertain, count(*) FILTER (WHERE decision = 'unrated') AS unrated, round(count(*) FILTER (WHERE decision = 'pass') / nullif(count(*) FILTER (WHERE decision IN ('pass', 'fail')), 0), 6) AS pass_rate FROM d GROUP BY GROUPING SETS ((task), (turn), ())")
def d31_review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("tax") % 4
    rated = turns(spark, sf_dir).select("task", "turn", F.when(code == 0, "unrated").when(code == 1, "pass").when(code == 2, "fail").otherwise("uncertain").alias("decision"))
    n = lambda name: F.count_if(F.col("decision") == name)
    grouped = rated.groupingSets([["task"], ["turn"], []], "task", "turn")
    return grouped.agg(n("pass").alias("passed"), n("fail").alias("failed"), n("uncertain").alias("uncertain"), n("unrated").alias("unrated"), r6(F.try_divide(n("pass"), n("pass") + n("fail"))).alias("pass_rate")).select(
        F.coalesce("task", F.lit("all")).alias("task"), F.coalesce(F.col("turn").cast("string"), F.lit("all")).alias("turn"), "passed", "failed", "uncertain", "unrated", "pass_rate"
    )


@query("a15_review_template", f"WITH {TURNS} SELECT session, turn, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS note FROM scored WHERE status IN ('pending_review', 'response_incomplete')")
def a15_review_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where(F.col("status").isin("pending_review", "response_incomplete")).select("session", "turn", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("note"))


@query("a13_long_export", "SELECT l_returnflag AS split, CAST(l_orderkey AS BIGINT) AS session, metric, value FROM (SELECT *, unnest(['quantity', 'discount', 'tax']) AS metric, unnest([l_quantity, CASE WHEN l_discount > 0.05 THEN l_discount END, l_tax]) AS value FROM lineitem)")
def a13_long_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("split"), F.col("l_orderkey").alias("session"), F.col("l_quantity").alias("quantity"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("discount"), F.col("l_tax").alias("tax"))
    return wide.unpivot(["split", "session"], ["quantity", "discount", "tax"], "metric", "value")
