"""Typed scores: a status and, only where it is ok, a finite number; votes, prefixes and judges are averaged by strict rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: From worst to best; a group of statuses has its worst.
PRECEDENCE = ("response_incomplete", "pending_review", "unavailable")


def typed(status: Column, score: Column) -> Column:
    """A result whose score is null unless the status is ok."""
    return F.struct(status.alias("status"), F.when(status == "ok", score.cast("double")).alias("score"))


def typed_violations(rows: DataFrame) -> DataFrame:
    """Rows that break the rule: a number without ok, or a score that is no finite number."""
    bad = (F.col("status") != "ok") & F.col("score").isNotNull()
    odd = F.isnan("score") | (F.abs("score") == float("inf"))
    return rows.where(bad | F.coalesce(odd, F.lit(False)))


def worst(status: Column) -> Column:
    """The aggregate of a group's statuses by precedence; any other than ok counts at least as unavailable."""
    out = F.when(F.bool_and(status == "ok"), "ok").otherwise("unavailable")
    for name in PRECEDENCE[-2::-1]:
        out = F.when(F.bool_or(status == name), name).otherwise(out)
    return out


def mean_report(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean over ok results with explicit denominators, and counts by status as text."""
    counted = rows.groupBy(*by, "status").agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    entry = F.concat_ws("=", "status", F.col("n").cast("string"))
    return counted.groupBy(*by).agg(
        F.try_divide(F.sum(F.when(F.col("status") == "ok", F.col("s"))), F.sum(F.when(F.col("status") == "ok", F.col("n")))).alias("mean"),
        F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("n"))), F.lit(0)).alias("valid"),
        F.sum("n").alias("total"),
        F.array_join(F.array_sort(F.collect_list(entry)), ";").alias("statuses"),
    )


def margins_report(rows: DataFrame, by: list[str]) -> DataFrame:
    """Means with denominators for every combination of `by`, 'all' standing for any value."""
    cubed = rows.cube(*by).agg(F.avg("score").alias("mean"), F.count("score").alias("valid"), F.count("*").alias("total"), *[F.grouping(c).alias(f"_{c}") for c in by])
    return cubed.select(*[F.when(F.col(f"_{c}") == 1, "all").otherwise(F.col(c).cast("string")).alias(c) for c in by], "mean", "valid", "total")


def vote_mean(votes: DataFrame, by: list[str], n_votes: int, pending_aware: bool = False) -> DataFrame:
    """One result for each group of votes; every vote must be there and ok. Groups with another number of votes are 'invalid_votes'."""
    status = worst(F.col("status")) if pending_aware else F.when(F.bool_and(F.col("status") == "ok"), "ok").otherwise("unavailable")
    grouped = votes.groupBy(*by).agg(
        F.when(F.count("*") != n_votes, "invalid_votes").otherwise(status).alias("status"), F.avg("score").alias("mean"), F.array_join(F.array_sort(F.collect_list("status")), ",").alias("components")
    )
    return grouped.select(*by, "status", F.when(F.col("status") == "ok", F.col("mean")).alias("score"), F.when(F.col("status") != "ok", F.col("components")).alias("components"))


def cumulative_minimum(rows: DataFrame, by: list[str], order: str = "turn", pending_aware: bool = False) -> DataFrame:
    """Least score so far; from the first result that is not ok on, the prefix is unresolved.

    Adds cum_status, cum_score, non_monotone (a later prefix scored above an earlier one) and, if pending_aware, the unresolved turns.
    """
    so_far = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    blocked = F.max(F.when(F.col("status") != "ok", 1).otherwise(0)).over(so_far) == 1
    status = F.lit("unavailable")
    if pending_aware:
        for name in PRECEDENCE[-2::-1]:
            status = F.when(F.max((F.col("status") == name).cast("int")).over(so_far) == 1, name).otherwise(status)
    least = F.min("score").over(so_far)
    out = rows.withColumns(
        {
            "cum_status": F.when(blocked, status).otherwise("ok"),
            "cum_score": F.when(~blocked, F.least(F.lit(1.0), least)),
            "non_monotone": F.coalesce(~blocked & (F.least(F.lit(1.0), least) < F.col("score")), F.lit(False)),
        }
    )
    if pending_aware:
        bad = F.collect_list(F.when(F.col("status") != "ok", F.col(order))).over(so_far)
        out = out.withColumn("unresolved", F.array_join(bad, ","))
    return out


def judge_mean(rows: DataFrame, by: list[str], judges: tuple[str, str]) -> DataFrame:
    """Mean of two judges; both must have valid results. A judge without a row counts as unavailable."""
    one = lambda name, column: F.max(F.when(F.col("judge") == name, F.col(column)))
    grouped = rows.groupBy(*by).agg(*[F.coalesce(one(j, "status"), F.lit("unavailable")).alias(f"s{k}") for k, j in enumerate(judges)], *[one(j, "score").alias(f"v{k}") for k, j in enumerate(judges)])
    both = (F.col("s0") == "ok") & (F.col("s1") == "ok")
    return grouped.select(*by, F.when(both, "ok").otherwise("unavailable").alias("status"), F.when(both, (F.col("v0") + F.col("v1")) / 2).alias("score"), F.when(~both, F.concat_ws(",", "s0", "s1")).alias("components"))


def override(auto: DataFrame, human: DataFrame, keys: list[str], open_statuses: tuple[str, ...]) -> DataFrame:
    """Human results take the place of open automatic ones only; origin says which was used, and an override of a closed result is marked."""
    joined = auto.join(human.select(*keys, F.col("score").alias("human_score")), keys, "left")
    is_open, given = F.col("status").isin(*open_statuses), F.col("human_score").isNotNull()
    return joined.select(
        *keys,
        F.when(is_open & given, "ok").otherwise(F.col("status")).alias("status"),
        F.when(is_open & given, F.col("human_score")).otherwise(F.col("score")).alias("score"),
        F.when(is_open & given, "human").otherwise("automatic").alias("origin"),
        (given & ~is_open).alias("illegal"),
    )


def outcomes(rows: DataFrame, session: list[str]) -> DataFrame:
    """For each session: whether all turns passed, and the first turn that failed."""
    return rows.groupBy(*session).agg(F.bool_and(F.coalesce(F.col("score") == 1, F.lit(False))).alias("all_passed"), F.min(F.when(F.col("score") == 0, F.col("turn"))).alias("first_failure"))


def prefix_success(rows: DataFrame, session: list[str]) -> DataFrame:
    """Per turn: the share of sessions all of whose turns so far scored 1."""
    so_far = Window.partitionBy(*session).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    good = F.min(F.coalesce(F.col("score"), F.lit(0.0))).over(so_far)
    return rows.select("turn", good.alias("good")).groupBy("turn").agg(F.avg("good").alias("rate"), F.count("*").alias("sessions"))
