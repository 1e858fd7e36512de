"""Audits: jobs that return the rows that break a rule. An empty result means that the check passed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Keys of one side only, as side = missing or extra."""
    missing = expected.select(*key).join(found.select(*key), key, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(found.select(*key).join(expected.select(*key), key, "left_anti").withColumn("side", F.lit("extra")))


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def compare_runs(expected: DataFrame, found: DataFrame, key: list[str], columns: list[str], shard: Column | None = None) -> DataFrame:
    """(key, violation) of a run against what it should hold: 'missing', 'foreign', 'repeated', '<column> differs' (null is equal to null), and 'wrong shard' where column `shard` of found is not what the expression says.

    Both sides meet in one aggregation by key, so a key's rows move once, whatever is checked. Columns that are binary on both sides are compared as they are, others as text.
    """
    plain = {c for c in columns if dict(expected.dtypes)[c] == dict(found.dtypes)[c] == "binary"}
    values = F.struct(*[(F.col(c) if c in plain else F.col(c).cast("string")).alias(c) for c in columns], F.lit(1).alias("_"))
    off = F.lit(False) if shard is None else ~F.col("shard").eqNullSafe(shard)
    one = expected.select(*key, F.lit(1).alias("e"), F.lit(0).alias("f"), values.alias("ve"), F.lit(None).cast(_type_of(values, expected)).alias("vf"), F.lit(False).alias("off"))
    two = found.select(*key, F.lit(0).alias("e"), F.lit(1).alias("f"), F.lit(None).cast(_type_of(values, found)).alias("ve"), values.alias("vf"), off.alias("off"))
    # few keys have rows of both sides in one task, so sorting the rows before they move would only spill
    met = one.unionByName(two).repartition(*key).groupBy(*key).agg(F.sum("e").alias("e"), F.sum("f").alias("f"), F.min("ve").alias("ve"), F.min("vf").alias("low"), F.max("vf").alias("high"), F.bool_or("off").alias("off"))
    both = (F.col("e") > 0) & (F.col("f") > 0)
    checks = {"missing": F.col("f") == 0, "foreign": F.col("e") == 0, "repeated": F.col("f") > 1, "wrong shard": F.col("off")}
    checks |= {f"{c} differs": both & ~(F.col(f"ve.{c}").eqNullSafe(F.col(f"low.{c}")) & F.col(f"ve.{c}").eqNullSafe(F.col(f"high.{c}"))) for c in columns}
    return met.select(*key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))).alias("violation"))


def _type_of(values: Column, rows: DataFrame) -> str:
    return rows.select(values.alias("v")).schema["v"].dataType.simpleString()


def counted(violations: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """(check, violations) of a table with a column `violation`: of each check the number of rows with one of its violations, zeros included."""
    row = violations.agg(*[F.count_if(F.col("violation").isin(*v)).alias(f"c{k}") for k, v in enumerate(names.values())])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c{k}").alias("violations")) for k, n in enumerate(names)])).alias("v")).select("v.*")


def reconcile(jobs: DataFrame, inventories: DataFrame, receipts: DataFrame) -> DataFrame:
    """(job, state, owner, rule, candidates, problem) of each job: who owns it after two or more producers have worked on it.

    jobs: (job, source), the producer that its canonical row names or null. inventories: (job, host, at), what each producer holds (few by contract). receipts: (job, receipt_host, valid), at most one
    a job. A valid receipt, the first commit, decides; then the canonical source, if that producer holds the job; then the earliest candidate. Nothing is chosen by quality, and all candidates
    of a job stay listed. problem: an invalid receipt, or a source that no inventory confirms.
    """
    held = inventories.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("at", "host"))).alias("candidates"))
    joined = jobs.join(held, "job", "left").join(receipts, "job", "left")
    known = F.coalesce(F.exists("candidates", lambda c: c["host"] == F.col("source")), F.lit(False))
    done, named = F.coalesce("valid", F.lit(False)), F.col("source").isNotNull()
    first = F.get("candidates", F.lit(0))["host"]
    decided = lambda receipt, source, earliest: F.when(done, receipt).when(named & known, source).when(~named & first.isNotNull(), earliest)
    problem = F.when(~F.coalesce("valid", F.lit(True)), "invalid receipt").when(~done & named & ~known, "source without inventory")
    return joined.select(
        "job", F.when(done, "completed").otherwise("pending").alias("state"), decided(F.col("receipt_host"), F.col("source"), first).alias("owner"), decided(F.lit("receipt"), F.lit("source"), F.lit("earliest")).alias("rule"), F.coalesce("candidates", F.array()).alias("candidates"), problem.alias("problem")
    )


def worker_batches(assigned: DataFrame, expected: DataFrame, generated: DataFrame, by: list[str], turns: list[int]) -> DataFrame:
    """(by, session, violation) of batches of workers: whole sessions 'assigned twice', 'omitted' or 'unexpected', and sessions whose 'turns differ' from each assigned worker doing each turn once, in one aggregation by session.

    assigned: by, worker, session. expected: by, session. generated: by, worker, session, turn.
    """
    mark = lambda rows, a, e: rows.select(*by, "session", F.lit(a).alias("a"), F.lit(e).alias("e"), F.col("worker").cast("string").alias("worker"), F.col("turn").cast("long").alias("turn"))
    none = F.lit(None)
    rows = mark(assigned.withColumn("turn", none), 1, 0).unionByName(mark(expected.withColumns({"worker": none, "turn": none}), 0, 1)).unionByName(mark(generated, 0, 0))
    each = F.struct("worker", "turn")
    met = rows.groupBy(*by, "session").agg(
        F.sum("a").alias("a"), F.sum("e").alias("e"), F.array_sort(F.collect_list(F.when(F.col("turn").isNotNull(), each))).alias("done"), F.array_sort(F.collect_set(F.when(F.col("a") == 1, F.col("worker")))).alias("workers")
    )
    due = F.flatten(F.transform("workers", lambda w: F.transform(F.array(*[F.lit(t).cast("long") for t in turns]), lambda t: F.struct(w.alias("worker"), t.alias("turn")))))
    checks = {"assigned twice": F.col("a") > 1, "omitted": (F.col("e") > 0) & (F.col("a") == 0), "unexpected": (F.col("e") == 0) & (F.col("a") > 0), "turns differ": F.col("done") != due}
    return met.select(*by, "session", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))).alias("violation"))


def start_lags(workers: DataFrame, by: list[str], most: float = 0.1) -> DataFrame:
    """(by, start_lag, late) of workers (by, worker, started seconds): how long after the first of its batch the last one starts, and how many start more than `most` after it. The first is one row a batch, joined back."""
    first = workers.groupBy(*by).agg(F.min("started").alias("first"))
    return workers.join(first, by).groupBy(*by).agg(F.max(F.col("started") - F.col("first")).alias("start_lag"), F.count_if(F.col("started") - F.col("first") > most).alias("late"))


def conflicting_answers(traces: DataFrame, key: str, raw: str) -> DataFrame:
    """Requests with more than one distinct answer: a conflict, never a choice."""
    return traces.groupBy(key).agg(F.count_distinct(raw).alias("answers")).where("answers > 1")


def mismatches(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keys of both sides with a column that differs (null is equal to null), a row for each such column."""
    a = left.select(*key, *[F.col(c).cast("string").alias(f"l_{c}") for c in columns])
    b = right.select(*key, *[F.col(c).cast("string").alias(f"r_{c}") for c in columns])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"l_{c}").alias("left"), F.col(f"r_{c}").alias("right")) for c in columns])
    return a.join(b, key).select(*key, F.explode(F.filter(each, lambda s: ~s["left"].eqNullSafe(s["right"]))).alias("d")).select(*key, "d.*")


def compare_inventories(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows that are on one side only or differ, with a reason."""
    a, b = (side.select(*key, F.struct(*columns).alias(name)) for side, name in ((left, "l"), (right, "r")))
    joined = a.join(b, key, "full_outer")
    reason = F.when(F.col("l").isNull(), "only right").when(F.col("r").isNull(), "only left")
    for c in columns:
        reason = reason.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), f"{c} differs")
    return joined.select(*key, reason.alias("reason")).where("reason is not null")


def contract(rows: DataFrame, key: list[str], not_null: list[str], finite: list[str]) -> DataFrame:
    """(rule, violations) of a table contract, in one pass for the columns and one for the key."""
    nulls = {f"null {c}": F.count_if(F.col(c).isNull()) for c in not_null}
    odd = {f"not finite {c}": F.count_if(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))) for c in finite}
    checks = nulls | odd
    values = rows.agg(*[c.alias(f"c{k}") for k, c in enumerate(checks.values())])
    listed = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"c{k}").alias("violations")) for k, name in enumerate(checks)])
    out = values.select(F.explode(listed).alias("v")).select("v.*")
    return out.unionByName(duplicate_keys(rows, key).agg(F.lit("duplicate key").alias("rule"), F.count("*").alias("violations")))


def dictionary(rows: DataFrame) -> DataFrame:
    """(column, type, nullable, n_rows): what each text column could be read as, whether nulls occur; one pass."""
    kinds = [("long", "bigint"), ("double", "double")]
    parts = []
    for c in rows.columns:
        text = F.col(c).cast("string")
        parts += [F.bool_or(text.isNull()).alias(f"{c}__null")] + [F.bool_and(text.isNull() | text.try_cast(k).isNotNull()).alias(f"{c}__{name}") for name, k in kinds]
    one = rows.agg(F.count("*").alias("n_rows"), *parts)
    described = [
        F.struct(
            F.lit(c).alias("column"), F.when(F.col(f"{c}__long"), "integer").when(F.col(f"{c}__double"), "number").otherwise("text").alias("type"), F.col(f"{c}__null").alias("nullable"), F.col("n_rows")
        )
        for c in rows.columns
    ]
    return one.select(F.explode(F.array(*described)).alias("d")).select("d.*")


def union_checks(checks: dict[str, DataFrame], detail: Column | None = None) -> DataFrame:
    """(check, violations) of several violation tables."""
    counted = [df.agg(F.lit(name).alias("check"), F.count("*").alias("violations")) for name, df in checks.items()]
    return reduce(DataFrame.unionByName, counted)
