"""Streams that stop and start again between arrivals: merged tables, expiring gates, ratings, closed windows."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnloom.operators import ranking
from turnloom.sources.shared import new_folder
from turnloom.streaming import logs, state
from turnloom.streaming.merge import MergedTable

START = datetime(2024, 1, 1)


def _at(seconds):
    return START + timedelta(seconds=seconds)


def _counts(spark, compact_every):
    schema = spark.createDataFrame([], "k string, n long").schema
    table = MergedTable(spark, new_folder(spark, "merged"), schema, ["k"], compact_every)
    return table, lambda rows, batch: table.apply(spark.createDataFrame(rows, schema), batch), lambda: {r.k: r.n for r in table.read().collect()}


def test_merged_table(spark):
    table, apply, read = _counts(spark, 2)
    assert read() == {}
    assert apply([("a", 1), ("b", 1)], 0) and apply([("a", 3), (None, 4)], 1)
    assert read() == {"a": 3, "b": 1, None: 4}
    # batch 2 makes a base of three batches
    assert apply([("c", 9)], 2) and table._journal().where("base").count() == 1
    assert apply([("a", 5)], 3) and len(table._parts()) == 2
    assert read() == {"a": 5, "b": 1, "c": 9, None: 4}


def test_batch_that_comes_again(spark):
    table, apply, read = _counts(spark, 20)
    apply([("a", 1)], 0)
    assert not apply([("a", 100)], 0) and read() == {"a": 1}
    # written, but not in the journal: the writer broke off; the batch comes again
    spark.createDataFrame([("a", 50, 1)], "k string, n long, _batch long").write.parquet(f"{table.folder}/batch-1")
    assert read() == {"a": 1}
    assert apply([("a", 2)], 1) and read() == {"a": 2}


def test_counts_after_lost_commit(spark):
    """The query's own log loses its last batch, as when it dies after the merge: the batch runs again, and the counts stay."""
    table, _, read = _counts(spark, 20)
    schema = spark.createDataFrame([], "k string").schema
    counted = lambda stream: stream.groupBy("k").agg(F.count("*").alias("n"))
    replay = logs.Replay(spark, schema, lambda s: logs.merged(table)(counted(s)), "counts")
    replay.arrive(spark.createDataFrame([("a",), ("a",), ("b",)], schema))
    replay.arrive(spark.createDataFrame([("a",)], schema))
    want = {"a": 3, "b": 1}
    assert read() == want
    last = max(r.batch for r in table._journal().collect())
    hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{replay.state}/commits/{last}")
    assert path.getFileSystem(hadoop).delete(path, False)
    journal = table._journal().count()
    replay.run()
    assert read() == want and table._journal().count() == journal


TURNS = "session string, turn long, at timestamp"


def test_expiring_gate(spark):
    out = new_folder(spark, "gates")
    schema = spark.createDataFrame([], TURNS).schema
    replay = logs.Replay(spark, schema, lambda s: logs.appended(out)(state.expiring_gate(s, "session", 3, "at", 100_000)), "turns")
    arrive = lambda *rows: replay.arrive(spark.createDataFrame([(s, t, _at(x)) for s, t, x in rows], schema))
    got = lambda: sorted((r.session, r.outcome, r.turns) for r in spark.read.schema("session string, outcome string, turns array<long>").parquet(out).collect())
    arrive(("full", 2, 0), ("full", 0, 10), ("gap", 0, 5), ("gap", 2, 6), ("slow", 0, 50))
    assert got() == []
    arrive(("full", 1, 60), ("full", 1, 61), ("slow", 1, 120), ("odd", 7, 100))
    assert got() == [("full", "complete", []), ("gap", "expired", [1])]
    # behind the watermark of 120 s; the expired session is not opened again
    arrive(("gap", 1, 30), ("slow", 2, 180))
    assert ("gap", "late", [1]) in got() and ("slow", "complete", []) in got()
    arrive((None, None, 10_000))
    assert got() == [("full", "complete", []), ("gap", "expired", [1]), ("gap", "late", [1]), ("odd", "expired", [0, 1, 2]), ("slow", "complete", [])]
    assert [s["numRowsTotal"] for s in replay.progress[-1]["stateOperators"]] == [0]


@pytest.mark.parametrize("arrivals", [1, 3])
def test_ratings_equal_the_batch(spark, arrivals):
    """However the updates fall into arrivals in their order, the stream has the result of the batch operator."""
    rows = [(u, u * 100 + k, f"v{k % 3}", k + (2 if k % 5 == 0 else 0), _at(60 * k + u)) for u in range(6) for k in range(3 * u + 1)]
    df = spark.createDataFrame(rows, "item long, event long, said string, version long, at timestamp")
    table = MergedTable(spark, new_folder(spark, "latest"), spark.createDataFrame([], "item long, said string, version long, conflicts long").schema, ["item"])
    changes = new_folder(spark, "changes")
    replay = logs.Replay(spark, df.schema, lambda s: logs.merged(table, changes, "kind = 'latest'")(state.rating_changes(s, "item", ["at", "event"], "version", "said")), "ratings", processing_time=True)
    for k in range(arrivals):
        replay.arrive(df.where(F.least(F.floor((F.unix_timestamp("at") - START.timestamp()) / 300), F.lit(arrivals - 1)) == k))
    want = ranking.latest_by_version(df, ["item"], "version", ["at", "event"])
    columns = ["item", "said", "version", "conflicts"]
    assert sorted(map(tuple, table.read().select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    kept = spark.read.schema("item long, kind string, said string, version long, conflicts long").parquet(f"{changes}/batch=*")
    assert kept.where("kind = 'conflict'").count() == want.agg(F.sum("conflicts")).first()[0]


def test_closed_windows_and_late_rows(spark):
    schema = spark.createDataFrame([], "kind string, at timestamp").schema
    out, behind = new_folder(spark, "windows"), new_folder(spark, "behind")
    counting = logs.Replay(spark, schema, lambda s: logs.appended(out)(logs.tumbling_counts(s, "at", "1 minute", ["kind"], "30 seconds")), "events")
    late = logs.Replay(spark, schema, lambda s: logs.appended(behind)(state.late_rows(s, "at", "1 minute", "30 seconds", ["kind"])), "events")
    late.folder = counting.folder
    for rows in ([("a", 10), ("a", 100), ("b", 30)], [("a", 59), ("b", 61), ("b", 200)], [(None, 9000)]):
        counting.arrive(spark.createDataFrame([(k, _at(x)) for k, x in rows], schema))
        late.run()
    got = sorted((r.start, r.kind, r.n) for r in spark.read.schema("start timestamp, kind string, n long").parquet(out).collect())
    # the mark stands at 70 s when the second rows come: 59 s is behind its window, 61 s is not
    assert got == [(_at(0), "a", 1), (_at(0), "b", 1), (_at(60), "a", 1), (_at(60), "b", 1), (_at(180), "b", 1)]
    assert [(r.start, r.kind) for r in spark.read.schema("start timestamp, kind string").parquet(behind).collect()] == [(_at(0), "a")]


def test_run_tree_by_tasks(spark):
    """Files of one folder a session are written by as many tasks as asked for, whole, and found by a listing of tasks."""
    from turnloom.sources import files

    root = new_folder(spark, "tree")
    rows = spark.range(300).select(F.concat(F.lit("session="), "id").alias("folder"), F.lit("turns.json").alias("name"), F.encode(F.concat(F.lit('{"turn": '), "id", F.lit("}")), "UTF-8").alias("content"))
    receipts = files.publish_folders(rows.repartition(8, "folder"), root)
    assert receipts.rdd.getNumPartitions() == 8 and receipts.agg(F.sum("bytes")).first()[0] == 300 * 10 + 10 + 2 * 90 + 3 * 200
    found = spark.read.schema("turn long").option("recursiveFileLookup", True).json(root)
    at = F.regexp_extract(F.col("_metadata.file_path"), r"session=(\d+)/", 1).cast("long")
    assert found.where(at == F.col("turn")).count() == found.count() == 300


def test_ratings_by_bucket(spark):
    """Many items cost no more groups of state than there are buckets; an item without a key and items of one bucket stay apart."""
    rows = [(None if u == 0 else 2**60 + u, u * 100 + k, f"v{k}", k + (1 if (u + k) % 5 == 0 else 0), _at(60 * k + u)) for u in range(40) for k in range(4)]
    df = spark.createDataFrame(rows, "item long, event long, said string, version long, at timestamp")
    table = MergedTable(spark, new_folder(spark, "latest"), spark.createDataFrame([], "item long, said string, version long, conflicts long").schema, ["item"])
    replay = logs.Replay(spark, df.schema, lambda s: logs.merged(table, new_folder(spark, "changes"), "kind = 'latest'")(state.rating_changes(s, "item", ["at", "event"], "version", "said", buckets=3)), "ratings", processing_time=True)
    replay.arrive(df.where("event % 100 < 2"))
    replay.arrive(df.where("event % 100 >= 2"))
    want = ranking.latest_by_version(df, ["item"], "version", ["at", "event"])
    columns = ["item", "said", "version", "conflicts"]
    key = lambda r: str(tuple(r))
    assert sorted(map(key, table.read().select(*columns).collect())) == sorted(map(key, want.select(*columns).collect()))
    batches = [p for p in replay.progress if p["numInputRows"]]
    # the keys of the state that a batch writes: a value and a list of each bucket, and one bucket without a key
    assert len(batches) == 2 and all(s["numRowsTotal"] < 40 for p in batches for s in p["stateOperators"])


def test_ratings_forget_by_item(spark):
    """An item left alone for the ttl begins anew, though another of its bucket was updated meanwhile."""

    class Store:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        def appendList(self, rows):
            pass

    class Clock:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentProcessingTimeInMs(self):
            return self.ms

    ratings = state._Ratings(100)
    ratings.ratings, ratings.conflicts = Store(), Store()

    def run(ms, *rows):
        frame = pd.DataFrame(rows, columns=["item_", "version_", "place_", "value_"])
        return [tuple(r) for out in ratings.handleInputRows((0,), iter([frame]), Clock(ms)) for r in out[["item_", "kind", "version", "conflicts"]].itertuples(index=False)]

    run(0, ("a", 1, "0", "x"), ("b", 1, "0", "x"))
    run(90, ("b", 2, "1", "x"))
    assert run(150, ("a", 9, "2", "y"), ("b", 4, "2", "y")) == [("b", "latest", 4, 1), ("a", "latest", 9, 0), ("b", "conflict", 4, 1)]


def test_stale_updates_by_bucket(spark):
    schema = spark.createDataFrame([], "item long, at long, claimed long").schema
    rows = [(None if u == 0 else 2**60 + u, 10 * u + k, k - (k > 1)) for u in range(40) for k in range(4)]
    out = new_folder(spark, "checked")
    replay = logs.Replay(spark, schema, lambda s: logs.appended(out)(logs.versioned_updates(s, "item", ["at"], "claimed", ["at"], buckets=3)), "updates")
    for part in (0, 1):
        replay.arrive(spark.createDataFrame([r for r in rows if (r[1] % 10) // 2 == part], schema))
    got = {r["at"]: (r.item, r.accepted, r.version) for r in spark.read.schema("item long, at long, accepted boolean, version long").parquet(out).collect()}
    # claims 0, 1, 1, 2 of each item: the second 1 is stale
    assert got == {at: (item, at % 10 != 2, [1, 2, 2, 3][at % 10]) for item, at, _ in rows}
    assert max(s["numRowsTotal"] for p in replay.progress for s in p["stateOperators"]) <= 4
