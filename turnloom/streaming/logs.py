"""Append logs as streams: first answers, running counts, feeds, latest ratings, session gates. Each has the result of its batch form."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnloom.sources.shared import new_folder
from turnloom.streaming.merge import MergedTable
from turnloom.streaming.state import BUCKETS, PROVIDER, bucket_of, counted


def stream_of(spark: SparkSession, path: str, files_each: int = 1) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream of its files. The stream's base must be a folder unless the path is a pattern, so it is made one."""
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_each).parquet(pattern)


def drain(stream: DataFrame, name: str, key: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that has arrived and gives what its sink holds: appended rows, or with a key the last row of each in a merged table."""
    spark = stream.sparkSession
    out = new_folder(spark, name)
    table = MergedTable(spark, out, stream.schema, key) if key else None
    writer = merged(table)(stream) if table else appended(out)(stream)
    with _settings(spark):
        writer.option("checkpointLocation", new_folder(spark, f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return table.read() if table else spark.read.schema(stream.schema).parquet(out)


@contextmanager
def _settings(spark: SparkSession, processing_time: bool = False) -> Iterator[None]:
    """For the queries started inside: the state store that transformWithState needs. With timers of processing time every batch asks for another without data, so that a run over what is there would not end; these are left out."""
    wanted = dict([PROVIDER]) | ({"spark.sql.streaming.noDataMicroBatches.enabled": "false"} if processing_time else {})
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Replay:
    """A stream over a folder that grows: each call of `arrive` appends rows and runs the query over what is new, from its checkpoint, as a job that is started again and again would.

    A query may thus be stopped between any two arrivals. start: takes the stream and gives its writer, without checkpoint and trigger.
    """

    def __init__(self, spark: SparkSession, schema, start: Callable[[DataFrame], object], name: str, files_each: int | None = None, processing_time: bool = False):
        self.spark, self.schema, self.start, self.files_each, self.processing_time = spark, schema, start, files_each, processing_time
        self.folder, self.state = new_folder(spark, name), new_folder(spark, f"{name}-state")
        self.progress: list[dict] = []

    def arrive(self, rows: DataFrame) -> StreamingQuery:
        rows.write.mode("append").parquet(self.folder)
        return self.run()

    def run(self) -> StreamingQuery:
        reader = self.spark.readStream.schema(self.schema)
        if self.files_each:
            reader = reader.option("maxFilesPerTrigger", self.files_each)
        with _settings(self.spark, self.processing_time):
            query = self.start(reader.parquet(self.folder)).option("checkpointLocation", self.state).trigger(availableNow=True).start()
            query.awaitTermination()
        self.progress += [dict(p) if isinstance(p, dict) else p.jsonValue for p in query.recentProgress]
        return query


def snapshots(progress: list[dict], name: str) -> list[tuple]:
    """(batch, metrics...) of the observation `name` in each batch that had rows."""
    return [(p["batchId"], *p["observedMetrics"][name].asDict().values()) for p in progress if p["numInputRows"]]


def appended(folder: str) -> Callable[[DataFrame], Callable]:
    """A writer of rows that never change, for Replay."""
    return lambda stream: stream.writeStream.outputMode("append").format("parquet").option("path", folder)


def merged(table: MergedTable, changes: str | None = None, where: str | None = None):
    """A writer of changed rows into a keyed table, for Replay. changes: a folder that keeps all rows of a batch, of which those that meet `where` go into the table.

    The batch is evaluated once, by one write: its state must not be computed a second time.
    """

    def batch_of(rows: DataFrame, batch: int) -> None:
        if changes is not None:
            path = f"{changes}/batch={batch}"
            rows.write.mode("overwrite").parquet(path)
            rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
        if not table.apply(rows if where is None else rows.where(where), batch) and changes is None:
            # merged before, but the state of the query has to come to the same point
            rows.write.format("noop").mode("overwrite").save()

    return lambda stream: stream.writeStream.outputMode("update").foreachBatch(batch_of)


def first_answers(events: DataFrame, key: list[str]) -> DataFrame:
    """The first row of each key to arrive; later ones are dropped."""
    return events.dropDuplicates(key)


def first_answers_within(events: DataFrame, key: list[str], time: str, bound: str) -> DataFrame:
    """The same with state bounded by a watermark."""
    return events.withWatermark(time, bound).dropDuplicatesWithinWatermark(key)


def running_counts(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by).count()


def latest_ratings(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("updates"))


def session_gate(turns: DataFrame, key: str, n_turns: int) -> DataFrame:
    """(key, turns) once turns 0 to n_turns - 1 of a session have arrived, in any order; a gap keeps it open."""

    def gate(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, sent = state.get if state.exists else (0, False)
        for frame in frames:
            for t in frame["turn"]:
                if 0 <= t < n_turns:
                    seen |= 1 << int(t)
        ready = seen == (1 << n_turns) - 1
        state.update((seen, sent or ready))
        if ready and not sent:
            yield pd.DataFrame({key: [k[0]], "turns": [n_turns]})

    grouped = turns.select(key, "turn").groupBy(key)
    return grouped.applyInPandasWithState(gate, f"{key} {turns.schema[key].dataType.simpleString()}, turns long", "seen long, sent boolean", "append", GroupStateTimeout.NoTimeout)


def versioned_updates(events: DataFrame, key: str, order: list[str], version: str, kept: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(key, kept, accepted, version) of every update: one whose version is not the stored one is stale and changes nothing; an accepted one raises it by one.

    The state is one number for each item, kept by bucket of items, so that a batch needs a call for each bucket and not for each item. Updates of an item count in the order of `order` within a
    batch, and batch after batch.
    """

    def check(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(order)
        accepted, versions = [], []
        for item, claimed in zip(rows["item_"], rows[version], strict=True):
            now = stored.get(item, 0)
            accepted.append(bool(claimed == now))
            stored[item] = now + accepted[-1]
            versions.append(stored[item])
        state.update((list(stored), list(stored.values())))
        yield rows[[key, *kept]].assign(accepted=accepted, version=versions)

    columns = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in [key, *kept])
    dealt = events.select(bucket_of(key, buckets).alias("bucket_"), F.col(key).cast("string").alias("item_"), *dict.fromkeys([key, *kept, *order, version]))
    return dealt.groupBy("bucket_").applyInPandasWithState(check, f"{columns}, accepted boolean, version long", "item array<string>, stored array<long>", "append", GroupStateTimeout.NoTimeout)


def tumbling_counts(events: DataFrame, time: str, width: str, by: list[str], late: str = "1 day") -> DataFrame:
    """Rows of windows, whole in append mode once the watermark has passed them. A row without any of `by` moves the watermark and is not counted."""
    return events.withWatermark(time, late).where(counted(by, time)).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")
