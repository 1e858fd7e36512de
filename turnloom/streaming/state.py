"""Stateful streams over transformWithState: session gates that expire, ratings by version, rows behind the watermark.

The processors' state is in the RocksDB state store, so it grows with the open sessions and items, not with the memory of a task. Times
come in as milliseconds of a plain column (no name here begins with an underscore: rows come as named tuples): a row behind the watermark reaches the processor, which reports it, instead of being dropped
without a trace.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DAY_MS = 86_400_000


class _Gate(StatefulProcessor):
    """A bit for each turn that has come, the latest time of a turn, the time at which the session expires, and whether it has been passed on."""

    def __init__(self, key: str, n_turns: int, timeout_ms: int):
        self.key, self.n_turns, self.timeout_ms = key, n_turns, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.turns = handle, handle.getValueState("turns", "seen long, last long, expires long, sent boolean")

    def _row(self, key: tuple, outcome: str, turns: list[int]) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "outcome": [outcome], "turns": [turns]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        seen, last, expires, sent = self.turns.get() if self.turns.exists() else (0, -1, -1, False)
        on_time = False
        for frame in rows:
            late = frame["ms_"] <= watermark
            for turn in sorted(frame["turn"][late]):
                yield self._row(key, "late", [int(turn)])
            for turn, ms in zip(frame["turn"][~late], frame["ms_"][~late], strict=True):
                on_time, last = True, max(last, int(ms))
                if 0 <= turn < self.n_turns:
                    seen |= 1 << int(turn)
        if not on_time:
            return
        if not sent and seen == (1 << self.n_turns) - 1:
            sent = True
            yield self._row(key, "complete", [])
        if last + self.timeout_ms != expires:
            if expires >= 0:
                self.handle.deleteTimer(expires)
            expires = last + self.timeout_ms
            self.handle.registerTimer(expires)
        self.turns.update((seen, last, expires, sent))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.turns.exists():
            seen, _, _, sent = self.turns.get()
            self.turns.clear()
            if not sent:
                yield self._row(key, "expired", [t for t in range(self.n_turns) if not seen >> t & 1])

    def close(self) -> None:
        pass


def _millis(rows: DataFrame, time: str) -> DataFrame:
    return rows.withColumn("ms_", F.unix_millis(F.col(time).cast("timestamp")))


def expiring_gate(turns: DataFrame, key: str, n_turns: int, time: str, timeout_ms: int, delay: str = "0 seconds") -> DataFrame:
    """(key, outcome, turns) of a stream of turns (rows without key or turn move the watermark only): 'complete' once turns 0 to n_turns - 1 have come, in any order; 'expired' with the list of the missing ones when no turn came for the timeout; 'late' with a turn that came behind the watermark.

    A session's state goes when it expires; until then a complete one is remembered, so that a turn that comes twice does not open it again.
    """
    marked = _millis(turns.withWatermark(time, delay), time).select(key, F.col("turn").cast("long").alias("turn"), "ms_")
    marked = marked.where(F.when(F.col(key).isNotNull() & F.col("turn").isNotNull(), F.col("ms_")).isNotNull())
    schema = f"{key} {turns.schema[key].dataType.simpleString()}, outcome string, turns array<long>"
    return marked.groupBy(key).transformWithStateInPandas(_Gate(key, n_turns, timeout_ms), schema, "Append", "EventTime")


def counted(columns: list[str], time: str) -> Column:
    """True for rows with a time and any of the columns; others only move the watermark. The condition reads the time so that it stays above the watermark in the plan."""
    return F.when(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull(), F.col(time)).isNotNull()


class _Late(StatefulProcessor):
    """No state: passes on the rows whose window had ended when they came."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            behind = frame[frame["ms_"] <= watermark]
            if len(behind):
                yield behind[self.columns]

    def close(self) -> None:
        pass


def late_rows(events: DataFrame, time: str, width: str, delay: str, columns: list[str], spread: int = 64) -> DataFrame:
    """The rows that `tumbling_counts` with the same window and delay leaves out, with `start` of their window."""
    windowed = events.withWatermark(time, delay).withColumn("w_", F.window(time, width))
    plain = windowed.where(counted(columns, time)).select(*columns, F.unix_millis("w_.start").alias("start_ms"), F.unix_millis("w_.end").alias("ms_"))
    dealt = plain.withColumn("k_", F.pmod(F.xxhash64(*columns, "start_ms"), F.lit(spread)))
    schema = ", ".join([*(f"{c} {events.schema[c].dataType.simpleString()}" for c in columns), "start_ms long"])
    found = dealt.groupBy("k_").transformWithStateInPandas(_Late([*columns, "start_ms"]), schema, "Append", "EventTime")
    return found.select(F.timestamp_millis("start_ms").alias("start"), *columns)


#: Items are dealt to this many groups of state, so that the calls of a batch don't grow with the items. Part of a query's checkpoint.
BUCKETS = 1024


def bucket_of(key: str, buckets: int) -> Column:
    """The group of an item; items without a key have one of their own."""
    return F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")


class _Ratings(StatefulProcessor):
    """Of each item of a bucket the last version in time order, the best rating so far, the number of conflicts and the time of the last update; beside them a list of the conflicting updates. An item that has been left alone is forgotten, also if others of its bucket are not.

    One call handles all items of a bucket that a batch has, and reads and writes the state once.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ratings = handle.getValueState("ratings", "item array<string>, last array<long>, version array<long>, place array<string>, value array<string>, conflicts array<long>, at array<long>", self.ttl_ms)
        self.conflicts = handle.getListState("conflicts", "item string, place string, version long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = int(timerValues.getCurrentProcessingTimeInMs())
        kept = zip(*self.ratings.get(), strict=True) if self.ratings.exists() else ()
        known = {item: state for item, *state in kept if self.ttl_ms is None or state[-1] + self.ttl_ms > now}
        touched, found = set(), []
        columns = ["item_", "version_", "place_", "value_"]
        for item, claimed, own, said in pd.concat(list(rows)).sort_values("place_")[columns].itertuples(index=False):
            last, best, place, value, n, _ = known.get(item, (None, None, "", None, 0, now))
            if last is not None and claimed != last + 1:
                n += 1
                found.append((item, own, int(claimed), said))
            last = int(claimed)
            if best is None or (last, own) > (best, place):
                best, place, value = last, own, said
            known[item] = (last, best, place, value, n, now)
            touched.add(item)
        if found:
            self.conflicts.appendList([f[:3] for f in found])
        items = list(known)
        self.ratings.update((items, *map(list, zip(*known.values(), strict=True))))
        latest = [(item, "latest", known[item][3], known[item][1], known[item][4]) for item in items if item in touched]
        conflicts = [(item, "conflict", said, claimed, known[item][4]) for item, _, claimed, said in found]
        yield pd.DataFrame(latest + conflicts, columns=["item_", "kind", "said_", "version", "conflicts"])

    def close(self) -> None:
        pass


def rating_changes(events: DataFrame, key: str, order: list[str], version: str, value: str, ttl_ms: int | None = 90 * DAY_MS, buckets: int = BUCKETS) -> DataFrame:
    """Of each batch and item one row of kind 'latest' (the rating of the highest version, the last in order among equals, and the number of conflicts), and one of kind 'conflict' for each update whose version did not follow the one before it.

    Updates count in the order of `order` (a time, then whole numbers) within a batch, batch after batch. An item without updates for the ttl (of processing time) is forgotten. The key goes
    through the state as text, so its type must be one that text gives back.
    """
    time, *numbers = order
    # one text that sorts like the columns: microseconds and numbers with leading zeros
    place = F.concat_ws("|", *[F.lpad(x.cast("string"), 20, "0") for x in (F.unix_micros(F.col(time).cast("timestamp")), *[F.col(c).cast("long") for c in numbers])])
    kept = events.select(bucket_of(key, buckets).alias("bucket_"), F.col(key).cast("string").alias("item_"), F.col(version).cast("long").alias("version_"), place.alias("place_"), F.col(value).cast("string").alias("value_"))
    schema = "item_ string, kind string, said_ string, version long, conflicts long"
    changes = kept.groupBy("bucket_").transformWithStateInPandas(_Ratings(ttl_ms), schema, "Update", "ProcessingTime")
    return changes.select(F.col("item_").cast(events.schema[key].dataType).alias(key), "kind", F.col("said_").alias(value), "version", "conflicts")
