"""Queries that replay a table as a stream, and queries that write a table in a session format and read it back."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.operators import session_tables
from turnloom.plans.base import query, table
from turnloom.plans.histories import ASKED, asked
from turnloom.sources import files, pictures, sessions
from turnloom.sources.shared import new_folder, stored
from turnloom.streaming import logs, state
from turnloom.streaming.merge import MergedTable


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.stream_of(spark, f"{sf_dir}/events.parquet")


#: Events in three arrivals by time; a fiftieth of the first arrive with the last.
ARRIVALS = """
ends AS (SELECT min(epoch_ns(ts) // 1000000) AS a, max(epoch_ns(ts) // 1000000) AS b FROM events),
arrivals AS (SELECT e.*, epoch_ns(ts) // 1000000 AS ms, CASE WHEN (epoch_ns(ts) // 1000000 - a) * 3 // (b - a + 1) = 0 AND event_id % 50 = 0 THEN 2 ELSE (epoch_ns(ts) // 1000000 - a) * 3 // (b - a + 1) END AS arrival FROM events e, ends)"""


def _arrivals(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ms = F.unix_millis("ts")
    # one row
    a, b = events.agg(F.min(ms), F.max(ms)).first()
    third = F.floor((ms - a) * 3 / (b - a + 1))
    arrival = F.when((third == 0) & (F.col("event_id") % 50 == 0), 2).otherwise(third)
    return [events.where(arrival == k) for k in range(3)]


def _heartbeat(rows: DataFrame, time: str) -> DataFrame:
    """A row long after all others, with nothing but a time."""
    last = rows.agg((F.max(time) + F.expr("INTERVAL 3650 DAYS")).alias(time))
    return last.select(*[F.col(c) if c == time else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])


@query("k1_first_answers", "SELECT DISTINCT user_id, event_type FROM events")
def k1_first_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of what has been seen lasts from one start of the query to the next."""
    parts, out = _arrivals(spark, sf_dir), new_folder(spark, "first-answers")
    replay = logs.Replay(spark, parts[0].schema, lambda s: logs.appended(out)(logs.first_answers(s, ["user_id", "event_type"]).select("user_id", "event_type")), "answer-events")
    for rows in parts:
        replay.arrive(rows)
    return spark.read.schema("user_id long, event_type string").parquet(out)


@query("k2_running_counts", "SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def k2_running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update mode into a merged table, over three arrivals, the query started anew for each."""
    parts, folder = _arrivals(spark, sf_dir), new_folder(spark, "running-counts")
    counts = MergedTable(spark, folder, spark.createDataFrame([], "event_type string, count long").schema, ["event_type"], compact_every=2)
    replay = logs.Replay(spark, parts[0].schema, lambda stream: logs.merged(counts)(logs.running_counts(stream, ["event_type"])), "count-events")
    for rows in parts:
        replay.arrive(rows)
    return counts.read()


@query("k3_review_feed", "SELECT event_id, user_id FROM events WHERE event_id % 5 = 0 OR value < 1")
def k3_review_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, out = _arrivals(spark, sf_dir), new_folder(spark, "review-feed")
    replay = logs.Replay(spark, parts[0].schema, lambda s: logs.appended(out)(s.where("event_id % 5 = 0 or value < 1").select("event_id", "user_id")), "feed-events", files_each=2)
    for rows in parts:
        replay.arrive(rows)
    return spark.read.schema("event_id long, user_id long").parquet(out)


@query("k4_latest_ratings", "SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type, count(*) AS updates FROM events GROUP BY user_id")
def k4_latest_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.drain(logs.latest_ratings(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type"), "latest-ratings", ["user_id"])


@query(
    "k4_stale_updates",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, event_id % 5 AS claimed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS version, CAST(NULL AS BIGINT) AS event_id, false AS accepted FROM e
UNION ALL SELECT e.user_id, e.k, f.version + CAST(e.claimed = f.version AS BIGINT), e.event_id, e.claimed = f.version FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, event_id, accepted, version FROM f WHERE k > 0""",
)
def k4_stale_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that claim a version, in several batches: the earlier half of the time is written first, each user's rows in one file."""
    folder = new_folder(spark, "updates")
    rows = table(spark, sf_dir, "events").withColumn("claimed", F.col("event_id") % 5)
    ends = rows.agg(F.min("ts").cast("timestamp").cast("double").alias("a"), F.max("ts").cast("timestamp").cast("double").alias("b")).first()
    late = F.col("ts").cast("timestamp").cast("double") >= (ends.a + ends.b) / 2
    for part in (~late, late):
        rows.where(part).repartition(2, "user_id").write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return logs.drain(logs.versioned_updates(stream, "user_id", ["ts", "event_id"], "claimed", ["event_id"]), "updates-checked")


_VERSIONS = "versions AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS version FROM events)"


def _rating_stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(latest ratings, conflicts) out of one stream: each user's numbered events in three arrivals by time, the query started anew for each."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.select("user_id", "event_id", "event_type", "ts", (F.row_number().over(by_user) + F.when(F.col("event_id") % 17 == 0, 1).otherwise(0)).cast("long").alias("version"))
    rows = stored(rows.withColumn("value", F.concat_ws(":", F.col("event_id").cast("string"), "event_type")), "numbered-events")
    ms = F.unix_millis("ts")
    # one row
    a, b = rows.agg(F.min(ms), F.max(ms)).first()
    folder, rest = new_folder(spark, "ratings"), new_folder(spark, "rating-changes")
    schema = spark.createDataFrame([], "user_id long, value string, version long, conflicts long").schema
    latest = MergedTable(spark, folder, schema, ["user_id"], compact_every=2)

    def start(stream: DataFrame):
        changes = state.rating_changes(stream, "user_id", ["ts", "event_id"], "version", "value")
        return logs.merged(latest, rest, "kind = 'latest'")(changes)

    replay = logs.Replay(spark, rows.schema, start, "rating-events", processing_time=True)
    for k in range(3):
        replay.arrive(rows.where(F.floor((ms - a) * 3 / (b - a + 1)) == k))
    conflicts = spark.read.schema("user_id long, kind string, value string, version long, conflicts long").parquet(f"{rest}/batch=*").where("kind = 'conflict'")
    return latest.read(), conflicts


@query("k4_versioned_ratings", f"WITH {_VERSIONS}, c AS (SELECT *, version <> lag(version) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1 AS conflict, row_number() OVER (PARTITION BY user_id ORDER BY version DESC, ts DESC, event_id DESC) AS k FROM versions) SELECT user_id, max(event_id || ':' || event_type) FILTER (WHERE k = 1) AS rating, max(version) AS version, count(*) FILTER (WHERE conflict) AS conflicts FROM c GROUP BY user_id")
def k4_versioned_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rating_stream(spark, sf_dir)[0].withColumnRenamed("value", "rating")


@query("k4_rating_conflicts", f"WITH {_VERSIONS}, c AS (SELECT *, lag(version) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM versions) SELECT user_id, event_id || ':' || event_type AS rating, version FROM c WHERE version <> before + 1")
def k4_rating_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rating_stream(spark, sf_dir)[1].select("user_id", F.col("value").alias("rating"), "version")


@query(
    "k5_expiring_gate",
    """WITH t AS (SELECT conv_id, turn, conv_id * 60000 + turn * 10000 AS ms, conv_id * 3 // (SELECT max(conv_id) + 1 FROM conversations) AS third FROM conversations WHERE NOT (conv_id % 7 = 0 AND turn = 1)),
a AS (SELECT *, CASE WHEN third = 0 AND conv_id % 11 = 0 AND turn = 0 THEN 2 ELSE third END AS arrival FROM t),
w AS (SELECT x.arrival, max(a.ms) - 60000 AS mark FROM (VALUES (1), (2)) AS x(arrival) JOIN a ON a.arrival < x.arrival GROUP BY x.arrival),
m AS (SELECT a.*, coalesce(ms <= mark, false) AS late FROM a LEFT JOIN w USING (arrival)),
s AS (SELECT conv_id, list(DISTINCT turn) FILTER (WHERE turn BETWEEN 0 AND 3) AS seen FROM m WHERE NOT late GROUP BY conv_id)
SELECT conv_id, 'late' AS outcome, CAST(turn AS VARCHAR) AS turns FROM m WHERE late
UNION ALL SELECT conv_id, CASE WHEN len(seen) = 4 THEN 'complete' ELSE 'expired' END, array_to_string(list_filter([0, 1, 2, 3], lambda t: NOT coalesce(list_contains(seen, t), false)), ',') FROM s""",
)
def k5_expiring_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of conversations by event time, in three arrivals; some lack a turn, of some the first turn comes behind the watermark, and a heartbeat ends all."""
    rows = table(spark, sf_dir, "conversations").where("not (conv_id % 7 = 0 and turn = 1)").select("conv_id", "turn", F.timestamp_millis(F.col("conv_id") * 60000 + F.col("turn") * 10000).alias("at"))
    # one row
    n = table(spark, sf_dir, "conversations").agg(F.max("conv_id") + 1).first()[0]
    third = F.floor(F.col("conv_id") * 3 / n)
    arrival = F.when((third == 0) & (F.col("conv_id") % 11 == 0) & (F.col("turn") == 0), 2).otherwise(third)
    out = new_folder(spark, "gate")
    replay = logs.Replay(spark, rows.schema, lambda stream: logs.appended(out)(state.expiring_gate(stream, "conv_id", 4, "at", 300_000, "1 minute")), "gate-turns")
    for k in range(3):
        replay.arrive(rows.where(arrival == k))
    replay.arrive(_heartbeat(rows, "at"))
    return spark.read.schema("conv_id long, outcome string, turns array<long>").parquet(out).select("conv_id", "outcome", F.array_join(F.col("turns").cast("array<string>"), ",").alias("turns"))


_LATE = f"{ARRIVALS}, marks AS (SELECT x.arrival, max(a.ms) - 3600000 AS mark FROM (VALUES (1), (2)) AS x(arrival) JOIN arrivals a ON a.arrival < x.arrival GROUP BY x.arrival), windowed AS (SELECT a.*, date_trunc('hour', ts) AS start, coalesce(epoch_ms(date_trunc('hour', ts)) + 3600000 <= mark, false) AS late FROM arrivals a LEFT JOIN marks USING (arrival))"


@query("k6_closed_windows", f"WITH {_LATE} SELECT start, event_type, late, count(*) AS n FROM windowed GROUP BY ALL")
def k6_closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed, and the rows that came too late for theirs, which go to a table of their own. Two streams over the same arrivals."""
    parts = _arrivals(spark, sf_dir)
    out, behind = new_folder(spark, "closed-windows"), new_folder(spark, "late-rows")
    counting = logs.Replay(spark, parts[0].schema, lambda s: logs.appended(out)(logs.tumbling_counts(s, "ts", "1 hour", ["event_type"], "1 hour")), "window-events")
    # the same folder, read by a second query
    late = logs.Replay(spark, parts[0].schema, lambda s: logs.appended(behind)(state.late_rows(s, "ts", "1 hour", "1 hour", ["event_type", "event_id"])), "window-events")
    late.folder = counting.folder
    for rows in [*parts, _heartbeat(parts[0], "ts")]:
        counting.arrive(rows)
        late.run()
    whole = spark.read.schema("start timestamp, event_type string, n long").parquet(out).withColumn("late", F.lit(False))
    missed = spark.read.schema("start timestamp, event_type string, event_id long").parquet(behind).groupBy("start", "event_type").agg(F.count("*").alias("n"))
    return whole.unionByName(missed.withColumn("late", F.lit(True))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("k6_progress", f"WITH {ARRIVALS} SELECT arrival, count(*) AS n, count(*) FILTER (WHERE value < 1) AS low, max(ms) AS last_ms, sum(count(*)) OVER (ORDER BY arrival) AS so_far FROM arrivals GROUP BY arrival")
def k6_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each batch of a running query saw, observed while it ran."""
    parts, out = _arrivals(spark, sf_dir), new_folder(spark, "observed")
    metrics = [F.count("*").alias("n"), F.count_if(F.col("value") < 1).alias("low"), F.max(F.unix_millis("ts")).alias("last_ms")]
    replay = logs.Replay(spark, parts[0].schema, lambda s: logs.appended(out)(s.observe("seen", *metrics).select("event_id")), "observed-events")
    for rows in parts:
        replay.arrive(rows)
    seen = logs.snapshots(replay.progress, "seen")
    so_far = F.sum("n").over(Window.orderBy("batch"))
    # a row for each batch
    return spark.createDataFrame(seen, "batch long, n long, low long, last_ms long").select(F.col("batch").alias("arrival"), "n", "low", "last_ms", so_far.alias("so_far"))


@query("k5_session_gate", "SELECT conv_id, CAST(4 AS BIGINT) AS turns FROM conversations WHERE turn BETWEEN 0 AND 3 GROUP BY conv_id HAVING count(DISTINCT turn) = 4")
def k5_session_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.drain(logs.session_gate(logs.stream_of(spark, f"{sf_dir}/conversations.parquet"), "conv_id", 4), "session-gate")


@query("k6_streamed_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def k6_streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = logs.drain(logs.tumbling_counts(events, "ts", "1 hour", ["event_type"]), "windows", ["start", "event_type"])
    return counted.withColumn("start", F.col("start").cast("timestamp_ntz"))


_LISTS = f"{ASKED}, lists AS (SELECT session, string_agg(text, '|' ORDER BY turn) AS texts, count(*) AS n FROM asked GROUP BY session)"


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = asked(spark, sf_dir).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return listed.select("session", F.transform("t", lambda s: s["text"]).alias("texts"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("sample_id").cast("long").alias("session"), F.md5(F.array_join("instructions", "|").cast("binary")).alias("texts"), F.size("instructions").cast("long").alias("n"))


@query("a1_three_turn_scan", f"WITH {_LISTS} SELECT session, md5(texts) AS texts, n FROM lists WHERE n = 3")
def a1_three_turn_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions written as JSON lines in two splits; those with another number of turns are violations."""
    folder = new_folder(spark, "three-turns")
    split = F.when(F.col("session") % 2 == 0, "cm").otherwise("cu")
    rows = _lists(spark, sf_dir).select(F.concat(F.col("session").cast("string"), F.lit(".png")).alias("image"), F.col("texts").alias("instruction"), split.alias("split"))
    for name in ("cm", "cu"):
        rows.where(F.col("split") == name).drop("split").write.json(f"{folder}/{name}")
    return _shown(sessions.read_three_turns(spark, folder)[0])


@query("a2_variable_turn_scan", f"WITH {_LISTS} SELECT session, md5(texts) AS texts, n FROM lists WHERE n BETWEEN 2 AND 3 AND session % 5 <> 0")
def a2_variable_turn_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In every fifth session the second turn is left out, which is a gap."""
    folder = new_folder(spark, "variable-turns")
    turn = lambda k: F.when((F.col("session") % 5 == 0) & F.lit(k == 1), None).otherwise(F.get("texts", F.lit(k)))
    rows = _lists(spark, sf_dir).where("size(texts) <= 3 and (session % 5 <> 0 or size(texts) = 3)")
    rows.select(F.col("session").cast("string").alias("id"), *[turn(k).alias(f"turn{k + 1}") for k in range(3)]).write.json(f"{folder}/all")
    return _shown(sessions.read_variable_turns(spark, folder)[0])


@query("a3_prefix_csv_scan", f"WITH {_LISTS} SELECT session, md5(texts) AS texts, n FROM lists WHERE n = 3 AND session % 4 <> 0")
def a3_prefix_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session as three prefixes with list literals; in every fourth the second is in conflict."""
    folder = new_folder(spark, "prefixes")
    prefixes = _lists(spark, sf_dir).where("size(texts) = 3").select("session", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"), "texts")
    own = F.slice("texts", F.lit(1), F.col("k"))
    own = F.when((F.col("session") % 4 == 0) & (F.col("k") == 2), F.transform(own, lambda t: F.concat(t, F.lit("!")))).otherwise(own)
    quoted = F.transform(own, lambda t: F.concat(F.lit("'"), F.replace(F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n")), F.lit("'")))
    rows = prefixes.select(F.col("session").cast("string").alias("image_index"), F.col("k").cast("string").alias("turns"), F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")).alias("instructions"))
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)
    return _shown(sessions.read_prefix_csv(spark, folder)[0])


@query("a4_zip_members", "SELECT 'archive-' || (conv_id // 10) AS archive, conv_id || '_' || turn || '.txt' AS member, CAST(strlen(text) AS BIGINT) AS size, CAST(1 AS BIGINT) AS copies FROM conversations")
def a4_zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of every ten conversations, with a member for each turn, written in tasks and listed again."""

    def archive(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for c, t, text in zip(rows["conv_id"], rows["turn"], rows["text"], strict=True):
                z.writestr(f"{c}_{t}.txt", text)
        return pd.DataFrame({"path": [f"archive-{key[0]}"], "content": [out.getvalue()]})

    turns_ = table(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / 10).alias("ten"), "conv_id", "turn", "text")
    return sessions.zip_members(stored(turns_.groupBy("ten").applyInPandas(archive, "path string, content binary"), "archives"))


@query("a7_array_scan", "SELECT vec_id // 16 AS file, vec_id % 16 AS step, CAST(0 AS BIGINT) AS layer, h AS head, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding[16 * h + 1:16 * h + 16]]), 6) AS total FROM embeddings CROSS JOIN (SELECT unnest(range(4)) AS h)")
def a7_array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of arrays for every sixteen vectors, as steps of four heads, beside one that is not wanted; written in tasks and read as positions."""

    def arrays(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        ordered = rows.sort_values("vec_id")
        np.savez(out, wanted=np.stack(ordered["embedding"]).astype(np.float64).reshape(len(rows), 1, 4, 16), other=np.zeros(3))
        return pd.DataFrame({"path": [str(key[0])], "content": [out.getvalue()]})

    vectors = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("file"), "vec_id", "embedding")
    read = sessions.array_positions(stored(vectors.groupBy("file").applyInPandas(arrays, "path string, content binary"), "arrays"), "wanted")
    return read.select(F.col("file").cast("long").alias("file"), "step", "layer", "head", F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query(
    "a6_image_scan",
    """WITH v AS (SELECT vec_id, 4 + vec_id % 5 AS w, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT) % 256) AS a FROM embeddings),
p AS (SELECT vec_id, w, 64 // w AS h, unnest(range(w * (64 // w))) AS i, a FROM v),
s AS (SELECT vec_id, w, h, string_agg(printf('%02x%02x%02x', a[i + 1], 255 - a[i + 1], a[i + 1] * 7 % 256), '' ORDER BY i) AS hex FROM p GROUP BY ALL)
SELECT 'image-' || vec_id || '.png' AS file, CAST(w AS INT) AS width, CAST(h AS INT) AS height, sha256(encode('RGB:' || w || ':' || h || ':') || unhex(hex)) AS pixel_hash FROM s""",
)
def a6_image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PNG file of every vector, of five shapes, written in tasks and decoded again."""
    folder = new_folder(spark, "images")
    w = (4 + F.col("vec_id") % 5).cast("int")
    sized = table(spark, sf_dir, "embeddings").select("vec_id", w.alias("width"), F.expr("cast(64 div (4 + vec_id % 5) as int)").alias("height"), F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000) % 256).alias("a"))
    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    pixel = F.transform(F.slice("a", F.lit(1), F.col("width") * F.col("height")), lambda v: F.concat(byte(v), byte(255 - v), byte(v * 7 % 256)))
    images = sized.select(F.concat(F.lit("image-"), F.col("vec_id").cast("string")).alias("name"), "width", "height", F.unhex(F.array_join(pixel, "")).alias("rgb"))
    # the files are written here
    stored(pictures.write_images(images, folder), "image-receipts")
    return sessions.read_images(spark, f"{folder}/*").select(F.regexp_extract("origin", "([^/]+)$", 1).alias("file"), "width", "height", "pixel_hash")


_GROUPED = """g AS (SELECT vec_id // 50 AS session, vec_id AS position, j AS g, list_sum([abs(CAST(x AS DOUBLE)) FOR x IN embedding[8 * j + 1:8 * j + 8]]) / list_sum([abs(CAST(x AS DOUBLE)) FOR x IN embedding]) AS m, CASE WHEN (vec_id // 50) % 5 = 0 AND j = 4 THEN 0 ELSE 8 END AS n FROM embeddings CROSS JOIN (SELECT unnest(range(8)) AS j)),
s AS (SELECT session, g, avg(m) AS m, any_value(n) AS n FROM g GROUP BY ALL),
names(kind, name, role, age, gs) AS (VALUES ('group', 'T1', NULL, NULL, [0]), ('group', 'T2', NULL, NULL, [1]), ('group', 'I0_vit', NULL, NULL, [2]), ('group', 'I0_vae', NULL, NULL, [3]), ('group', 'I1_vit', NULL, NULL, [4]), ('group', 'I1_vae', NULL, NULL, [5]), ('group', 'target_image', NULL, NULL, [6]), ('group', 'context_other', NULL, NULL, [7]),
('image', 'I0_combined', NULL, NULL, [2, 3]), ('image', 'I1_combined', NULL, NULL, [4, 5]), ('category', 'history_instructions', NULL, NULL, [0]), ('category', 'current_instruction', NULL, NULL, [1]), ('category', 'original_image', NULL, NULL, [2, 3]), ('category', 'history_images', NULL, NULL, [4, 5]), ('category', 'target_image', NULL, NULL, [6]), ('category', 'context_other', NULL, NULL, [7]),
('object', 'T1', 'history_instruction', 1, [0]), ('object', 'T2', 'current_instruction', 0, [1]), ('object', 'I0_vit', 'original_image', 1, [2]), ('object', 'I0_vae', 'original_image', 1, [3]), ('object', 'I1_vit', 'history_image', 0, [4]), ('object', 'I1_vae', 'history_image', 0, [5]), ('object', 'I0_combined', 'original_image', 1, [2, 3]), ('object', 'I1_combined', 'history_image', 0, [4, 5]))"""


@query(
    "l4_session_tables",
    f"""WITH {_GROUPED}, t AS (SELECT session, sum(n) AS whole FROM s GROUP BY session), r AS (SELECT session, kind, name, role, age, sum(m) AS m, sum(n) AS n FROM names JOIN s ON list_contains(gs, s.g) GROUP BY ALL)
SELECT session, kind, name, role, CAST(age AS BIGINT) AS age, round(m, 6) AS mass, CAST(n AS BIGINT) AS tokens, CASE WHEN n > 0 THEN round(m / n, 6) END AS density, CASE WHEN n > 0 THEN round(m / (n / whole), 6) END AS enrichment, CASE WHEN n = 0 THEN 'structural_zero' END AS null_reason FROM r JOIN t USING (session)""",
)
def l4_session_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty vectors are the positions of a session, eight cells a group; in every fifth session one group has no tokens."""
    x = F.transform("embedding", lambda v: F.abs(v.cast("double")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("session"), F.col("vec_id").alias("position"), x.alias("x"))
    masses = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: total(F.slice("x", j * 8 + 1, F.lit(8))) / total("x"))
    empty = F.when(F.col("session") % 5 == 0, F.lit(4)).otherwise(F.lit(-1))
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.when(j == empty, 0).otherwise(8).cast("long"))
    out = session_tables.session_tables(rows.select("session", "position", masses.alias("masses"), tokens.alias("tokens")))
    return out.withColumns({c: F.round(c, 6) for c in ("mass", "density", "enrichment")})


@query("a11_atomic_publish", "SELECT 'turns-' || conv_id || '.txt' AS file, CAST(strlen(string_agg(text, chr(10) ORDER BY turn)) AS BIGINT) AS bytes, sha256(string_agg(text, chr(10) ORDER BY turn)) AS sha256, CAST(1 AS BIGINT) AS copies FROM conversations GROUP BY conv_id")
def a11_atomic_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of each conversation, published twice as by a task that is run again, next to parts that a writer left behind; readers see each file once and whole."""
    folder = new_folder(spark, "published")
    listed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    name = F.concat(F.lit("turns-"), F.col("conv_id").cast("string"), F.lit(".txt"))
    rows = stored(listed.select(name.alias("name"), F.encode(F.array_join(F.transform("t", lambda s: s["text"]), "\n"), "UTF-8").alias("content")), "conversation-files")
    # a hidden name is what a part has
    left = rows.select(F.concat(F.lit("."), "name", F.lit(".part-0")).alias("name"), F.substring("content", 1, 10).alias("content"))
    for part in (left, rows, rows):
        stored(files.publish_files(part, folder), "receipts")
    found = spark.read.format("binaryFile").load(f"{folder}/*")
    return found.groupBy(F.regexp_extract("path", "([^/]+)$", 1).alias("file")).agg(F.max("length").alias("bytes"), F.max(F.sha2("content", 256)).alias("sha256"), F.count("*").alias("copies"))


@query("a8_manifest", f"WITH {_LISTS} SELECT session, n FROM lists")
def a8_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "manifest")
    sessions.write_manifest(_lists(spark, sf_dir).select("session", F.size("texts").cast("long").alias("n")), folder)
    return spark.read.schema("session long, n long").json(folder)


def _total(column: str):
    return F.aggregate(F.transform(column, lambda v: v.cast("double")), F.lit(0.0), lambda a, v: a + v)


@query("a9_table_sink", "SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(NULL AS DOUBLE) AS total FROM embeddings UNION ALL SELECT vec_id, NULL, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding]), 6) FROM embeddings")
def a9_table_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tables")
    rows = table(spark, sf_dir, "embeddings")
    sessions.write_tables([rows.select("vec_id", F.col("label").cast("long").alias("label")), rows.select("vec_id", F.round(_total("embedding"), 6).alias("total"))], folder)
    return spark.read.option("header", True).schema("vec_id long, label long, total double").csv(folder)


@query("a10_metric_sink", "SELECT CAST(label AS BIGINT) AS label, count(*) AS n, count(*) FILTER (WHERE vec_id % 3 <> 0) AS valid, round(avg(list_sum([CAST(x AS DOUBLE) FOR x IN embedding])) FILTER (WHERE vec_id % 3 <> 0), 6) AS mean FROM embeddings GROUP BY label")
def a10_metric_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "metrics")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.when(F.col("vec_id") % 3 != 0, _total("embedding")).alias("total"))
    sessions.write_metrics(rows, folder, ["total"], "label")
    back = spark.read.parquet(folder).select(F.col("label").cast("long").alias("label"), F.col("metrics")[0].alias("m"))
    return back.groupBy("label").agg(F.count("*").alias("n"), F.count_if("m.valid").alias("valid"), F.round(F.avg(F.when(F.col("m.valid"), F.col("m.value"))), 6).alias("mean"))


@query("a12_event_sink", "SELECT event_id, event_type FROM events")
def a12_event_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, in two appends."""
    folder = new_folder(spark, "events")
    for k in (0, 1):
        sessions.append_events(table(spark, sf_dir, "events").where(f"event_id % 2 = {k}").select("event_id", "event_type"), folder)
    return spark.read.schema("event_id long, event_type string").json(folder)


@query("a5_run_tree_scan", "SELECT conv_id, count(*) AS turns, min(turn) AS first, max(turn) AS last FROM conversations GROUP BY conv_id")
def a5_run_tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in one folder a session; identity comes from the paths. As many tasks write as there are cores, whatever the size of the turns, and the folders are listed by tasks."""
    folder, tasks = new_folder(spark, "run-tree"), 4 * spark.sparkContext.defaultParallelism
    turn = F.struct("turn", F.to_json(F.struct("conv_id", "turn", "role")).alias("line"))
    listed = table(spark, sf_dir, "conversations").repartition(tasks, "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    name = F.concat(F.lit("session="), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    content = F.encode(F.array_join(F.transform("t", lambda s: s["line"]), "\n"), "UTF-8")
    stored(files.publish_folders(listed.select(name.alias("folder"), F.lit("turns.json").alias("name"), content.alias("content")), folder), "receipts")
    rows = spark.read.schema("conv_id long, turn long, role string").option("recursiveFileLookup", True).json(folder)
    at = F.regexp_extract(F.col("_metadata.file_path"), r"session=(-?\d+|null)/", 1).try_cast("long")
    return rows.select(at.alias("path_session"), "turn").groupBy(F.col("path_session").alias("conv_id")).agg(F.count("*").alias("turns"), F.min("turn").alias("first"), F.max("turn").alias("last"))
