"""Queries over conversations: identity, digests, seeds, segments of histories, prefixes and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.functions import digest
from turnloom.operators import history
from turnloom.plans.base import query, table

#: The user turns of a conversation, numbered from 1, are its instructions.
ASKED = """
asked AS (SELECT conv_id AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn, text FROM conversations WHERE role = 'user')"""
_JSON = "'\"' || replace(replace(replace({0}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n') || '\"'"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("session"), F.row_number().over(order).cast("long").alias("turn"), "text")


@query("b1_source_ids", "SELECT conv_id, turn, role || '/' || lpad(CAST(conv_id AS VARCHAR), 6, '0') AS session_id, role || '/' || lpad(CAST(conv_id AS VARCHAR), 6, '0') || '/turn_' || turn AS source_id FROM conversations")
def b1_source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = F.concat_ws("/", "role", F.lpad(F.col("conv_id").cast("string"), 6, "0"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", session.alias("session_id"), F.concat_ws("/", session, F.concat(F.lit("turn_"), F.col("turn").cast("string"))).alias("source_id"))


@query(
    "b2_canonical_digest",
    f"""SELECT conv_id, turn, sha256('{{"role": ' || {_JSON.format('role')} || ', "text": ' || {_JSON.format('text')} || ', "turn": ' || turn || '}}') AS spaced,
sha256('{{"role":' || {_JSON.format('role')} || ',"text":' || {_JSON.format('text')} || ',"turn":' || turn || '}}') AS compact FROM conversations""",
)
def b2_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"turn": F.col("turn").cast("string"), "role": digest.json_text("role"), "text": digest.json_text("text")}
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[digest.digest(digest.json_object(fields, spaced)).alias(name) for name, spaced in (("spaced", True), ("compact", False))])


@query(
    "b3_session_fingerprint",
    f"""WITH {ASKED} SELECT session, sha256('["' || session || '", [' || string_agg({_JSON.format('text')}, ', ' ORDER BY turn) || '], "' || md5(CAST(session AS VARCHAR)) || '", 512]') AS fingerprint FROM asked GROUP BY session""",
)
def b3_session_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of session, instructions, source hash and settings."""
    listed = asked(spark, sf_dir).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    instructions = digest.json_array(F.transform("turns", lambda t: digest.json_text(t["text"])))
    source = digest.json_text(F.md5(F.col("session").cast("string").cast("binary")))
    whole = digest.json_array(F.array(digest.json_text(F.col("session").cast("string")), instructions, source, F.lit("512")))
    return listed.select("session", digest.digest(whole).alias("fingerprint"))


_SEED = "CAST(CAST('0x' || substr({0}, 1, 16) AS UBIGINT) % 9223372036854775808::UBIGINT AS BIGINT)"


@query("b4_derived_seed", f"""SELECT conv_id, turn, {_SEED.format("sha256('[42,' || conv_id || ',' || turn || ']')")} AS seed FROM conversations""")
def b4_derived_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = digest.json_array(F.array(F.lit("42"), F.col("conv_id").cast("string"), F.col("turn").cast("string")), spaced=False)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", digest.seed63(digest.digest(whole)).alias("seed"))


@query(
    "b5_request_identity",
    f"""SELECT conv_id, turn, vote, 41 + vote AS seed, sha256('[["' || md5(role) || '"], ' || {_JSON.format('text')} || ', {{"max_tokens": 2048, "seed": 42}}, ' || vote || ', ' || (41 + vote) || ']') AS request_hash FROM conversations CROSS JOIN (VALUES (1::BIGINT), (2::BIGINT)) AS v(vote)""",
)
def b5_request_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "conversations").withColumn("vote", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))).withColumn("seed", F.col("vote") + 41)
    settings = digest.json_object({"seed": F.lit("42"), "max_tokens": F.lit("2048")})
    images = digest.json_array(F.array(digest.json_text(F.md5(F.col("role").cast("binary")))))
    whole = digest.json_array(F.array(images, digest.json_text("text"), settings, F.col("vote").cast("string"), F.col("seed").cast("string")))
    return votes.select("conv_id", "turn", "vote", "seed", digest.digest(whole).alias("request_hash"))


@query("b6_detection_key", """SELECT vec_id, sha256('["' || md5(CAST(vec_id AS VARCHAR)) || '", "object ' || label || '", "0.35", ' || CASE WHEN vec_id % 2 = 0 THEN 'true' ELSE 'false' END || ', false]') AS request_key FROM embeddings""")
def b6_detection_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(
        digest.json_text(F.md5(F.col("vec_id").cast("string").cast("binary"))), digest.json_text(F.concat(F.lit("object "), F.col("label").cast("string"))), F.lit('"0.35"'), F.when(F.col("vec_id") % 2 == 0, "true").otherwise("false"), F.lit("false")
    )
    return table(spark, sf_dir, "embeddings").select("vec_id", digest.digest(digest.json_array(parts)).alias("request_key"))


@query("b8_deep_finite", "SELECT count(*) AS rows, CAST(count(*) FILTER (WHERE len([v for v in embedding if isnan(v) or isinf(v)]) > 0) AS BIGINT) AS violations FROM embeddings")
def b8_deep_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.exists("embedding", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("rows"), F.count_if(odd).alias("violations"))


#: Segments of the history up to each turn, by the rule for every earlier turn and the current one.
SEGMENTS = (
    ASKED
    + """, n AS (SELECT c.session, c.turn AS cur, h.turn AS t, h.text, h.turn = c.turn AS is_current FROM asked c JOIN asked h ON h.session = c.session AND h.turn <= c.turn),
segments AS (
  SELECT session, turn AS cur, 0 AS pos, 'image' AS kind, 'image' AS role, 0 AS t, '' AS text, 0 AS image FROM asked
  UNION ALL SELECT session, cur, (t - 1) * 5 + 1, 'text', 'label', t, '', NULL FROM n
  UNION ALL SELECT session, cur, (t - 1) * 5 + 2, 'text', CASE WHEN is_current THEN 'current' ELSE 'history' END, t, text, NULL FROM n
  UNION ALL SELECT session, cur, (t - 1) * 5 + 3, 'text', 'separator', t, {before}, NULL FROM n WHERE NOT is_current
  UNION ALL SELECT session, cur, (t - 1) * 5 + 4, 'image', 'image', t, '', t FROM n WHERE NOT is_current
  UNION ALL SELECT session, cur, (t - 1) * 5 + 5, 'text', 'separator', t, {after}, NULL FROM n WHERE NOT is_current)"""
)
_BARE = SEGMENTS.format(before="chr(10) || chr(10)", after="chr(10) || chr(10)")
_CHAT = SEGMENTS.format(before="'<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)", after="'<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10)")


def _histories(spark: SparkSession, sf_dir: str, protocol: str = "bare") -> DataFrame:
    return history.prefixes(asked(spark, sf_dir)).withColumn("segments", history.history_segments(F.col("instructions"), protocol))


@query("b9_history_segments", f"WITH {_CHAT} SELECT session, cur AS turn, CAST(pos AS BIGINT) AS pos, kind, role, CAST(t AS BIGINT) AS of_turn, text, CAST(image AS BIGINT) AS image_index FROM segments")
def b9_history_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _histories(spark, sf_dir, "chat").select("session", "turn", F.posexplode("segments").alias("pos", "s"))
    return rows.select("session", "turn", F.col("pos").cast("long").alias("pos"), "s.kind", "s.role", F.col("s.turn").alias("of_turn"), "s.text", "s.image_index")


@query("b10_render_history", f"WITH {_BARE} SELECT session, cur AS turn, sha256(string_agg(CASE WHEN kind = 'image' THEN '[IMAGE_' || image || ']' ELSE text END, '' ORDER BY pos)) AS rendered FROM segments GROUP BY ALL")
def b10_render_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histories(spark, sf_dir).select("session", "turn", F.sha2(history.render("segments"), 256).alias("rendered"))


@query("b11_prefix_length", f"WITH {_BARE} SELECT session, cur AS turn, CAST(min(pos) FILTER (WHERE role = 'label' AND t = cur) AS BIGINT) AS prefix_length FROM segments GROUP BY ALL")
def b11_prefix_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histories(spark, sf_dir).select("session", "turn", history.prefix_length("segments").alias("prefix_length"))


@query(
    "b12_segment_signatures",
    f"""WITH {_BARE} SELECT session, cur AS turn, CAST(pos AS BIGINT) AS pos, sha256('{{' || CASE WHEN kind = 'image' THEN '"image_hash":"' || md5(session || '/' || image) || '",' ELSE '' END || '"image_index":' || coalesce(CAST(image AS VARCHAR), 'null') || ',"kind":"' || kind || '","role":"' || role || '","text":' || {_JSON.format('text')} || ',"turn":' || t || '}}') AS signature FROM segments""",
)
def b12_segment_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = lambda k: F.md5(F.concat_ws("/", F.col("session").cast("string"), k.cast("string")).cast("binary"))
    rows = _histories(spark, sf_dir).select("session", "turn", F.posexplode(history.signatures("segments", image)).alias("pos", "signature"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query("b13_reusable_prefix", f"WITH {ASKED} SELECT session, turn, CASE WHEN turn % 3 = 0 THEN 0 ELSE turn - 1 END AS reused FROM asked WHERE turn > 1")
def b13_reusable_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions of the turn before are reused if they begin this turn's; for every third turn the saved ones were changed."""
    order = Window.partitionBy("session").orderBy("turn")
    rows = history.prefixes(asked(spark, sf_dir)).withColumn("saved", F.lag("instructions").over(order)).where("turn > 1")
    changed = F.when(F.col("turn") % 3 == 0, F.transform("saved", lambda t: F.concat(t, F.lit("?")))).otherwise(F.col("saved"))
    return rows.select("session", "turn", history.reusable_prefix(changed, F.col("instructions")).alias("reused"))


@query("b14_protocol_manifest", f"WITH {_BARE} SELECT session, cur AS turn, count(*) FILTER (WHERE kind = 'image') AS image_count, count(*) FILTER (WHERE role IN ('current', 'history')) AS instruction_count, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE role = 'current') AS removed_segments FROM segments GROUP BY ALL")
def b14_protocol_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda f: F.size(F.filter("segments", f)).cast("long")
    return _histories(spark, sf_dir).select(
        "session",
        "turn",
        count(lambda s: s["kind"] == "image").alias("image_count"),
        count(lambda s: s["role"].isin("current", "history")).alias("instruction_count"),
        F.array_join(history.removed_places("segments"), ",").alias("removed_segments"),
    )


@query("b15_negative_branch", f"WITH {_BARE} SELECT session, cur AS turn, count(*) FILTER (WHERE role <> 'current') AS kept, true AS history_kept FROM segments GROUP BY ALL")
def b15_negative_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the current instruction is dropped: what stands before it is left as it was."""
    kept = _histories(spark, sf_dir).withColumn("negative", history.without_current("segments"))
    n = history.prefix_length("segments").cast("int")
    return kept.select("session", "turn", F.size("negative").cast("long").alias("kept"), (F.slice("negative", F.lit(1), n + 1) == F.slice("segments", F.lit(1), n + 1)).alias("history_kept"))


@query("e4_input_history", "SELECT conv_id, turn, coalesce(string_agg(md5(text), ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS input_hashes FROM conversations")
def e4_input_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    hashes = F.collect_list(F.md5(F.col("text").cast("binary"))).over(before)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(hashes, ",").alias("input_hashes"))


_HOLES = "(SELECT conv_id AS session, turn FROM conversations WHERE NOT (conv_id % 5 = 0 AND turn = 1) UNION ALL SELECT conv_id, turn FROM conversations WHERE conv_id % 7 = 0 AND turn = 0)"


@query("e5_contiguity", f"WITH s AS (SELECT session, turn, turn - lag(turn) OVER (PARTITION BY session ORDER BY turn) AS step FROM {_HOLES}) SELECT session, count(*) AS turns, count(*) FILTER (WHERE step > 1) AS gaps, count(*) FILTER (WHERE step = 0) AS duplicates, bool_and(coalesce(step = 1, true)) AS contiguous FROM s GROUP BY session")
def e5_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn is taken out of some sessions and repeated in others."""
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn")
    holes = own.where("NOT (session % 5 = 0 AND turn = 1)").unionByName(own.where("session % 7 = 0 AND turn = 0"))
    return history.contiguity(holes)


@query("j5_history_audit", "WITH s AS (SELECT conv_id, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS off, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, count(DISTINCT off) > 1 AS broken_order, count(*) FILTER (WHERE role = before) AS repeated_roles FROM s GROUP BY conv_id")
def j5_history_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") - F.row_number().over(order)).alias("off"), (F.col("role") == F.lag("role").over(order)).alias("same"))
    return rows.groupBy("conv_id").agg((F.count_distinct("off") > 1).alias("broken_order"), F.count_if(F.coalesce("same", F.lit(False))).alias("repeated_roles"))


@query("e24_longest_prefix", "WITH p AS (SELECT conv_id, turn, sum(length(string_split(text, ' '))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS words FROM conversations) SELECT conv_id, CAST(max(words) AS BIGINT) AS words, max(words) <= 400 AS fits FROM p GROUP BY conv_id")
def e24_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the longest prefix, and whether it fits a budget of 400."""
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    words = table(spark, sf_dir, "conversations").select("conv_id", F.sum(F.size(F.split("text", " "))).over(so_far).alias("words"))
    return words.groupBy("conv_id").agg(F.max("words").alias("words"), (F.max("words") <= 400).alias("fits"))


@query("g6_prefix_prompts", f"WITH {ASKED} SELECT session, turn, sha256('Steps:' || chr(10) || string_agg('Turn ' || turn || ': ' || text, chr(10)) OVER (PARTITION BY session ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS prompt FROM asked")
def g6_prefix_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numbered line for each instruction so far, in a template."""
    rows = history.prefixes(asked(spark, sf_dir))
    lines = F.array_join(F.transform("instructions", lambda t, i: F.concat(F.lit("Turn "), (i + 1).cast("string"), F.lit(": "), t)), "\n")
    return rows.select("session", "turn", F.sha2(F.concat(F.lit("Steps:\n"), lines), 256).alias("prompt"))


@query("a14_safe_export", "SELECT conv_id, turn, CASE WHEN regexp_matches(ltrim(cell), '^[=+\\-@]') THEN '''' || cell ELSE cell END AS cell FROM (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN '=' WHEN 1 THEN ' -' ELSE '' END || text AS cell FROM conversations)")
def a14_safe_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that a spreadsheet would read as a formula get a quote in front."""
    lead = F.when(F.col("conv_id") % 4 == 0, "=").when(F.col("conv_id") % 4 == 1, " -").otherwise("")
    cells = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(lead, "text").alias("cell"))
    return cells.withColumn("cell", F.when(F.ltrim("cell").rlike(r"^[=+\-@]"), F.concat(F.lit("'"), "cell")).otherwise(F.col("cell")))


@query("g9_token_pieces", "SELECT conv_id, turn, substr(text, CAST(turn * 3 + 1 AS BIGINT), 8) AS piece, substr(text, CAST(turn * 3 + 5 AS BIGINT), 8) AS overlapping FROM conversations")
def g9_token_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces by character offsets (start, end); overlaps are kept."""
    piece = lambda start, end: F.substring(F.col("text"), (start + 1).cast("int"), (end - start).cast("int"))
    start = F.col("turn") * 3
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", piece(start, start + 8).alias("piece"), piece(start + 4, start + 12).alias("overlapping"))


@query(
    "b19_settings_rules",
    """WITH s AS (SELECT event_id AS run, user_id % 12 AS votes, value / 100 AS temperature, event_type AS dtype FROM events)
SELECT run, rule FROM (SELECT run, 'votes out of range' AS rule FROM s WHERE votes NOT BETWEEN 1 AND 10 UNION ALL SELECT run, 'temperature out of range' FROM s WHERE temperature < 0 OR temperature > 0.9 UNION ALL SELECT run, 'unknown type' FROM s WHERE dtype NOT IN ('click', 'view'))""",
)
def b19_settings_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of runs against ranges and enumerations; a row for each rule that is broken."""
    settings = table(spark, sf_dir, "events").select(F.col("event_id").alias("run"), (F.col("user_id") % 12).alias("votes"), (F.col("value") / 100).alias("temperature"), F.col("event_type").alias("dtype"))
    broken = {"votes out of range": ~F.col("votes").between(1, 10), "temperature out of range": ~F.col("temperature").between(0.0, 0.9), "unknown type": ~F.col("dtype").isin("click", "view")}
    found = F.array_compact(F.array(*[F.when(bad, rule) for rule, bad in broken.items()]))
    return settings.select("run", F.explode(found).alias("rule"))


@query("b23_settings_identity", """SELECT sha256('{"dtype": "' || event_type || '", "votes": ' || user_id || '}') AS identity, count(*) AS runs FROM events GROUP BY identity""")
def b23_settings_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that older runs had are dropped before the settings are digested."""
    settings = table(spark, sf_dir, "events").select(F.struct(F.col("event_type").alias("dtype"), F.col("user_id").alias("votes"), F.col("value").alias("old_scale"), F.col("ts").alias("old_start")).alias("s"))
    kept = F.col("s").dropFields("old_scale", "old_start")
    counted = settings.groupBy(kept.alias("s")).agg(F.count("*").alias("runs"))
    canonical = digest.json_object({"dtype": digest.json_text(F.col("s.dtype")), "votes": F.col("s.votes").cast("string")})
    return counted.select(digest.digest(canonical).alias("identity"), "runs")
