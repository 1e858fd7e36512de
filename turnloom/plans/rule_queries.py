"""Queries over edits: instructions made from parts' names, detections made from embeddings, answers made from scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import boxes, digest, parsing
from turnloom.operators import hooks, rules, spatial
from turnloom.plans.base import query, r6, table
from turnloom.sources.shared import new_folder, stored

# An instruction of each form, and one of none.
FORMS = (
    ("subject_replace", "Replace [{a}] with [{b}]"),
    ("subject_remove", "Remove [{a}]"),
    ("material_alter", "Change the material of [{a}] to [{b}]"),
    ("color_alter", "Change the color of [{a}] to [{b}]"),
    ("subject_add", "Add [{a}] on the [left] of [{b}]"),
    ("subject_add", "Add [{a}]"),
    ("text_change", "Replace the text '[{a}]' on [{b}] with '[yes]'"),
    ("text_change", "Add text '[{b}]' on the image"),
    ("position_change", "Change the position of [{a}] to [above] of [{b}]"),
    ("position_change", "Change the position of [{a}] to [beside] of [{b}]"),
    ("count_change", "Change the count of [{a}] to [2]"),
    ("count_change", "Change the count of [{a}] to [two]"),
    ("background_change", "Change the background to sea, remain the {a},{b} unchanged"),
    ("background_change", "Change the background to [{b}]"),
    ("subject_remove", "Drop {a}"),
)
_CASE = " ".join(f"WHEN {k} THEN '{t}'" for k, (t, _) in enumerate(FORMS))
_FORM = " ".join("WHEN {} THEN '{}'".format(k, f.replace("'", "''")) for k, (_, f) in enumerate(FORMS))
#: One edit for each part.
EDITS = f"""
named AS (SELECT p_partkey AS id, p_brand || CASE WHEN p_partkey % 2 = 0 THEN 's' WHEN p_partkey % 3 = 0 THEN 'es' ELSE '' END AS name FROM part),
edits AS (SELECT p.id, CASE p.id % 15 {_CASE} END AS task, replace(replace(CASE p.id % 15 {_FORM} END, '{{a}}', p.name), '{{b}}', coalesce(q.name, 'none')) AS instruction,
  CASE p.id % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'yes, it is' ELSE 'the text says yes' END AS answer FROM named p LEFT JOIN named q ON q.id = p.id + 7)"""


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("p_partkey") % 2 == 0, "s").when(F.col("p_partkey") % 3 == 0, "es").otherwise("")
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", end).alias("name"))
    other = named.select((F.col("id") - 7).alias("id"), F.col("name").alias("other"))
    form = F.array(*[F.struct(F.lit(t).alias("task"), F.lit(f).alias("form")) for t, f in FORMS])
    chosen = named.join(other, "id", "left").withColumn("f", F.get(form, (F.col("id") % 15).cast("int")))
    said = F.when(F.col("id") % 4 == 0, "no").when(F.col("id") % 4 == 1, "yes, it is").otherwise("the text says yes")
    text = F.replace(F.replace(F.col("f.form"), F.lit("{a}"), F.col("name")), F.lit("{b}"), F.coalesce("other", F.lit("none")))
    return chosen.select("id", "f.task", text.alias("instruction"), said.alias("answer"))


_B = r"\[([^\]]+)\]"
# The forms of instructions as SQL patterns, written out apart from those of the library.
_SQL_FORMS = {
    "subject_replace": ((f"Replace {_B} with {_B}", 2),),
    "subject_remove": ((f"Remove {_B}", 1),),
    "material_alter": ((f"Change the material of {_B} to {_B}", 2),),
    "color_alter": ((f"Change the color of {_B} to {_B}", 2),),
    "subject_add": ((f"Add {_B} on the {_B} of {_B}", 3), (f"Add {_B}", 1)),
    "text_change": ((f"Replace the text '{_B}' on {_B} with '{_B}'", 3), (f"Add text '{_B}' on the image", 1)),
    "position_change": ((f"Change the position of {_B} to {_B} of {_B}", 3),),
    "count_change": ((f"Change the count of {_B} to {_B}", 2),),
}


def _extract(pattern: str, n: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"WHEN regexp_matches(instruction, '{quoted}') THEN [" + ", ".join(f"regexp_extract(instruction, '{quoted}', {k + 1})" for k in range(n)) + "]"


_PARSE = "CASE " + " ".join(f"WHEN task = '{name}' THEN CASE " + " ".join(_extract(*form) for form in forms) + " END" for name, forms in _SQL_FORMS.items())
_PARSE += " WHEN task = 'background_change' THEN CASE WHEN regexp_matches(instruction, 'Change the background to ([^,]+), remain the (.+) unchanged') THEN list_concat([regexp_extract(instruction, 'Change the background to ([^,]+), remain', 1)], string_split(regexp_extract(instruction, 'remain the (.+) unchanged', 1), ',')) "
_PARSE += _extract(f"Change the background to {_B}", 1) + " END END"
PARSED = f"{EDITS}, parsed AS (SELECT *, {_PARSE} AS parts FROM edits)"
VALID = "parts IS NOT NULL AND CASE WHEN task = 'count_change' THEN regexp_matches(parts[2], '^[0-9]+$') WHEN task = 'position_change' OR task = 'subject_add' AND len(parts) = 3 THEN parts[2] IN ('left', 'right', 'above', 'below') ELSE true END"


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edits(spark, sf_dir).withColumn("parts", parsing.parse_instruction("task", "instruction"))
    return out.withColumn("valid", parsing.valid_instruction("task", "parts"))


@query("g1_parse_instruction", f"WITH {PARSED} SELECT id, task, array_to_string(parts, '|') AS parts, len(parts) AS n FROM parsed WHERE parts IS NOT NULL")
def g1_parse_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).where("parts is not null").select("id", "task", F.array_join("parts", "|").alias("parts"), F.size("parts").cast("long").alias("n"))


@query("g2_valid_instruction", f"WITH {PARSED} SELECT task, {VALID} AS valid, count(*) AS n FROM parsed GROUP BY ALL")
def g2_valid_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).groupBy("task", "valid").agg(F.count("*").alias("n"))


@query("g3_singular", f"WITH {EDITS} SELECT id, CASE WHEN ends_with(name, 'es') THEN left(name, length(name) - 2) WHEN ends_with(name, 's') THEN left(name, length(name) - 1) ELSE name END AS singular FROM named")
def g3_singular(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("p_partkey") % 2 == 0, "s").when(F.col("p_partkey") % 3 == 0, "es").otherwise("")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), parsing.singular(F.concat("p_brand", end)).alias("singular"))


_SAID = "CASE conv_id % 8 WHEN 0 THEN 'Yes.' WHEN 1 THEN '**No**, it is absent.' WHEN 2 THEN 'Therefore, the final answer is: yes' WHEN 3 THEN 'yes' || chr(10) || 'no' WHEN 4 THEN 'Some say yes here' WHEN 5 THEN 'Thus no.' WHEN 6 THEN 'Answer: `YES`' ELSE '' END || chr(10) || text"


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ("Yes.", "**No**, it is absent.", "Therefore, the final answer is: yes", "yes\nno", "Some say yes here", "Thus no.", "Answer: `YES`", "")
    lead = F.get(F.array(*map(F.lit, texts)), (F.col("conv_id") % 8).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(lead, F.lit("\n"), "text").alias("said"))


_TOKEN = "[\"''“”‘’]?(yes|no)[\"''“”‘’]?"
_FORMS = (
    f"^{_TOKEN}[.!]?\\s*$",
    f"^{_TOKEN}[,.!:]\\s+\\S",
    f"^(?:(?:therefore|thus|so|hence)[,:]?\\s+)?(?:(?:the|my)\\s+)?(?:(?:final|correct)\\s+)?(?:answer|response)\\s*(?:is\\s+|:\\s*){_TOKEN}[.!]?\\s*$",
    f"^(?:therefore|thus|so|hence)[,:]?\\s+{_TOKEN}[.!]?\\s*$",
)
_ANSWERS = " UNION ALL ".join(f"SELECT conv_id, turn, lower(regexp_extract(line, '{p}', 1, 'i')) AS a FROM lines" for p in _FORMS)


@query(
    "g4_decision",
    f"""WITH said AS (SELECT conv_id, turn, {_SAID} AS said FROM conversations), lines AS (SELECT conv_id, turn, trim(regexp_replace(unnest(string_split(said, chr(10))), '[*`]', '', 'g')) AS line FROM said),
a AS ({_ANSWERS}), d AS (SELECT conv_id, turn, count(DISTINCT a) AS n, min(a) AS a FROM a WHERE a <> '' GROUP BY ALL) SELECT conv_id, turn, CASE WHEN n = 1 THEN a END AS decision FROM said LEFT JOIN d USING (conv_id, turn)""",
)
def g4_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("conv_id", "turn", parsing.decision("said").alias("decision"))


@query(
    "g5_tagged_verdict",
    """WITH v AS (SELECT conv_id, count(*) AS turns, string_agg('<answer_turn_' || (turn + CASE WHEN conv_id % 7 = 3 THEN 2 ELSE 1 END) || '>' || CASE WHEN turn >= 2 AND conv_id % 3 = 1 THEN 'no' ELSE 'yes' END || '</answer_turn_' || (turn + CASE WHEN conv_id % 7 = 3 THEN 2 ELSE 1 END) || '>', '' ORDER BY turn) || CASE conv_id % 5 WHEN 0 THEN '' WHEN 1 THEN '<answer_final>no</answer_final>' ELSE '<answer_final>yes</answer_final>' END AS raw FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, turns, regexp_extract_all(raw, '<answer_final>(yes|no)</answer_final>', 1) AS f, [CAST(x AS INT) for x in regexp_extract_all(raw, '<answer_turn_([0-9]+)>', 1)] AS ids, regexp_extract_all(raw, '>(yes|no)</answer_turn', 1) AS vals FROM v),
r AS (SELECT *, CASE WHEN len(f) <> 1 OR len(ids) = 0 THEN 'missing or repeated answer tags' WHEN ids <> [CAST(x AS INT) for x in range(1, len(ids) + 1)] OR len(ids) > turns THEN 'turn sequence invalid' WHEN f[1] = 'yes' AND NOT (len(ids) = turns AND NOT list_contains(vals, 'no')) THEN 'inconsistent yes' WHEN f[1] = 'no' AND NOT (vals[-1] = 'no' AND NOT list_contains(vals[:-2], 'no')) THEN 'no must stop at the first failure' END AS reason FROM p)
SELECT conv_id, CASE WHEN reason IS NULL THEN 'ok' ELSE 'pending_review' END AS status, CASE WHEN reason IS NULL THEN CAST(f[1] = 'yes' AS INT) * 1.0e0 END AS score, reason FROM r""",
)
def g5_tagged_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = F.when(F.col("conv_id") % 7 == 3, 2).otherwise(1)
    number = (F.col("turn") + shift).cast("string")
    word = F.when((F.col("turn") >= 2) & (F.col("conv_id") % 3 == 1), "no").otherwise("yes")
    tag = F.concat(F.lit("<answer_turn_"), number, F.lit(">"), word, F.lit("</answer_turn_"), number, F.lit(">"))
    listed = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", tag.alias("tag")).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("tags"))
    final = F.when(F.col("conv_id") % 5 == 0, "").when(F.col("conv_id") % 5 == 1, "<answer_final>no</answer_final>").otherwise("<answer_final>yes</answer_final>")
    raw = listed.select("conv_id", F.size("tags").alias("turns"), F.concat(F.array_join(F.transform("tags", lambda t: t["tag"]), ""), final).alias("raw"))
    return raw.select("conv_id", parsing.verdict("raw", "turns").alias("v")).select("conv_id", "v.*")


@query("g7_contains_text", f"WITH {EDITS} SELECT id, contains(answer, lower(CASE WHEN id % 2 = 0 THEN 'YES' ELSE 'text' END)) AS found FROM edits")
def g7_contains_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.lower(F.when(F.col("id") % 2 == 0, "YES").otherwise("text"))
    return edits(spark, sf_dir).select("id", F.contains("answer", wanted).alias("found"))


@query("g8_caption", "SELECT conv_id, turn, array_to_string([replace(lower(trim(x)), '.', '') for x in string_split(text, ' ')], ' . ') || ' .' AS caption FROM conversations")
def g8_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", parsing.caption(F.split("text", " ")).alias("caption"))


_TRACES = "traces AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'length' ELSE 'stop' END AS finish, CASE WHEN event_id % 7 = 0 THEN '  ' ELSE event_type END AS raw, md5(CAST(user_id AS VARCHAR) || event_type) AS request, CASE WHEN event_id % 11 = 0 THEN 'timeout' END AS error FROM events)"


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 5 == 0, "length").otherwise("stop").alias("finish"),
        F.when(F.col("event_id") % 7 == 0, "  ").otherwise(F.col("event_type")).alias("raw"),
        F.md5(F.concat(F.col("user_id").cast("string"), "event_type").cast("binary")).alias("request"),
        F.when(F.col("event_id") % 11 == 0, "timeout").alias("error"),
    )


@query("g10_incomplete_answers", f"WITH {_TRACES} SELECT CASE WHEN finish = 'length' THEN 'token_limit' WHEN trim(raw) = '' THEN 'empty_response' ELSE 'complete' END AS cause, count(*) AS n FROM traces GROUP BY cause")
def g10_incomplete_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traces(spark, sf_dir).groupBy(F.coalesce(parsing.incomplete_cause("finish", "raw"), F.lit("complete")).alias("cause")).agg(F.count("*").alias("n"))


@query("g11_cache_admissible", f"WITH {_TRACES} SELECT request, count(*) FILTER (WHERE finish = 'stop' AND trim(raw) <> '' AND error IS NULL AND request = md5(CAST(user_id AS VARCHAR) || event_type)) AS admissible, count(*) AS total FROM traces JOIN events USING (event_id) GROUP BY request")
def g11_cache_admissible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete, free of errors, and with the identity computed anew."""
    own = table(spark, sf_dir, "events").select("event_id", F.md5(F.concat(F.col("user_id").cast("string"), "event_type").cast("binary")).alias("identity"))
    joined = _traces(spark, sf_dir).join(own, "event_id")
    good = parsing.incomplete_cause("finish", "raw").isNull() & F.col("error").isNull() & (F.col("request") == F.col("identity"))
    return joined.groupBy("request").agg(F.count_if(good).alias("admissible"), F.count("*").alias("total"))


@query("g13_metric_names", "WITH n AS (SELECT vec_id, 't' || (vec_id % 3 + 1) || '__T' || label || ':mass' || CASE WHEN vec_id % 2 = 0 THEN '@L' || vec_id % 36 || 'H' || vec_id % 16 ELSE '' END AS name FROM embeddings) SELECT vec_id, CAST(regexp_extract(name, '^t([0-9]+)__', 1) AS BIGINT) AS turn, regexp_extract(name, '__([^:]+):', 1) AS object, regexp_extract(name, ':([a-z0-9_]+)', 1) AS metric, try_cast(regexp_extract(name, '@L([0-9]+)H', 1) AS BIGINT) AS layer, try_cast(regexp_extract(name, 'H([0-9]+)$', 1) AS BIGINT) AS head FROM n")
def g13_metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("@L"), (F.col("vec_id") % 36).cast("string"), F.lit("H"), (F.col("vec_id") % 16).cast("string"))).otherwise("")
    name = F.concat(F.lit("t"), (F.col("vec_id") % 3 + 1).cast("string"), F.lit("__T"), F.col("label").cast("string"), F.lit(":mass"), place)
    return table(spark, sf_dir, "embeddings").select("vec_id", name.alias("name")).select("vec_id", *parsing.metric_parts("name"))


#: Sixteen boxes of each vector, made of four values each; one image each vector.
BOXES = """
values4 AS (SELECT vec_id AS image, unnest(range(16)) AS k, embedding FROM embeddings),
frac AS (SELECT image, k, [abs(CAST(embedding[4 * k + j] AS DOUBLE)) * 7 - floor(abs(CAST(embedding[4 * k + j] AS DOUBLE)) * 7) for j in [1, 2, 3, 4]] AS f FROM values4),
boxes AS (SELECT image, k, least(f[1], f[3]) AS x1, least(f[2], f[4]) AS y1, greatest(f[1], f[3]) AS x2, greatest(f[2], f[4]) AS y2, (image * 31 + k * 17) % 100 / 100.0e0 AS score FROM frac)"""
_IOU = "coalesce(CASE WHEN least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1) THEN (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) ELSE 0 END / nullif((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - CASE WHEN least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1) THEN (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) ELSE 0 END, 0), 0)"


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, found: array<struct<score, box>>)"""
    cut = lambda v: F.abs(v.cast("double")) * 7 - F.floor(F.abs(v.cast("double")) * 7)

    def box(k):
        f = F.transform(F.slice("embedding", k * 4 + 1, F.lit(4)), cut)
        score = (F.col("vec_id") * 31 + k * 17) % 100 / 100.0
        return F.struct(score.alias("score"), F.array(F.least(f[0], f[2]), F.least(f[1], f[3]), F.greatest(f[0], f[2]), F.greatest(f[1], f[3])).alias("box"))

    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.transform(F.sequence(F.lit(0), F.lit(15)), box).alias("found"))


@query("f22_iou", f"WITH {BOXES} SELECT a.image, a.k, round({_IOU}, 6) AS iou FROM boxes a JOIN boxes b ON a.image = b.image AND b.k = a.k + 1")
def f22_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = detections(spark, sf_dir).select("image", F.posexplode(F.zip_with(F.slice("found", 1, 15), F.slice("found", 2, 15), lambda a, b: boxes.iou(a["box"], b["box"]))).alias("k", "iou"))
    return own.select("image", F.col("k").cast("long").alias("k"), r6("iou").alias("iou"))


_SAME = "(least(k.x2, b.x2) - greatest(k.x1, b.x1)) * (least(k.y2, b.y2) - greatest(k.y1, b.y1))"
_OVER = f"least(k.x2, b.x2) > greatest(k.x1, b.x1) AND least(k.y2, b.y2) > greatest(k.y1, b.y1) AND {_SAME} / ((k.x2 - k.x1) * (k.y2 - k.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_SAME}) > 0.8"


def _fold(name: str, source: str) -> str:
    """Tables of a fold over boxes in order (id, kind, pos, x1, y1, x2, y2): a box is kept if it overlaps none of those kept by more than 0.8."""
    return f"""{name}_fold AS (SELECT DISTINCT id, kind, CAST(0 AS BIGINT) AS pos, CAST([] AS STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[]) AS kept FROM {source}
UNION ALL SELECT f.id, f.kind, f.pos + 1, CASE WHEN len(list_filter(f.kept, lambda k: {_OVER})) > 0 THEN f.kept ELSE list_append(f.kept, struct_pack(x1 := b.x1, y1 := b.y1, x2 := b.x2, y2 := b.y2)) END FROM {name}_fold f JOIN {source} b ON b.id = f.id AND b.kind = f.kind AND b.pos = f.pos),
{name}_counts AS (SELECT id, kind, arg_max(len(kept), pos) AS n FROM {name}_fold GROUP BY ALL)"""


@query(
    "f23_distinct_boxes",
    f"""WITH RECURSIVE {BOXES}, sets AS (SELECT image AS id, 'once' AS kind, k AS pos, x1, y1, x2, y2 FROM boxes UNION ALL SELECT image, 'twice', k, x1, y1, x2, y2 FROM boxes
UNION ALL SELECT image, 'twice', k + 16, x1 * 1.001e0, y1 * 1.001e0, x2 * 1.001e0, y2 * 1.001e0 FROM boxes), {_fold("sets", "sets")}
SELECT a.id AS image, a.n, b.n AS n_doubled FROM sets_counts a JOIN sets_counts b ON a.id = b.id AND a.kind = 'once' AND b.kind = 'twice'""",
)
def f23_distinct_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's boxes next to slightly moved copies; a fold over the boxes in order."""
    own = detections(spark, sf_dir).select("image", F.transform("found", lambda d: d["box"]).alias("boxes"))
    moved = F.transform("boxes", lambda b: F.transform(b, lambda v: v * 1.001))
    doubled = F.concat("boxes", moved)
    return own.withColumn("doubled", doubled).select("image", boxes.count_distinct_boxes("boxes").alias("n"), boxes.count_distinct_boxes("doubled").alias("n_doubled"))


@query("f24_best_detection", f"WITH {BOXES} SELECT image, round(arg_min(x1, struct_pack(a := -score, b := k)), 6) AS x1, round(arg_min(y2, struct_pack(a := -score, b := k)), 6) AS y2 FROM boxes WHERE NOT (x2 - x1 > 0.6 AND y2 - y1 > 0.6) GROUP BY image")
def f24_best_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = detections(spark, sf_dir).select("image", boxes.best_box("found", 0.6).alias("b")).where("b is not null")
    return best.select("image", r6(F.col("b")[0]).alias("x1"), r6(F.col("b")[3]).alias("y2"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, k, x1, y1, x2, y2): each detection a row."""
    own = detections(spark, sf_dir).select("image", F.posexplode(F.transform("found", lambda d: d["box"])).alias("k", "b"))
    return own.select("image", "k", *[F.col("b")[i].alias(c) for i, c in enumerate(spatial.CORNERS)])


@query("c16_any_overlap", f"WITH {BOXES} SELECT a.image, max({_IOU}) > 0 AS overlaps FROM boxes a JOIN boxes b ON a.image = b.image WHERE a.k < 8 AND b.k >= 8 GROUP BY a.image")
def c16_any_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight detections of an image against the others."""
    rows = _rows(spark, sf_dir)
    return spatial.any_overlap(rows.where("k < 8"), rows.where("k >= 8"), ["image"], "k")


@query("c16_overlapping_pairs", f"WITH {BOXES} SELECT a.image, a.k AS left_k, b.k AS right_k, round({_IOU}, 6) AS iou FROM boxes a JOIN boxes b ON a.image = b.image WHERE a.k < 8 AND b.k >= 8 AND {_IOU} > 0")
def c16_overlapping_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    pairs = spatial.overlapping_pairs(rows.where("k < 8"), rows.where("k >= 8"), ["image"], "k")
    return pairs.select("image", F.col("left_k").cast("long"), F.col("right_k").cast("long"), r6("iou").alias("iou"))


@query("c17_any_direction", f"WITH {BOXES}, c AS (SELECT image, k, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM boxes) SELECT a.image, bool_or(CASE a.image % 4 WHEN 0 THEN b.x - a.x < -0.6 WHEN 1 THEN b.x - a.x > 0.6 WHEN 2 THEN b.y - a.y < -0.6 ELSE b.y - a.y > 0.6 END) AS towards FROM c a JOIN c b ON a.image = b.image WHERE a.k < 8 AND b.k >= 8 GROUP BY a.image")
def c17_any_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("position", F.get(F.array(*map(F.lit, parsing.DIRECTIONS)), (F.col("image") % 4).cast("int")))
    return spatial.any_direction(rows.where("k < 8"), rows.where("k >= 8"), ["image"], "position", 0.6)


def _scored_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits with the boxes of an image each: how many of them count as found depends on the id."""
    own = detections(spark, sf_dir).select(F.col("image").alias("im"), F.transform("found", lambda d: d["box"]).alias("b"))
    n = lambda k, m: F.pmod(F.floor(F.col("id") / k), F.lit(m)).cast("int")
    # one row: the number of images, over which the edits are dealt evenly
    counted = own.agg(F.count("*").alias("images"))
    joined = edits(spark, sf_dir).crossJoin(F.broadcast(counted)).join(own, F.col("id") % F.col("images") == F.col("im"))
    take = lambda start, count: F.slice("b", F.lit(start), count)
    found = joined.select("id", "task", "instruction", "answer", take(1, n(3, 3)).alias("src_one"), take(4, n(5, 3)).alias("src_two"), take(7, n(7, 4)).alias("dst_one"), take(11, n(2, 3)).alias("dst_two"), F.array(take(1, n(3, 2) + 1), take(5, n(4, 2))).alias("dst_kept"))
    return rules.rule_score(found)


_FOUND = f"""{PARSED}, {BOXES.strip()}, e AS (SELECT p.*, id % (SELECT count(*) FROM embeddings) AS image, {VALID} AS valid, answer LIKE '%yes%' AS yes, id // 3 % 3 AS n_src_one, id // 5 % 3 AS n_src_two, id // 7 % 4 AS n_dst_one, id // 2 % 3 AS n_dst_two FROM parsed p WHERE id % (SELECT count(*) FROM embeddings) IN (SELECT vec_id FROM embeddings)),
near AS (SELECT id, max({_IOU}) AS best FROM e JOIN boxes a USING (image) JOIN boxes b ON b.image = e.image WHERE a.k < n_src_one AND b.k >= 10 AND b.k < 10 + n_dst_two GROUP BY id),
gone AS (SELECT id, {_IOU} AS first FROM e JOIN boxes a USING (image) JOIN boxes b ON b.image = e.image WHERE a.k = 0 AND b.k = 6),
beside AS (SELECT id, bool_or((b.x1 + b.x2) / 2 - (a.x1 + a.x2) / 2 < -0.03) AS l FROM e JOIN boxes a USING (image) JOIN boxes b ON b.image = e.image WHERE a.k >= 3 AND a.k < 3 + n_src_two AND b.k >= 6 AND b.k < 6 + n_dst_one GROUP BY id),
kept AS (SELECT id, id // 4 % 2 > 0 AND bool_and(NOT (x2 - x1 > 0.9 AND y2 - y1 > 0.9)) AS k FROM e JOIN boxes USING (image) WHERE k IN (0, 4) GROUP BY id, image)"""
_RULES = {
    "h1_add": ("task = 'subject_add' AND len(parts) = 1", "yes AND n_dst_one > 0"),
    "h2_add_beside": ("task = 'subject_add' AND len(parts) = 3", "yes AND n_src_two > 0 AND n_dst_one > 0 AND coalesce(l, false)"),
    "h3_remove": ("task = 'subject_remove'", "n_src_one > 0 AND (n_dst_one = 0 OR first < 0.2)"),
    "h4_replace": ("task = 'subject_replace'", "yes AND n_src_one > 0 AND n_dst_two > 0 AND coalesce(best, 0) > 0"),
    "h5_recolour": ("task IN ('color_alter', 'material_alter')", "yes"),
    "h6_text": ("task = 'text_change'", "contains(answer, lower(parts[-1])) AND (len(parts) = 1 OR n_src_one > 0)"),
    "h9_background": ("task = 'background_change'", "yes AND k"),
}


def _rule_query(name: str, condition: str, passed: str):
    sql = f"WITH {_FOUND} SELECT id, CASE WHEN valid THEN 'ok' ELSE 'invalid_annotation' END AS status, CASE WHEN valid THEN CAST(coalesce({passed}, false) AS INT) * 1.0e0 END AS score FROM e LEFT JOIN near USING (id) LEFT JOIN gone USING (id) LEFT JOIN beside USING (id) LEFT JOIN kept USING (id) WHERE {condition}"

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        where = condition.replace("len(parts)", "size(parts)")
        return _scored_edits(spark, sf_dir).where(where).select("id", "status", "score")

    return run


for _name, (_condition, _passed) in _RULES.items():
    _rule_query(_name, _condition, _passed)


_COUNTED = f"""{_FOUND}, asked AS (SELECT id, image, 'src_one' AS kind, 0 AS low, n_src_one AS n FROM e UNION ALL SELECT id, image, 'src_two', 3, n_src_two FROM e UNION ALL SELECT id, image, 'dst_one', 6, n_dst_one FROM e UNION ALL SELECT id, image, 'dst_two', 10, n_dst_two FROM e),
own AS (SELECT id, kind, k - low AS pos, x1, y1, x2, y2 FROM asked JOIN boxes USING (image) WHERE k >= low AND k < low + n), {_fold("own", "own")},
n AS (SELECT id, coalesce(max(n) FILTER (WHERE kind = 'src_one'), 0) AS s1, coalesce(max(n) FILTER (WHERE kind = 'src_two'), 0) AS s2, coalesce(max(n) FILTER (WHERE kind = 'dst_one'), 0) AS d1, coalesce(max(n) FILTER (WHERE kind = 'dst_two'), 0) AS d2 FROM e LEFT JOIN own_counts USING (id) GROUP BY id),
ends AS (SELECT id, (max(x1 + x2) FILTER (WHERE kind = 'dst_one') - max(x1 + x2) FILTER (WHERE kind = 'dst_two')) / 2 AS dx, (max(y1 + y2) FILTER (WHERE kind = 'dst_one') - max(y1 + y2) FILTER (WHERE kind = 'dst_two')) / 2 AS dy FROM own WHERE pos = 0 GROUP BY id)"""
_STATUS = "SELECT id, CASE WHEN valid THEN 'ok' ELSE 'invalid_annotation' END AS status, CASE WHEN valid THEN CAST(coalesce({passed}, false) AS INT) * 1.0e0 END AS score FROM e JOIN n USING (id) LEFT JOIN ends USING (id) WHERE task = '{task}'"


@query("h7_position", f"WITH RECURSIVE {_COUNTED} " + _STATUS.format(task="position_change", passed="s1 = d1 AND s2 = d2 AND d1 > 0 AND d2 > 0 AND CASE parts[2] WHEN 'left' THEN dx < 0 WHEN 'right' THEN dx > 0 WHEN 'above' THEN dy < 0 WHEN 'below' THEN dy > 0 ELSE false END"))
def h7_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_edits(spark, sf_dir).where("task = 'position_change'").select("id", "status", "score")


@query("h8_count", f"WITH RECURSIVE {_COUNTED} " + _STATUS.format(task="count_change", passed="s1 > 0 AND d1 = CAST(parts[2] AS BIGINT)"))
def h8_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_edits(spark, sf_dir).where("task = 'count_change'").select("id", "status", "score")


_ONE = "CASE WHEN ends_with({0}, 'es') THEN left({0}, length({0}) - 2) WHEN ends_with({0}, 's') THEN left({0}, length({0}) - 1) ELSE {0} END"


@query(
    "h10_detection_requests",
    f"""WITH {PARSED}, v AS (SELECT * FROM parsed WHERE {VALID})
SELECT id, 'after' AS image, parts[1] AS object, 0.3e0 AS threshold, true AS all_boxes, false AS drop_large FROM v WHERE task = 'subject_add'
UNION SELECT id, 'before', parts[3], 0.3e0, true, false FROM v WHERE task = 'subject_add' AND len(parts) = 3
UNION SELECT id, i, parts[1], 0.35e0, false, true FROM v CROSS JOIN (VALUES ('before'), ('after')) AS t(i) WHERE task = 'subject_remove'
UNION SELECT id, 'before', {_ONE.format("parts[1]")}, 0.3e0, true, false FROM v WHERE task = 'subject_replace'
UNION SELECT id, 'after', {_ONE.format("parts[2]")}, 0.3e0, true, false FROM v WHERE task = 'subject_replace'
UNION SELECT id, 'before', parts[2], 0.3e0, false, false FROM v WHERE task = 'text_change' AND len(parts) = 3
UNION SELECT id, i, parts[p], 0.4e0, true, false FROM v CROSS JOIN (VALUES ('before', 1), ('before', 3), ('after', 1), ('after', 3)) AS t(i, p) WHERE task = 'position_change'
UNION SELECT id, 'before', parts[1], 0.3e0, false, false FROM v WHERE task = 'count_change'
UNION SELECT id, 'after', parts[1], 0.3e0, true, false FROM v WHERE task = 'count_change'
UNION SELECT id, 'after', unnest(parts[2:]), 0.25e0, false, false FROM v WHERE task = 'background_change'""",
)
def h10_detection_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.detection_requests(parsed(spark, sf_dir)).select("id", "need.image", "need.object", "need.threshold", "need.all_boxes", "need.drop_large")


@query("h11_shared_scores", f"WITH {EDITS} SELECT id, vote, CASE WHEN task IN ('subject_remove', 'position_change', 'count_change') THEN id % 2 ELSE (id + vote) % 2 END AS score FROM edits CROSS JOIN (VALUES (1), (2)) AS v(vote)")
def h11_shared_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks without a judge have one score for all votes."""
    voted = edits(spark, sf_dir).withColumn("vote", F.explode(F.array(F.lit(1), F.lit(2))))
    return voted.select("id", "vote", F.when(F.col("task").isin(*rules.JUDGE_FREE), F.col("id") % 2).otherwise((F.col("id") + F.col("vote")) % 2).alias("score"))


@query("i6_work_list", f"WITH {EDITS}, k AS (SELECT id, sha256('[\"' || task || '\", \"' || answer || '\"]') AS request FROM edits) SELECT request, min(id) AS asked_by, count(*) AS uses FROM k GROUP BY request")
def i6_work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same request is asked once."""
    key = digest.digest(digest.json_array(F.array(digest.json_text("task"), digest.json_text("answer"))))
    return edits(spark, sf_dir).groupBy(key.alias("request")).agg(F.min("id").alias("asked_by"), F.count("*").alias("uses"))


class _Detector:
    """Stands for a model: as many boxes as the object's name is long modulo four; names of a length divisible by five it can't answer the first time."""

    def __init__(self, refuses: bool):
        self.refuses = refuses

    def __call__(self, requests):
        length = requests["object"].str.len()
        kept = requests[~self.refuses | (length % 5 != 0)]
        return kept.assign(n_boxes=kept["object"].str.len() % 4)[["request", "n_boxes"]]


@query(
    "l1_model_hook",
    f"""WITH {PARSED}, v AS (SELECT id, task, parts FROM parsed WHERE {VALID} AND task IN ('subject_add', 'count_change')),
r AS (SELECT id, 'after' AS image, parts[1] AS object FROM v UNION SELECT id, 'before', parts[3] FROM v WHERE task = 'subject_add' AND len(parts) = 3 UNION SELECT id, 'before', parts[1] FROM v WHERE task = 'count_change'),
k AS (SELECT *, sha256('["' || image || '", "' || object || '"]') AS request FROM r)
SELECT request, any_value(image) AS image, any_value(object) AS object, count(*) AS uses, CAST(any_value(length(object)) % 4 AS BIGINT) AS n_boxes, any_value(length(object) % 5 = 0) AS second_run, CAST(1 AS BIGINT) AS answers FROM k GROUP BY request""",
)
def l1_model_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections that additions and counts ask for, each distinct request once; what the model leaves open the first time is asked again by a second run, and nothing else."""
    wanted = parsed(spark, sf_dir).where(F.col("task").isin("subject_add", "count_change"))
    asked = rules.detection_requests(wanted).select("id", "need.image", "need.object")
    key = digest.digest(digest.json_array(F.array(digest.json_text("image"), digest.json_text("object"))))
    asked = stored(asked.withColumn("request", key), "requests")
    store = hooks.AnswerStore(spark, new_folder(spark, "answers"), "request", "n_boxes long")
    store.run(asked, lambda: _Detector(True), tasks=4)
    first = stored(store.read().select("request", F.lit(False).alias("second_run")), "first-answers")
    store.run(asked, lambda: _Detector(False), tasks=4)
    given = spark.read.schema(store.schema).parquet(store.folder).groupBy("request").agg(F.count("*").alias("answers"))
    answered = store.answered(asked).groupBy("request").agg(F.first("image").alias("image"), F.first("object").alias("object"), F.count("*").alias("uses"), F.first("n_boxes").alias("n_boxes"))
    return answered.join(given, "request").join(first, "request", "left").withColumn("second_run", F.coalesce("second_run", F.lit(True)))
