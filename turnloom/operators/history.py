"""Session histories: ordered segments of every prefix, their text, signatures and reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.functions import digest

# Fixed values of the three protocols: the text between a turn's instruction and its image, and between that image and the next turn.
SEPARATORS = {"bare": ("\n\n", "\n\n"), "chat": ("<|im_end|>\n<|im_start|>assistant\n", "<|im_end|>\n<|im_start|>user\n"), "legacy": ("\n\n", "\n\n")}


def _segment(kind: str, role: Column | str, turn: Column, text: Column, image: Column | None = None) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    image = F.lit(None).cast("long") if image is None else image.cast("long")
    return F.struct(F.lit(kind).alias("kind"), role.alias("role"), turn.cast("long").alias("turn"), text.alias("text"), image.alias("image_index"))


def history_segments(instructions: Column, protocol: str = "bare", framing: str = "") -> Column:
    """array<segment> of a history whose last instruction is the current one."""
    before, after = SEPARATORS[protocol]
    none, n = F.lit(""), F.size(instructions)

    def turn(text: Column, i: Column) -> Column:
        k = i + 1
        current = k == n
        label = F.when(current, "CURRENT EDIT").otherwise("HISTORY")
        shown = F.concat(label, F.lit(" — Turn "), k.cast("string"), F.lit("\n")) if protocol == "legacy" else none
        own = F.array(_segment("text", "label", k, shown), _segment("text", F.when(current, "current").otherwise("history"), k, text))
        closing = F.array(_segment("text", "separator", k, F.lit(before)), _segment("image", "image", k, none, k), _segment("text", "separator", k, F.lit(after)))
        return F.when(current, own).otherwise(F.concat(own, closing))

    head = [_segment("image", "image", F.lit(0), none, F.lit(0))]
    if protocol == "legacy":
        head.append(_segment("text", "framing", F.lit(0), F.lit(framing)))
    return F.concat(F.array(*head), F.flatten(F.transform(instructions, turn)))


def render(segments: Column | str) -> Column:
    shown = lambda s: F.when(s["kind"] == "image", F.concat(F.lit("[IMAGE_"), s["image_index"].cast("string"), F.lit("]"))).otherwise(s["text"])
    return F.array_join(F.transform(segments, shown), "")


def prefix_length(segments: Column | str) -> Column:
    """Segments before the label of the current turn."""
    at = F.array_position(F.transform(segments, lambda s: s["role"]), "current")
    return (at - 2).cast("long")


def without_current(segments: Column | str) -> Column:
    return F.filter(segments, lambda s: s["role"] != "current")


def removed_places(segments: Column | str) -> Column:
    marks = F.transform(segments, lambda s, i: F.when(s["role"] == "current", i))
    return F.filter(marks, lambda i: i.isNotNull())


def signatures(segments: Column | str, image_hash) -> Column:
    """Digest of each segment; an image's has the hash of the image."""

    def one(s: Column) -> Column:
        fields = {
            "kind": digest.json_text(s["kind"]),
            "role": digest.json_text(s["role"]),
            "turn": s["turn"].cast("string"),
            "text": digest.json_text(s["text"]),
            "image_index": F.coalesce(s["image_index"].cast("string"), F.lit("null")),
        }
        image = digest.json_object(fields | {"image_hash": digest.json_text(image_hash(s["image_index"]))}, spaced=False)
        return digest.digest(F.when(s["kind"] == "image", image).otherwise(digest.json_object(fields, spaced=False)))

    return F.transform(segments, one)


def reusable_prefix(old: Column, new: Column) -> Column:
    """Length of old if it begins new, else 0."""
    return F.when((F.size(old) <= F.size(new)) & (F.slice(new, 1, F.size(old)) == old), F.size(old)).otherwise(0).cast("long")


def prefixes(turns: DataFrame, session: str = "session", text: str = "text") -> DataFrame:
    """Adds the instructions up to each turn, in order."""
    so_far = Window.partitionBy(session).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("instructions", F.collect_list(text).over(so_far))


def contiguity(turns: DataFrame, session: str = "session") -> DataFrame:
    """(session, turns, gaps, duplicates, contiguous) of each session; turns should count up from the first."""
    order = Window.partitionBy(session).orderBy("turn")
    step = F.col("turn") - F.lag("turn").over(order)
    return turns.select(session, "turn", step.alias("step")).groupBy(session).agg(
        F.count("*").alias("turns"), F.count_if(F.col("step") > 1).alias("gaps"), F.count_if(F.col("step") == 0).alias("duplicates"), F.bool_and(F.coalesce(F.col("step") == 1, F.lit(True))).alias("contiguous")
    )
