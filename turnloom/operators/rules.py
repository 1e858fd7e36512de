"""Rule scores of edits. Detections and answers are columns of the edit's row; each rule is an expression that gives 0 or 1.

A row has: task, parts (from the instruction), answer (lower-cased text), and detections as arrays of boxes, found in the image before (src_*)
and after (dst_*) for the first (`one`) and second (`two`) object that the rule asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import boxes, parsing

# Tasks that need no judge, and what each task asks of the detector: (image, part or None for all kept objects, threshold, all boxes, large boxes dropped).
JUDGE_FREE = ("subject_remove", "position_change", "count_change")
DETECTION_REQUESTS = {
    "subject_add": (("after", 0, 0.3, True, False), ("before", 2, 0.3, True, False)),
    "subject_remove": (("before", 0, 0.35, False, True), ("after", 0, 0.35, False, True)),
    "subject_replace": (("before", 0, 0.3, True, False), ("after", 1, 0.3, True, False)),
    "text_change": (("before", 1, 0.3, False, False),),
    "position_change": (("before", 2, 0.4, True, False), ("before", 0, 0.4, True, False), ("after", 2, 0.4, True, False), ("after", 0, 0.4, True, False)),
    "count_change": (("before", 0, 0.3, False, False), ("after", 0, 0.3, True, False)),
    "background_change": (("after", None, 0.25, False, False),),
}


def said_yes(answer: Column | str = "answer") -> Column:
    """The word anywhere in the answer: answers were read strictly before, here the rule's own wide test is kept."""
    return F.contains(F.col(answer) if isinstance(answer, str) else answer, F.lit("yes"))


def some(found: Column | str) -> Column:
    return F.size(found) > 0


def any_pair(left: Column | str, right: Column | str, test) -> Column:
    return F.exists(left, lambda a: F.exists(right, lambda b: test(a, b)))


def added() -> Column:
    return said_yes() & some("dst_one")


def added_beside() -> Column:
    position = F.col("parts")[1]
    pair = any_pair("src_two", "dst_one", lambda ref, new: boxes.towards(position, boxes.centre(ref), boxes.centre(new)))
    return said_yes() & some("src_two") & some("dst_one") & pair


def removed() -> Column:
    """The object was there, and is gone or elsewhere."""
    elsewhere = boxes.iou(F.get("src_one", F.lit(0)), F.get("dst_one", F.lit(0))) < 0.2
    return some("src_one") & (~some("dst_one") | elsewhere)


def replaced() -> Column:
    return said_yes() & some("src_one") & some("dst_two") & any_pair("src_one", "dst_two", lambda a, b: boxes.iou(a, b) > 0)


def recoloured() -> Column:
    return said_yes()


def text_changed() -> Column:
    wanted = F.lower(F.element_at("parts", -1))
    return F.contains(F.col("answer"), wanted) & ((F.size("parts") == 1) | some("src_one"))


def moved() -> Column:
    same = lambda k: boxes.count_distinct_boxes(f"src_{k}") == boxes.count_distinct_boxes(f"dst_{k}")
    target, reference = (boxes.centre(F.get(f"dst_{k}", F.lit(0))) for k in ("one", "two"))
    return same("one") & same("two") & some("dst_one") & some("dst_two") & boxes.towards(F.col("parts")[1], reference, target, 0.0)


def counted() -> Column:
    return some("src_one") & (boxes.count_distinct_boxes("dst_one") == F.col("parts")[1].cast("long"))


def background_changed() -> Column:
    """dst_kept: the best box of each kept object, or an empty array."""
    wide = lambda b: (F.abs(b[2] - b[0]) > 0.9) & (F.abs(b[3] - b[1]) > 0.9)
    return said_yes() & F.forall("dst_kept", lambda found: (F.size(found) > 0) & ~F.coalesce(wide(F.get(found, F.lit(0))), F.lit(False)))


def rule_score(edits: DataFrame) -> DataFrame:
    """Adds status and score: invalid instructions have no score."""
    task = F.col("task")
    passed = (
        F.when((task == "subject_add") & (F.size("parts") == 3), added_beside())
        .when(task == "subject_add", added())
        .when(task == "subject_remove", removed())
        .when(task == "subject_replace", replaced())
        .when(task.isin("color_alter", "material_alter"), recoloured())
        .when(task == "text_change", text_changed())
        .when(task == "position_change", moved())
        .when(task == "count_change", counted())
        .when(task == "background_change", background_changed())
    )
    parsed = edits.withColumn("parts", parsing.parse_instruction("task", "instruction")).withColumn("valid", parsing.valid_instruction("task", "parts"))
    return parsed.withColumns({"status": F.when(F.col("valid"), "ok").otherwise("invalid_annotation"), "score": F.when(F.col("valid"), F.coalesce(passed, F.lit(False)).cast("double"))})


def detection_requests(parsed: DataFrame) -> DataFrame:
    """Every detection that a valid edit may need, once each, in column `need`: image, object, threshold and flags. Parts that an instruction lacks are not asked for."""

    def asked(image: str, part: int | None, threshold: float, all_boxes: bool, drop_large: bool) -> Column:
        names = F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))) if part is None else F.array(F.get("parts", F.lit(part)))
        flags = [F.lit(threshold).alias("threshold"), F.lit(all_boxes).alias("all_boxes"), F.lit(drop_large).alias("drop_large")]
        # objects of a replacement are asked for in the singular
        return F.transform(names, lambda o: F.struct(F.lit(image).alias("image"), F.when(F.col("task") == "subject_replace", parsing.singular(o)).otherwise(o).alias("object"), *flags))

    needs = F.lit(None)
    for task, rows in DETECTION_REQUESTS.items():
        needs = F.when(F.col("task") == task, F.concat(*[asked(*r) for r in rows])).otherwise(needs)
    return parsed.where("valid").withColumn("need", F.explode(F.array_distinct(needs))).where("need.object is not null")


def requested_detections(needed: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """What a detector answered to each request: found has the keys, image, object, threshold, all_boxes, drop_large and boxes. A request without an answer stays, with null boxes, for the next run."""
    named = needed.select("*", *[F.col(f"need.{c}").alias(c) for c in ("image", "object", "threshold", "all_boxes", "drop_large")])
    on = [*keys, "image", "object", "threshold", "all_boxes", "drop_large"]
    return named.join(found.select(*on, "boxes"), on, "left")
