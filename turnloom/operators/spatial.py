"""Spatial joins of detections kept as rows: overlapping boxes by grid cells, directions by extremes. No image is gathered in one row or task.

A box (x1, y1, x2, y2) belongs to the finest level whose cells are at least as wide and high as it, so it lies in at most four of them. Boxes are
compared in the cells of the coarser of their two levels: those of that level with their own cells, finer ones with the cells of that level that they lie in. A pair
that shares several cells counts in the one that holds the lower corner of its intersection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import boxes

#: Cells of level k are 2 ** -k wide; boxes are shares of an image.
LEVELS = 12
CORNERS = ("x1", "y1", "x2", "y2")


def _levelled(rows: DataFrame, by: list[str], row: str, side: str) -> DataFrame:
    """Boxes with an inside (others overlap nothing), their own level, as columns of that side."""
    wide = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    level = F.least(F.greatest(F.floor(-F.log2(wide)), F.lit(0)), F.lit(LEVELS)).cast("int")
    kept = rows.where("x2 > x1 and y2 > y1").select(*by, F.col(row).alias(f"{side}_row"), *[F.col(c).cast("double").alias(c) for c in CORNERS])
    return kept.withColumn("own", level).select(*by, f"{side}_row", F.col("own").alias(f"{side}_own"), F.struct(*CORNERS).alias(side))


def _cell(v: Column, level: Column) -> Column:
    return F.floor(v * F.pow(F.lit(2.0), level))


def _dealt(rows: DataFrame, side: str, levels: Column) -> DataFrame:
    """A row for each of the levels and cells that a box lies in."""
    each = rows.withColumn("level", F.explode(levels))
    span = lambda a, b: F.sequence(_cell(F.col(f"{side}.{a}"), F.col("level")), _cell(F.col(f"{side}.{b}"), F.col("level")))
    return each.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))


def _joined(left: DataFrame, right: DataFrame, by: list[str], row: str, how: str) -> list[DataFrame]:
    """Two joins: left boxes of a level with right ones of it or finer, and right ones of a level with finer left ones."""
    a, b = _levelled(left, by, row, "a"), _levelled(right, by, row, "b")
    own = lambda side: F.array(F.col(f"{side}_own"))
    up = lambda side: F.sequence(F.lit(0), F.col(f"{side}_own"))
    finer = F.when(F.col("a_own") > 0, F.sequence(F.lit(0), F.col("a_own") - 1)).otherwise(F.array().cast("array<int>"))
    wide, high = F.least("a.x2", "b.x2") - F.greatest("a.x1", "b.x1"), F.least("a.y2", "b.y2") - F.greatest("a.y1", "b.y1")
    out = []
    for one, two in ((_dealt(a, "a", own("a")), _dealt(b, "b", up("b"))), (_dealt(a, "a", finer), _dealt(b, "b", own("b")))):
        one, two = one.alias("l"), two.alias("r")
        on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) if c in by else F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*by, "level", "cx", "cy")]
        meet = (wide > 0) & (high > 0)
        if how == "inner":
            meet = meet & (F.col("l.cx") == _cell(F.greatest("a.x1", "b.x1"), F.col("l.level"))) & (F.col("l.cy") == _cell(F.greatest("a.y1", "b.y1"), F.col("l.level")))
        for c in on:
            meet = meet & c
        out.append(one.join(two, meet, how))
    return out


def overlapping_pairs(left: DataFrame, right: DataFrame, by: list[str], row: str) -> DataFrame:
    """(by, left_row, right_row, iou) of each pair of one group whose boxes have a common inside, once. Rows have by, `row` and x1, y1, x2, y2."""
    box = lambda side: F.array(*[F.col(f"{side}.{c}") for c in CORNERS])
    one, two = (j.select(*[F.col(f"l.{c}").alias(c) for c in by], F.col("a_row").alias(f"left_{row}"), F.col("b_row").alias(f"right_{row}"), boxes.iou(box("a"), box("b")).alias("iou")) for j in _joined(left, right, by, row, "inner"))
    return one.unionByName(two)


def any_overlap(left: DataFrame, right: DataFrame, by: list[str], row: str) -> DataFrame:
    """(by, overlaps) of each group of the left side: whether any of its boxes overlaps one of the right side. A left box is done with its first partner."""
    found = [j.select(*[F.col(f"l.{c}").alias(c) for c in by]).distinct() for j in _joined(left, right, by, row, "left_semi")]
    hit = found[0].unionByName(found[1]).distinct().withColumn("overlaps", F.lit(True))
    return left.select(*by).distinct().join(hit, by, "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(False)))


def any_direction(references: DataFrame, targets: DataFrame, by: list[str], position: str, least: float = 0.03) -> DataFrame:
    """(by, towards) of the groups with a reference and a target: whether any target's centre lies in the direction `position` (a column of the references) of any reference's by more than least.

    Some pair does if the extreme ones do, so two aggregations are joined and no pair is made.
    """
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    ends = lambda rows, side, *more: rows.groupBy(*by, *more).agg(*[f(v).alias(f"{side}_{n}") for v, k in ((x, "x"), (y, "y")) for f, n in ((F.min, f"{k}0"), (F.max, f"{k}1"))])
    joined = ends(references, "a", position).join(ends(targets, "b"), by)
    p = F.col(position)
    # the target farthest in the direction against the reference farthest from it
    passed = F.when(p == "left", F.col("b_x0") - F.col("a_x1") < -least).when(p == "right", F.col("b_x1") - F.col("a_x0") > least).when(p == "above", F.col("b_y0") - F.col("a_y1") < -least).when(p == "below", F.col("b_y1") - F.col("a_y0") > least).otherwise(False)
    return joined.groupBy(*by).agg(F.bool_or(passed).alias("towards"))
