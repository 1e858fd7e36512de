"""Column functions over boxes (array<double> x1, y1, x2, y2, as shares of the image)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes that only touch."""
    wide, high = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    shared = F.when((wide > 0) & (high > 0), wide * high).otherwise(0.0)
    return F.coalesce(F.try_divide(shared, area(a) + area(b) - shared), F.lit(0.0))


def count_distinct_boxes(boxes: Column | str, threshold: float = 0.8) -> Column:
    """Number of boxes left when, in order, each box that overlaps a kept one by more than the threshold is dropped."""
    none = F.slice(F.col(boxes) if isinstance(boxes, str) else boxes, 1, 0)
    kept = F.aggregate(boxes, none, lambda kept, b: F.when(F.exists(kept, lambda k: iou(k, b) > threshold), kept).otherwise(F.array_append(kept, b)))
    return F.size(kept).cast("long")


def best_box(detections: Column | str, large: float | None = None) -> Column:
    """Box of the best score (the first of equals); boxes wider and higher than `large` are left out. detections: array<struct<score, box>>."""
    usable = detections if large is None else F.filter(detections, lambda d: ~((d["box"][2] - d["box"][0] > large) & (d["box"][3] - d["box"][1] > large)))
    best = F.array_max(F.transform(usable, lambda d: d["score"]))
    return F.get(F.filter(usable, lambda d: d["score"] == best), F.lit(0))["box"]


def centre(b: Column) -> Column:
    return F.array((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)


def towards(position: Column, reference: Column, target: Column, least: float = 0.03) -> Column:
    """Whether target lies left, right, above or below of reference by more than least; both are centres."""
    dx, dy = target[0] - reference[0], target[1] - reference[1]
    return F.when(position == "left", dx < -least).when(position == "right", dx > least).when(position == "above", dy < -least).when(position == "below", dy > least).otherwise(False)
