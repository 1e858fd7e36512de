"""Spatial joins of detection rows against all pairs, and an image with very many boxes."""

import random

import pytest
from pyspark.sql import functions as F

from turnloom.operators import spatial

BOXES = "image long, k long, x1 double, y1 double, x2 double, y2 double, position string"


def _iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def _random_boxes(rng, images, n):
    """Boxes of all sizes, some on cell borders, some without an inside, some equal."""
    out = []
    for image in images:
        for k in range(n):
            size = 2.0 ** -rng.randrange(0, 14)
            x, y = rng.choice([rng.random(), rng.randrange(9) / 8]), rng.choice([rng.random(), rng.randrange(9) / 8])
            w, h = size * rng.choice([1, rng.random(), 0]), size * rng.choice([1, rng.random()])
            out.append((image, k, x, y, x + w, y + h, ("left", "right", "above", "below", "none")[(image or 0) % 5]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    left, right = _random_boxes(rng, [0, 1, 2, None], 25), _random_boxes(rng, [0, 1, 3, None], 25)
    a, b = spark.createDataFrame(left, BOXES), spark.createDataFrame(right, BOXES)
    want = {(p[0], p[1], q[1]): _iou(p[2:6], q[2:6]) for p in left for q in right if p[0] == q[0] and _iou(p[2:6], q[2:6]) > 0}
    rows = spatial.overlapping_pairs(a, b, ["image"], "k").collect()
    assert len(rows) == len(want) and {(r.image, r.left_k, r.right_k): r.iou for r in rows} == pytest.approx(want)
    some = {r.image: r.overlaps for r in spatial.any_overlap(a.where("image is not null"), b, ["image"], "k").collect()}
    assert some == {i: any(k[0] == i for k in want) for i in (0, 1, 2)}


def test_any_direction(spark):
    rng = random.Random(5)
    left, right = _random_boxes(rng, range(10), 3), _random_boxes(rng, range(10), 3)
    middle = lambda r: ((r[2] + r[4]) / 2, (r[3] + r[5]) / 2)
    passes = {"left": lambda dx, dy: dx < -0.3, "right": lambda dx, dy: dx > 0.3, "above": lambda dx, dy: dy < -0.3, "below": lambda dx, dy: dy > 0.3, "none": lambda dx, dy: False}
    want = {i: any(passes[p[6]](middle(q)[0] - middle(p)[0], middle(q)[1] - middle(p)[1]) for p in left for q in right if p[0] == q[0] == i) for i in range(10)}
    got = spatial.any_direction(spark.createDataFrame(left, BOXES), spark.createDataFrame(right, BOXES), ["image"], "position", 0.3)
    assert {r.image: r.towards for r in got.collect()} == want and {True, False} == set(want.values())


def test_one_image_with_many_boxes(spark):
    """A hundred thousand small boxes of one image on each side, and a large one: each small one meets its equal and the large one, in some seconds."""
    n = 100_000
    at = lambda c, m: F.lit(1.0) * (F.col("id") % m if c == "x" else F.floor(F.col("id") / m)) / 400
    small = spark.range(n).select(F.lit(0).cast("long").alias("image"), F.col("id").alias("k"), at("x", 400).alias("x1"), at("y", 400).alias("y1"), (at("x", 400) + 0.001).alias("x2"), (at("y", 400) + 0.001).alias("y2"))
    large = spark.createDataFrame([(0, -1, 0.0, 0.0, 1.0, 1.0)], "image long, k long, x1 double, y1 double, x2 double, y2 double")
    pairs = spatial.overlapping_pairs(small, small.unionByName(large), ["image"], "k")
    assert pairs.agg(F.count("*"), F.count_if(F.col("left_k") == F.col("right_k")), F.count_if(F.col("right_k") == -1)).first()[:] == (2 * n, n, n)
    assert spatial.any_overlap(small, large, ["image"], "k").collect() == [(0, True)]
