"""Clustering with a VA-file against plain rounds."""

import hashlib
import math
import random

import numpy as np
import pytest

from tests.conftest import SMALL
from turnloom.llm.va_clusters import Assigner, Cells, VAFile, centroid_clusters


def _plain(rows, k=40, rounds=5, dims=64):
    kept = [(i, [math.floor(256 * min(max(x, -(2.0**19)), 2.0**19)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((away(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    own = lambda n: sum(d for _, d, m in found if n is None or m == n)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, own(n), own(None), sha[n]) for i, d, n in found), key=repr)


def _got(df, **options):
    return sorted(map(tuple, centroid_clusters(df, **options).collect()), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, cells int, full string, cluster long, distance double"


def test_table(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    assert _got(df) == _plain([(r.vec_id, r.embedding) for r in df.collect()])


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_ties_and_odd_rows(spark, bits):
    """Small whole grids, so that many distances tie; equal vectors, equal ids, and rows to leave out."""
    rng = random.Random(bits)
    rows = [(i % 90, [float(rng.choice([-0.01, 0.0, 0.01])) for _ in range(4)]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [1.0] * 3), (203, [None, 1.0, 1.0, 1.0]), (204, [math.nan] * 4), (205, [math.inf, 0.0, 0.0, 0.0]), (None, [0.5] * 4), (206, [3e38, -3e38, 0.0, 1e-30]), (-7, [524287.5, 0.25, -0.25, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "x", 3, 0.5) for i, v in rows], VECTORS)
    assert _got(df, k=7, rounds=3, dims=4, bits=bits) == _plain([(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 7, 3, 4)


def test_few_and_none(spark):
    few = spark.createDataFrame([(i, [float(i)] * 2, 0, 0, "", 0, 0.0) for i in range(3)], VECTORS)
    assert _got(few, k=5, rounds=2, dims=2) == _plain([(i, [float(i)] * 2) for i in range(3)], 5, 2, 2)
    assert _got(few.where("vec_id > 5"), dims=2) == [] and _got(few) == []


def test_cells_leave_out_distances():
    """On vectors in groups most centroids are ruled out by their cells; what is left agrees with all distances."""
    rng = np.random.default_rng(3)
    centroids = rng.integers(-200, 200, (40, 16))
    vectors = centroids[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, (3000, 16))
    cells = Cells.fitted(4, vectors.min(axis=0), vectors.max(axis=0), vectors.mean(axis=0), vectors.std(axis=0))
    packed = cells.pack(vectors)
    assert packed.shape == (3000, 8)
    assigner = Assigner(cells, centroids)
    low, high = assigner.bounds(cells.unpack(packed, 16))
    away = ((vectors[:, None, :] - centroids) ** 2).sum(axis=2)
    assert (low <= away).all() and (away <= high).all()
    assert (assigner.nearest(packed, vectors) == away.argmin(axis=1)).all()
    assert assigner.pairs < 0.2 * away.size


def test_bits():
    with pytest.raises(ValueError):
        VAFile(None, bits=9)
