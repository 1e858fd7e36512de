"""Operator 13: clustering about centroids with a VA-file.

1. Vectors become whole numbers. One pass takes count, least, greatest, mean and deviation of each dimension; cells of each dimension are
   cut at normal quantiles of these, so that they hold about equally many vectors.
2. The VA-file is one table: of each vector its cells, a few bits a dimension, and beside them the full vector. It is written once.
3. For a set of centroids, lookup tables give the least and the greatest squared distance of a cell to each centroid, by dimension. Their
   sums over a vector's cells are an interval for its distance to each centroid; a centroid whose interval begins beyond the least end can't be
   the nearest. Distances are computed from the full vector only to the centroids that are left, if there are several.
4. A round assigns all vectors and adds up the vectors of each centroid in the tasks; the sums of at most k centroids meet on the driver, where the
   quotients are taken with whole numbers. All figures are exact, whatever the cells.

The full vector stands in the same row as its cells: in Spark a table that is read by keys is read whole, so a file of its own would cost a shuffle and
save no reading. What the cells save is distances.

Defined cases: a vector that is null, of another length, or has null, NaN or infinite components is left out; an empty table, or one without whole vectors, gives
no rows; fewer vectors than centroids give as many centroids; a null id counts as the empty text where the first centroids are chosen; equal ids are
chosen by their vectors; ties of distance go to the centroid of the smaller number; components beyond +-2**19 are taken as +-2**19, so that a squared distance of
64 dimensions fits in a long; repeated rows are kept; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.storage import materialise

ROWS = 2048
SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


@dataclass
class Cells:
    """low[d, c] and high[d, c]: least and greatest component of cell c of dimension d, both inclusive. The last edge is open."""

    bits: int
    edges: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fitted(cls, bits: int, least, greatest, mean, deviation) -> Cells:
        quantiles = np.array([NormalDist().inv_cdf(k / (1 << bits)) for k in range(1, 1 << bits)])
        edges = np.floor(np.asarray(mean)[:, None] + np.asarray(deviation)[:, None] * quantiles).astype(np.int64)
        least, greatest = np.asarray(least)[:, None], np.asarray(greatest)[:, None]
        return cls(bits, edges, np.maximum(np.hstack([least, edges]), least), np.minimum(np.hstack([edges - 1, greatest]), greatest))

    def pack(self, vectors: np.ndarray) -> np.ndarray:
        """Cells of the vectors, `bits` bits each."""
        n, dims = vectors.shape
        cells = np.stack([np.searchsorted(self.edges[d], vectors[:, d], side="right") for d in range(dims)], axis=1).astype(np.uint8)
        return np.packbits(((cells[:, :, None] >> np.arange(self.bits, dtype=np.uint8)) & 1).reshape(n, -1), axis=1, bitorder="little")

    def unpack(self, packed: np.ndarray, dims: int) -> np.ndarray:
        bits = np.unpackbits(packed, axis=1, count=dims * self.bits, bitorder="little").reshape(len(packed), dims, self.bits)
        return bits @ (1 << np.arange(self.bits))


class Assigner:
    """Nearest centroids by intervals from lookup tables."""

    def __init__(self, cells: Cells, centroids: np.ndarray):
        self.cells, self.centroids = cells, centroids
        below, above = cells.low[:, :, None] - centroids.T[:, None, :], cells.high[:, :, None] - centroids.T[:, None, :]
        square = np.maximum(below * below, above * above)
        inside = (below <= 0) & (above >= 0)
        self.least, self.greatest = np.where(inside, 0, np.minimum(below * below, above * above)), square
        self.pairs = self.rows = 0

    def bounds(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.zeros((len(cells), len(self.centroids)), dtype=np.int64)
        high = np.zeros_like(low)
        for d in range(cells.shape[1]):
            low += self.least[d][cells[:, d]]
            high += self.greatest[d][cells[:, d]]
        return low, high

    def nearest(self, packed: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        low, high = self.bounds(self.cells.unpack(packed, vectors.shape[1]))
        left = low <= high.min(axis=1)[:, None]
        cluster = left.argmax(axis=1)
        several = np.flatnonzero(left.sum(axis=1) > 1)
        row, centroid = np.nonzero(left[several])
        self.rows, self.pairs = self.rows + len(several), self.pairs + len(row)
        if len(row):
            away = distances(vectors[several], row, self.centroids, centroid)
            head = np.searchsorted(row, np.arange(len(several)))
            # pairs of a row come by number of centroid: the first of the least is kept
            least = np.flatnonzero(away == np.minimum.reduceat(away, head)[row])
            first = least[np.searchsorted(row[least], np.arange(len(several)))]
            cluster[several] = centroid[first]
        return cluster


def distances(vectors: np.ndarray, row: np.ndarray, centroids: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    out = np.zeros(len(row), dtype=np.int64)
    for d in range(vectors.shape[1]):
        apart = vectors[row, d].astype(np.int64) - centroids[centroid, d]
        out += apart * apart
    return out


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _columns(batch: pa.RecordBatch, bits: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return _matrix(batch.column("cells"), np.uint8, -(-dims * bits // 8)), _matrix(batch.column("full"), "<i4", dims)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


class VAFile:
    """kept: (vec_id, vector array<int>) of the whole vectors."""

    def __init__(self, vectors: DataFrame, dims: int = 64, scale: int = 256, bits: int = 4, id_col: str = "vec_id", vector_col: str = "embedding"):
        if not 1 <= bits <= 8:
            raise ValueError("bits of a cell are 1 to 8")
        self.dims, self.bits = dims, bits
        most = float(scale << 19)
        whole = lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x), F.lit(False))
        rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("v").isNotNull() & (F.size("v") == dims)).where(F.forall("v", whole))
        bounded = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(most)), F.lit(-most))).cast("int")
        self.kept = rows.select("vec_id", F.transform("v", bounded).alias("vector"))
        self.cells, self.table = None, None

    def start(self, k: int) -> np.ndarray:
        """The k vectors whose ids come first in hash order."""
        key = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
        rows = self.kept.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()
        return np.array([r.vector for r in rows], dtype=np.int64).reshape(-1, self.dims)

    def build(self) -> VAFile:
        dims = self.dims

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total, square = 0, np.zeros(dims), np.zeros(dims)
            least, greatest = np.full(dims, np.iinfo(np.int64).max), np.full(dims, np.iinfo(np.int64).min)
            for batch in _blocks(batches):
                v = batch.column(0).flatten().to_numpy().reshape(-1, dims).astype(np.int64)
                n, total, square = n + len(v), total + v.sum(axis=0), square + (v.astype(float) ** 2).sum(axis=0)
                least, greatest = np.minimum(least, v.min(axis=0)), np.maximum(greatest, v.max(axis=0))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), pa.array(np.full(dims, n), pa.int64()), *(pa.array(x) for x in (total, square, least, greatest))], names=["d", "n", "total", "square", "least", "greatest"])

        each = self.kept.select("vector").mapInArrow(measure, "d int, n long, total double, square double, least long, greatest long")
        rows = each.groupBy("d").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("square").alias("square"), F.min("least").alias("least"), F.max("greatest").alias("greatest")).orderBy("d").collect()
        mean = np.array([r.total / r.n for r in rows])
        deviation = np.sqrt(np.maximum(np.array([r.square / r.n for r in rows]) - mean**2, 0))
        self.cells = cells = Cells.fitted(self.bits, [r.least for r in rows], [r.greatest for r in rows], mean, deviation)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _blocks(batches):
                v = batch.column(1).flatten().to_numpy().reshape(-1, dims)
                packed, full = cells.pack(v), v.astype("<i4")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array([x.tobytes() for x in full], pa.binary())], names=["vec_id", "cells", "full"])

        self.table = materialise(self.kept.mapInArrow(encode, "vec_id long, cells binary, full binary"), "va-file")
        return self

    def moved(self, centroids: np.ndarray) -> np.ndarray:
        """Centroids after a round: the floor of the mean of each one's vectors; one without vectors stays."""
        assigner, k, bits, dims = Assigner(self.cells, centroids), len(centroids), self.bits, self.dims

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
            for batch in _blocks(batches):
                packed, full = _columns(batch, bits, dims)
                cluster = assigner.nearest(packed, full)
                n += np.bincount(cluster, minlength=k)
                order = np.argsort(cluster, kind="stable")
                own, head = np.unique(cluster[order], return_index=True)
                total[own] += np.add.reduceat(full[order].astype(np.int64), head, axis=0)
            for c in np.flatnonzero(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(dims, c), pa.int32()), pa.array(np.arange(dims), pa.int32()), pa.array(np.full(dims, n[c]), pa.int64()), pa.array(total[c], pa.int64())], names=["cluster", "d", "n", "total"])

        sums = self.table.select("cells", "full").mapInArrow(add, "cluster int, d int, n long, total long")
        out = centroids.copy()
        for r in sums.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            out[r.cluster, r.d] = r.total // r.n
        return out

    def assigned(self, centroids: np.ndarray) -> DataFrame:
        """(vec_id, cluster, distance) of every vector."""
        assigner, bits, dims = Assigner(self.cells, centroids), self.bits, self.dims

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _blocks(batches):
                packed, full = _columns(batch, bits, dims)
                cluster = assigner.nearest(packed, full)
                away = distances(full, np.arange(len(full)), centroids, cluster)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(away, pa.int64())], names=["vec_id", "cluster", "distance"])

        return self.table.mapInArrow(assign, "vec_id long, cluster int, distance long")


def centroid_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every whole vector."""
    spark = vectors.sparkSession
    file = VAFile(vectors, **options)
    centroids = file.start(k)
    if not len(centroids):
        return spark.createDataFrame([], SCHEMA)
    file.build()
    for _ in range(rounds):
        centroids = file.moved(centroids)
    assigned = materialise(file.assigned(centroids), "assigned")
    # at most k rows on the driver and in the broadcast
    sums = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    rows = [(c, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in sorted(sums)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select(*[x.split()[0] for x in SCHEMA.split(", ")])


def oracle_sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256) -> str:
    steps = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM kept QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id)) <= {k}
)"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS best
  FROM (SELECT kept.vec_id, kept.v, c, list_sum(list_transform(list_zip(kept.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{r}) GROUP BY vec_id
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (
    SELECT c, list(f ORDER BY i) AS v FROM (
      SELECT best.c AS c, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS f FROM (SELECT best, v, unnest(range(1, {dims + 1})) AS i FROM a{r}) GROUP BY 1, 2
    ) GROUP BY c
  ) m USING (c)
)""")
    return "WITH" + ", ".join(steps) + f"""
SELECT vec_id, CAST(best.c AS INT) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = best.c
"""
