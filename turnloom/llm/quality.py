"""Operator 8: quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - w . x): one weight vector w over hashed text features is shared by all grades, and thresholds
ascend. It gives each whole text an expected grade and tail probabilities P(grade >= k). Features, all hashed into one table: three-byte
shapes of the text (letters folded by case, digits, other bytes kept), lower-cased words, and a few marks of how often words repeat.
It is fitted on a bounded sample of rated rows; the arrays sent to tasks have a fixed size. The query's grades are made of two labels of 0 and 1,
as the table has no other: 0 poor, 1 usable but toxic, 2 good.

Defined cases: null and empty texts have the features of an empty text; equal texts get equal results; with no rated row every grade is
as likely as any other; grades without rows are allowed; a document is kept if the chance of a grade over 0 is not less than one half; a very long text
is a slice of its own, read to its end; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.labelled import labelled_sample
from turnloom.llm.textops import Words, slices, utf8_of

SHAPE_BITS, WORD_BITS = 12, 13
N_FEATURES = (1 << SHAPE_BITS) + (1 << WORD_BITS) + 64
MAX_ROWS = 8_000

_SHAPE = np.arange(256, dtype=np.uint32)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 128


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value), sorted by text. Shape and word blocks hold square roots of shares, so each has length 1."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    buf = words.buf
    owner, feature, value = [], [], []

    def block(own: np.ndarray, bucket: np.ndarray, bits: int, start: int) -> None:
        pair, count = np.unique(own << bits | bucket, return_counts=True)
        o = pair >> bits
        owner.append(o)
        feature.append(start + (pair & ((1 << bits) - 1)))
        value.append(np.sqrt(count / np.maximum(np.bincount(own, minlength=n), 1)[o]))

    if len(buf) >= 3:
        s = _SHAPE[buf]
        mixed = (s[:-2] * np.uint32(0x9E3779B1) + s[1:-1] * np.uint32(0x85EBCA77) + s[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        own = np.repeat(np.arange(n), np.diff(words.off))
        inside = own[:-2] == own[2:]
        block(own[:-2][inside], (mixed[inside] >> np.uint32(32 - SHAPE_BITS)).astype(np.int64), SHAPE_BITS, 0)
    h = words.hashes()
    own = words.text_of.astype(np.int64)
    block(own, (h >> np.uint64(64 - WORD_BITS)).astype(np.int64), WORD_BITS, 1 << SHAPE_BITS)
    base = (1 << SHAPE_BITS) + (1 << WORD_BITS)
    total = np.bincount(own, minlength=n)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    repeats = np.bincount(own, same, minlength=n) / np.maximum(total, 1)
    pairs = mixed_pairs(h, own)
    distinct = np.bincount(pairs[0], minlength=n) / np.maximum(np.maximum(total - 1, 0), 1)
    for k, share in enumerate((repeats, np.where(total > 1, 1 - distinct, 0))):
        owner.append(np.arange(n))
        feature.append(base + 16 * k + np.minimum((share * 15.999).astype(np.int64), 15))
        value.append(np.ones(n))
    owner.append(np.arange(n))
    feature.append(base + 32 + np.minimum(np.log2(total + 1).astype(np.int64), 20))
    value.append(np.full(n, 0.5))
    o, f, v = np.concatenate(owner), np.concatenate(feature), np.concatenate(value)
    order = np.argsort(o, kind="stable")
    return o[order], f[order], v[order]


def mixed_pairs(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of neighbouring words of each text: (text, hash)."""
    inside = own[1:] == own[:-1]
    pair = h[1:][inside] * np.uint64(0x9E3779B97F4A7C15) + h[:-1][inside]
    text = own[1:][inside]
    key = np.lexsort((pair, text))
    text, pair = text[key], pair[key]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])
    return text[new], pair[new]


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8_of(batch.column(0))
        for i, j in slices(offsets):
            owner, feature, value = features(data, offsets[i : j + 1])
            at = pa.array(np.searchsorted(owner, np.arange(j - i + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(i, j - i), pa.ListArray.from_arrays(at, pa.array(feature, pa.int32())), pa.ListArray.from_arrays(at, pa.array(value, pa.float32()))], names=["label", "features", "values"]
            )


@dataclass
class CumulativeLink:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, s: np.ndarray) -> np.ndarray:
        """(texts, grades - 1): P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.thresholds[None, :], -500, 500)))


def train(grade: np.ndarray, owner: np.ndarray, feature: np.ndarray, value: np.ndarray, n_grades: int, epochs: int = 12, batch: int = 256, rate: float = 0.05, decay: float = 1e-4) -> CumulativeLink:
    """Maximum likelihood by Adam; thresholds are a first one and positive steps, so they stay in order."""
    rng = np.random.Generator(np.random.PCG64(8))
    n, first = len(grade), np.searchsorted(owner, np.arange(len(grade) + 1))
    share = np.array([(np.sum(grade < k) + 0.5) / (n + 1.0) for k in range(1, n_grades)])
    start = np.log(share / (1 - share))
    t = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    w = np.zeros(N_FEATURES)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, t)]
    step = 0
    for _ in range(max(epochs, -(-600 * batch // max(n, 1)))):
        for part in np.array_split(rng.permutation(n), max(1, n // batch)):
            size = first[part + 1] - first[part]
            at = np.repeat(first[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            own = np.repeat(np.arange(len(part)), size)
            s = np.bincount(own, value[at] * w[feature[at]], minlength=len(part))
            theta = t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))])
            edge = np.concatenate([[-np.inf], theta, [np.inf]])
            g = grade[part]
            hi, lo = (1 / (1 + np.exp(-np.clip(edge[g + k] - s, -60, 60))) for k in (1, 0))
            p = np.maximum(hi - lo, 1e-9)
            d_hi, d_lo = hi * (1 - hi) / p / len(part), lo * (1 - lo) / p / len(part)
            gw = np.bincount(feature[at], value[at] * (d_hi - d_lo)[own], minlength=N_FEATURES) + decay * w
            by_edge = np.bincount(g + 1, -d_hi, minlength=n_grades + 1) + np.bincount(g, d_lo, minlength=n_grades + 1)
            g_theta = by_edge[1:n_grades]
            gt = np.concatenate([[g_theta.sum()], np.exp(t[1:]) * np.cumsum(g_theta[::-1])[::-1][1:]])
            step += 1
            for q, grad, (m, v) in zip((w, t), (gw, gt), state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return CumulativeLink(w, t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))]))


def fit(docs: DataFrame, ratings: DataFrame, grade, n_grades: int, max_rows: int = MAX_ROWS, usable=None) -> CumulativeLink:
    """grade: an expression over the ratings, 0 to n_grades - 1. Fits on at most max_rows rated rows."""
    sample = labelled_sample(docs, ratings, grade, max_rows, usable).select("text", "label").mapInArrow(_featurise, "label double, features array<int>, values array<float>").toArrow()
    if not sample.num_rows:
        k = np.arange(1, n_grades) / n_grades
        return CumulativeLink(np.zeros(N_FEATURES), np.log(k / (1 - k)))
    lists = sample.column("features").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    grades = np.clip(np.rint(sample.column("label").to_numpy()), 0, n_grades - 1).astype(np.int64)
    return train(grades, np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy().astype(np.int64), sample.column("values").combine_chunks().flatten().to_numpy().astype(np.float64), n_grades)


def score(docs: DataFrame, model: CumulativeLink, keep_grade: int = 1, least: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept) of every row; tail_probability is P(grade >= keep_grade), kept from `least` on."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = text_tails(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, keep_grade - 1])], names=["doc_id", "expected_grade", "tail_probability"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")
    return scored.withColumn("kept", F.col("tail_probability") >= least)


def text_tails(texts: pa.Array, model: CumulativeLink) -> np.ndarray:
    data, offsets = utf8_of(texts)
    out = [np.zeros((0, len(model.thresholds)))]
    for i, j in slices(offsets):
        owner, feature, value = features(data, offsets[i : j + 1])
        out.append(model.tails(np.bincount(owner, value * model.weights[feature], minlength=j - i)))
    return np.concatenate(out)


def keep_good(docs: DataFrame, model: CumulativeLink, keep_grade: int = 1, least: float = 0.5) -> DataFrame:
    """The rows of docs with P(grade >= keep_grade) of at least `least`, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(text_tails(batch.column(place), shared.value)[:, keep_grade - 1] >= least))

    return docs.mapInArrow(run, docs.schema)
