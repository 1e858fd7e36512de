"""Operator 5: toxicity by a factorization machine over hashed terms.

Terms are the lower-cased runs of letters and digits of the whole text and their beginnings, hashed; a term counts once. From a bounded sample of labelled
rows Spark counts each term's rows by label and keeps the terms most associated with the label, alone or in pairs: of the most frequent terms all pairs
are counted by label, and both terms of a pair are kept that tells more than either of them. The machine is then fitted on those terms: a bias, a weight for each term, and a vector for each term whose products weigh pairs of terms. Scoring reads whole texts in
Arrow batches with the fitted arrays, whose size is fixed by the parameters.

Defined cases: null and empty texts have no terms and score the bias; equal texts score alike; without any labelled row, or with labels of one
class only, the score is the smoothed share of label 1; terms of equal association are kept in the order of their hashes; a very long text is a
slice of its own, read to its end; an empty table gives no rows; further columns are ignored. A term that says nothing about the label, alone or
in pairs, is not among the kept ones: at most MAX_TERMS alone and twice MAX_PAIRS by pairs of the PAIR_TERMS most frequent, bounds on features, not on rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.labelled import id_crc32, labelled_sample
from turnloom.llm.textops import NOT_ALNUM, Words, mix, slices, utf8_of

BITS = 18
MAX_ROWS = 20_000
MAX_TERMS = 1_024
HEADS = (4, 5, 6, 7, 8)
#: Least log-likelihood ratio (twice the gain in log-likelihood) of a term with the label.
LEAST_G = 20.0
#: Most frequent terms whose pairs are counted, and how many pairs add their terms.
PAIR_TERMS = 1_024
MAX_PAIRS = 256
RANK = 8
_SHIFT, _MASK = np.uint64(64 - BITS), (1 << BITS) - 1


def _term_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text: (text, bucket), sorted. Terms are words, and word beginnings of HEADS bytes with how many distinct words have them (1, 2 or 4 at least)."""
    words = Words(data, offsets, NOT_ALNUM)
    size = words.end - words.start
    whole = words.hashes()
    order = np.lexsort((whole, words.text_of))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (whole[order][1:] != whole[order][:-1]) | (words.text_of[order][1:] != words.text_of[order][:-1])
    one = order[new]
    text = words.text_of.astype(np.int64)
    terms = [text[one] << BITS | (whole[one] >> _SHIFT).astype(np.int64)]
    for k in HEADS:
        own = one[size[one] > k]
        head = words.hashes(k)[own]
        pair, count = np.unique(text[own] << BITS | (head >> _SHIFT).astype(np.int64), return_counts=True)
        for level in (1, 2, 4):
            at = pair[count >= level]
            bucket = mix((at & _MASK).astype(np.uint64) + np.uint64(level * 1_000_003 + k * 7_919)) >> _SHIFT
            terms.append(at >> BITS << BITS | bucket.astype(np.int64))
    found = np.unique(np.concatenate(terms))
    return found >> BITS, found & _MASK


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, label, weight -> label, weight, terms"""
    for batch in batches:
        data, offsets = utf8_of(batch.column(0))
        for i, j in slices(offsets):
            owner, bucket = _term_rows(data, offsets[i : j + 1])
            at = np.searchsorted(owner, np.arange(j - i + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(bucket, pa.int32()))], names=["label", "weight", "terms"]
            )


@dataclass
class Machine:
    """slots: bucket -> row of the weights, -1 for a term without weights."""

    bias: float
    slots: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, owner: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        """owner ascends; slot: rows of the weights."""
        out = np.full(n, self.bias)
        if len(owner):
            out += np.bincount(owner, self.weights[slot], minlength=n)
            for v in self.vectors.T:
                own = v[slot]
                out += 0.5 * (np.bincount(owner, own, minlength=n) ** 2 - np.bincount(owner, own * own, minlength=n))
        return out


def _slotted(batches: Iterator[pa.RecordBatch], slots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Terms to rows of the weights; terms without weights go."""
    for batch in batches:
        lists = batch.column(1)
        slot = slots[lists.flatten().to_numpy().astype(np.int64)]
        owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        at = np.searchsorted(owner[slot >= 0], np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(slot[slot >= 0], pa.int32()))], names=["label", "slots"])


def _likelihood_ratio(both: np.ndarray, with_term: np.ndarray, positive: float, n: float) -> np.ndarray:
    """Of the 2 x 2 table of a term (or pair) and the label; both: rows with it and label 1."""
    cell = lambda k, row, column: np.where(k > 0, k * np.log(np.maximum(k, 1e-12) * n / np.maximum(row * column, 1e-12)), 0.0)
    without = n - with_term
    return 2 * (cell(both, with_term, positive) + cell(with_term - both, with_term, n - positive) + cell(positive - both, without, positive) + cell(n - positive - with_term + both, without, n - positive))


def _paired_terms(labels: np.ndarray, slots: np.ndarray, first: np.ndarray, n_terms: int) -> np.ndarray:
    """Terms of the MAX_PAIRS pairs that gain most over the better of their two terms, and LEAST_G at least."""
    held = np.zeros((len(labels), n_terms), dtype=np.float32)
    held[np.repeat(np.arange(len(labels)), np.diff(first)), slots] = 1
    together, positive = (held.T @ held).astype(np.float64), (held.T @ (held * labels[:, None].astype(np.float32))).astype(np.float64)
    g = _likelihood_ratio(positive, together, float(labels.sum()), float(len(labels)))
    alone = np.diag(g)
    gain = np.triu(g - np.maximum(alone[:, None], alone[None, :]), 1)
    gain[together < 3] = 0
    best = np.argsort(-gain, axis=None, kind="stable")[:MAX_PAIRS]
    best = best[gain.ravel()[best] >= LEAST_G]
    return np.unique(np.concatenate(np.unravel_index(best, gain.shape)))


def _train(labels: np.ndarray, slots: np.ndarray, first: np.ndarray, n_terms: int, epochs: int = 30, batch: int = 256, rate: float = 0.05, decay: float = 1e-5) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam on the mean log loss; text i has slots[first[i] : first[i + 1]]."""
    rng = np.random.Generator(np.random.PCG64(5))
    bias = np.array([np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))])
    w, v = np.zeros(n_terms), rng.normal(0, 0.05, (n_terms, RANK))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (bias, w, v)]
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // batch)):
            size = first[part + 1] - first[part]
            slot = slots[np.repeat(first[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            owner = np.repeat(np.arange(len(part)), size)
            sums = np.zeros((len(part), RANK))
            np.add.at(sums, owner, v[slot])
            z = bias[0] + np.bincount(owner, w[slot], minlength=len(part)) + 0.5 * ((sums**2).sum(1) - np.bincount(owner, (v[slot] ** 2).sum(1), minlength=len(part)))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            gw = np.bincount(slot, error[owner], minlength=n_terms) + decay * w
            gv = decay * v
            np.add.at(gv, slot, error[owner, None] * (sums[owner] - v[slot]))
            step += 1
            for p, g, (m, s) in zip((bias, w, v), (np.array([error.sum()]), gw, gv), state, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return float(bias[0]), w, v


def _rows_of(sample: DataFrame, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, slots and offsets of the sample's rows, whose number is bounded."""
    rows = sample.select("label", "terms").mapInArrow(lambda it: _slotted(it, slots), "label double, slots array<int>").toArrow()
    lists = rows.column("slots").combine_chunks()
    return rows.column("label").to_numpy(), lists.flatten().to_numpy().astype(np.int64), lists.offsets.to_numpy()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, usable=None) -> Machine:
    """Fits on a sample of at most max_rows labelled rows for which usable (a condition on doc_id) holds."""
    sample = labelled_sample(docs, labels, F.col(label), max_rows, usable).mapInArrow(_terms, "label double, weight long, terms array<int>")
    sample = sample.persist()
    total, positive = sample.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.sum(F.col("weight") * F.col("label")), F.lit(0.0))).first()
    total, positive = float(total), float(positive)
    slots, w, v = np.full(1 << BITS, -1, dtype=np.int32), np.zeros(0), np.zeros((0, RANK))
    bias = float(np.log((positive + 0.5) / (total - positive + 0.5)))
    if 0 < positive < total:
        # rows, not weights, are counted for the choice of terms: copies of one text are one piece of evidence
        n, pos = sample.agg(F.count("*"), F.sum("label")).first()
        by_term = sample.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("p"), F.count("*").alias("d"))
        # log-likelihood ratio of the 2 x 2 table of term and label
        cell = lambda k, row, column: F.when(k > 0, k * F.log(k * float(n) / (row * column))).otherwise(0.0)
        with_pos, without = F.col("p"), F.lit(float(n)) - F.col("d")
        positive_rows, negative_rows = F.lit(float(pos)), F.lit(float(n - pos))
        g = 2 * (
            cell(with_pos, F.col("d"), positive_rows)
            + cell(F.col("d") - with_pos, F.col("d"), negative_rows)
            + cell(positive_rows - with_pos, without, positive_rows)
            + cell(negative_rows - F.col("d") + with_pos, without, negative_rows)
        )
        kept = by_term.where(f"d >= 3 and d < {n}").select("term", g.alias("g")).where(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "term").limit(MAX_TERMS).collect()
        frequent = by_term.where(f"d >= 20 and d < {n}").orderBy(F.desc("d"), "term").limit(PAIR_TERMS).select("term").collect()
        terms = [r.term for r in kept]
        if frequent:
            slots[[r.term for r in frequent]] = np.arange(len(frequent))
            paired = _paired_terms(*_rows_of(sample, slots), len(frequent))
            slots[:] = -1
            terms += sorted({frequent[k].term for k in paired} - set(terms))
        slots[terms] = np.arange(len(terms))
        if terms:
            bias, w, v = _train(*_rows_of(sample, slots), len(terms))
    sample.unpersist()
    return Machine(bias, slots, w, v)


def _scorer(machine):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = machine.value
        for batch in batches:
            data, offsets = utf8_of(batch.column(1))
            for i, j in slices(offsets):
                owner, bucket = _term_rows(data, offsets[i : j + 1])
                slot = fitted.slots[bucket]
                z = fitted.logits(owner[slot >= 0], slot[slot >= 0], j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())], names=["doc_id", "score"])

    return score


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(shared), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out():
    return id_crc32("doc_id") % 4 == 2


def keep_clean(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    schema = docs.schema
    place = schema.fieldNames().index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            narrow = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(place)], names=["doc_id", "text"])
            marks = [p for b in scorer([narrow]) for p in b.column("score").to_pylist()]
            yield batch.filter(pa.array([m < threshold for m in marks], pa.bool_()))

    return docs.mapInArrow(keep, schema)
