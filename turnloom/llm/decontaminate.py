"""Operator 10: benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words are counted over the whole corpus.
2. The TF-IDF rows of the benchmark's passages get a randomised SVD: tasks multiply their rows with a random matrix and add up their shares
   of the product with the basis; the right singular vectors are the latent space. A large benchmark is taken in blocks, so small that a
   block's space holds all of its passages: no part of a passage's weight is lost. Tasks get the arrays of `PER_PASS` blocks at once.
3. Each text is searched in overlapping windows, longer than the passages they are for. A window whose words that occur in such
   passages weigh too little for any accepted match is passed over; the others are projected. Their product with a passage, which other
   words of the window cannot lessen, must reach the least that a text with `least_common` of the passage's weight can have.
   All such windows are candidates, greatest product first, until one is accepted.
4. A candidate is accepted if the window's words of the passage have a cosine of `least_cosine` with it and the longest common
   subsequence of words, weighted by inverse document frequency, has `least_common` of the passage's weight, and `least_answer` of the
   weight of its last quarter, where the answer stands.

Defined cases: null, empty and blank texts match nothing, nor do such passages; a passage without id matches with a null id; repeated passages match each; repeated rows give
repeated matches; of windows with equal products the one that begins first is tried first; a very long text is a slice of its own, searched to its
end; an empty corpus or benchmark gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.textops import NOT_ALNUM, Words, slices, utf8_of

BITS = 18
PER_PASS = 8
_SHIFT = np.uint64(64 - BITS)
MATCH_SCHEMA = "doc_id long, item_id long, cosine double, common_share double, answer_share double"


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, text of each word, and offsets by text. Words are lower-cased runs of letters and digits."""
    words = Words(data, offsets, NOT_ALNUM)
    return (words.hashes() >> _SHIFT).astype(np.int64), words.text_of, words.first


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8_of(batch.column(0), lower=True)
        found = np.zeros(1 << BITS, dtype=np.int64)
        for i, j in slices(offsets):
            bucket, text, _ = word_buckets(data, offsets[i : j + 1])
            pair = np.unique(text.astype(np.int64) << BITS | bucket)
            found += np.bincount(pair & ((1 << BITS) - 1), minlength=1 << BITS)
        has = np.flatnonzero(found)
        # bucket -1 counts the texts
        yield pa.RecordBatch.from_arrays([pa.array(np.append(has, -1)), pa.array(np.append(found[has], batch.num_rows))], names=["bucket", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """idf of every bucket; as many numbers as buckets, whatever the corpus."""
    counted = docs.select("text").mapInArrow(_document_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = counted.column("bucket").to_numpy(), counted.column("n").to_numpy()
    total = int(n[bucket == -1].sum())
    df = np.zeros(1 << BITS)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    return np.log((total + 1) / (df + 1)) + 0.05


def tf_idf(bucket: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their weights, of length 1."""
    own, count = np.unique(bucket, return_counts=True)
    weight = count * idf[own]
    return own, weight / max(float(np.linalg.norm(weight)), 1e-12)


def least_product(bucket: np.ndarray, idf: np.ndarray, least_common: float) -> float:
    """Least product of a passage's term weights with those of any text that holds `least_common` of the passage's weight."""
    own, count = np.unique(bucket, return_counts=True)
    value = np.sort(count * idf[own])
    before = np.cumsum(value) - value
    return float((value * np.clip(least_common * value.sum() - before, 0, value)).sum())


def own_cosine(item: np.ndarray, text: np.ndarray, idf: np.ndarray) -> float:
    """Cosine of a passage with those words of a text that are the passage's, each counted at most as often as there."""
    own, count = np.unique(item, return_counts=True)
    found = np.minimum(count, np.bincount(np.searchsorted(own, text[np.isin(text, own)]), minlength=len(own)))
    a, b = count * idf[own], found * idf[own]
    return float(a @ b / max(float(np.linalg.norm(a) * np.linalg.norm(b)), 1e-12))


def _random_rows(bucket: np.ndarray, columns: int) -> np.ndarray:
    """Rows of the random matrix, the same in every task."""
    return np.stack([np.random.Generator(np.random.PCG64(int(b))).normal(size=columns) for b in bucket]) if len(bucket) else np.zeros((0, columns))


def _add_up(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(v, dtype=np.float64) for v in table.column("share").to_pylist()], axis=0)
    return pa.table({"bucket": table.column("bucket").slice(0, 1), "share": pa.array([total.tobytes()], pa.binary())})


def latent_space(items: DataFrame, idf: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, vectors): right singular vectors of the items' TF-IDF rows, a row for each bucket in use."""
    spark = items.sparkSession
    shared = spark.sparkContext.broadcast(idf)

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        data, offsets = utf8_of(batch.column("text"), lower=True)
        bucket, _, first = word_buckets(data, offsets)
        for k, number in enumerate(batch.column("place").to_pylist()):
            yield number, *tf_idf(bucket[first[k] : first[k + 1]], shared.value)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(number, (weight @ _random_rows(own, rank + 16)).tobytes()) for number, own, weight in rows(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([y for _, y in out], pa.binary())], names=["place", "row"])

    sketched = items.mapInArrow(sketch, "place long, row binary").toArrow().sort_by("place")
    if not sketched.num_rows:
        return np.zeros(0, dtype=np.int64), np.zeros((0, 1))
    basis, _ = np.linalg.qr(np.stack([np.frombuffer(r, dtype=np.float64) for r in sketched.column("row").to_pylist()]))
    by_item = dict(zip(sketched.column("place").to_pylist(), basis, strict=True))
    own_basis = spark.sparkContext.broadcast(by_item)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, own, weight in rows(batch):
                for b, w in zip(own.tolist(), weight.tolist(), strict=True):
                    sums[b] = sums.get(b, 0) + w * own_basis.value[number]
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["bucket", "share"])

    added = items.mapInArrow(project, "bucket long, share binary").groupBy("bucket").applyInArrow(_add_up, "bucket long, share binary").toArrow().sort_by("bucket")
    if not added.num_rows:
        return np.zeros(0, dtype=np.int64), np.zeros((0, 1))
    _, size, vectors = np.linalg.svd(np.stack([np.frombuffer(v, dtype=np.float64) for v in added.column("share").to_pylist()]).T, full_matrices=False)
    keep = min(rank, int((size > 1e-9 * max(size[0], 1e-12)).sum()))
    return added.column("bucket").to_numpy(), vectors[:keep].T.astype(np.float32)


@dataclass
class Group:
    """Passages of one length class, and the windows they are looked for in."""

    items: np.ndarray
    latent: np.ndarray
    least_product: np.ndarray
    in_passages: np.ndarray
    most_times: np.ndarray
    least_weight: float
    window: int
    stride: int


@dataclass
class Index:
    idf: np.ndarray
    buckets: np.ndarray
    slot: np.ndarray
    vectors: np.ndarray
    words: list[np.ndarray]
    item_ids: list[int | None]
    groups: list[Group]
    least_cosine: float
    least_common: float
    least_answer: float


def build_index(items: DataFrame, idf: np.ndarray, rank: int, least_cosine: float, least_common: float, least_answer: float) -> Index:
    """items: (item_id, text, place), one block of bounded size."""
    buckets, vectors = latent_space(items, idf, rank)
    slot = np.full(1 << BITS, -1, dtype=np.int32)
    slot[buckets] = np.arange(len(buckets))
    block = items.orderBy("place").toArrow()
    data, offsets = utf8_of(block.column("text").combine_chunks() if block.num_rows else pa.array([], pa.string()), lower=True)
    bucket, _, first = word_buckets(data, offsets)
    words = [bucket[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    by_class: dict[int, list[int]] = {}
    for k, own in enumerate(words):
        if len(own):
            step = max(4, 1 << (len(own).bit_length() - 2))
            by_class.setdefault(-(-len(own) // step) * step, []).append(k)
    groups = []
    for longest, own in sorted(by_class.items()):
        latent, most = [], np.zeros(len(buckets) + 1, dtype=np.int32)
        for k in own:
            b, count = np.unique(words[k], return_counts=True)
            latent.append((count * idf[b]) @ vectors[slot[b]])
            most[slot[b]] = np.maximum(most[slot[b]], count)
        # a little less, as products are of single precision
        least = np.array([0.999 * least_product(words[k], idf, least_common) for k in own])
        stride = max(2, longest // 4)
        groups.append(Group(np.array(own), np.stack(latent).astype(np.float32), least, most > 0, most, least_common * min(float(idf[words[k]].sum()) for k in own), longest + stride, stride))
    return Index(idf, buckets, slot, vectors, words, block.column("item_id").to_pylist(), groups, least_cosine, least_common, least_answer)


def common_subsequence(item: np.ndarray, text: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places in item of a common subsequence of greatest weight."""
    best = np.zeros((len(item) + 1, len(text) + 1))
    for i in range(len(item) - 1, -1, -1):
        through = np.where(text == item[i], best[i + 1, 1:] + weight[i], best[i + 1, :-1])
        best[i, :-1] = np.maximum.accumulate(np.maximum(through, best[i + 1, :-1])[::-1])[::-1]
    i = j = 0
    out = []
    while i < len(item) and j < len(text):
        if best[i, j] == best[i + 1, j]:
            i += 1
        elif best[i, j] == best[i, j + 1]:
            j += 1
        else:
            out.append(i)
            i, j = i + 1, j + 1
    return np.array(out, dtype=np.int64)


def search(index: Index, bucket: np.ndarray, text: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float, float, float]]:
    """(text, item, cosine, common share, answer share) of accepted matches in a range of texts."""
    weight = index.idf[bucket]
    length = np.diff(first)
    windows: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
    place = index.slot[bucket]
    slot_idf = np.append(index.idf[index.buckets], 0)
    for g in index.groups:
        # slot -1 is the last one, of no passage
        inside = np.concatenate([[0], np.cumsum(np.where(g.in_passages[place], weight, 0))])
        n = np.where(length > 0, 1 + np.maximum(0, -(-(length - g.window) // g.stride)), 0)
        owner = np.repeat(np.arange(len(length)), n)
        begin = first[owner] + g.stride * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
        end = np.minimum(begin + g.window, first[owner + 1])
        heavy = np.flatnonzero(inside[end] - inside[begin] >= g.least_weight - 1e-9)
        for w in heavy.tolist():
            a, b = int(begin[w]), int(end[w])
            own, count = np.unique(place[a:b], return_counts=True)
            value = np.minimum(count, g.most_times[own]) * slot_idf[own]
            product = g.latent @ (value[own >= 0].astype(np.float32) @ index.vectors[own[own >= 0]])
            for k in np.flatnonzero(product >= g.least_product).tolist():
                key = (int(owner[w]), int(g.items[k]))
                windows.setdefault(key, []).append((-float(product[k]), max(a - g.stride, int(first[owner[w]])), min(b + g.stride, int(first[owner[w] + 1]))))
    out = []
    for (t, k), candidates in sorted(windows.items()):
        item = index.words[k]
        w = index.idf[item]
        answer = np.arange(len(item)) >= len(item) - max(1, len(item) // 4)
        for _, a, b in sorted(candidates):
            cosine = own_cosine(item, bucket[a:b], index.idf)
            if cosine < index.least_cosine:
                continue
            common = common_subsequence(item, bucket[a:b], w)
            share, of_answer = float(w[common].sum() / w.sum()), float(w[common][answer[common]].sum() / w[answer].sum())
            if share >= index.least_common and of_answer >= index.least_answer:
                out.append((t, k, cosine, share, of_answer))
                break
    return out


def matches_in(texts: pa.Array, some: list[Index]) -> list[tuple[int, int, float, float, float]]:
    """(text, item id, cosine, common share, answer share) of accepted matches."""
    data, offsets = utf8_of(texts, lower=True)
    out = []
    for i, j in slices(offsets):
        bucket, text, first = word_buckets(data, offsets[i : j + 1])
        out += [(i + t, index.item_ids[k], *rest) for index in some for t, k, *rest in search(index, bucket, text, first)]
    return out


def indices(docs: DataFrame, benchmark: DataFrame, rank: int = 256, block_items: int = 4096, least_cosine: float = 0.4, least_common: float = 0.7, least_answer: float = 0.5) -> Iterator[list[Index]]:
    """Indices of the benchmark's blocks, at most PER_PASS at once. A block that the hash gives more than `rank` passages gets a larger space."""
    idf = inverse_frequencies(docs)
    n, most = benchmark.count(), min(rank, block_items)
    blocks = 1 if n <= most else -(-n // max(1, 3 * most // 4))
    keyed = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("place", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)))
    for begin in range(0, blocks, PER_PASS):
        out = []
        for k in range(begin, min(begin + PER_PASS, blocks)):
            items = keyed.where(F.col("block") == k).drop("block").persist()
            out.append(build_index(items, idf, max(rank, items.select("text").distinct().count()), least_cosine, least_common, least_answer))
            items.unpersist()
        yield out


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, cosine, common_share, answer_share) of every accepted match of a text with a passage."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for some in indices(docs, benchmark, **options):
        shared = docs.sparkSession.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = matches_in(batch.column(1), shared.value)
                rows = np.array([f[0] for f in found], dtype=np.int64)
                values = [pa.array([f[k] for f in found], pa.float64()) for k in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([f[1] for f in found], pa.int64()), *values], names=["doc_id", "item_id", "cosine", "common_share", "answer_share"])

        part = own.mapInArrow(run, MATCH_SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def keep_unmatched(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that match no passage, with all their columns."""
    place, out = docs.schema.fieldNames().index("text"), docs
    for some in indices(docs, benchmark, **options):
        shared = docs.sparkSession.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = {f[0] for f in matches_in(batch.column(place), shared.value)}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
