"""Operator 11: substring dedup with a compressed FM-index for each shard.

A window is `window` consecutive words of one document. A window repeats if its words also start in a document with a smaller id; every
word that a repeating window covers is removed.

1. Each window has an anchor: the run of `anchor_words` words inside it with the least hash, the leftmost at ties. Equal windows have equal
   anchors. Neighbouring windows with one anchor make a segment, so a document is cut into overlapping segments of fewer than
   twice the window's words. Only segments whose anchor is found in several documents go on; they are what is streamed.
2. Equal segments are taken together, with the least id that holds them; their words are read from that document.
3. Segments are dealt out by their anchors. A task takes some at a time, of about `shard_words` words, and makes an FM-index (fm_index) over
   them, with the least id behind each interval of full matches; backward search over its wavelet tree then gives the matching statistics of
   each segment. A window repeats where the match has full length and an id below the segment's own is behind it. A segment's later copies repeat
   all the way.
4. An anchor with more than `most_segments` different segments (a passage whose neighbours all differ) is split into several shards. Their
   windows, with the least id that each shard's index found, are brought together by digest, so that nothing is lost.
5. Repeating windows are gathered for each document, as a start and a bit for each window of a segment, and its words are filtered.

Words are compared by 64-bit hashes; for two unequal windows to be taken as equal, their anchors and all differing words would have to
collide.

Defined cases: a null, empty or blank text has no words; a text with fewer words than a window keeps them all, as does the first of equal texts;
rows of one id (repeated or not) don't remove each other's words; a row without id removes nothing and loses nothing; a very long text is a
slice of its own in each pass, and its segments are dealt out like others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.fm_index import FMIndex
from turnloom.llm.storage import materialise
from turnloom.llm.textops import Words, mix, powers, slices, utf8_of

LENGTH = np.uint64(0xD6E8FEB86659FD93)
_rng = np.random.Generator(np.random.PCG64(11))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xC2B2AE3D27D4EB4F
_BASE_INV = pow(_BASE, -1, 1 << 64)
_WORD_BASE = 0x9E3779B97F4A7C15
_WORD_BASE_INV = pow(_WORD_BASE, -1, 1 << 64)
SEGMENT_SCHEMA = "doc_id long, text_key long, start int, windows int, anchor long, digest long"
MATCH_SCHEMA = "anchor long, digest long, doc_id long, mask long, place int, window_digest long, least_id long"


def word_hashes(words: Words) -> np.ndarray:
    """Hashes of the words as they are, unlike Words.hashes, which folds case."""
    total = np.zeros(len(words.buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[words.buf] * powers(len(words.buf), _BASE), out=total[1:])
    own = (total[words.end] - total[words.start]) * powers(len(words.buf), _BASE_INV)[words.start]
    return mix(own + (words.end - words.start).astype(np.uint64) * LENGTH)


class Runs:
    """Hashes of any runs of consecutive words."""

    def __init__(self, hashes: np.ndarray):
        self.total = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * powers(len(hashes), _WORD_BASE), out=self.total[1:])
        self.shift = powers(len(hashes), _WORD_BASE_INV)

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.total[start + length] - self.total[start]) * self.shift[start] + np.asarray(length, dtype=np.uint64) * LENGTH)


def _leftmost_least(values: np.ndarray, span: int) -> np.ndarray:
    """Place of the least value among each `span` consecutive ones."""
    best, have = np.arange(len(values)), 1
    while 2 * have <= span:
        a, b = best[:-have], best[have:]
        best, have = np.where(values[a] <= values[b], a, b), 2 * have
    n = len(values) - span + 1
    a, b = best[:n], best[span - have : span - have + n]
    return np.where(values[a] <= values[b], a, b)


def _anchor_words(window: int) -> int:
    """A third of the window, or as many words as leave at most 63 places for an anchor: a segment's windows are bits of a long."""
    return max(1, window // 3, window - 62)


def segments_of(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """(text, start within it, number of windows, anchor, digest) of each segment; the start is that of the first window."""
    hashes, gram = word_hashes(words), _anchor_words(window)
    if len(hashes) < window:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    runs = Runs(hashes)
    grams = runs.of(np.arange(len(hashes) - gram + 1), gram)
    at = _leftmost_least(grams, window - gram + 1)
    start = np.arange(len(at))
    inside = start + window <= words.first[1:][words.text_of[: len(at)]]
    start, at = start[inside], at[inside]
    opens = np.ones(len(start), dtype=bool)
    opens[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(opens)
    n = np.diff(np.append(head, len(start)))
    first = start[head]
    text = words.text_of[first]
    return text, first - words.first[text], n, grams[at[head]].view(np.int64), runs.of(first, n + window - 1).view(np.int64)


def _cutter(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_of(batch.column("text"))
            for i, j in slices(offsets):
                text, start, n, anchor, digest = segments_of(Words(data, offsets[i : j + 1]), window)
                owner = pa.array(text + i, pa.int64())
                numbers = [pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(anchor, pa.int64()), pa.array(digest, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(owner), batch.column("text_key").take(owner), *numbers], names=[x.split()[0] for x in SEGMENT_SCHEMA.split(", ")])

    return cut


def _reader(window: int):
    """Words of the wanted segments (lists of start, windows, anchor, digest, salt) of each document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_of(batch.column("text"))
            wanted = batch.column("wanted")
            for i, j in slices(offsets):
                words = Words(data, offsets[i : j + 1])
                hashes = word_hashes(words)
                own = wanted.slice(i, j - i)
                text, item = np.repeat(np.arange(j - i), own.value_lengths().to_numpy()), own.flatten()
                fields = {name: item.field(k) for k, name in enumerate(("start", "windows", "anchor", "digest", "salt"))}
                first = words.first[text] + fields["start"].to_numpy()
                size = fields["windows"].to_numpy() + window - 1
                for a in range(0, len(first), 4096):
                    own_first, own_size = first[a : a + 4096], size[a : a + 4096]
                    ends = np.cumsum(own_size)
                    place = np.arange(ends[-1]) + np.repeat(own_first - (ends - own_size), own_size)
                    raw = pa.py_buffer(hashes[place].tobytes())
                    binary = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends * 8]).astype(np.int32).tobytes()), raw])
                    part = [fields[name].slice(a, len(ends)) for name in ("anchor", "salt", "digest")]
                    yield pa.RecordBatch.from_arrays([*part, batch.column("doc_id").take(pa.array(text[a : a + 4096] + i, pa.int64())), binary], names=["anchor", "salt", "digest", "doc_id", "words"])

    return read


def _search(anchor, salt, digest, doc_id, raw: list[bytes], window: int) -> pa.RecordBatch:
    """One shard: its index, and what the matching statistics of its segments say."""
    flat = np.frombuffer(b"".join(raw), dtype=np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw])])
    index = FMIndex(flat, offsets, doc_id, window)
    length, least = index.matching_statistics(flat, offsets)
    size = np.diff(offsets)
    windows = size - window + 1
    owner = np.repeat(np.arange(len(raw)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = offsets[owner] + place
    repeats = (length[at] == window) & (least[at] < doc_id[owner])
    mask = np.bitwise_or.reduceat(repeats.astype(np.int64) << place, np.cumsum(windows) - windows)
    split = salt >= 0
    more = split[owner]
    columns = [anchor[~split], digest[~split], doc_id[~split], mask[~split]], [anchor[owner[more]], digest[owner[more]], doc_id[owner[more]]]
    n, m = int((~split).sum()), int(more.sum())
    # rows of segments that are whole in this shard, then rows of windows for those whose anchor has several shards
    tail = [place[more], Runs(flat).of(at[more], window).view(np.int64), least[at[more]]]
    out = [pa.array(np.concatenate([columns[0][k], columns[1][k]]), pa.int64()) for k in range(3)]
    out.append(pa.concat_arrays([pa.array(columns[0][3], pa.int64()), pa.nulls(m, pa.int64())]))
    out += [pa.concat_arrays([pa.nulls(n, kind), pa.array(x, kind)]) for x, kind in zip(tail, (pa.int32(), pa.int64(), pa.int64()), strict=True)]
    return pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in MATCH_SCHEMA.split(", ")])


def _searcher(window: int, shard_words: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor and salt; a shard ends between two of these, once it has the words."""
        held: list[tuple] = []
        words, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "salt", "digest", "doc_id", "words")), strict=True):
                if words >= shard_words and row[:2] != last:
                    yield _shard(held, window)
                    held, words = [], 0
                held.append(row)
                words, last = words + len(row[4]) // 8, row[:2]
        if held:
            yield _shard(held, window)

    return search


def _shard(rows: list[tuple], window: int) -> pa.RecordBatch:
    anchor, salt, digest, doc_id, raw = zip(*rows, strict=True)
    return _search(*(np.array(x, dtype=np.int64) for x in (anchor, salt, digest, doc_id)), list(raw), window)


def _kept_words(window: int):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_of(batch.column("text"))
            found = batch.column("found")
            for i, j in slices(offsets):
                words = Words(data, offsets[i : j + 1])
                covered = covered_words(words, found.slice(i, j - i), window)
                buf, ends = joined(words, ~covered)
                n_words = np.diff(words.first)
                total = np.concatenate([[0], np.cumsum(covered)])
                removed = total[words.first[1:]] - total[words.first[:-1]]
                strings = pa.Array.from_buffers(pa.large_string(), j - i, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(buf.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), strings.cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return kept


def covered_words(words: Words, found: pa.ListArray, window: int) -> np.ndarray:
    """Which words a repeating window covers. found: for each text a list of (start, mask), or null."""
    n = len(words.start)
    change = np.zeros(n + 1, dtype=np.int64)
    sizes = np.nan_to_num(found.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    item = found.flatten()
    if len(item):
        first = words.first[np.repeat(np.arange(len(sizes)), sizes)] + item.field(0).to_numpy()
        mask = item.field(1).to_numpy()
        for place in range(window - _anchor_words(window) + 1):
            at = first[(mask >> place & 1).astype(bool)] + place
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
    return np.cumsum(change[:-1]) > 0


def joined(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text joined by one space: bytes, and offsets of texts."""
    start, end, text = words.start[keep], words.end[keep], words.text_of[keep]
    n_texts = len(words.first) - 1
    last = np.ones(len(text), dtype=bool)
    last[:-1] = text[1:] != text[:-1]
    size = end - start + ~last
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)
    buf = words.buf[at] if len(at) else np.zeros(0, dtype=np.uint8)
    buf[ends[~last] - 1] = 32
    per_text = np.zeros(n_texts + 1, dtype=np.int64)
    np.add.at(per_text, text + 1, size)
    return buf, np.cumsum(per_text)


class SubstringDedup:
    def __init__(self, docs: DataFrame, window: int = 50, shard_words: int = 1 << 18, most_segments: int = 4096, id_col: str = "doc_id", text_col: str = "text"):
        self.window, self.shard_words, self.most_segments = window, shard_words, most_segments
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))

    def open_segments(self) -> DataFrame:
        """Segments whose anchor is in several documents."""
        cut = self.docs.where(F.col("doc_id").isNotNull()).mapInArrow(_cutter(self.window), SEGMENT_SCHEMA)
        segments = materialise(cut, "segments")
        # tables of their own, here and below: a join with an aggregate in its own stage could not split a key with very many rows
        shared = segments.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
        shared = materialise(shared, "shared-anchors")
        return materialise(segments.join(shared, "anchor"), "open-segments")

    def _first_of_each(self, segments: DataFrame) -> DataFrame:
        """(anchor, digest, own, salt) of each different segment: own is its place in the least document that holds it, salt its shard where the anchor has several, else -1."""
        each = segments.groupBy("anchor", "digest").agg(F.min(F.struct("doc_id", "text_key", "start", "windows")).alias("own"))
        each = materialise(each, "distinct-segments")
        hot = each.groupBy("anchor").agg(F.ceil(F.count("*") / self.most_segments).alias("shards")).where("shards > 1")
        return each.join(materialise(hot, "split-anchors"), "anchor", "left").withColumn("salt", F.coalesce(F.pmod("digest", "shards"), F.lit(-1)).cast("long"))

    def _with_words(self, each: DataFrame) -> DataFrame:
        wanted = each.groupBy("own.doc_id", "own.text_key").agg(F.collect_list(F.struct("own.start", "own.windows", "anchor", "digest", "salt")).alias("wanted"))
        # of repeated rows one is read
        texts = self.docs.join(wanted.hint("merge"), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
        return texts.select("doc_id", "text", "wanted").mapInArrow(_reader(self.window), "anchor long, salt long, digest long, doc_id long, words binary")

    def repeats(self, segments: DataFrame) -> DataFrame:
        """(anchor, digest, first_id, mask) of each different segment: which of its windows repeat in the document first_id, the least that holds it."""
        words = self._with_words(self._first_of_each(segments))
        dealt = words.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
        matches = materialise(dealt.mapInArrow(_searcher(self.window, self.shard_words), MATCH_SCHEMA), "matches")
        whole = matches.where("mask is not null").select("anchor", "digest", "doc_id", "mask")
        windows = matches.where("mask is null")
        least = windows.groupBy("anchor", "window_digest").agg(F.min("least_id").alias("first_id"))
        repeating = windows.join(materialise(least, "split-windows"), ["anchor", "window_digest"]).where("first_id < doc_id")
        split = repeating.groupBy("anchor", "digest", "doc_id").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"))
        rest = windows.select("anchor", "digest", "doc_id").distinct().join(split, ["anchor", "digest", "doc_id"], "left").fillna(0, ["mask"])
        return whole.unionByName(rest).withColumnRenamed("doc_id", "first_id")

    def found(self) -> DataFrame:
        """(doc_id, text_key, found) of the documents with repeating windows: found lists (start, mask)."""
        segments = self.open_segments()
        every = F.expr("shiftrightunsigned(-1L, 64 - windows)")
        hits = segments.join(self.repeats(segments), ["anchor", "digest"]).withColumn("mask", F.when(F.col("doc_id") > F.col("first_id"), every).otherwise(F.col("mask")))
        return hits.where("mask != 0").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "mask")).alias("found"))

    def result(self) -> DataFrame:
        """(doc_id, n_words, n_removed, kept_text) of every row."""
        joined_ = self.docs.join(self.found().hint("merge"), ["doc_id", "text_key"], "left").select("doc_id", "text", "found")
        return joined_.mapInArrow(_kept_words(self.window), "doc_id long, n_words long, n_removed long, kept_text string")


def substring_dedup(docs: DataFrame, **options) -> DataFrame:
    return SubstringDedup(docs, **options).result()


def digests(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH words AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS MATERIALIZED (
  SELECT r, doc_id, s, md5_number(array_to_string(w[s : s + 49], ' ')) AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM words)
), repeating AS (
  SELECT r, s FROM (SELECT r, s, doc_id, min(doc_id) OVER (PARTITION BY k) AS least FROM starts) WHERE least < doc_id
), covered AS (
  SELECT DISTINCT r, unnest(range(s, s + 50)) AS i FROM repeating
), each AS (
  SELECT r, i, w[i] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM words)
), kept AS (
  SELECT each.r, count(*) AS n, string_agg(word, ' ' ORDER BY each.i) AS t FROM each ANTI JOIN covered USING (r, i) GROUP BY each.r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (r)
"""
