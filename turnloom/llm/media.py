"""Operator 6: media columns. Payload bytes are stored as lossless WebP pixels, read back to pixel arrays, and described by features.

Four bytes make a pixel (R, G, B, A), 16 pixels a row; a payload over 16384 rows takes several files, one after another, so a very long text is
held by one task, and coded 1 MB at a time. Each file has prefix codes fitted to it; transforms, cache and copies are used where the
data make them pay, ties going to the plainer form. Texts of a batch that are about as long are coded together by array operations over all
of them; what is stored for a text is the same in any company.

Defined cases: a null text is empty; an empty text is one row of zero bytes; equal texts give equal stored bytes and features; an empty
table gives no rows; repeated rows are kept; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm import webp
from turnloom.llm.textops import utf8_of

ROW_BYTES = 64
ROWS_TOGETHER, BYTES_TOGETHER = 512, 1 << 20
VALUES = np.arange(256)
SQUARES = VALUES * VALUES
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES - len(raw))


def store(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW_BYTES // 4, 4)
    return b"".join(webp.encode_best(rows[k : k + webp.MAX_SIDE]) for k in range(0, len(rows), webp.MAX_SIDE))


def store_all(payloads: list[bytes]) -> list[bytes]:
    """`store` of each payload of one of _parts."""
    if len(payloads) == 1:
        return [store(payloads[0])]
    return webp.encode_all([np.frombuffer(x, dtype=np.uint8).reshape(-1, ROW_BYTES // 4, 4) for x in payloads])


def load(stored: bytes) -> np.ndarray:
    """Rows of pixels (rows, 16, 4)."""
    return np.concatenate(webp.decode(stored))


def load_all(stored: list[bytes]) -> list[np.ndarray]:
    """`load` of each."""
    if len(stored) == 1:
        return [load(stored[0])]
    return [images[0] if len(images) == 1 else np.concatenate(images) for images in webp.decode_all(stored)]


def feature(pixels: np.ndarray) -> str:
    """Rows, mean and deviation of the samples in thousandths, and the share of each 32 values in thousandths."""
    counts, n = np.bincount(pixels.ravel(), minlength=256), pixels.size
    total, square = int(counts @ VALUES), int(counts @ SQUARES)
    share = ",".join([str(1000 * c // n) for c in counts.reshape(8, 32).sum(axis=1).tolist()])
    return f"rows={len(pixels)};mean={1000 * total // n};var={(n * square - total * total) // (n * n)};hist={share}"


def _parts(lengths: np.ndarray) -> Iterator[list[int]]:
    """All rows, those of about one length together: ROWS_TOGETHER and BYTES_TOGETHER at most, so that arrays stay in the processor's cache, or one longer row."""
    order, end = np.argsort(lengths, kind="stable"), 0
    total = np.cumsum(lengths.take(order) + ROW_BYTES)  # padded, at most
    while end < len(order):
        start, before = end, int(total[end - 1]) if end else 0
        end = min(start + ROWS_TOGETHER, max(start + 1, int(np.searchsorted(total, before + BYTES_TOGETHER, side="right"))))
        yield order[start:end].tolist()


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8_of(batch.column(1))
        out: list[tuple] = [()] * batch.num_rows
        for rows in _parts(np.diff(offsets[: batch.num_rows + 1])):
            raws = [data[offsets[i] : offsets[i + 1]].tobytes() for i in rows]
            files = store_all([padded(raw) for raw in raws])
            for i, raw, stored, pixels in zip(rows, raws, files, load_all(files), strict=True):
                payload = pixels.tobytes()
                out[i] = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW_BYTES:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(pixels))
        columns = [*zip(*out, strict=True)] or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)


def media_columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_columns, SCHEMA)


def stored_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the stored files themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_of(batch.column(1))
            files = [b""] * batch.num_rows
            for rows in _parts(np.diff(offsets[: batch.num_rows + 1])):
                for i, stored in zip(rows, store_all([padded(data[offsets[i] : offsets[i + 1]].tobytes()) for i in rows]), strict=True):
                    files[i] = stored
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, media binary")
