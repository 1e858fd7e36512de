"""Vector helpers over batches of UTF-8 texts, used inside Arrow tasks.

A batch is one byte buffer plus the offsets of its texts, as Arrow stores a string column. Words are maximal runs of
bytes other than space, tab, line feed, vertical tab, form feed and carriage return; as these are ASCII, UTF-8 bytes can be
searched directly. A word's hash is a polynomial over its (lower-cased A-Z) bytes modulo 2**64, read from prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
#: For words without punctuation: all ASCII but letters and digits.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=6)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, base: int) -> np.ndarray:
    size = 1 << max(16, int(n).bit_length())
    return _powers(size, base)[:n]


def utf8_of(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (n + 1) of a string column; null counts as empty. lower: letters beyond A-Z are lower-cased, too."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column, "")
    if lower:
        column = pc.utf8_lower(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most `most` bytes together; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """The words of a range of texts: byte starts and ends, 64-bit hashes, and `first[i]:first[i + 1]` for text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR):
        base, n = int(offsets[0]), len(offsets) - 1
        buf = data[base : int(offsets[-1])]
        self.buf, self.off = buf, offsets - base
        self._total: np.ndarray | None = None
        inside = ~separator[buf]
        starts, ends = inside.copy(), inside.copy()
        if len(buf):
            starts[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            cut = self.off[:-1][(self.off[:-1] < self.off[1:])]
            starts[cut] = inside[cut]
            cut = cut[cut > 0] - 1
            ends[cut] = inside[cut]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.off, side="left")
        self.text_of = np.repeat(np.arange(n), np.diff(self.first))

    def hashes(self, head: int | None = None) -> np.ndarray:
        """Of whole words, or of their first `head` bytes (of the whole word where it is shorter)."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        if self._total is None:
            self._total = np.zeros(len(self.buf) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.buf] * powers(len(self.buf), _P), out=self._total[1:])
        end = self.end if head is None else np.minimum(self.end, self.start + head)
        own = (self._total[end] - self._total[self.start]) * powers(len(self.buf), _P_INV)[self.start]
        return mix(own + (end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `size` words within a text, and the text of each; a text with fewer words (but some) gives one over all its words."""
    h = words.hashes()
    n_words = np.diff(words.first)
    if not len(h):
        return h, np.zeros(0, dtype=np.int64)
    base = np.uint64(0xC2B2AE3D27D4EB4F | 1)
    gram = np.zeros(len(h), dtype=np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(min(size, len(h))):
            gram[: len(h) - j] += h[j:] * factor
            factor = factor * base
    whole = np.arange(len(h)) + size <= words.first[1:][words.text_of]
    out, owner = mix(gram[whole]), words.text_of[whole]
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        sums = np.zeros(len(short), dtype=np.uint64)
        factor = np.uint64(1)
        with np.errstate(over="ignore"):
            for j in range(size - 1):
                has = n_words[short] > j
                sums[has] += h[words.first[short[has]] + j] * factor
                factor = factor * base
            sums += n_words[short].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        out, owner = np.concatenate([out, mix(sums)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def unique_sets(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each owner, one after another, and offsets (n + 1). Owners must ascend."""
    first = np.searchsorted(owner, np.arange(n + 1))
    parts, sizes = [], np.zeros(n, dtype=np.int64)
    for i in range(n):
        if first[i + 1] > first[i]:
            part = values[first[i] : first[i + 1]]
            part = np.unique(part) if len(part) > 1 else part
            parts.append(part)
            sizes[i] = len(part)
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])
