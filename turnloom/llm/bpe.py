"""Exact byte-level BPE ids for batches of texts.

The library's own pre-tokeniser splits a text into pieces which are encoded one by one, so equal pieces always give equal ids. Here
the split is done for a whole batch at once on code points, pieces are told apart by 64-bit hashes, and the library encodes each
distinct piece once for a bounded table. Texts that hold a special token's string, or code points whose class may differ between
Unicode versions, go to the library whole. Nothing is truncated.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np
import regex

from turnloom.llm.textops import mix, powers

TABLE_ENTRIES = 1 << 20
_P = 0xD1342543DE82EF95
_P_INV = pow(_P, -1, 1 << 64)
_SPACE, _LETTER, _NUMBER, _OTHER, _UNSURE = 0, 1, 2, 3, 4


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\p{White_Space}", _SPACE), (r"\p{Cn}|[\x1c-\x1f]", _UNSURE)):
        out[[ord(c) for c in regex.findall(pattern, everything)]] = kind
    return out


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the vocabulary file: the version part of a cache key."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class ByteBpe:
    """Ids as `tokenizers` gives them for a byte-level BPE file without normaliser."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.begin = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        if len(self.keys) + len(keys) > TABLE_ENTRIES:
            self._clear()
        coded = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        count = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        begin = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, np.fromiter((x for c in coded for x in c), dtype=np.uint32, count=int(count.sum()))])
        # both key lists ascend
        at = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.count = np.insert(self.keys, at, keys), np.insert(self.begin, at, begin), np.insert(self.count, at, count)

    def _pieces(self, text: str, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pieces in the joined text, and the code points."""
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind, n = _classes()[cp], len(cp)
        edge = np.zeros(n + 1, dtype=bool)
        edge[off] = True
        turn = np.empty(n, dtype=bool)
        turn[0] = True
        turn[1:] = kind[1:] != kind[:-1]
        turn |= edge[:n]
        space = kind == _SPACE
        start = turn & space
        after = np.flatnonzero(turn & ~space)
        led = np.zeros(len(after), dtype=bool)
        led[after > 0] = space[after[after > 0] - 1]
        led &= ~edge[after]
        start[after[led] - 1] = True
        blank = np.zeros(len(after), dtype=bool)
        blank[led] = cp[after[led] - 1] == 32
        start[after[~blank]] = True
        quote = np.flatnonzero((cp == 39) & start)
        quote = quote[(quote + 1 < n)]
        quote = quote[turn[quote] & (kind[quote + 1] == _LETTER) & ~edge[quote + 1]]
        if len(quote):
            one = cp[quote + 1]
            two = np.where((quote + 2 < n) & ~edge[np.minimum(quote + 2, n)], cp[np.minimum(quote + 2, n - 1)], 0)
            length = np.where(np.isin(one, [115, 116, 109, 100]), 1, 0)
            length[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)] = 2
            quote, length = quote[length > 0], length[length > 0]
            start[quote + 1] = False
            after = quote + 1 + length
            start[after[after < n]] = True
        return np.flatnonzero(start), cp

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and offsets (len(texts) + 1)."""
        texts = [t or "" for t in texts]
        odd = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        odd |= {i for i, t in enumerate(texts) if not t.isascii() and (_classes()[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)] == _UNSURE).any()}
        odd |= {i for i, t in enumerate(texts) if t.isascii() and any(c in t for c in "\x1c\x1d\x1e\x1f")}
        plain = [t if i not in odd else "" for i, t in enumerate(texts)]
        joined = "".join(plain)
        off = np.concatenate([[0], np.cumsum(np.fromiter(map(len, plain), dtype=np.int64, count=len(plain)))])
        counts = np.zeros(len(texts), dtype=np.int64)
        flat = np.zeros(0, dtype=np.uint32)
        if joined:
            start, cp = self._pieces(joined, off)
            end = np.append(start[1:], len(cp))
            total = np.zeros(len(cp) + 1, dtype=np.uint64)
            value = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
            np.cumsum(value * powers(len(cp), _P), out=total[1:])
            key = mix((total[end] - total[start]) * powers(len(cp), _P_INV)[start] + (end - start).astype(np.uint64))
            distinct, seen, back = np.unique(key, return_index=True, return_inverse=True)
            new = ~np.isin(distinct, self.keys, assume_unique=True)
            if new.any():
                if len(self.keys) + int(new.sum()) > TABLE_ENTRIES:
                    self._clear()
                    new[:] = True
                where = seen[new]
                self._learn(distinct[new], [joined[a:b] for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)])
            at = np.searchsorted(self.keys, distinct)
            begin, count = self.begin[at][back], self.count[at][back]
            stop = np.cumsum(count)
            flat = self.ids[np.repeat(begin - (stop - count), count) + np.arange(int(stop[-1]))]
            edges = np.concatenate([[0], stop])[np.searchsorted(start, off)]
            counts = np.diff(edges)
        if odd:
            parts, edges = [], np.concatenate([[0], np.cumsum(counts)])
            for i, t in enumerate(texts):
                if i in odd:
                    own = np.array(self.library.encode(t, add_special_tokens=False).ids, dtype=np.uint32)
                    parts.append(own)
                    counts[i] = len(own)
                else:
                    parts.append(flat[edges[i] : edges[i + 1]])
            flat = np.concatenate(parts)
        return flat, np.concatenate([[0], np.cumsum(counts)])


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One encoder, with its table, for each worker process."""
    return ByteBpe(path)
