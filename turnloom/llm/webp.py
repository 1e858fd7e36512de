"""Lossless WebP (VP8L) images in numpy: the decoder in full, and an encoder that can use every feature that it reads.

An image is an array (height, width, 4) of R, G, B, A bytes. Decoding follows the public format specification: prefix codes,
back-references, colour cache, meta prefix codes, and the inverse of the predictor, cross-colour, subtract-green and palette transforms.

Where one group of codes holds for the image, tokens are found by array operations: for every bit of a window the place of the token that
would follow one starting there, then only those places that a walk from the first token meets are read. `encode_best` chooses transforms,
cache and references from the data, by estimates of the stored size.

`encode_all` and `decode_all` do the same for many short images at once, with the same bytes and pixels as one by one: arrays hold the pixels
of all, a step of the decoder reads a token of each. Images that need a transform, and those much longer than the others, go one by one.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
# Fixed values of this encoder: bits of the code in which code lengths 0 to 15 and the three kinds of runs are written; a complete code.
LENGTH_BITS = (4, 5, 5, 5, 4, 4, 4, 4, 4, 4, 4, 5, 5, 4, 4, 4, 5, 4, 4)
MAX_SIDE = 1 << 14
HASH = 0x1E35A7BD


@lru_cache(maxsize=1)
def near_offsets() -> tuple[tuple[int, int], ...]:
    """The 120 near pixels of short distance codes, by distance, then by how far to the side, left of the pixel first."""
    around = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return tuple(sorted(around, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0)))


class Reader:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.pos = data, 0

    def read(self, n: int) -> int:
        at = self.pos
        self.pos = at + n
        if self.pos > 8 * len(self.data):
            raise ValueError("the image data ends too early")
        return (int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)


@lru_cache(maxsize=16)
def _reversed(n: int) -> np.ndarray:
    """The numbers below 2**n with their bits in reverse order."""
    out = np.zeros(1, dtype=np.int64)
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then symbol, as they are written: the first bit lowest."""
    codes, used = np.zeros(len(lengths), dtype=np.int64), np.flatnonzero(lengths)
    own = lengths[used]
    order = np.argsort(own.astype(np.uint8), kind="stable")
    room = 1 << (15 - own[order])
    before = np.cumsum(room) - room
    codes[used[order]] = _reversed(15)[before]
    return codes


class Prefix:
    """A prefix code; one symbol takes no bits. table: symbol << 4 | length for each value of the next `bits` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        own = lengths[used]
        self.only = int(used[0]) if len(used) == 1 else None
        self.last_symbol = int(used[-1]) if len(used) else 0
        if self.only is not None:
            self.bits, self.table = 0, (used << 4).astype(np.uint16)
            return
        self.bits = int(own.max(initial=0))
        if not len(used) or int((1 << (self.bits - own)).sum()) != 1 << self.bits:
            raise ValueError("a prefix code is not complete")
        order = np.argsort(own.astype(np.uint8), kind="stable")
        self.table = np.repeat((used << 4 | own)[order].astype(np.uint16), 1 << (self.bits - own[order])).take(_reversed(self.bits))

    def next(self, bits: Reader) -> int:
        at = bits.pos
        entry = int(self.table[(int.from_bytes(bits.data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7)) & ((1 << self.bits) - 1)])
        bits.read(entry & 15)
        return entry >> 4


@lru_cache(maxsize=256)
def _length_table(lengths: tuple[int, ...]) -> tuple[int, list[int]]:
    code = Prefix(np.array(lengths))
    return code.bits, code.table.tolist()


def _read_prefix(bits: Reader, alphabet: int) -> Prefix:
    lengths = np.zeros(alphabet, dtype=np.int64)
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Prefix(lengths)
    own = [0] * 19
    n = 4 + bits.read(4)
    word = bits.read(3 * n)
    for k in range(n):
        own[CODE_LENGTH_ORDER[k]] = word >> (3 * k) & 7
    code_bits, table = _length_table(tuple(own))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    mask, at, word, held = (1 << code_bits) - 1, bits.pos, 0, 0
    out = bytearray()
    before = 8
    while len(out) < alphabet and left > 0:
        left -= 1
        if held < 14:
            # a token takes 14 bits at most; a short number is shifted faster than one of all bits
            word, held = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 32], "little") >> (at & 7), 249
        entry = table[word & mask]
        n, size = entry >> 4, entry & 15
        word >>= size
        if n < 16:
            out.append(n)
            before = n or before
        else:
            extra, least = ((2, 3), (3, 3), (7, 11))[n - 16]
            out += bytes((before if n == 16 else 0,)) * (least + (word & ((1 << extra) - 1)))
            word >>= extra
            size += extra
        at += size
        held -= size
    if len(out) > alphabet:
        raise ValueError("too many code lengths")
    if at > 8 * len(bits.data):
        raise ValueError("the image data ends too early")
    bits.pos = at
    lengths[: len(out)] = np.frombuffer(out, dtype=np.uint8)
    return Prefix(lengths)


def _read_codes(bits: Reader, sizes: tuple[int, ...]) -> list[Prefix]:
    """A code for each alphabet; one written like the code before it is not built again."""
    out: list[Prefix] = []
    text = lambda at, n: (int.from_bytes(bits.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)
    last, n = 0, 0
    for k, size in enumerate(sizes):
        if k and sizes[k - 1] == size and bits.pos + n <= 8 * len(bits.data) and text(bits.pos, n) == last:
            out.append(out[-1])
            bits.pos += n
            continue
        at = bits.pos
        out.append(_read_prefix(bits, size))
        n = bits.pos - at
        last = text(at, n)
    return out


def _value(prefix: int, bits: Reader) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


# Of length and distance prefixes: number of extra bits, and the value with all of them zero.
_EXTRA = np.array([0 if k < 4 else (k - 2) >> 1 for k in range(40)])
_LEAST = np.array([k + 1 if k < 4 else ((2 + (k & 1)) << ((k - 2) >> 1)) + 1 for k in range(40)])
_EXTRAS = _EXTRA.tolist()
WINDOW, FAR = 1 << 16, 1 << 40
_BIT = np.tile(np.arange(8), WINDOW // 8 + 16)


def _windows(data: np.ndarray, first: int, n: int) -> np.ndarray:
    """For each of n bits from bit 8 * first on, the 25 bits or more that begin there."""
    own = data[first : first + (n >> 3) + 4].astype(np.int64)
    words = own[:-3] | own[1:-2] << 8 | own[2:-1] << 16 | own[3:] << 24
    return np.repeat(words, 8) >> _BIT[: 8 * len(words)]


def _token_runs(bits: Reader, group: list[Prefix], n: int):
    """Runs of tokens of one group: (kind, value, extra, next place); kind 0 literal (ARGB), 1 cache (place), 2 copy (length, distance code)."""
    tables = [c.table for c in group]
    sizes = [(t & 15).astype(np.uint8) for t in tables]
    masks = [(1 << c.bits) - 1 for c in group]
    mixed, end = group[0].last_symbol >= 256, 8 * len(bits.data)
    # where a token leads whose green symbol is no literal: behind that symbol, and FAR beyond it for a copy, which the walk resolves where it meets one
    ahead = sizes[0] + np.where((tables[0] >= 256 << 4) & (tables[0] < 280 << 4), FAR, 0)
    # a token has at most 15 + 10 + 15 + 18 bits, so with 96 bits beyond its span a window holds every token that begins in the span
    data = np.concatenate([np.frombuffer(bits.data, dtype=np.uint8), np.zeros(20, dtype=np.uint8)])
    width, place = min(WINDOW, 64 * n), bits.pos
    while place <= end:
        base = place >> 3
        span = min(width, end - 8 * base) + 8 & ~7
        win = _windows(data, base, span + 96)
        own = np.arange(span)
        index = win[:span] & masks[0]
        g = tables[0].take(index)
        after = own + (g & 15)
        following = after.copy()
        for k in (1, 2, 3):
            if group[k].bits:
                if k == 1 or group[k] is not group[k - 1]:
                    own_sizes = sizes[k].take(win & masks[k])
                following += own_sizes.take(following)
        if mixed:
            np.copyto(following, own + ahead.take(index), where=g >= 256 << 4)
        view, places, p = memoryview(following), [], place - 8 * base
        while True:
            for _ in range(n - len(places)):
                if p >= span:
                    break
                places.append(p)
                p = view[p]
            if p < FAR:
                break
            p += -FAR + _EXTRAS[(int(g[places[-1]]) >> 4) - 256]
            entry = int(tables[4][int(win[p]) & masks[4]])
            p += (entry & 15) + _EXTRAS[entry >> 4]
        at = np.array(places, dtype=np.int64)
        symbol, a = (g.take(at) >> 4).astype(np.int64), after.take(at)
        parts = []
        for k in (1, 2, 3):
            entry = tables[k].take(win.take(a) & masks[k]).astype(np.int64)
            parts.append(entry >> 4)
            a = a + (entry & 15)
        kind, extra = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        value = parts[2] << 24 | parts[0] << 16 | symbol << 8 | parts[1]
        if mixed:
            kind[symbol >= 280] = 1
            value[kind == 1] = symbol[kind == 1] - 280
            is_copy = np.flatnonzero((symbol >= 256) & (symbol < 280))
            kind[is_copy] = 2
            low = lambda where, count: win[where] & ((1 << count) - 1)
            prefix, from_ = symbol[is_copy] - 256, after[at[is_copy]]
            value[is_copy] = _LEAST[prefix] + low(from_, _EXTRA[prefix])
            to = from_ + _EXTRA[prefix]
            d = tables[4].take(win.take(to) & masks[4])
            d = d.astype(np.int64)
            extra[is_copy] = _LEAST[d >> 4] + low(to + (d & 15), _EXTRA[d >> 4])
        yield kind, value, extra, 8 * base + np.append(at[1:], p)
        place = 8 * base + p
    raise ValueError("the image data ends too early")


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = near_offsets()[code - 1]
    return max(1, dx + dy * width)


def _plain(group: list[Prefix]) -> bool:
    """Whether all pixels are one literal that takes no bits."""
    return all(c.only is not None for c in group[:4]) and group[0].only < 256


def _read_group(bits: Reader, group: list[Prefix], width: int, n: int, cache_bits: int, trace: Counter) -> np.ndarray:
    """An image whose tokens all have one group of codes."""
    if _plain(group):
        return np.full(n, group[3].only << 24 | group[1].only << 16 | group[0].only << 8 | group[2].only, dtype=np.uint32)
    if group[0].last_symbol >= 280 + (1 << cache_bits if cache_bits else 0):
        raise ValueError("a cache place is out of range")
    shift = 32 - cache_bits
    out: list[int] = []
    slots: list[int] = []
    cache = [0] * (1 << cache_bits)
    if group[0].last_symbol < 256:
        parts, left = [], n
        for _, value, _, following in _token_runs(bits, group, n):
            parts.append(value[:left])
            if len(value) >= left:
                bits.pos = int(following[left - 1])
                break
            left -= len(value)
        if bits.pos > 8 * len(bits.data):
            raise ValueError("the image data ends too early")
        return np.concatenate(parts).astype(np.uint32)
    for kind, value, extra, following in _token_runs(bits, group, n):
        copy_at = np.flatnonzero(kind == 2)
        trace.update(name for k, name in enumerate(("literal", "cache", "copy")) if (kind == k).any())
        slot = np.where(kind == 1, value, (value * HASH & 0xFFFFFFFF) >> shift).tolist() if cache_bits else []
        kinds, values, first = kind.tolist(), value.tolist(), 0
        for stop in [*copy_at.tolist(), len(kinds)]:
            # literals and cache places up to the next copy, or the last that the image needs
            stop_ = min(stop, first + n - len(out))
            if cache_bits:
                for k, v, h in zip(kinds[first:stop_], values[first:stop_], slot[first:stop_], strict=True):
                    if k:
                        v = cache[h]
                    else:
                        cache[h] = v
                    out.append(v)
                slots += slot[first:stop_]
            else:
                out += values[first:stop_]
            if len(out) == n or stop == len(kinds):
                last = stop_ - 1
                break
            length, back = values[stop], _distance(int(extra[stop]), width)
            start = len(out) - back
            if start < 0 or len(out) + length > n:
                raise ValueError("a back-reference leaves the image")
            for grown in (out, slots) if cache_bits else (out,):
                piece = grown[start : start + length]
                grown += piece if len(piece) == length else (piece * (length // len(piece) + 1))[:length]
            if cache_bits:
                for v, h in zip(out[-length:], slots[-length:], strict=True):
                    cache[h] = v
            first, last = stop + 1, stop
            if len(out) == n:
                break
        if len(out) == n:
            bits.pos = int(following[last])
            if bits.pos > 8 * len(bits.data):
                raise ValueError("the image data ends too early")
            return np.array(out, dtype=np.uint32)
    raise ValueError("the image data ends too early")


class Head(NamedTuple):
    """What stands before the tokens of an entropy-coded image: groups of codes, and for several of them which blocks use which."""

    cache_bits: int
    groups: list[list[Prefix]]
    block: int
    groups_of: np.ndarray | None


def _read_head(bits: Reader, width: int, height: int, main: bool) -> Head:
    cache_bits = bits.read(4) if bits.read(1) else 0
    block, groups_of = 0, None
    if main and bits.read(1):
        block = bits.read(3) + 2
        wide = -(-width // (1 << block))
        groups_of = (_read_pixels(bits, wide, -(-height // (1 << block)), False, Counter()) >> np.uint32(8)) & np.uint32(0xFFFF)
    sizes = (256 + 24 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    return Head(cache_bits, [_read_codes(bits, sizes) for _ in range(1 if groups_of is None else int(groups_of.max()) + 1)], block, groups_of)


def _read_pixels(bits: Reader, width: int, height: int, main: bool, trace: Counter) -> np.ndarray:
    """An entropy-coded image as ARGB numbers, row by row."""
    return _read_body(bits, _read_head(bits, width, height, main), width, height, trace)


def _read_body(bits: Reader, head: Head, width: int, height: int, trace: Counter) -> np.ndarray:
    cache_bits, groups, block, groups_of = head
    n, wide = width * height, -(-width // (1 << block))
    if len(groups) == 1:
        return _read_group(bits, groups[0], width, n, cache_bits, trace)
    out: list[int] = []
    cache, cached = [0] * (1 << cache_bits), 0
    while len(out) < n:
        y, x = divmod(len(out), width)
        green, red, blue, alpha, dist = groups[int(groups_of[(y >> block) * wide + (x >> block)])]
        symbol = green.next(bits)
        if symbol < 256:
            r, b, a = red.next(bits), blue.next(bits), alpha.next(bits)
            out.append(a << 24 | r << 16 | symbol << 8 | b)
        elif symbol < 280:
            length = _value(symbol - 256, bits)
            back = _distance(_value(dist.next(bits), bits), width)
            if back > len(out) or len(out) + length > n:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out.append(out[-back])
        else:
            while cached < len(out):
                cache[(HASH * out[cached] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[cached]
                cached += 1
            out.append(cache[symbol - 280])
    return np.array(out, dtype=np.uint32)


def channels(argb: np.ndarray) -> np.ndarray:
    """(..., 4) bytes of their own: A, R, G, B."""
    return np.ascontiguousarray(argb.astype("<u4").view(np.uint8).reshape(*argb.shape, 4)[..., ::-1])


def joined(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(parts.astype(np.uint8)[..., ::-1]).view("<u4")[..., 0].astype(np.uint32)


def swapped(argb: np.ndarray) -> np.ndarray:
    """Numbers whose bytes are B, G, R, A as those whose bytes are R, G, B, A, and back."""
    return argb & np.uint32(0xFF00FF00) | argb >> np.uint32(16) & np.uint32(255) | (argb & np.uint32(255)) << np.uint32(16)


def _numbers(pixels: np.ndarray) -> np.ndarray:
    """ARGB numbers of (..., 4) bytes R, G, B, A, row by row."""
    return swapped(np.ascontiguousarray(pixels).reshape(-1).view("<u4").astype(np.uint32))


def _average(a: list[int], b: list[int]) -> list[int]:
    return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]


def predicted(mode: int, left: list[int], top: list[int], top_right: list[int], top_left: list[int]) -> list[int]:
    clamp = lambda x: 0 if x < 0 else min(x, 255)
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, top_left, strict=True)]
    if mode == 13:
        middle = _average(left, top)
        return [clamp(m + int((m - c) / 2)) for m, c in zip(middle, top_left, strict=True)]
    plain = {
        1: lambda: left,
        2: lambda: top,
        3: lambda: top_right,
        4: lambda: top_left,
        5: lambda: _average(_average(left, top_right), top),
        6: lambda: _average(left, top_left),
        7: lambda: _average(left, top),
        8: lambda: _average(top_left, top),
        9: lambda: _average(top, top_right),
        10: lambda: _average(_average(left, top_left), _average(top, top_right)),
    }
    return plain[mode]() if mode in plain else [255, 0, 0, 0]


def _neighbours(pixels: list[list[int]], at: int, x: int, y: int, width: int, mode: int) -> list[int]:
    if y == 0:
        return pixels[at - 1] if x else [255, 0, 0, 0]
    if x == 0:
        return pixels[at - width]
    return predicted(mode, pixels[at - 1], pixels[at - width], pixels[at - width + 1], pixels[at - width - 1])


BLACK = np.array([255, 0, 0, 0], dtype=np.uint8)
ROW_MODES = (0, 1, 2, 3, 4, 8, 9)


def _from_above(mode: int, above: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Predictions of a row but for its first pixel, by a mode that looks at the row above only; `first` is what stands right of that row's end."""
    top, left, right = above[1:], above[:-1], np.concatenate([above[2:], first[None]])[: len(above) - 1]
    half = lambda a, b: (a & b) + ((a ^ b) >> 1)
    return {2: top, 3: right, 4: left}[mode] if mode < 5 else half(left, top) if mode == 8 else half(top, right)


def undo_predictor(argb: np.ndarray, width: int, block: int, modes: np.ndarray) -> np.ndarray:
    rest, wide = channels(argb).reshape(-1, width, 4), -(-width // (1 << block))
    rest[0, 0] += BLACK
    np.cumsum(rest[0], axis=0, dtype=np.uint8, out=rest[0])
    of_block = (modes & np.uint32(15)).reshape(-1, wide)
    y = 1
    while y < len(rest):
        own = of_block[y >> block]
        end = min(len(rest), ((y >> block) + 1) << block)
        mode = int(own[0]) if (own == own[0]).all() else -1
        rows = rest[y:end]
        if mode in (0, 1, 2, 14, 15):
            np.cumsum(rest[y - 1 : end, 0], axis=0, dtype=np.uint8, out=rest[y - 1 : end, 0])
            if mode == 1:
                np.cumsum(rows, axis=1, dtype=np.uint8, out=rows)
            elif mode == 2:
                np.cumsum(rest[y - 1 : end, 1:], axis=0, dtype=np.uint8, out=rest[y - 1 : end, 1:])
            else:
                rows[:, 1:] += BLACK
        elif mode in ROW_MODES:
            for k in range(y, end):
                rest[k, 0] += rest[k - 1, 0]
                rest[k, 1:] += _from_above(mode, rest[k - 1], rest[k, 0])
        else:
            flat = rest[y - 1 : end].reshape(-1, 4).tolist()
            for at in range(width, len(flat)):
                x = at % width
                guess = _neighbours(flat, at, x, 1, width, int(own[x >> block]))
                flat[at] = [(p + q) & 255 for p, q in zip(flat[at], guess, strict=True)]
            rest[y - 1 : end] = np.array(flat, dtype=np.uint8).reshape(-1, width, 4)
        y = end
    return joined(rest.reshape(-1, 4))


def residuals(argb: np.ndarray, width: int, mode: int) -> np.ndarray:
    """(rows, width, 4): what is left after one of ROW_MODES everywhere."""
    own = channels(argb).reshape(-1, width, 4)
    guess = np.empty_like(own)
    guess[0, 0], guess[0, 1:], guess[1:, 0] = BLACK, own[0, :-1], own[:-1, 0]
    if mode == 0:
        guess[1:, 1:] = BLACK
    elif mode == 1:
        guess[1:, 1:] = own[1:, :-1]
    else:
        half = lambda a, b: (a & b) + ((a ^ b) >> 1)
        top, left = own[:-1, 1:], own[:-1, :-1]
        right = np.concatenate([own[:-1, 2:], own[1:, :1]], axis=1)[:, : width - 1]
        guess[1:, 1:] = {2: top, 3: right, 4: left}[mode] if mode < 5 else half(left, top) if mode == 8 else half(top, right)
    return own - guess


def apply_predictor(argb: np.ndarray, width: int, block: int, modes: np.ndarray) -> np.ndarray:
    pixels, wide, out = channels(argb).tolist(), -(-width // (1 << block)), []
    for at, own in enumerate(pixels):
        y, x = divmod(at, width)
        guess = _neighbours(pixels, at, x, y, width, int(modes[(y >> block) * wide + (x >> block)]) & 15)
        out.append([(p - q) & 255 for p, q in zip(own, guess, strict=True)])
    return joined(np.array(out, dtype=np.uint8))


def cross_color(argb: np.ndarray, width: int, block: int, elements: np.ndarray, sign: int) -> np.ndarray:
    """sign 1 undoes the transform, -1 applies it. An element holds red-to-blue, green-to-blue and green-to-red in R, G and B."""
    n = np.arange(len(argb))
    own = elements[(n // width >> block) * -(-width // (1 << block)) + (n % width >> block)]
    _, red_blue, green_blue, green_red = (channels(own)[:, k].view(np.int8).astype(np.int32) for k in range(4))
    parts = channels(argb).astype(np.int32)
    signed = lambda c: (c & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    green, old_red = signed(parts[:, 2]), parts[:, 1].copy()
    parts[:, 1] += sign * (green_red * green >> 5)
    true_red = signed(parts[:, 1] if sign == 1 else old_red)
    parts[:, 3] += sign * ((green_blue * green >> 5) + (red_blue * true_red >> 5))
    return joined((parts & 255).astype(np.uint8))


def add_green(argb: np.ndarray, sign: int) -> np.ndarray:
    parts = channels(argb)
    parts[:, 1] += parts[:, 2] if sign == 1 else -parts[:, 2]
    parts[:, 3] += parts[:, 2] if sign == 1 else -parts[:, 2]
    return joined(parts)


def palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def undo_palette(argb: np.ndarray, width: int, height: int, table: np.ndarray) -> np.ndarray:
    bundle = palette_bits(len(table))
    per, green = 8 >> bundle, ((argb >> np.uint32(8)) & np.uint32(255)).reshape(height, -1)
    x = np.arange(width)
    index = (green[:, x >> bundle] >> (per * (x & ((1 << bundle) - 1))).astype(np.uint32)) & np.uint32((1 << per) - 1)
    full = np.zeros(256, dtype=np.uint32)
    full[: len(table)] = table
    return full[index].ravel()


class Image(NamedTuple):
    """An image read up to the tokens of its pixels; undo: (transform, width, block, its image), in the order written."""

    bits: Reader
    width: int
    height: int
    across: int
    undo: list[tuple[int, int, int, np.ndarray | None]]
    head: Head
    used: Counter


def _open(data: bytes) -> Image:
    bits, used = Reader(data), Counter()
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        used.update([("predictor", "cross-colour", "subtract-green", "palette")[kind]])
        if kind in (PREDICTOR, CROSS_COLOR):
            block = bits.read(3) + 2
            image = _read_pixels(bits, -(-across // (1 << block)), -(-height // (1 << block)), False, Counter())
            undo.append((kind, across, block, image))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, across, 0, None))
        else:
            size = bits.read(8) + 1
            steps = channels(_read_pixels(bits, size, 1, False, Counter()))
            undo.append((kind, across, 0, joined(np.cumsum(steps, axis=0, dtype=np.uint8))))
            across = -(-across // (1 << palette_bits(size)))
    return Image(bits, width, height, across, undo, _read_head(bits, across, height, True), used)


def _close(image: Image, argb: np.ndarray) -> np.ndarray:
    """(height, width, 4): R, G, B, A."""
    for kind, wide, block, own in reversed(image.undo):
        if kind == PREDICTOR:
            argb = undo_predictor(argb, wide, block, (own >> np.uint32(8)) & np.uint32(255))
        elif kind == CROSS_COLOR:
            argb = cross_color(argb, wide, block, own, 1)
        elif kind == SUBTRACT_GREEN:
            argb = add_green(argb, 1)
        else:
            argb = undo_palette(argb, wide, image.height, own)
    return swapped(argb).astype("<u4").view(np.uint8).reshape(image.height, image.width, 4)


TOGETHER, PIXELS_TOGETHER = 64, 1 << 18
# Of green and distance symbols: bits behind the code that belong to the token.
_GREEN_EXTRA = np.zeros(1 << 12, dtype=np.uint32)
_GREEN_EXTRA[256:280] = _EXTRA[:24]
_FAR_EXTRA = np.resize(_EXTRA, 256).astype(np.uint32)


def _shared_table(images: list[Image]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tables in one, as symbol << 6 | bits of code and of what belongs to it; of five codes an image their places there, and masks. Place 0 takes no bits."""
    parts, first, masks, room = [np.zeros(1, dtype=np.uint32)], [], [], 1
    for image in images:
        group, own = image.head.groups[0], []
        for k, c in enumerate(group):
            if k and c is group[k - 1]:
                own.append(own[-1])
                continue
            own.append(room)
            wide = c.table.astype(np.uint32)
            symbol = wide >> 4
            parts.append((symbol << 6 | wide & 15) + (_GREEN_EXTRA.take(symbol) if k == 0 else _FAR_EXTRA.take(symbol) if k == 4 else 0))
            room += len(wide)
        first.append(own)
        masks.append([(1 << c.bits) - 1 for c in group])
    return np.concatenate(parts), np.array(first).T, np.array(masks).T


def _walk_together(images: list[Image], words: np.ndarray, base: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens in the order of images: image, symbols of green, red, blue and alpha, place after it, pixels that it makes, distance code of a copy or 0.

    Every step reads a token of each image that has bits left, so that some tokens are read behind an image's last, which the caller cuts off.
    """
    table, all_first, all_masks = _shared_table(images)
    first, masks = tuple(all_first), tuple(all_masks)
    pos, who, stops = base * 8 + np.array([image.bits.pos for image in images]), np.arange(len(images)), ends
    seen: list[tuple[np.ndarray, ...]] = []
    step = 0
    while len(who):
        green = table.take(first[0] + (words.take(pos >> 3, mode="clip") >> (pos & 7) & masks[0]))
        inner = pos + (green & 63)
        word = words.take(inner >> 3, mode="clip") >> (inner & 7)
        red = table.take(first[1] + (word & masks[1]))
        size = red & 63
        word >>= size
        blue = table.take(first[2] + (word & masks[2]))
        own = blue & 63
        word >>= own
        alpha = table.take(first[3] + (word & masks[3]))
        size += own
        size += alpha & 63
        pos = inner + size
        special = (green >= 256 << 6).nonzero()[0]
        if len(special):
            copy = green.take(special) < 280 << 6
            at = inner.take(special)
            entry = table.take(first[4].take(special) * copy + (words.take(at >> 3, mode="clip") >> (at & 7) & masks[4].take(special) * copy))
            pos[special] = at + (entry & 63)
        seen.append((who, green, red, blue, alpha, inner, pos))
        step += 1
        if step % 8 == 0 or len(who) < TOGETHER:
            keep = (pos < stops).nonzero()[0]
            if len(keep) < len(who):
                who, pos, stops = who.take(keep), pos.take(keep), stops.take(keep)
                first, masks = tuple(x.take(keep) for x in first), tuple(x.take(keep) for x in masks)
    of = np.concatenate([x[0] for x in seen])
    order = np.argsort(of.astype(np.uint16), kind="stable")
    of, green, red, blue, alpha, inner, after = (np.concatenate(x).take(order) for x in zip(*seen, strict=True))
    green, red, blue, alpha = (x >> 6 for x in (green, red, blue, alpha))
    made, far = np.ones(len(of), dtype=np.int64), np.zeros(len(of), dtype=np.int64)
    copies = np.flatnonzero((green >= 256) & (green < 280))
    if len(copies):
        low = lambda at, count: words.take(at >> 3, mode="clip") >> (at & 7) & ((1 << count) - 1)
        prefix, at, whose = green.take(copies) - 256, inner.take(copies), of.take(copies)
        extra = _EXTRA.take(prefix)
        made[copies] = _LEAST.take(prefix) + low(at - extra, extra)
        prefix = table.take(all_first[4].take(whose) + (words.take(at >> 3, mode="clip") >> (at & 7) & all_masks[4].take(whose))) >> 6
        extra = _EXTRA.take(prefix)
        far[copies] = _LEAST.take(prefix) + low(after.take(copies) - extra, extra)
    return of, green, red, blue, alpha, after, made, far


def _read_together(images: list[Image]) -> list[np.ndarray]:
    """What _read_group gives for each of at most 65,536 images."""
    if any(image.head.groups[0][0].last_symbol >= 280 + (1 << image.head.cache_bits if image.head.cache_bits else 0) for image in images):
        raise ValueError("a cache place is out of range")
    data = b"".join(image.bits.data for image in images) + bytes(16)
    lengths = np.array([len(image.bits.data) for image in images])
    base = np.cumsum(lengths) - lengths
    # the 64 bits from each byte on; what is read of one number has 57 at most
    words = np.ndarray(len(data) - 7, dtype="<i8", buffer=data, strides=(1,)).astype(np.int64)
    of, green, red, blue, alpha, after, made, far = _walk_together(images, words, base, 8 * (base + lengths))
    sizes = np.array([image.across * image.height for image in images])
    room = np.cumsum(sizes) - sizes
    total, n = np.cumsum(made), int(sizes.sum())
    tokens = np.bincount(of, minlength=len(images))
    start = total - made
    start -= np.repeat(start.take(np.cumsum(tokens) - tokens), tokens)
    if (np.bincount(of, made, len(images)) < sizes).any():
        raise ValueError("the image data ends too early")
    keep = np.flatnonzero(start < sizes.take(of))
    of, green, red, blue, alpha, after, made, far, start = (x.take(keep) for x in (of, green, red, blue, alpha, after, made, far, start))
    last = np.append(np.flatnonzero(of[1:] != of[:-1]), len(of) - 1)
    if (after.take(last) > 8 * (base + lengths)).any():
        raise ValueError("the image data ends too early")
    ends, out, done = np.searchsorted(of, np.arange(1, len(images) + 1)).tolist(), [], 0
    while done < len(images):
        # as many images as keep their pixels in the processor's cache
        stop = max(done + 1, int(np.searchsorted(room, room[done] + PIXELS_TOGETHER)))
        tokens = slice(ends[done - 1] if done else 0, ends[stop - 1])
        out += _pixels_together(images[done:stop], of[tokens] - done, *(x[tokens] for x in (green, red, blue, alpha, made, far, start)))
        done = stop
    return out


def _pixels_together(images: list[Image], of: np.ndarray, green: np.ndarray, red: np.ndarray, blue: np.ndarray, alpha: np.ndarray, made: np.ndarray, far: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Pixels of all images from their tokens: each pixel points to one before it, or to itself if it is a literal, and pointers are followed to their ends."""
    sizes = np.array([image.across * image.height for image in images])
    room, n = np.cumsum(sizes) - sizes, int(sizes.sum())
    pixel, cached = room.take(of) + start, np.flatnonzero(green >= 280)
    source, own = np.arange(n + 1), np.arange(n)
    copies = np.flatnonzero(far)
    if len(copies):
        code, width = far.take(copies), np.array([image.across for image in images]).take(of.take(copies))
        close = _near_table().take(np.minimum(code, 120), axis=0)
        back = np.where(code > 120, code - 120, np.maximum(1, close[:, 0] + close[:, 1] * width))
        if (back > start.take(copies)).any() or (start.take(copies) + made.take(copies) > sizes.take(of.take(copies))).any():
            raise ValueError("a back-reference leaves the image")
        length = made.take(copies)
        at = np.repeat(pixel.take(copies) + length - np.cumsum(length), length) + np.arange(int(length.sum()))
        source[at] -= np.repeat(back, length)
        _follow(source, at)
    # place n stands for the 0 that an unwritten place of the cache holds
    value = np.zeros(n + 1, dtype=np.uint32)
    value[pixel] = alpha << np.uint32(24) | red << np.uint32(16) | green << np.uint32(8) | blue
    if len(cached):
        # a copy stands in the place of the cache in which its source stands
        bits = np.array([image.head.cache_bits for image in images])
        slot = (value[:n] * np.uint32(HASH) >> np.repeat(32 - bits, sizes).astype(np.uint32)).astype(np.uint16)
        asks = pixel.take(cached)
        slot[asks] = green.take(cached) - np.uint32(280)
        slot = slot.take(source[:n])
        of_pixel = np.repeat(np.arange(len(images), dtype=np.uint16), sizes)
        order = np.argsort(slot, kind="stable")
        if not bits.all():
            order = order.compress((bits > 0).take(of_pixel.take(order)))
        order = order.take(np.argsort(of_pixel.take(order), kind="stable"))
        key = of_pixel.take(order).astype(np.uint32) << np.uint32(16) | slot.take(order)
        asking = np.zeros(n, dtype=bool)
        asking[asks] = True
        asking = asking.take(order)
        # the last pixel up to each one that does not itself ask the cache
        known = np.maximum.accumulate(np.where(asking, 0, np.arange(len(order))))
        at = np.flatnonzero(asking)
        known = known.take(at)
        found = (key.take(known) == key.take(at)) & ~asking.take(known)
        source[order.take(at)] = np.where(found, order.take(known), n)
        _follow(source, np.flatnonzero(source[:n] != own))
    value = value.take(source[:n])
    for image, literal, cache, copy in zip(images, *(np.bincount(of, x, len(images)) > 0 for x in (green < 256, green >= 280, far > 0)), strict=True):
        if image.head.groups[0][0].last_symbol >= 256:
            image.used.update(name for name, found in (("literal", literal), ("cache", cache), ("copy", copy)) if found)
    return np.split(value, room[1:])


def _follow(source: np.ndarray, at: np.ndarray) -> None:
    while len(at):
        now = source.take(at)
        then = source.take(now)
        source[at] = then
        at = at.compress(then != now)


@lru_cache(maxsize=1)
def _near_table() -> np.ndarray:
    return np.array([(0, 0), *near_offsets()])


def decode_vp8l(data: bytes, trace: Counter | None = None) -> np.ndarray:
    """(height, width, 4): R, G, B, A. trace counts the images that use a feature."""
    image = _open(data)
    pixels = _close(image, _read_body(image.bits, image.head, image.across, image.height, image.used))
    if trace is not None:
        trace.update(image.used.keys())
    return pixels


def _files(stored: bytes) -> Iterator[bytes]:
    """The image data of one or more files, one after another."""
    at = 0
    while at < len(stored):
        riff, size, webp, kind, own = struct.unpack_from("<4sI4s4sI", stored, at)
        if (riff, webp, kind) != (b"RIFF", b"WEBP", b"VP8L"):
            raise ValueError("not a lossless WebP file")
        yield stored[at + 20 : at + 20 + own]
        at += 8 + size


def decode(stored: bytes, trace: Counter | None = None) -> list[np.ndarray]:
    """The images of one or more files, one after another."""
    return [decode_vp8l(data, trace) for data in _files(stored)]


def decode_all(stored: list[bytes], trace: Counter | None = None) -> list[list[np.ndarray]]:
    """`decode` of each; images of about one length are read together, a token of each in a step."""
    images = [(k, _open(data)) for k, one in enumerate(stored) for data in _files(one)]
    sizes = [8 * len(image.bits.data) - image.bits.pos for _, image in images]
    # longer ones would go on with few others beside them, where a step costs more than tokens found by windows
    most = 1.25 * sorted(sizes)[-TOGETHER] if len(images) >= TOGETHER else 0
    ready = [k for k, (_, image) in enumerate(images) if sizes[k] <= most and len(image.head.groups) == 1 and image.head.groups[0][0].only is None]
    argb = dict(zip(ready, _read_together([images[k][1] for k in ready]), strict=True)) if len(ready) >= TOGETHER else {}
    out: list[list[np.ndarray]] = [[] for _ in stored]
    for k, (whose, image) in enumerate(images):
        own = argb[k] if k in argb else _read_body(image.bits, image.head, image.across, image.height, image.used)
        out[whose].append(_close(image, own))
        if trace is not None:
            trace.update(image.used.keys())
    return out


class Writer:
    """Numbers of given bits, least significant bit first."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.sizes: list[int] = []

    def write(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def append(self, other: Writer) -> None:
        self.values += other.values
        self.sizes += other.sizes

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.parts += [(np.array(self.values, dtype=np.int64), np.array(self.sizes, dtype=np.int64)), (values, sizes)]
        self.values, self.sizes = [], []

    def bytes(self) -> bytes:
        self.add(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        values, sizes = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        keep = np.flatnonzero(sizes)
        values, sizes = values.take(keep).astype(np.uint64), sizes.take(keep)
        end = np.cumsum(sizes)
        start = end - sizes
        # numbers that start in the same 32 bits have no bit in common and reach into the next 32 at most
        word = start >> 5
        first = np.append(0, np.flatnonzero(word[1:] != word[:-1]) + 1)
        sums, at = np.add.reduceat(values << (start & 31).astype(np.uint64), first), word.take(first)
        cells = np.zeros(int(word[-1]) + 2, dtype=np.uint64)
        cells[at] = sums & np.uint64(0xFFFFFFFF)
        cells[at + 1] += sums >> np.uint64(32)
        return cells.astype("<u4").tobytes()[: (int(end[-1]) + 7) // 8]


def huffman(counts: np.ndarray, most: int) -> np.ndarray:
    """Code lengths of at most `most` bits; rare symbols count as more frequent until they fit. Leaves and sums wait in two queues."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    lengths[order] = _depths(counts[order].tolist(), most)
    return lengths


def _depths(counts: list[int], most: int) -> list[int]:
    """Code lengths of two symbols or more, rarest first."""
    n, least = len(counts), 1
    never = float("inf")
    while True:
        # both queues end with what is never the lighter one
        weight = [*counts, never] if counts[0] >= least else [*(max(c, least) for c in counts), never]
        sums, parent, leaf, inner = [never] * n, [0] * (2 * n - 1), 0, 0
        for made in range(n - 1):
            one, other = weight[leaf], sums[inner]
            if one <= other:
                parent[leaf], leaf, total = made + n, leaf + 1, one
                one = weight[leaf]
            else:
                parent[n + inner], inner, total = made + n, inner + 1, other
                other = sums[inner]
            if one <= other:
                parent[leaf], leaf = made + n, leaf + 1
                sums[made] = total + one
            else:
                parent[n + inner], inner = made + n, inner + 1
                sums[made] = total + other
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= most:
            return depth[:n]
        least *= 2


@lru_cache(maxsize=1)
def _length_codes() -> list[int]:
    return canonical(np.array(LENGTH_BITS)).tolist()


@lru_cache(maxsize=1)
def _length_header() -> tuple[tuple[int, int], ...]:
    """The start of every longer code, which tells the code of code lengths, as numbers of at most 32 bits with their sizes."""
    header = 15 << 1
    for k, s in enumerate(CODE_LENGTH_ORDER):
        header |= LENGTH_BITS[s] << (5 + 3 * k)
    return (header & 0xFFFFFFFF, header >> 32), (32, 5 + 3 * 19 - 32)


@lru_cache(maxsize=8192)
def _run_tokens(value: int, run: int, again: bool) -> tuple[int, list[int], list[int]]:
    """How many tokens a run of equal code lengths takes, and their bits as numbers of at most 32 bits with their sizes. again: the last length but 0 was the same."""
    tokens = []
    if value == 0:
        while run >= 3:
            k = min(run, 138)
            tokens.append((17, k - 3, 3) if k <= 10 else (18, k - 11, 7))
            run -= k
    else:
        if not again:
            tokens.append((value, 0, 0))
            run -= 1
        while run >= 3:
            k = min(run, 6)
            tokens.append((16, k - 3, 2))
            run -= k
    tokens += [(value, 0, 0)] * run
    codes, values, sizes = _length_codes(), [0], [0]
    for symbol, extra, n in tokens:
        own, size = codes[symbol] | extra << LENGTH_BITS[symbol], LENGTH_BITS[symbol] + n
        if sizes[-1] + size > 32:
            values.append(0)
            sizes.append(0)
        values[-1] |= own << sizes[-1]
        sizes[-1] += size
    return len(tokens), values, sizes


def _write_prefix(out: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist() or [0]
    if len(used) <= 2 and used[-1] < 256:
        out.write(1, 1)
        out.write(len(used) - 1, 1)
        out.write(int(used[0] > 1), 1)
        out.write(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            out.write(used[1], 8)
        return
    # zeros at the end are left out
    lengths = lengths[: used[-1] + 1]
    starts = np.concatenate([[0], np.flatnonzero(lengths[1:] != lengths[:-1]) + 1, [len(lengths)]])
    _write_runs(out, lengths[starts[:-1]].tolist(), (starts[1:] - starts[:-1]).tolist())


def _write_runs(out: Writer, lengths: list[int], runs: list[int]) -> None:
    """A code of more than two symbols or of large ones, from runs of equal lengths."""
    count, before, values, sizes = 0, 8, [], []
    for value, run in zip(lengths, runs, strict=True):
        n, bits, own = _run_tokens(value, run, value == before)
        count += n
        values += bits
        sizes += own
        before = value or before
    if count < 2:
        n, bits, own = _run_tokens(0, 2 - count, False)
        count, values, sizes = 2, values + bits, sizes + own
    start, widths = _length_header()
    out.values += start
    out.sizes += widths
    out.write(1, 1)
    width = max(1, (((count - 2).bit_length() + 1) // 2))
    out.write(width - 1, 3)
    out.write(count - 2, 2 * width)
    out.values += values
    out.sizes += sizes


@lru_cache(maxsize=8192)
def _prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits, number of them) of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    extra = value.bit_length() - 2
    second = value >> extra & 1
    return 2 * extra + 2 + second, value & ((1 << extra) - 1), extra


@lru_cache(maxsize=64)
def _near_codes(width: int) -> dict[int, int]:
    return {x + y * width: k for k, (x, y) in reversed([*enumerate(near_offsets(), 1)]) if x + y * width >= 1}


def slots_of(argb: np.ndarray, cache_bits: int) -> np.ndarray:
    return (argb * np.uint32(HASH) >> np.uint32(32 - cache_bits)).astype(np.int64)


def cache_hits(argb: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether the last pixel before each one in its place of the cache is the same."""
    order = np.argsort(slot.astype(np.uint16), kind="stable")
    same, own = np.zeros(len(argb), dtype=bool), argb.take(order)
    # equal pixels have one place
    same[order[1:]] = own[1:] == own[:-1]
    return same


MIN_COPY, MAX_COPY, SHARED_COST = 3, 4096, 0.05


def _match_keys(argb: np.ndarray) -> np.ndarray:
    """A number for each three pixels in a row."""
    wide = argb.astype(np.uint64)
    with np.errstate(over="ignore"):
        return wide[:-2] * np.uint64(0x9E3779B97F4A7C15) + wide[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + wide[2:] * np.uint64(0xD6E8FEB86659FD93)


def matches(argb: np.ndarray, key: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(place, length, distance) of copies, greedily from the left: at least MIN_COPY pixels that last stood `distance` before. key: _match_keys, where they are known."""
    n = len(argb)
    if n < 2 * MIN_COPY - 1:
        return []
    key = _match_keys(argb) if key is None else key
    order = key.argsort(kind="stable")
    own = key.take(order)
    again = (own[1:] == own[:-1]).nonzero()[0]
    if not len(again):
        return []
    at = order.take(again + 1)
    left_first = at.argsort()
    places, prior, raw = at.take(left_first).tolist(), order.take(again.take(left_first)).tolist(), argb.tobytes()
    out, k = [], 0
    while k < len(places):
        i = places[k]
        back, most = i - prior[k], min(MAX_COPY, n - i)
        # the first pixels as one number, whose lowest bit tells where they part
        length = min(16, most)
        a, b = 4 * i, 4 * prior[k]
        if apart := int.from_bytes(raw[a : a + 4 * length], "little") ^ int.from_bytes(raw[b : b + 4 * length], "little"):
            length = (apart & -apart).bit_length() - 1 >> 5
        else:
            step = 64
            while length < most:
                own = argb[i + length : i + min(length + step, most)]
                same = own == argb[i + length - back : i + length - back + len(own)]
                if not same.all():
                    length += int(same.argmin())
                    break
                length += len(own)
                step *= 4
        if length >= MIN_COPY:
            out.append((i, length, back))
            k = bisect_left(places, i + length, k)
        else:
            k += 1
    return out


def _write_pixels(out: Writer, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, references: bool = False, meta_block: int = 0, cached: tuple[np.ndarray, np.ndarray] | None = None) -> None:
    """cached: slots_of and cache_hits, where they are known."""
    out.write(int(cache_bits > 0), 1)
    if cache_bits:
        out.write(cache_bits, 4)
    n, n_groups, wide, of = len(argb), 1, 1, np.zeros(1, dtype=np.int64)
    if main:
        out.write(int(meta_block > 0), 1)
        if meta_block:
            out.write(meta_block - 2, 3)
            wide = -(-width // (1 << meta_block))
            of = np.arange(wide * -(-(n // width) // (1 << meta_block))) % 2
            n_groups = int(of.max()) + 1
            _write_pixels(out, (of << 8).astype(np.uint32), wide, False)
    # four cells a token: symbols of green (or length), red (or the length's extra bits), blue (or distance), alpha (or its extra bits)
    alphabet = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    base = np.cumsum([0, *alphabet * n_groups])
    none = int(base[-1])  # the symbol of a cell that has no code
    at = channels(argb).take((2, 1, 3, 0), axis=1) + base[:4]
    shift = np.zeros(n, dtype=np.int64)
    if meta_block:
        places = np.arange(n)
        shift = 5 * of[(places // width >> meta_block) * wide + (places % width >> meta_block)]
        at += base[shift][:, None]
    if cache_bits:
        slot = slots_of(argb, cache_bits) if cached is None else cached[0]
        hit = np.flatnonzero(cache_hits(argb, slot) if cached is None else cached[1])
        at[hit, 0], at[hit, 1:] = base.take(shift.take(hit)) + 280 + slot.take(hit), none
    copies = matches(argb) if references else []
    if copies:
        near = _near_codes(width)
        a, b, c, d, e, f = np.array([_prefix_of(length) + _prefix_of(near.get(back, back + 120)) for _, length, back in copies]).T
        place, length, _ = np.array(copies).T
        at[place, 0], at[place, 1], at[place, 2], at[place, 3] = base[shift[place]] + 256 + a, none, base[shift[place] + 4] + d, none
        inside = np.zeros(n + 1, dtype=np.int8)
        inside[place + 1], inside[place + length] = 1, -1
        kept = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) == 0)
        at, place = at.take(kept, axis=0), np.searchsorted(kept, place)
    counts = np.bincount(at.ravel(), minlength=none + 1)
    written, bits_of = np.zeros(none + 1, dtype=np.int64), np.zeros(none + 1, dtype=np.int64)
    own = [counts[base[k] : base[k + 1]] for k in range(5 * n_groups)]
    for k in range(1, 5 * n_groups, 5):
        # red, blue and alpha share a code, which is built and read once, where that costs little
        pooled = own[k] + own[k + 1] + own[k + 2]
        *alone, together = _rows_bits(np.stack([*own[k : k + 3], pooled]))
        if together + 8.0 * np.count_nonzero(pooled) < (1 + SHARED_COST) * sum(alone):
            own[k : k + 3] = [pooled] * 3
    for k in range(5 * n_groups):
        if not (k and own[k] is own[k - 1]):
            lengths = huffman(own[k], 15)
            codes, header = canonical(lengths), Writer()
            _write_prefix(header, lengths)
        out.append(header)
        if np.count_nonzero(lengths) > 1:
            written[base[k] : base[k + 1]], bits_of[base[k] : base[k + 1]] = codes, lengths
    parts, size = written.take(at), bits_of.take(at)
    if copies:
        parts[place, 1], size[place, 1], parts[place, 3], size[place, 3] = b, c, e, f
    out.add(parts.ravel(), size.ravel())


def _code_bits(counts: np.ndarray) -> float:
    """About the bits of symbols with these counts, with those of their code: 4 bits a symbol that occurs."""
    own = counts[counts > 0].astype(np.float64)
    total = own.sum()
    return float(total * np.log2(total) - own @ np.log2(own)) + 4.0 * len(own) if len(own) > 1 else 8.0


def _weight(counts: np.ndarray) -> np.ndarray:
    return counts * np.log2(np.maximum(counts, 1))


@lru_cache(maxsize=1)
def _small_weights() -> tuple[np.ndarray, np.ndarray]:
    """Of the numbers below 4096 what they add to _code_bits as a total, and as a count."""
    x = np.arange(4096)
    return _weight(x), np.minimum(x, 1) * 4.0 - _weight(x)


def _rows_bits(counts: np.ndarray) -> list[float]:
    """_code_bits of each row."""
    total = counts.sum(axis=1)
    if int(total.max(initial=0)) < 4096:
        of_total, of_count = _small_weights()
        bits = of_total.take(total) + of_count.take(counts).sum(axis=1)
    else:
        bits = _weight(total) + (np.minimum(counts, 1) * 4.0 - _weight(counts)).sum(axis=1)
    # two symbols take more than 8 bits with their code, one takes 4 and rounding
    return [x if x > 6 else 8.0 for x in bits.tolist()]


def _channel_bits(parts: np.ndarray, which: tuple[int, ...] = (0, 1, 2, 3)) -> list[float]:
    own = (parts if len(which) == 4 else parts[:, which]) + np.arange(len(which), dtype=np.int16) * np.int16(256)
    return _rows_bits(np.bincount(own.ravel(), minlength=256 * len(which)).reshape(-1, 256))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int8).astype(np.int16)


MULTIPLIERS = (-16, 16)
LEAST_RELATED = 0.3


def _related(parts: np.ndarray) -> bool:
    """Whether two of red, green and blue go together; a share of one that is taken from another saves nothing where they do not."""
    own = np.ascontiguousarray(parts[:, 1:].T).astype(np.float32)
    own -= own.mean(axis=1, keepdims=True)
    products = own @ own.T
    size = np.sqrt(np.maximum(np.diag(products), 1e-9))
    shares = np.abs(products / size[:, None] / size)
    return bool(max(shares[0, 1], shares[0, 2], shares[1, 2]) >= LEAST_RELATED)


def _cross_element(parts: np.ndarray, red_bits: float, blue_bits: float) -> tuple[tuple[int, int, int], float]:
    """Green-to-red, green-to-blue and red-to-blue of the whole image, each the one of MULTIPLIERS or 0 that saves most bits, and what they save."""
    red, green, blue = (np.ascontiguousarray(parts[:, k]) for k in (1, 2, 3))

    def best(own: np.ndarray, by: np.ndarray, bits: float) -> tuple[int, float, np.ndarray]:
        found = (0, bits, own)
        for m in MULTIPLIERS:
            rest = (own - (m * _signed(by) >> 5)).astype(np.uint8)
            if (bits := _code_bits(np.bincount(rest))) < found[1]:
                found = (m, bits, rest)
        return found

    green_red, new_red, _ = best(red, green, red_bits)
    green_blue, new_blue, rest = best(blue, green, blue_bits)
    red_blue, new_blue, _ = best(rest, red, new_blue)
    return (green_red, green_blue, red_blue), red_bits + blue_bits - new_red - new_blue


PREDICT_BLOCK, CROSS_BLOCK, CROSS_BITS, ZERO_SHARE = 4, 9, 40, 0.5


def _row_modes(argb: np.ndarray, width: int) -> np.ndarray:
    """A mode for each block of rows: of those that copy a neighbour the one that leaves most zeros, if they are more than ZERO_SHARE; else 0."""
    own = argb.reshape(-1, width)
    starts = np.arange(0, len(own), 1 << PREDICT_BLOCK)
    area = np.diff(starts, append=len(own)) * width
    last = int(starts[-1])
    # no block has more zeros than the image; its last block, which may be small, is looked at alone
    for now, left in ((own[:, 1:], own[:, :-1]), (own[1:], own[:-1]), (own[1:, :-1], own[:-1, 1:]), (own[1:, 1:], own[:-1, :-1])):
        equal = now == left
        if np.count_nonzero(equal) > ZERO_SHARE * area[0] or np.count_nonzero(equal[max(last - len(own) + len(equal), 0) :]) > ZERO_SHARE * area[-1]:
            break
    else:
        return np.zeros(len(starts), dtype=np.int64)
    same = np.zeros((5, len(own)), dtype=np.int64)
    same[1] = (own[:, 1:] == own[:, :-1]).sum(axis=1)
    same[2, 1:] = (own[1:] == own[:-1]).sum(axis=1)
    same[3, 1:] = (own[1:, :-1] == own[:-1, 1:]).sum(axis=1)
    same[4, 1:] = (own[1:, 1:] == own[:-1, :-1]).sum(axis=1)
    zeros = np.add.reduceat(same, starts, axis=1)
    return np.where(zeros.max(axis=0) > ZERO_SHARE * area, zeros.argmax(axis=0), 0)


def _less_predicted(argb: np.ndarray, width: int, modes: np.ndarray) -> np.ndarray:
    """What is left after the modes of _row_modes."""
    of_row = np.repeat(modes, 1 << PREDICT_BLOCK)[: len(argb) // width]
    out = residuals(argb, width, 0)
    for m in set(modes.tolist()) - {0}:
        out[of_row == m] = residuals(argb, width, m)[of_row == m]
    return out.reshape(-1, 4)


def encode_best(pixels: np.ndarray) -> bytes:
    """A file of one image, with transforms, cache and copies where estimates from the data say that they make it smaller."""
    height, width = pixels.shape[:2]
    argb = _numbers(pixels)
    parts = channels(argb)
    transforms: tuple[int, ...] = ()
    values: dict[int, np.ndarray] = {}
    alone = _channel_bits(parts)
    bits = plain = sum(alone)
    ordered = np.sort(argb)
    starts = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    if len(starts) < 256:
        palette = 24.0 * (len(starts) + 1) + _code_bits(np.diff(starts, prepend=0, append=len(argb)))
        if palette < bits:
            transforms, bits = (PALETTE,), palette
    modes = _row_modes(argb, width)
    if modes.any() and (own := sum(_channel_bits(_less_predicted(argb, width, modes))) + 4.0 * len(modes)) < bits:
        transforms, values, bits = (PREDICTOR,), {PREDICTOR: modes}, own
    if _related(parts):
        if (own := alone[0] + alone[2] + sum(_channel_bits(parts - parts[:, 2:3], (1, 3)))) < bits:
            transforms, values, bits = (SUBTRACT_GREEN,), {}, own
        element, saved = _cross_element(parts, alone[1], alone[3])
        if plain - saved + CROSS_BITS < bits:
            green_red, green_blue, red_blue = (m & 255 for m in element)
            own = np.tile(np.array([255, red_blue, green_blue, green_red], dtype=np.uint8), (-(-height // (1 << CROSS_BLOCK)), 1))
            transforms, values = (CROSS_COLOR,), {CROSS_COLOR: joined(own)}
    return encode(pixels, transforms, references=True, cache_bits=-1, values=values, blocks={PREDICTOR: PREDICT_BLOCK, CROSS_COLOR: CROSS_BLOCK}, plain=plain)


def _best_cache(argb: np.ndarray, without: float | None = None) -> tuple[int, tuple[np.ndarray, np.ndarray] | None]:
    """Bits of a cache of about an eighth of the pixels, or 0 where it does not pay; the places of the pixels, and which of them are found there. without: sum of _channel_bits, where it is known."""
    size = min(max(len(argb).bit_length() - 3, 1), 10)
    slot = slots_of(argb, size)
    hit = cache_hits(argb, slot)
    if not hit.any():
        return 0, None
    parts = channels(argb)
    without = sum(_channel_bits(parts)) if without is None else without
    rest = parts[~hit]
    green = np.concatenate([np.bincount(rest[:, 2], minlength=256), np.bincount(slot[hit])])
    return (size, (slot, hit)) if _code_bits(green) + sum(_channel_bits(rest, (0, 1, 3))) < without else (0, None)


SURE = 1e-6
# Cells of one image's counts when many are written: green, lengths and cache places, then red, blue, alpha, distances, and what has no code.
_CELLS = (0, 1304, 1560, 1816, 2072, 2112)
_CELL_CODE = np.repeat(np.arange(6), np.diff([*_CELLS, _CELLS[-1] + 1]))


def _bits_of_rows(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """What _rows_bits gives for rows of images of which some may be large."""
    of_total, of_count = _small_weights()
    large = np.flatnonzero(total >= len(of_total))
    bits = of_total.take(total, mode="clip") + of_count.take(counts, mode="clip").sum(axis=1)
    if len(large):
        bits[large] = _weight(total[large]) + (np.minimum(counts[large], 1) * 4.0 - _weight(counts[large])).sum(axis=1)
    return np.where(bits > 6, bits, 8.0)


def _byte_bits(of: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """_rows_bits of the bytes `own` of each of n images."""
    counts = np.bincount(of * 256 + own, minlength=256 * n).reshape(n, 256)
    return _bits_of_rows(counts, counts.sum(axis=1))


def _plainly_best(argb: np.ndarray, parts: np.ndarray, of: np.ndarray, sizes: np.ndarray, width: int, alone: np.ndarray) -> np.ndarray:
    """Of images of one width, those for which encode_best chooses no transform for sure: each is bounded by the most that it could save."""
    n, room = len(sizes), np.cumsum(sizes) - sizes
    plain = ((alone[:, 0] + alone[:, 1]) + alone[:, 2]) + alone[:, 3]
    # palette
    ordered = np.sort(of.astype(np.uint64) << np.uint64(32) | argb)
    starts = np.append(0, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1)
    whose = (ordered.take(starts) >> np.uint64(32)).astype(np.int64)
    counts, colours = np.diff(starts, append=len(argb)), np.bincount(whose, minlength=n)
    palette = 24.0 * colours + np.maximum(8.0, _weight(sizes) + np.bincount(whose, 4.0 - _weight(counts), n))
    best = (colours > 256) | (np.where(colours > 1, palette, 24.0 + 8.0) > plain + SURE)
    # predictor: any block more than ZERO_SHARE equal to a neighbour
    rows = sizes // width
    row = np.arange(int(rows.sum())) - np.repeat(np.cumsum(rows) - rows, rows)
    block = np.flatnonzero(row % (1 << PREDICT_BLOCK) == 0)
    area = np.diff(block, append=len(row)) * width
    x, upper = np.tile(np.arange(width), len(row)), np.repeat(row > 0, width)
    most = np.zeros(len(block), dtype=np.int64)
    for back, there in ((1, x > 0), (width, upper), (width - 1, upper & (x < width - 1)), (width + 1, upper & (x > 0))):
        if back and back < len(argb):
            same = np.zeros(len(argb), dtype=np.int32)
            same[back:] = (argb[back:] == argb[:-back]) & there[back:]
            most = np.maximum(most, np.add.reduceat(same, block * width))
    best &= np.bincount(np.repeat(np.arange(n), -(-rows >> PREDICT_BLOCK)), most > ZERO_SHARE * area, n) == 0
    # subtract-green and cross-colour, where channels go together
    red, green, blue = (parts[:, k].astype(np.float64) for k in (1, 2, 3))
    total = {k: np.add.reduceat(v, room) for k, v in (("r", red), ("g", green), ("b", blue), ("rr", red * red), ("gg", green * green), ("bb", blue * blue), ("rg", red * green), ("rb", red * blue), ("gb", green * blue))}
    spread = lambda a, b: total[a + b] - total[a] * total[b] / sizes
    size = {k: np.maximum(spread(k, k), 1e-9) for k in "rgb"}
    share = np.max([spread(a, b) ** 2 / (size[a] * size[b]) for a, b in ("rg", "rb", "gb")], axis=0)
    asked = np.flatnonzero(best & ((share >= (LEAST_RELATED - 0.01) ** 2) | (np.minimum(np.minimum(size["r"], size["g"]), size["b"]) < 1)))
    if len(asked):
        among = np.zeros(n, dtype=np.int64)
        among[asked] = np.arange(len(asked))
        chosen = np.zeros(n, dtype=bool)
        chosen[asked] = True
        at = np.flatnonzero(chosen.take(of))
        own, of_own = parts.take(at, axis=0), among.take(of.take(at))
        red, green, blue = own[:, 1], own[:, 2], own[:, 3]
        bits = lambda x: _byte_bits(of_own, x.astype(np.uint8), len(asked))
        less = alone[asked, 0] + alone[asked, 2] + bits(red - green) + bits(blue - green)
        shares = {m: m * _signed(green) >> 5 for m in MULTIPLIERS}
        reds = np.min([alone[asked, 1], *(bits(red - shares[m]) for m in MULTIPLIERS)], axis=0)
        rests = [blue, *((blue - shares[m]).astype(np.uint8) for m in MULTIPLIERS)]
        blues = np.min([alone[asked, 3], *(bits(x) for x in rests[1:]), *(bits(x - (m * _signed(red) >> 5)) for x in rests for m in MULTIPLIERS)], axis=0)
        crossed = plain[asked] - (alone[asked, 1] + alone[asked, 3] - reds - blues) + CROSS_BITS
        best[asked] = (less > plain[asked] + SURE) & (crossed > plain[asked] + SURE)
    return best


def encode_all(images: list[np.ndarray]) -> list[bytes]:
    """What encode_best gives for each of at most 8,192 images of one width; those that need no transform are written together."""
    width, sizes = images[0].shape[1], np.array([x.shape[0] * x.shape[1] for x in images])
    argb = _numbers(np.concatenate(images))
    parts = channels(argb)
    of = np.repeat(np.arange(len(images)), sizes)
    alone = np.stack([_byte_bits(of, parts[:, k], len(images)) for k in range(4)], axis=1)
    best = _plainly_best(argb, parts, of, sizes, width, alone) & (max(width, int(sizes.max()) // width) <= MAX_SIDE)
    kept = np.flatnonzero(best)
    out = dict(zip(kept.tolist(), _written(argb, parts, of, sizes, width, alone, kept), strict=True)) if len(kept) else {}
    return [out[k] if k in out else encode_best(own) for k, own in enumerate(images)]


def _written(argb: np.ndarray, parts: np.ndarray, of: np.ndarray, sizes: np.ndarray, width: int, alone: np.ndarray, kept: np.ndarray) -> list[bytes]:
    """Files of the images `kept`, without transforms."""
    n, room = len(kept), np.cumsum(sizes) - sizes
    if n < len(sizes):
        at = np.flatnonzero(np.isin(of, kept))
        argb, parts = argb.take(at), parts.take(at, axis=0)
        sizes, alone = sizes.take(kept), alone.take(kept, axis=0)
        of, room = np.repeat(np.arange(n), sizes), np.cumsum(sizes) - sizes
    # a cache of about an eighth of the pixels, where it pays
    bits = np.array([min(max(int(x).bit_length() - 3, 1), 10) for x in sizes])
    slot = (argb * np.uint32(HASH) >> np.repeat(32 - bits, sizes).astype(np.uint32)).astype(np.int64)
    order = np.argsort(slot.astype(np.uint16), kind="stable")
    order = order.take(np.argsort(of.astype(np.uint16).take(order), kind="stable"))
    own, whose = argb.take(order), of.take(order)
    hit = np.zeros(len(argb), dtype=bool)
    # equal pixels have one place
    hit[order[1:]] = (own[1:] == own[:-1]) & (whose[1:] == whose[:-1])
    miss = np.flatnonzero(~hit)
    of_miss = of.take(miss)
    green = np.where(hit, 256 + slot, parts[:, 2])
    counts = np.bincount(of * 1280 + green, minlength=1280 * n).reshape(n, 1280)
    cost = _bits_of_rows(counts, sizes) + np.sum([_byte_bits(of_miss, parts[:, k].take(miss), n) for k in (0, 1, 3)], axis=0)
    plain = ((alone[:, 0] + alone[:, 1]) + alone[:, 2]) + alone[:, 3]
    pays = cost < plain
    for k in np.flatnonzero(np.abs(cost - plain) < SURE).tolist():
        pays[k] = _best_cache(argb[room[k] : room[k] + sizes[k]])[0] > 0
    pays &= np.bincount(of, hit, n) > 0
    hit &= pays.take(of)
    # symbols of each pixel: green or place, red, blue, alpha
    first, none = of * _CELLS[-1] + of, _CELLS[-1]
    at = parts.take((2, 1, 3, 0), axis=1) + np.array(_CELLS[:4])
    hits = np.flatnonzero(hit)
    at[hits, 0], at[hits, 1:] = 280 + slot.take(hits), none
    key, near = _match_keys(argb), _near_codes(width)
    copies, whose_copy = [], []
    for k, (start, size) in enumerate(zip(room.tolist(), sizes.tolist(), strict=True)):
        found = matches(argb[start : start + size], key[start : start + size - 2])
        copies += [(start + i, length, *_prefix_of(length), *_prefix_of(near.get(back, back + 120))) for i, length, back in found]
        whose_copy += [k] * len(found)
    tokens = np.arange(len(argb))
    if copies:
        place, length, a, b, c, d, e, f = np.array(copies).T
        at[place, 0], at[place, 1], at[place, 2], at[place, 3] = 256 + a, none, _CELLS[4] + d, none
        inside = np.zeros(len(argb) + 1, dtype=np.int8)
        inside[place + 1], inside[place + length] = 1, -1
        tokens = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) == 0)
        place = np.searchsorted(tokens, place)
    at = at.take(tokens, axis=0)
    at += first.take(tokens)[:, None]
    counts = np.bincount(at.ravel(), minlength=n * (none + 1)).reshape(n, none + 1)
    counts[:, none] = 0
    channel = counts[:, _CELLS[1] : _CELLS[4]].reshape(n, 3, 256)
    pooled = channel.sum(axis=1)
    apart = _bits_of_rows(channel.reshape(-1, 256), channel.sum(axis=2).ravel()).reshape(n, 3)
    # red, blue and alpha share a code, which is built and read once, where that costs little
    shared = _bits_of_rows(pooled, pooled.sum(axis=1)) + 8.0 * np.count_nonzero(pooled, axis=1) < (1 + SHARED_COST) * (apart[:, 0] + apart[:, 1] + apart[:, 2])
    channel[shared, 0], channel[shared, 1:] = pooled[shared], 0
    lengths, codes, alphabets = _codes_of(counts.ravel(), n)
    for x in (lengths, codes):
        own = x.reshape(n, none + 1)[:, _CELLS[1] : _CELLS[4]].reshape(n, 3, 256)
        own[shared, 1:] = own[shared, :1]
    values, widths = codes.take(at), lengths.take(at)
    if copies:
        values[place, 1], widths[place, 1], values[place, 3], widths[place, 3] = b, c, e, f
    heads, held = Writer(), []
    for k in range(n):
        before, paid = len(heads.values), int(pays[k])
        for value, size in ((0x2F, 8), (width - 1, 14), (int(sizes[k]) // width - 1, 14), (1, 1), (0, 3), (0, 1), (paid, 1), (int(bits[k]), 4 * paid), (0, 1)):
            heads.write(value, size)
        own = alphabets[5 * k : 5 * k + 5]
        for x in (own[0], own[1], own[1], own[1], own[4]) if shared[k] else own:
            heads.append(x)
        held.append(len(heads.values) - before)
    return [_file(data) for data in _bytes_of_each(heads, np.array(held), values, widths, np.bincount(of.take(tokens), minlength=n))]


def _codes_of(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[Writer]]:
    """Of each count, in rows of _CELLS: bits and code of its symbol, where the code has others; how each of five codes an image is written."""
    used = np.flatnonzero(counts)
    cell = used % (_CELLS[-1] + 1)
    code = used // (_CELLS[-1] + 1) * 5 + _CELL_CODE.take(cell)
    symbols = np.bincount(code, minlength=5 * n)
    # rarest first
    order = np.argsort(code << 32 | counts.take(used), kind="stable")
    weights, depths, at = counts.take(used.take(order)).tolist(), [], 0
    for size in symbols.tolist():
        depths += _depths(weights[at : at + size], 15) if size > 1 else [1] * size
        at += size
    own = np.zeros(len(used), dtype=np.int64)
    own[order] = depths
    # by length, then symbol
    order = np.argsort(code << 4 | own, kind="stable")
    room = 1 << (15 - own.take(order))
    before = np.cumsum(room) - room
    begin = np.cumsum(symbols) - symbols
    some = np.flatnonzero(symbols)
    before -= np.repeat(before.take(begin.take(some)), symbols.take(some))
    lengths, codes = np.zeros(len(counts), dtype=np.int64), np.zeros(len(counts), dtype=np.int64)
    real = symbols.take(code.take(order)) > 1
    to = used.take(order.compress(real))
    lengths[to], codes[to] = own.take(order.compress(real)), _reversed(15).take(before.compress(real))
    # runs of equal lengths, up to the last symbol of a code
    symbol = cell - np.array(_CELLS).take(_CELL_CODE.take(cell))
    follows = np.append(False, code[1:] == code[:-1])
    gap = symbol - np.where(follows, np.append(0, symbol[:-1]), -1) - 1
    fresh = ~follows | (gap > 0) | np.append(True, own[1:] != own[:-1])
    starts = np.flatnonzero(fresh)
    run_values, run_sizes, run_gaps = own.take(starts).tolist(), np.diff(starts, append=len(own)).tolist(), gap.take(starts).tolist()
    runs = np.bincount(code.take(starts), minlength=5 * n).tolist()
    symbol, at, run, written = symbol.tolist(), 0, 0, []
    for size, count in zip(symbols.tolist(), runs, strict=True):
        out = Writer()
        last = symbol[at + size - 1] if size else 0
        if size <= 2 and last < 256:
            one = symbol[at] if size else 0
            out.values, out.sizes = [1, max(size, 1) - 1, int(one > 1), one], [1, 1, 1, 8 if one > 1 else 1]
            if size == 2:
                out.write(last, 8)
        else:
            values, sizes = [], []
            for k in range(run, run + count):
                if run_gaps[k]:
                    values.append(0)
                    sizes.append(run_gaps[k])
                values.append(run_values[k])
                sizes.append(run_sizes[k])
            _write_runs(out, values, sizes)
        written.append(out)
        at, run = at + size, run + count
    return lengths, codes, written


def _bytes_of_each(heads: Writer, held: np.ndarray, values: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> list[bytes]:
    """What Writer.bytes gives for each image, of which `held` numbers of heads come first, then four for each of its tokens."""
    each = 4 * tokens
    total = held + each
    base = np.cumsum(total) - total
    all_values, all_sizes = np.zeros(int(total.sum()), dtype=np.uint64), np.zeros(int(total.sum()), dtype=np.int64)
    for own_values, own_sizes, first, count in ((np.array(heads.values), np.array(heads.sizes), base, held), (values.ravel(), sizes.ravel(), base + held, each)):
        at = np.arange(len(own_sizes)) + np.repeat(first - np.cumsum(count) + count, count)
        all_values[at], all_sizes[at] = own_values, own_sizes
    keep = np.flatnonzero(all_sizes)
    end = np.cumsum(all_sizes)
    bits = end.take(base + total - 1) - np.append(0, end.take(base + total - 1)[:-1])
    # each begins in a word of its own
    words = (bits + 31) // 32 + 1
    room = np.cumsum(words) - words
    start = end - all_sizes + np.repeat(32 * room - np.cumsum(bits) + bits, total)
    start, all_values = start.take(keep), all_values.take(keep)
    word = start >> 5
    first = np.append(0, np.flatnonzero(word[1:] != word[:-1]) + 1)
    sums, at = np.add.reduceat(all_values << (start & 31).astype(np.uint64), first), word.take(first)
    cells = np.zeros(int(words.sum()), dtype=np.uint64)
    cells[at] = sums & np.uint64(0xFFFFFFFF)
    cells[at + 1] += sums >> np.uint64(32)
    data = cells.astype("<u4").tobytes()
    return [data[4 * at : 4 * at + (n + 7) // 8] for at, n in zip(room.tolist(), bits.tolist(), strict=True)]


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), block: int = 2, cache_bits: int = 0, references: bool = False, meta_block: int = 0, seed: int = 0, values: dict | None = None, blocks: dict | None = None, plain: float | None = None) -> bytes:
    """A file of one image (height, width, 4). transforms are applied in the order given; their block values are in `values` or drawn from seed. cache_bits -1: by the data; plain: the _channel_bits of the pixels, where they are known."""
    height, width = pixels.shape[:2]
    if not (0 < height <= MAX_SIDE and 0 < width <= MAX_SIDE):
        raise ValueError("an image has 1 to 16384 pixels a side")
    rng = np.random.Generator(np.random.PCG64(seed)) if {PREDICTOR, CROSS_COLOR} & set(transforms) else None
    out, argb, across = Writer(), _numbers(pixels), width
    values, blocks = values or {}, blocks or {}
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.write(value, n)
    for kind in transforms:
        out.write(1, 1)
        out.write(kind, 2)
        own = blocks.get(kind, block)
        wide = -(-across // (1 << own))
        n = wide * -(-height // (1 << own))
        if kind == PREDICTOR:
            modes = values.get(kind)
            drawn = modes is None
            modes = rng.integers(0, 14, n) if drawn else modes
            out.write(own - 2, 3)
            _write_pixels(out, (modes << 8).astype(np.uint32), wide, False)
            argb = apply_predictor(argb, across, own, modes) if drawn else joined(_less_predicted(argb, across, modes))
        elif kind == CROSS_COLOR:
            elements = values.get(kind)
            elements = joined(rng.integers(0, 256, (n, 4)).astype(np.uint8)) if elements is None else elements
            out.write(own - 2, 3)
            _write_pixels(out, elements, wide, False)
            argb = cross_color(argb, across, own, elements, -1)
        elif kind == SUBTRACT_GREEN:
            argb = add_green(argb, -1)
        else:
            table, index = np.unique(argb, return_inverse=True)
            if len(table) > 256:
                raise ValueError("a palette has at most 256 colours")
            out.write(len(table) - 1, 8)
            steps = channels(table)
            steps[1:] -= steps[:-1].copy()
            _write_pixels(out, joined(steps), len(table), False)
            bundle = palette_bits(len(table))
            wide = -(-across // (1 << bundle))
            cells = np.zeros((height, wide << bundle), dtype=np.uint32)
            cells[:, :across] = index.reshape(height, across)
            per = 8 >> bundle
            argb = sum(cells[:, k :: 1 << bundle] << np.uint32(per * k) for k in range(1 << bundle)).ravel() << np.uint32(8)
            across = wide
    out.write(0, 1)
    argb = argb.astype(np.uint32)
    size, cached = _best_cache(argb, None if transforms else plain) if cache_bits < 0 else (cache_bits, None)
    _write_pixels(out, argb, across, True, size, references, meta_block, cached)
    return _file(out.bytes())


def _file(data: bytes) -> bytes:
    pad = len(data) & 1
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(data) + pad, b"WEBP", b"VP8L", len(data)) + data + b"\0" * pad
