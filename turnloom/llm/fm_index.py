"""A compressed FM-index over sequences of words, as arrays in one task.

The Burrows-Wheeler transform of the sequences is kept in a wavelet tree shaped by a Huffman code of the words: bits packed in 64-bit
units with a count before each unit, so a frequent word costs few bits and few steps. Backward search extends a match to the left by
one word; many sequences are searched side by side, one word of each at a time. Where a match reaches its greatest length, its last
word is dropped through the marks of equal prefixes; where it can't be extended, it is shortened to the next enclosing interval.

Each sequence ends in a separator of its own, less than every other, so no match reaches past a sequence. A sequence must not be longer
than LONGEST words.
"""

from __future__ import annotations

import numpy as np

LONGEST = 1 << 20


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a Huffman code for positive counts, by two queues over the sorted counts."""
    n = len(counts)
    if n == 1:
        return np.ones(1, dtype=np.int64)
    order = np.argsort(counts, kind="stable")
    weight = counts[order].tolist() + [0] * (n - 1)
    parent = [0] * (2 * n - 1)
    leaf, inner = 0, n
    for node in range(n, 2 * n - 1):
        for _ in range(2):
            if inner >= node or leaf < n and weight[leaf] <= weight[inner]:
                least, leaf = leaf, leaf + 1
            else:
                least, inner = inner, inner + 1
            parent[least] = node
            weight[node] += weight[least]
    depth = [0] * (2 * n - 1)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    out = np.empty(n, dtype=np.int64)
    out[order] = depth[:n]
    return out


class BitVector:
    """Packed bits; ones(i) counts those set before place i."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.units = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        self.units.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.units), dtype=np.int32)
        np.cumsum(np.bitwise_count(self.units[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        unit = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[unit] + np.bitwise_count(self.units[unit] & low)


class WaveletTree:
    """Ranks in a sequence of symbols 0..n-1 that are numbered by ascending length of their codes."""

    def __init__(self, sequence: np.ndarray, counts: np.ndarray, lengths: np.ndarray):
        self.lengths = lengths
        height = int(lengths[-1])
        total = np.concatenate([[0], np.cumsum(counts)])
        # canonical codes, left-justified to the height
        step = np.ones(len(counts), dtype=np.uint64) << (height - lengths).astype(np.uint64)
        code = np.cumsum(step) - step
        self.levels: list[BitVector] = []
        self.start, self.ones_at_start, self.bit = [], [], []
        prefix = np.zeros(len(counts), dtype=np.int64)
        starts = np.zeros(len(counts), dtype=np.int64)
        for level in range(height):
            bit = ((code >> np.uint64(height - 1 - level)) & np.uint64(1)).astype(np.int64)
            bits = bit[sequence]
            vector = BitVector(bits)
            ones = vector.ones(starts)
            self.levels.append(vector)
            self.start.append(starts.astype(np.int32))
            self.ones_at_start.append(ones.astype(np.int32))
            self.bit.append(bit.astype(bool))
            # the next level holds the symbols with longer codes, node by node, in the order of the sequence
            after = int(np.searchsorted(lengths, level + 1, side="right"))
            prefix = prefix * 2 + bit
            heads = np.flatnonzero(np.diff(prefix[after:], prepend=-1)) + after
            below = np.zeros(len(counts), dtype=np.int64)
            if after < len(counts):
                below[after:] = (total[heads] - total[after])[np.searchsorted(heads, np.arange(after, len(counts)), side="right") - 1]
                seen = np.cumsum(bits) - bits - ones[sequence]
                rank = np.where(bits == 1, seen, np.arange(len(sequence)) - starts[sequence] - seen)
                deeper = sequence >= after
                placed = np.empty(int(total[-1] - total[after]), dtype=sequence.dtype)
                placed[below[sequence[deeper]] + rank[deeper]] = sequence[deeper]
                sequence = placed
            starts = below

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol comes before its place."""
        at, live = at.copy(), np.arange(len(symbol))
        for level, vector in enumerate(self.levels):
            deep = self.lengths[symbol[live]] > level
            if not deep.all():
                live = live[deep]
                if not len(live):
                    break
            own, place = symbol[live], at[live]
            ones = vector.ones(self.start[level][own] + place) - self.ones_at_start[level][own]
            at[live] = np.where(self.bit[level][own], ones, place - ones)
        return at


def _ranks(text: np.ndarray, first: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by doubling, and the ranks of all suffixes by their first 1, 2, 4, ... words. first: rank of each suffix by one word."""
    n, rank, steps, h = len(text), first, [first], 1
    while h <= longest:
        later = np.zeros(n, dtype=np.int64)
        later[: n - h] = rank[h:]
        key = rank * n + later
        order = np.argsort(key)
        key = key[order]
        head = np.arange(n)
        head[1:][key[1:] == key[:-1]] = 0
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.maximum.accumulate(head)
        steps.append(rank)
        h *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    return order, steps


def _common(order: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix shares with the one before it in the suffix array."""
    a, b = order[1:].copy(), order[:-1].copy()
    out = np.zeros(len(order), dtype=np.int32)
    for k in range(len(steps) - 1, -1, -1):
        same = steps[k][a] == steps[k][b]
        a[same] += 1 << k
        b[same] += 1 << k
        out[1:][same] += 1 << k
    return out


class FMIndex:
    """flat: the words of all sequences as 64-bit hashes; sequence i is flat[offsets[i]:offsets[i + 1]], and belongs to owner[i]. Matches are of at most `most` words."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, owner: np.ndarray, most: int):
        self.most = most
        sizes, n_seq = np.diff(offsets), len(offsets) - 1
        if sizes.max(initial=0) > LONGEST:
            raise ValueError(f"a sequence has more than {LONGEST} words")
        self.words, ids = np.unique(flat, return_inverse=True)
        # the separator comes last among the words' numbers until codes are given
        n = len(flat) + n_seq
        ends = offsets[1:] + np.arange(n_seq)
        text = np.full(n, len(self.words), dtype=np.int64)
        inside = np.ones(n, dtype=bool)
        inside[ends] = False
        text[inside] = ids
        counts = np.bincount(text, minlength=len(self.words) + 1)
        counts[-1] = max(counts[-1], 1)
        lengths = code_lengths(counts)
        order = np.argsort(lengths, kind="stable")
        self.number = np.empty(len(order), dtype=np.int64)
        self.number[order] = np.arange(len(order))
        counts = counts[order]
        self.first = np.cumsum(counts) - counts
        text = self.number[text]
        separator = self.number[-1]
        rank = self.first[text]
        rank[ends] = self.first[separator] + np.arange(n_seq)
        suffixes, steps = _ranks(text, rank, int(sizes.max(initial=0)) + 1)
        common = _common(suffixes, steps)
        self.common = common
        self.tree = WaveletTree(text[suffixes - 1], counts, lengths[order])
        self.size = n
        # intervals of equal prefixes of most - 1 and of most words
        self.shorter, self.shorter_at = self._groups(common < most - 1)
        self.full, full_at = self._groups(common < most)
        own = np.repeat(owner, sizes + 1)[suffixes]
        self.least_owner = np.minimum.reduceat(own, full_at[:-1]) if n else own
        self._table: list[np.ndarray] = []

    def _groups(self, opens: np.ndarray) -> tuple[BitVector, np.ndarray]:
        opens = opens.copy()
        opens[:1] = True
        return BitVector(opens), np.append(np.flatnonzero(opens), len(opens))

    def symbols(self, flat: np.ndarray) -> np.ndarray:
        """Numbers of words in the index; -1 for a word that it doesn't hold."""
        if not len(self.words):
            return np.full(len(flat), -1)
        at = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
        return np.where(self.words[at] == flat, self.number[at], -1)

    def _minima(self) -> list[np.ndarray]:
        """Minima of the common lengths over runs of 1, 2, 4, ... places; made when a match first has to be shortened."""
        if not self._table:
            self._table = [np.append(self.common, -1)]
            self._table[0][0] = -1
            while 2 << len(self._table) <= 2 * self.size:
                last, span = self._table[-1], 1 << (len(self._table) - 1)
                self._table.append(np.minimum(last[:-span], last[span:]) if len(last) > span else last[:0])
        return self._table

    def _enclosing(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next larger interval around each, and its length."""
        table = self._minima()
        length = np.maximum(table[0][low], table[0][high])
        low, high = low.copy(), high.copy()
        for k in range(len(table) - 1, -1, -1):
            # left as long as all of a run is at least the length, then right
            move = low - (1 << k) + 1 >= 0
            move[move] = table[k][low[move] - (1 << k) + 1] >= length[move]
            low[move] -= 1 << k
            move = high + (1 << k) <= self.size
            move[move] = table[k][high[move]] >= length[move]
            high[move] += 1 << k
        return low, high, length

    def matching_statistics(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word of the given sequences: the length (at most `most`) of the longest match that starts there, and the least owner of a full match (the greatest long where there is none)."""
        n, sizes = len(flat), np.diff(offsets)
        lengths, least = np.zeros(n, dtype=np.int64), np.full(n, np.iinfo(np.int64).max)
        symbol = self.symbols(flat)
        order = np.argsort(-sizes, kind="stable")
        ends = offsets[1:][order]
        low, high, length = np.zeros(len(order), dtype=np.int64), np.full(len(order), self.size), np.zeros(len(order), dtype=np.int64)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            n_live = int(np.searchsorted(-sizes[order], -step, side="right"))
            at = ends[:n_live] - step
            self._extend(symbol[at], low[:n_live], high[:n_live], length[:n_live])
            lengths[at] = length[:n_live]
            whole = np.flatnonzero(length[:n_live] == self.most)
            least[at[whole]] = self.least_owner[self.full.ones(low[whole] + 1) - 1]
        return lengths, least

    def _extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> None:
        """Extends each match by one word to the left, in place."""
        cut = np.flatnonzero(length == self.most)
        group = self.shorter.ones(low[cut] + 1) - 1
        low[cut], high[cut], length[cut] = self.shorter_at[group], self.shorter_at[group + 1], self.most - 1
        unknown = symbol < 0
        low[unknown], high[unknown], length[unknown] = 0, self.size, 0
        open_ = np.flatnonzero(~unknown)
        while len(open_):
            own = symbol[open_]
            rank = self.tree.rank(np.concatenate([own, own]), np.concatenate([low[open_], high[open_]])) + np.tile(self.first[own], 2)
            below, above = rank[: len(own)], rank[len(own) :]
            found = below < above
            done = open_[found]
            low[done], high[done] = below[found], above[found]
            length[done] += 1
            open_ = open_[~found]
            if len(open_):
                low[open_], high[open_], length[open_] = self._enclosing(low[open_], high[open_])
