"""A compressed FM-index of word sequences with backward search over a wavelet matrix.

Sequences are joined behind separators, each smaller than every word and than the separators
before it; the Burrows-Wheeler transform of the whole is kept as a wavelet matrix of packed bits with
one count for each 64.  All searches are vectorised over many patterns at once.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ONE = _U(1)


def suffix_array(codes: np.ndarray, keep: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """By prefix doubling; the suffixes must differ within the array (distinct separators see to it).

    Also the ranks by the first ``keep`` symbols (a power of two), equal where those are.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], codes[order][1:] != codes[order][:-1]]))
    k = 1
    # Suffixes with a rank of their own are in place; only ties are sorted again.
    kept = rank if keep else None
    while True:
        if k == keep:
            kept = rank.copy()
        tied = np.zeros(n, bool)
        r = rank[order]
        same = r[1:] == r[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        if not same.any():
            return order, rank if k < keep else kept
        at = np.flatnonzero(tied)
        rows = order[at]
        following = np.where(rows + k < n, rank[np.minimum(rows + k, n - 1)] + 1, 0)
        key = np.argsort(r[at] * np.int64(n + 1) + following)
        rows, a, b = rows[key], r[at][key], following[key]
        order[at] = rows
        # Old ranks count distinct values before; new ones must keep the order, so they count rows.
        first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        if k == 1:
            rank[order] = np.searchsorted(r, r, "left")
        rank[rows] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        k *= 2


class WaveletMatrix:
    """rank(symbol, i): occurrences of symbol before i, for arrays of both."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        self.bits = bits
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            packed = np.packbits(np.pad(bit.astype(np.uint8), (0, -len(bit) % 64 + 64)), bitorder="little").view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            zeros = int(len(bit) - bit.sum())
            self.levels.append((packed, counts.astype(np.uint32), zeros))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        # Where the run of each symbol starts on the last level.
        self.base = np.zeros(0, np.int64)
        symbols = np.arange(1 << bits if bits < 4 else int(values.max(initial=0)) + 1)
        self.base = self._descend(symbols, np.zeros(len(symbols), np.int64))

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        packed, counts, _ = self.levels[level]
        word = i >> 6
        mask = (_ONE << (i & 63).astype(_U)) - _ONE
        return counts[word].astype(np.int64) + np.bitwise_count(packed[word] & mask)

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            bit = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            ones = self._ones(level, i)
            i = np.where(bit, self.levels[level][2] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        known = symbol < len(self.base)
        s = np.where(known, symbol, 0)
        return np.where(known, self._descend(s, i) - self.base[s], 0)


class FMIndex:
    """Index of sequences of word ids >= 1 (0 is kept for separators) with the runs of suffixes that share ``depth`` words.

    After construction the wavelet matrix, the counts of words and the bounds of the runs stay; words
    and suffix array are dropped.  ``first`` holds for each run the least rank among its suffixes, by
    sequence and then by place, and ``rank`` of a suffix is its place in the sequences in a row.
    """

    def __init__(self, sequences: list[np.ndarray], depth: int):
        lengths = np.array([len(s) for s in sequences], np.int64)
        self.depth, self.starts = depth, np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        words = np.concatenate([np.append(s, 0) for s in sequences]) if sequences else np.zeros(0, np.int64)
        separators = np.flatnonzero(words == 0)
        count = len(separators)
        codes = words + count
        codes[separators] = np.arange(count)[::-1]
        near = 1 << (depth.bit_length() - 1)  # two overlapping runs of this length make one of depth
        sa, rank = suffix_array(codes, near)
        self.n = n = len(words)
        bwt = words[sa - 1] if n else words
        self.sigma = int(words.max()) + 1 if n else 1
        self.below = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=self.sigma))])
        self.tree = WaveletMatrix(bwt, max(1, int(self.sigma - 1).bit_length()))
        # Neighbours of the suffix array that share their first depth words; shorter suffixes stand alone.
        same = np.zeros(n, bool)
        if n > 1:
            until = np.repeat(self.starts + lengths, lengths + 1) - np.arange(n)
            a, b = sa[1:], sa[:-1]
            alive = np.flatnonzero((until[a] >= depth) & (until[b] >= depth))
            for k in (0, depth - near):
                alive = alive[rank[a[alive] + k] == rank[b[alive] + k]]
            same[alive + 1] = True
        self.run = np.cumsum(~same, dtype=np.int32) - 1
        heads = np.flatnonzero(~same)
        self.edges = np.append(heads, n)
        self.first = np.minimum.reduceat(sa, heads) if n else np.zeros(0, np.int64)
        own = np.empty(n, np.int64)
        own[sa] = self.first[self.run] if n else 0
        self.own = [own[x : x + m] for x, m in zip(self.starts, lengths, strict=True)]

    def place(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, place in it) of ranks."""
        owner = np.searchsorted(self.starts, rank, "right") - 1
        return owner, rank - self.starts[owner]

    def extend(self, symbol: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: intervals of symbol followed by what the given intervals match."""
        known = symbol < self.sigma
        s = np.where(known, symbol, 0)
        both = self.tree.rank(np.concatenate([s, s]), np.concatenate([left, right]))
        low = self.below[s]
        a, b = low + both[: len(s)], low + both[len(s) :]
        return np.where(known, a, 0), np.where(known, b, 0)

    def intervals(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the rows of a matrix of word ids; empty where a row doesn't occur."""
        left, right = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            left, right = self.extend(patterns[:, k], left, right)
        return left, np.maximum(left, right)

    def matching_statistics(self, flat: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word of streamed texts in a row the length of the longest match that ends there, up to depth, and the run its suffix interval starts in.

        ``room`` says how many words of its own text end at each place.  All places are searched
        backwards at once, and each leaves when its interval is empty or depth is reached.
        """
        size, run = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        at = np.flatnonzero(room > 0) if self.n else np.zeros(0, np.int64)
        left, right = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64)
        for k in range(self.depth):
            a, b = self.extend(flat[at - k], left, right)
            found = b > a
            at, left, right = at[found], a[found], b[found]
            size[at] = k + 1
            run[at] = self.run[left]
            more = room[at] > k + 1
            at, left, right = at[more], left[more], right[more]
        return size, run
