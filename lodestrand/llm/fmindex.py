"""FM-index over integer sequences: suffix order, Burrows-Wheeler transform, wavelet-tree ranks, sampled positions."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols in a sequence of ints below 2**bits, one bit vector with prefix counts a level."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        now = seq
        for b in range(bits - 1, -1, -1):
            bit = (now >> b) & 1
            ones = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(len(now) - int(ones[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        lo, hi = np.zeros_like(at), at
        for ones, zeros, b in zip(self.levels, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            one = ((symbol >> b) & 1).astype(bool)
            lo1, hi1 = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + lo1, lo - lo1), np.where(one, zeros + hi1, hi - hi1)
        return hi - lo


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of seq in order. Each 0 ends a segment: zeros differ from one
    another and rank by position, so that no comparison goes past the end of a segment."""
    n = len(seq)
    ends = np.flatnonzero(seq == 0)
    rank = seq.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        key = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if n else key
        if n < 2 or new[order[-1]] == n - 1:
            return order
        nxt = np.full(n, 0, np.int64)
        nxt[: n - step] = new[step:] + 1
        # Once a symbol is the only one of its rank it stays so; the pair is then decided by the first part.
        rank = new * (n + 1) + nxt
        order = np.argsort(rank, kind="stable")
        step *= 2


class FMIndex:
    """Index of segments, each of symbols from 1 to sigma, for exact search of whole phrases."""

    def __init__(self, segments: np.ndarray, sigma: int, sample: int = 16):
        """segments: the symbols, every segment followed by a 0."""
        self.n, self.sample = len(segments), sample
        order = suffix_order(segments)
        self.bwt = segments[order - 1] if self.n else segments
        self.first = np.zeros(sigma + 2, np.int64)
        np.cumsum(np.bincount(segments, minlength=sigma + 1), out=self.first[1:])
        self.tree = WaveletMatrix(self.bwt, max(1, int(sigma).bit_length()))
        # A walk to the left never leaves its segment, as every segment start is sampled too.
        starts = np.concatenate([[True], segments[:-1] == 0]) if self.n else np.zeros(0, bool)
        sampled = starts | (np.arange(self.n) % sample == 0)
        self.marked = sampled[order]
        self.slot = np.cumsum(self.marked) - 1
        self.position = order[self.marked]

    def search(self, symbols: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range [lo, hi) of suffixes that begin with each phrase, which is so long a piece of symbols from its start on."""
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), self.n, np.int64)
        for back in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > back) & (lo < hi))
            if not len(live):
                break
            c = symbols[start[live] + lengths[live] - 1 - back]
            lo[live] = self.first[c] + self.tree.rank(c, lo[live])
            hi[live] = self.first[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the segments of the given suffixes, by steps to the left up to a sampled one."""
        at, steps = rows.astype(np.int64), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.marked[at])
        while len(live):
            c = self.bwt[at[live]]
            at[live] = self.first[c] + self.tree.rank(c, at[live])
            steps[live] += 1
            live = live[~self.marked[at[live]]]
        return self.position[self.slot[at]] + steps
