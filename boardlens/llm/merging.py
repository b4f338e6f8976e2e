"""Rank-synchronous merging of symbol sequences: byte-pair encoding of many short sequences at once in numpy."""

from __future__ import annotations

import numpy as np

from boardlens.llm.hashing import Lookup, chunks

NONE = np.iinfo(np.int64).max
#: Sequences of so many symbols together are merged at a time: their arrays stay in the processor's cache.
TOGETHER = 1 << 16


class RankMerger:
    """Merges by rank: (left, right) -> merged. Lower ranks merge first, and of equal ranks the leftmost.

    Sequences lie in one ragged array. In each round every sequence that still has a mergeable pair applies its
    lowest-rank pair, all sequences at the same time: at all places that do not overlap if no pair with the new symbol
    ranks lower, else at the leftmost place only, so the result is that of merging one pair at a time.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, rank: np.ndarray):
        left, right, merged, rank = (np.asarray(x, np.int64) for x in (left, right, merged, rank))
        self.pairs = Lookup((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64), np.arange(len(left)))
        self.merged, self.rank = np.append(merged, -1), np.append(rank, NONE)
        own = np.full(int(max(merged.max(initial=0), left.max(initial=0), right.max(initial=0))) + 1, -1, np.int64)
        np.maximum.at(own, merged, rank)
        risky = np.zeros(len(own), bool)
        for side in (left, right):
            risky[side[rank < own[side]]] = True
        self.risky = risky

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.pairs((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64), -1)

    def __call__(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence k is symbols[bounds[k]:bounds[k + 1]]. Returns the merged (symbols, bounds)."""
        parts = [self._merge(symbols[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]) for i, j in chunks(bounds, TOGETHER)]
        sizes = np.concatenate([np.diff(b) for _, b in parts]) if parts else np.zeros(0, np.int64)
        return np.concatenate([s for s, _ in parts]) if parts else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(sizes)])

    def _merge(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(bounds) - 1
        done: list[tuple[np.ndarray, np.ndarray]] = []
        sym, seq = symbols.astype(np.int64), np.repeat(np.arange(n), np.diff(bounds))
        pair = self._pairs_of(sym, seq)
        while len(sym):
            rank = self.rank[pair]
            head = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            least = np.minimum.reduceat(rank, head)
            size = np.diff(np.append(head, len(sym)))
            ended = np.repeat(least == NONE, size)
            if ended.any():
                done.append((sym[ended], seq[ended]))
                go = ~ended
                sym, seq, pair, rank = sym[go], seq[go], pair[go], rank[go]
                least, size = least[least != NONE], size[least != NONE]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            # Places of one run take turns; the first of a sequence starts a run. Equal ranks with other symbols
            # can't be neighbours of another sequence, as a pair never crosses two sequences.
            run = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (seq[at[1:]] != seq[at[:-1]])])
            begin = np.flatnonzero(run)
            order = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
            first = np.concatenate([[True], seq[at[1:]] != seq[at[:-1]]])
            at = at[(order % 2 == 0) & (first | ~self.risky[self.merged[pair[at]]])]
            sym[at] = self.merged[pair[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            sym, seq, pair = sym[stay], seq[stay], pair[stay]
            now = place[at]
            for i in (now, now[now > 0] - 1):
                pair[i] = -1
                i = i[i + 1 < len(sym)]
                i = i[seq[i] == seq[i + 1]]
                pair[i] = self._pair(sym[i], sym[i + 1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        sym, seq = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])
        order = np.argsort(seq, kind="stable")
        return sym[order], np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n))])

    def _pairs_of(self, sym: np.ndarray, seq: np.ndarray) -> np.ndarray:
        pair = np.full(len(sym), -1, np.int64)
        i = np.flatnonzero(seq[1:] == seq[:-1])
        pair[i] = self._pair(sym[i], sym[i + 1])
        return pair
