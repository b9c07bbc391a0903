"""Merging of pairs in matrices of symbols: one row for each word, all words of a power-of-two width at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

NO_RANK = np.int32(2**31 - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FREE = np.uint64(2**64 - 1)


class PairMerges:
    """Which symbol a pair of symbols becomes, in an open-addressing hash table.

    A smaller symbol merges first, or one of a smaller level where levels are given (one for each
    symbol); of equal ones the leftmost pair does.
    """

    def __init__(self, left: list[int], right: list[int], merged: list[int], levels: np.ndarray | None = None):
        self.levels = None if levels is None else np.append(levels.astype(np.int32), NO_RANK)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.slot_key = np.full(1 << self.bits, _FREE)
        self.slot_rank = np.full(1 << self.bits, NO_RANK)
        values, at = np.array(merged, np.int32), self._home(keys)
        while len(keys):
            free = self.slot_key[at] == _FREE
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.slot_key[at[put]], self.slot_rank[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair becomes, NO_RANK where it is none; -1 pads."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(len(left), NO_RANK)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left[open_].astype(np.uint64) << np.uint64(32)) | right[open_].astype(np.uint64)
        at = self._home(keys)
        while len(open_):
            seen = self.slot_key[at]
            hit = seen == keys
            out[open_[hit]] = self.slot_rank[at[hit]]
            on = ~hit & (seen != _FREE)
            open_, keys, at = open_[on], keys[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)

    def merge(self, flat: np.ndarray, lens: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words of at most width (two or more) symbols, one after another in flat.

        Each round merges every row's leftmost pair of least rank; rows without a pair leave.
        Yields (words, their new lengths, their new symbols one after another).
        """
        ids = np.full((len(lens), width), -1, np.int32)
        row = np.repeat(np.arange(len(lens)), lens)
        ids[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
        ranks = self.ranks(ids[:, :-1], ids[:, 1:])
        alive = np.arange(len(lens))
        while True:
            order = ranks if self.levels is None else self.levels[np.minimum(ranks, len(self.levels) - 1)]
            at = order.argmin(axis=1)  # the first of equal minima
            best = ranks[np.arange(len(alive)), at]
            done = best == NO_RANK
            if done.any():
                ended = ids[done]
                yield alive[done], (ended >= 0).sum(axis=1), ended[ended >= 0]
                alive, ids, ranks, at, best = alive[~done], ids[~done], ranks[~done], at[~done], best[~done]
            if not len(alive):
                return
            n, w = ids.shape
            rows, columns = np.arange(n), np.arange(w - 1)[None, :]
            ids[rows, at] = best
            # close the gap at at + 1
            shifted = np.take_along_axis(ids, columns + (columns > at[:, None]), 1)
            moved = np.take_along_axis(ranks, np.minimum(columns[:, :-1] + (columns[:, :-1] > at[:, None]), w - 2), 1) if w > 2 else ranks[:, :0]
            if w == 2:
                yield alive, np.ones(len(alive), np.int64), shifted[:, 0]
                return
            ids, ranks = shifted, moved
            last = ids.shape[1] - 2
            right = at <= last
            ranks[rows[right], at[right]] = self.ranks(ids[rows[right], at[right]], ids[rows[right], at[right] + 1])
            left = at > 0
            ranks[rows[left], at[left] - 1] = self.ranks(ids[rows[left], at[left] - 1], ids[rows[left], at[left]])
