"""FM-index of one shard of a word sequence, in NumPy."""

from __future__ import annotations

import numpy as np

#: Every so many places of a run, the suffix position is kept.
SAMPLED = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes; symbol 0 ends a run, and ends are ordered by place, so no comparison goes past one."""
    n = len(symbols)
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + ends.sum())
    order, step = np.argsort(rank, kind="stable"), 1
    rank = _ranks(rank, order)
    while rank.max(initial=-1) < n - 1:
        next_rank = np.zeros(n, np.int64)
        next_rank[:-step] = rank[step:] + 1
        key = rank * (n + 1) + next_rank
        order = np.argsort(key, kind="stable")
        rank = _ranks(key, order)
        step *= 2
    return order


def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    rank = np.empty(len(key), np.int64)
    new = key[order][1:] != key[order][:-1]
    rank[order] = np.concatenate([[0], np.cumsum(new)]) if len(key) else 0
    return rank


class FMIndex:
    """Of runs of symbols 1, 2, ..., each run followed by a 0."""

    def __init__(self, symbols: np.ndarray) -> None:
        order = suffix_array(symbols)
        before = np.where(order > 0, symbols[order - 1], 0)
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        # Rows that start with a smaller symbol.
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=(1 << self.levels) + 1))])
        # Sampled suffix positions: run starts too, so that no walk crosses a run's end.
        sampled = (order % SAMPLED == 0) | (before == 0)
        self.kept_before = np.concatenate([[0], np.cumsum(sampled)])
        self.positions = order[sampled]
        # Wavelet matrix of the symbols before the ordered suffixes: for each bit, counts of ones.
        self.ones, self.zeros = [], []
        level = before
        for bit in range(self.levels - 1, -1, -1):
            ones = (level >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.int32))
            self.zeros.append(int(len(level) - ones.sum()))
            level = np.concatenate([level[ones == 0], level[ones == 1]])

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the suffixes above each row."""
        low = np.zeros_like(row)
        for bit, ones, zeros in zip(range(self.levels - 1, -1, -1), self.ones, self.zeros, strict=True):
            one = ((symbol >> bit) & 1).astype(bool)
            a, b = ones[low], ones[row]
            low, row = np.where(one, zeros + a, low - a), np.where(one, zeros + b, row - b)
        return row - low

    def symbol(self, row: np.ndarray) -> np.ndarray:
        """The symbol before each row's suffix."""
        out = np.zeros_like(row)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            before = ones[row]
            one = ones[row + 1] - before
            out = out * 2 + one
            row = np.where(one == 1, zeros + before, row - before)
        return out

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all phrases (rows of symbols, the first `lengths` of each count; 0 never matches), from the last symbol back."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.kept_before.size - 1, np.int64)
        top = (1 << self.levels) - 1
        for i in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((i < lengths) & (lo < hi))
            c = phrases[live, i]
            fits = (c > 0) & (c <= top)
            hi[live[~fits]] = lo[live[~fits]]
            live, c = live[fits], c[fits]
            start = self.first[c]
            lo[live], hi[live] = start + self.rank(c, lo[live]), start + self.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the rows' suffixes: back in the text to the next sampled one."""
        row, steps, place = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = row[open_]
            kept = self.kept_before[at + 1] > self.kept_before[at]
            done = open_[kept]
            place[done] = self.positions[self.kept_before[row[done]]] + steps[done]
            open_ = open_[~kept]
            c = self.symbol(row[open_])
            row[open_] = self.first[c] + self.rank(c, row[open_])
            steps[open_] += 1
        return place
