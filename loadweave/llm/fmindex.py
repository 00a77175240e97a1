"""FM-index of a sequence of small integers, as numpy arrays.

The suffixes of the sequence are sorted; of them only the Burrows-Wheeler
transform is kept, in a wavelet tree (matrix layout) that answers rank queries,
and every ``SAMPLE``-th suffix position. Searches and locations work on many
patterns at once.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in sorted order, by prefix doubling.

    Each round only reorders suffixes that still share their rank with others.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    head = np.concatenate(([True], text[order][1:] != text[order][:-1])) if n else np.empty(0, bool)
    slot = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, slot, 0))
    open_ = np.flatnonzero(~(head & np.append(head[1:], True)))
    reach = 1
    while len(open_):
        at = order[open_]
        ahead = at + reach
        follow = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        group = rank[at]
        sort = np.lexsort((follow, group))
        at, follow, group = at[sort], follow[sort], group[sort]
        order[open_] = at
        head = np.concatenate(
            ([True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1]))
        )
        rank[at] = open_[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        open_ = open_[~(head & np.append(head[1:], True))]
        reach *= 2
    return order


class FMIndex:
    """Index of a sequence of integers from 0 on."""

    def __init__(self, text: np.ndarray):
        # 0 ends the text and sorts first; every symbol moves up by one
        text = np.append(np.asarray(text, np.int64) + 1, 0)
        self.n = len(text)
        order = suffix_array(text)
        last = text[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text))))
        self.levels = []
        for bit in reversed(range(max(1, int(text.max()).bit_length()))):
            ones = last >> bit & 1
            count = np.concatenate(([0], np.cumsum(ones))).astype(np.int32)
            self.levels.append((bit, count, self.n - int(count[-1])))
            last = np.concatenate((last[ones == 0], last[ones == 1]))
        sampled = order % SAMPLE == 0
        self.samples = order[sampled]
        self.sampled = np.concatenate(([0], np.cumsum(sampled)))

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        low = np.zeros_like(row)
        for bit, count, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            row = np.where(one, zeros + count[row], row - count[row])
            low = np.where(one, zeros + count[low], low - count[low])
        return row - low

    def step_back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one place earlier."""
        low, symbol, at = np.zeros_like(row), np.zeros_like(row), row
        for _, count, zeros in self.levels:
            one = count[at + 1] > count[at]
            symbol = symbol << 1 | one
            at = np.where(one, zeros + count[at], at - count[at])
            low = np.where(one, zeros + count[low], low - count[low])
        return self.before[symbol] + at - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of patterns of one length, one per row of the matrix.

        Returns the numbers of the patterns found and their row intervals.
        """
        found = np.arange(len(patterns))
        symbols = np.asarray(patterns, np.int64) + 1
        known = (symbols < len(self.before) - 1).all(axis=1)
        found, symbols = found[known], symbols[known]
        low, high = np.zeros(len(found), np.int64), np.full(len(found), self.n, np.int64)
        for column in reversed(range(symbols.shape[1])):
            symbol = symbols[:, column]
            low = self.before[symbol] + self.rank(symbol, low)
            high = self.before[symbol] + self.rank(symbol, high)
            left = low < high
            found, symbols, low, high = found[left], symbols[left], low[left], high[left]
        return found, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of rows: step back to a sampled one, add the steps."""
        place = np.empty(len(rows), np.int64)
        walking, at, steps = np.arange(len(rows)), rows, 0
        while len(walking):
            known = self.sampled[at + 1] > self.sampled[at]
            place[walking[known]] = self.samples[self.sampled[at[known]]] + steps
            walking, at = walking[~known], self.step_back(at[~known])
            steps += 1
        return place
