"""Per-worker table of rows computed once for every distinct word, and n-gram hashes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

# Parameter: words kept before the table starts anew.
ROWS_KEPT = 500_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (wraps around)."""
    values = (values ^ (values >> _SHIFT)) * _MIX
    return values ^ (values >> _SHIFT)


def ngram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """``[n - 1][i]``: hash of the n codes that end at i (for i < n - 1 of those that exist)."""
    codes = codes.astype(np.uint64) + np.uint64(1)
    levels = [mix(codes)]
    for n in range(2, order + 1):
        before = np.concatenate([[np.uint64(n)], levels[-1][:-1]])
        levels.append(mix(before * _MIX + codes + np.uint64(n)))
    return levels


class WordRows:
    """Rows of ``compute(words)`` (an array with one row per word) for words seen so far."""

    def __init__(self, compute: Callable[[list], np.ndarray], limit: int = ROWS_KEPT):
        self.compute, self.limit = compute, limit
        self.place: dict = {}
        self.rows: np.ndarray | None = None

    def look(self, words: list) -> np.ndarray:
        """Indexes into ``rows`` of the words of a batch; earlier indexes are void afterwards."""
        if len(self.place) > self.limit:
            self.place, self.rows = {}, None
        place = self.place
        new = list(set(words).difference(place))
        if new or self.rows is None:
            fresh = self.compute(new)
            start = len(place)
            if self.rows is None:
                self.rows = fresh
            else:
                if start + len(new) > len(self.rows):
                    size = max(2 * len(self.rows), start + len(new))
                    grown = np.empty((size, *self.rows.shape[1:]), self.rows.dtype)
                    grown[:start] = self.rows[:start]
                    self.rows = grown
                self.rows[start:start + len(new)] = fresh
            place.update(zip(new, range(start, start + len(new))))
        return np.fromiter(map(place.__getitem__, words), np.int64, len(words))


def sums_by_text(values: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Sum of consecutive rows of ``values``, ``sizes[i]`` of them for text i (0 for none)."""
    ends = np.cumsum(sizes)
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[ends] - total[ends - np.asarray(sizes)]
