"""The ratio of ``difflib.SequenceMatcher`` of two strings: the same number, without its search over all pairs.

The matcher takes the longest run of rare characters that both texts hold (the first in ``a``, then in ``b``), grows
it over equal neighbours and goes on left and right of it.  It finds each run by going over all pairs of equal rare
characters.  Here runs are found by length, longest first, in sorted tables of the runs of one length, so a text's
positions are looked at once for each length up to that of the run they begin, and memory grows with the texts.
"""

from __future__ import annotations

from bisect import bisect_left
from difflib import SequenceMatcher

import numpy as np

# Fixed by difflib: texts from which on frequent characters begin no match.
_LONG = 200
#: Characters of both texts up to which difflib itself is the shorter way.
SHORT = 200


def _grown(a: str, i: int, b: str, j: int, most: int) -> int:
    """Equal characters from i and j on, ``most`` at most."""
    n, step = 0, 16
    while n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n, step = n + step, step * 2
        elif step == 1:
            break
        else:
            step = (step + 1) // 2 if step > 1 else 1
            most = min(most, n + 2 * step)
    return n


def _grown_back(a: str, i: int, b: str, j: int, most: int) -> int:
    """Equal characters before i and j, ``most`` at most."""
    n = 0
    while n < most and a[i - n - 1] == b[j - n - 1]:
        n += 1
    return n


class _Runs:
    """Runs of rare characters of both texts: names of all runs of a length, equal for equal runs."""

    def __init__(self, a: str, b: str) -> None:
        x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in (a, b))
        top = int(y.max(initial=0)) + 1
        counts = np.bincount(y, minlength=top + 1)
        rare = (counts > 0) & (counts <= (len(b) // 100 + 1 if len(b) >= _LONG else len(b)))
        self.at_a, self.at_b = np.flatnonzero(rare[np.minimum(x, top)]), np.flatnonzero(rare[y])
        self.n_a, n = len(self.at_a), len(self.at_a) + len(self.at_b)
        first = np.unique(np.concatenate([x[self.at_a], y[self.at_b]]), return_inverse=True)[1].astype(np.int64)
        joined = np.zeros(n, dtype=bool)  # whether the next rare character is the next of the text
        joined[: max(self.n_a - 1, 0)] = np.diff(self.at_a) == 1
        joined[self.n_a : max(n - 1, self.n_a)] = np.diff(self.at_b) == 1
        ends = np.flatnonzero(~joined)
        self.run = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1
        self.names = [first]  # of runs of length 1, 2, 4, ...
        while self._shared(2 ** len(self.names)):
            k = 2 ** len(self.names)
            p = np.flatnonzero(self.run >= k)
            named = np.full(n, -1, dtype=np.int64)
            named[p] = np.unique(self._pairs(p, k), return_inverse=True)[1]
            self.names.append(named)

    def _pairs(self, p: np.ndarray, length: int) -> np.ndarray:
        """Names of the runs of a length at p, from those of the power of two below, which overlap."""
        half = min((length - 1).bit_length() - 1, len(self.names) - 1) if length > 1 else 0
        named = self.names[half]
        return named[p] * len(self.run) * 2 + named[p + length - 2**half] if length > 1 else named[p]

    def _shared(self, length: int) -> bool:
        p = np.flatnonzero(self.run >= length)
        k = np.searchsorted(p, self.n_a)
        if k == 0 or k == len(p):
            return False
        names = self._pairs(p, length)
        return bool(np.isin(names[:k], names[k:]).any())

    def longest(self) -> int:
        low, high = 1, 2 ** len(self.names)  # runs of ``low`` are shared, those of ``high`` are not
        if not self._shared(1):
            return 0
        low = high // 2
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self._shared(mid) else (low, mid)
        return low

    def table(self, length: int) -> tuple[list[int], list[int], list[int], list[int]]:
        """Places in a of runs that b holds; for each, from where to where its places stand in the last list."""
        p = np.flatnonzero(self.run >= length)
        k = np.searchsorted(p, self.n_a)
        names = self._pairs(p, length)
        order = np.argsort(names[k:], kind="stable")
        have = names[k:][order]
        low, high = np.searchsorted(have, names[:k]), np.searchsorted(have, names[:k], side="right")
        there = high > low
        return self.at_a[p[:k][there]].tolist(), low[there].tolist(), high[there].tolist(), self.at_b[p[k:][order] - self.n_a].tolist()


def matched(a: str, b: str) -> int:
    """Characters in the matcher's blocks."""
    if len(a) + len(b) <= SHORT:
        return sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
    runs = _Runs(a, b)
    total, areas = 0, [(0, len(a), 0, len(b))]
    for length in range(runs.longest(), 0, -1):
        places, low, high, there = runs.table(length)
        left = []
        for alo, ahi, blo, bhi in areas:
            k = bisect_left(places, alo)
            while k < len(places) and places[k] + length <= ahi and blo + length <= bhi:
                q = bisect_left(there, blo, low[k], high[k])
                if q == high[k] or there[q] + length > bhi:
                    k += 1
                    continue
                i, j = places[k], there[q]
                back = _grown_back(a, i, b, j, min(i - alo, j - blo))
                end = length + _grown(a, i + length, b, j + length, min(ahi - i, bhi - j) - length)
                total += back + end
                if alo < i - back and blo < j - back:
                    left.append((alo, i - back, blo, j - back))
                alo, blo = i + end, j + end
                k = bisect_left(places, alo, k)
            if alo < ahi and blo < bhi:
                left.append((alo, ahi, blo, bhi))
        areas = left
    # Where no rare character is shared, the matcher takes what both sides begin with.
    return total + sum(_grown(a, alo, b, blo, min(ahi - alo, bhi - blo)) for alo, ahi, blo, bhi in areas)


def ratio(a: str, b: str) -> float:
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0
