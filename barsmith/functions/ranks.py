"""How many of the last n values lie below a bound, and their sum, for every place of a series at once.

A wavelet matrix holds the ranks of the values bit by bit: at each bit, values with a 0 move stably before those with a 1, and
running counts and sums of the zeros tell where any stretch of the series goes on. A question takes one step for each bit,
and all places ask together, so the cost is n log n whatever the frame.
"""

from __future__ import annotations

import numpy as np


class Ranked:
    """Values without NaN; sums are kept in extended precision."""

    def __init__(self, x: np.ndarray):
        self.x, self.order = x, np.sort(x)
        self.bits = max(1, int(len(x)).bit_length())
        rank = np.searchsorted(self.order, x)  # equal values share the least place
        value = x.astype(np.longdouble)
        self.levels = []
        for b in range(self.bits - 1, -1, -1):
            zero = (rank >> b & 1) == 0
            count = np.concatenate([[0], np.cumsum(zero)])
            self.levels.append((b, count, np.concatenate([[0], np.cumsum(np.where(zero, value, 0))])))
            moved = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
            rank, value = rank[moved], value[moved]

    def below(self, bound: np.ndarray, n: int, equal: bool) -> tuple[np.ndarray, np.ndarray]:
        """For the place i = n - 1 and each after it: the number and the sum of the last n values that are below
        ``bound[i - n + 1]``, or, with ``equal``, not above it."""
        q = np.searchsorted(self.order, bound, "right" if equal else "left")
        low = np.arange(len(self.x) - n + 1)
        high = low + n
        number, total = np.zeros(len(low), np.int64), np.zeros(len(low), np.longdouble)
        for b, count, sums in self.levels:
            one = (q >> b & 1) == 1  # all zeros of the stretch are below
            number += np.where(one, count[high] - count[low], 0)
            total += np.where(one, sums[high] - sums[low], 0)
            zeros = count[-1]
            low, high = (np.where(one, zeros + at - count[at], count[at]) for at in (low, high))
        return number, total


def framed(x: np.ndarray, n: int, work) -> np.ndarray:
    """work(values, places) at the places whose last n values are all there, NaN elsewhere; ``work`` gets the series with
    missing values put at its mean, and is asked for all places from n - 1 on."""
    out = np.full(len(x), np.nan)
    missing = np.isnan(x)
    if len(x) < n or missing.all():
        return out
    there = np.convolve(missing, np.ones(n, np.int64), "valid") == 0
    filled = np.where(missing, x[~missing].mean(), x)
    out[n - 1 :] = np.where(there, work(filled), np.nan)
    return out


def mean_deviation(x: np.ndarray, n: int) -> np.ndarray:
    """Mean distance of the last n values from their mean; NaN unless all are there."""

    def work(v: np.ndarray) -> np.ndarray:
        v = v - v[0]  # small numbers keep their digits in sums
        held = np.concatenate([[0], np.cumsum(v.astype(np.longdouble))])
        total = held[n:] - held[:-n]
        mean = (total / n).astype(np.float64)
        number, below = Ranked(v).below(mean, n, True)
        spread = (mean.astype(np.longdouble) * (2 * number - n) - 2 * below + total) / n
        same = np.concatenate([[0], np.cumsum(v[1:] != v[:-1])])  # numbers the runs of equal values
        return np.where(same[n - 1 :] == same[: len(v) - n + 1], 0.0, spread.astype(np.float64))

    return framed(x, n, work)


def below_quantile(x: np.ndarray, n: int, share: float = 0.2) -> np.ndarray:
    """1 where a value lies below the interpolated quantile of the last n values, else 0; NaN unless all are there.

    It does exactly if no more values than the quantile's place, rounded up, are as low as it is."""
    most = np.ceil(round(share * (n - 1), 9))
    return framed(x, n, lambda v: (Ranked(v).below(v[n - 1 :], n, True)[0] <= most).astype(np.float64))
