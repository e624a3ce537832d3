"""Ranks and deviations of frames against plain loops."""

import math
import time

import numpy as np
import pytest

from barsmith.functions import ranks


def series(n, kind, seed=1):
    r = np.random.default_rng(seed)
    x = {"normal": r.normal(1_000, 3, n), "ties": r.integers(0, 4, n).astype(float), "flat": np.full(n, 7.3), "steps": np.repeat(r.normal(0, 1, n // 20 + 1), 20)[:n]}[kind]
    if kind == "normal":
        x[r.random(n) < 0.02] = np.nan
    return x


@pytest.mark.parametrize("kind", ["normal", "ties", "flat", "steps"])
@pytest.mark.parametrize("n", [1, 2, 14, 50, 299, 300, 301])
def test_frames_equal_loops(kind, n):
    x = series(300, kind)
    deviation, low = ranks.mean_deviation(x, n), ranks.below_quantile(x, n)
    for i in range(len(x)):
        w = x[max(0, i - n + 1) : i + 1]
        if len(w) < n or np.isnan(w).any():
            assert np.isnan(deviation[i]) and np.isnan(low[i])
            continue
        want = math.fsum(abs(v - math.fsum(w) / n) for v in w) / n
        assert math.isclose(deviation[i], want, rel_tol=1e-12, abs_tol=1e-12) and (deviation[i] == 0) == (len(set(w)) == 1)
        assert low[i] == (np.sum(w <= x[i]) <= math.ceil(round(0.2 * (n - 1), 9)))


def test_nothing_to_rank():
    for x in (np.zeros(0), np.full(5, np.nan), np.ones(3)):
        assert np.isnan(ranks.mean_deviation(x, 4)).all() and len(ranks.below_quantile(x, 4)) == len(x)


def test_the_cost_does_not_grow_with_the_frame():
    x = np.random.default_rng(2).normal(0, 1, 40_000)
    took = {}
    for n in (20, 500):
        for f in (ranks.mean_deviation, ranks.below_quantile):
            best = math.inf
            for _ in range(3):
                began = time.process_time()
                f(x, n)
                best = min(best, time.process_time() - began)
            took[n] = took.get(n, 0) + best
    assert took[500] < 2 * took[20], took
