"""Hard negatives against brute force in whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsmith.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90, scale=256):
    known = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(float(np.float32(x)) * scale) for x in v])
        known[i] = min(known.get(i, row), row)
    out = []
    for a, (label, v) in known.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in known.items()}
        first = sorted((-score[i], i) for i, (l, _) in known.items() if l == label and i != a)[:positives]
        for s, p in first:
            near = sorted((-score[i], i) for i, (l, _) in known.items() if l != label and low * -s <= 100 * score[i] <= high * -s)
            out += [(a, p, k, i, -s, -x) for k, (x, i) in enumerate(near[:negatives], 1)]
    return sorted(out)


def vectors(n, dims, size=1.0, seed=1):
    r = random.Random(seed)
    return [(i, [r.gauss(0, size) for _ in range(dims)], r.randrange(4)) for i in range(n)]


@pytest.mark.parametrize(("dims", "size"), [(3, 1.0), (64, 0.1), (64, 4000.0), (1_100, 0.5)])
def test_scores_are_exact(dims, size):
    a, b = (np.floor(np.random.default_rng(k).normal(0, size, (20, dims)) * 256) for k in (1, 2))
    bound = int(max((x * x).sum(1).max() for x in (a, b)))
    ps = hn.primes(dims, bound)
    assert math.prod(ps) > 2 * bound + 1 and all(min(dims, hn.SLICE) * ((p - 1) // 2) ** 2 <= 2**24 for p in ps)
    got = hn.scores([hn.centred(a, p) for p in ps], [hn.centred(b, p) for p in ps], ps)
    assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]


@pytest.mark.parametrize("block", [300, 7])
def test_equals_brute_force(spark, monkeypatch, block):
    rows = vectors(260, 8) + [(260, None, 1), (261, [1.0] * 8, None), (262, [1.0, float("nan")] * 4, 1), (263, [None] * 8, 1), (264, [float("inf")] * 8, 1), (None, [1.0] * 8, 2)]
    rows += [(265, [0.5] * 8, 1), (266, [0.5] * 8, 1), (267, [0.5] * 8, 2), (268, [0.5] * 8, 2), (270, [0.5] * 8, 3), (270, [0.5] * 8, 3), (270, [0.25] * 8, 3), (271, [2.0], 0), (272, [], 0)]
    monkeypatch.setattr(hn, "ANCHOR_ROWS", block)
    monkeypatch.setattr(hn, "ANCHOR_BYTES", block * (8 * 8 + 256))  # a block of anchors at a time
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "block", "score", "rank")})
    got = hn.hard_negatives(df, anchor_every=10)
    want = brute(rows, every=10)
    assert len(want) > 300 and sorted(map(tuple, got.collect())) == want


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hn.hard_negatives(none).count() == 0
    assert hn.hard_negatives(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], SCHEMA)).count() == 0  # no anchor
    alone = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1), (2, [], 1), (3, [0.5], 2)], SCHEMA)
    assert [tuple(r) for r in hn.hard_negatives(alone).collect()] == [(0, 1, 1, 3, 65536, 32768)]  # no window below a score of 0 but 0 itself
    with pytest.raises(ValueError, match="62 bits"):
        hn.hard_negatives(spark.createDataFrame([(0, [1e30], 1), (1, [1e30], 1)], SCHEMA))
