import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.llm.negatives import Codebooks, hard_negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=5, least=80, most=100, scale=256):
    """(anchor, positive, rank, negative, scores) by scoring all pairs in whole numbers."""
    ready = []
    for n, (id, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            ready.append((n, id, [math.floor(scale * float(np.float32(x))) for x in v], label))
    first = lambda found, k: sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))[:k]
    out = []
    for n, id, q, label in ready:
        if id is None or id % 100:
            continue
        scored = [(sum(a * b for a, b in zip(q, v)), other, m, own) for m, other, v, own in ready if m != n and len(v) == len(q)]
        for ps, p, _, _ in first([s for s in scored if s[3] == label], positives):
            inside = [s for s in scored if s[3] != label and least * ps <= 100 * s[0] <= most * ps]
            out += [(id, p, rank, x, ps, s) for rank, (s, x, _, _) in enumerate(first(inside, negatives), 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def vectors(seed, n, dim, labels, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    x = centres[rng.integers(0, 4, n)] + spread * rng.normal(size=(n, dim))
    x /= np.sqrt((x * x).sum(1))[:, None]
    return [(i, [float(v) for v in x[i]], int(rng.integers(0, labels))) for i in range(n)]


@pytest.mark.parametrize(("dim", "spread", "rows", "asked"), [(64, 0.5, 8192, 4096), (64, 0.05, 100, 2), (5, 1.0, 64, 1), (1, 1.0, 50, 3)])
def test_against_all_pairs(spark, dim, spread, rows, asked):
    data = vectors(dim, 600, dim, 3, spread)
    found = hard_negatives(spark.createDataFrame(data, VECTORS).repartition(3), F.col("vec_id") % 100 == 0, rows=rows, asked=asked)
    assert got(found) == brute(data)


def test_odd_rows_ties_and_repeats(spark):
    rng = random.Random(4)
    data = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (100, [1.0, 0.5], 2), (200, None, 1), (300, [], 1), (400, [1.0, None], 1), (500, [float("nan"), 1.0], 1), (600, [float("inf"), 1.0], 1), (700, [1.0, 1.0], None),
            (None, [1.0, 0.5], 1), (None, [1.0, 0.5], 2), (800, [0.0, 0.0], 1), (900, [-1.0, -1.0], 2), (1000, [1.0, 2.0, 3.0], 1), (1001, [1.0, 2.0, 3.0], 1), (1002, [1.0, 2.0, 3.0], 2), (1100, [9.0], 5)]
    data += [(i, [rng.choice([0.5, 1.0]), rng.choice([0.25, 0.5])], rng.choice([1, 2])) for i in range(1, 60)]
    docs = spark.createDataFrame([(*r, "x", 7, 8, True) for r in data], VECTORS + ", id string, row long, score int, anchor boolean")
    assert got(hard_negatives(docs, F.col("vec_id") % 100 == 0)) == brute(data)
    assert hard_negatives(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).collect() == []
    huge = spark.createDataFrame([(0, [3e38, 1.0], 1), (1, [3e38, 1.0], 1), (2, [3e38, 1.0], 2)], VECTORS)
    assert hard_negatives(huge, F.col("vec_id") % 100 == 0).collect() == []


def test_bounds_hold():
    """True scores never differ from the tables' by more than the product of the lengths."""
    x = np.floor(256 * np.array([v for _, v, _ in vectors(1, 3000, 64, 1, 0.8)]))
    model = Codebooks(x[:500])
    codes, rest = model.encode(x)
    off = np.abs(model.scores(x[:40], codes) - x[:40] @ x.T)
    bound = np.sqrt((x[:40] ** 2).sum(1))[:, None] * rest[None]
    assert (off <= bound + 1e-6).all() and np.median(bound) < 0.1 * 256 * 256


def test_doubles_and_other_parameters(spark):
    data = vectors(7, 300, 8, 4, 0.7)
    docs = spark.createDataFrame([(i, v, str(label)) for i, v, label in data], "vec_id long, embedding array<double>, label string")
    as_float = [(i, [float(np.float64(x)) for x in v], label) for i, v, label in data]
    found = hard_negatives(docs, F.col("vec_id") % 100 == 0, positives=2, negatives=3, least=50, most=90, scale=1000)
    expected = []
    ints = [(i, [math.floor(1000 * x) for x in v], label) for i, v, label in as_float]
    for id, q, label in ints:
        if id % 100:
            continue
        scored = [(sum(a * b for a, b in zip(q, v)), other, own) for other, v, own in ints if other != id]
        for ps, p, _ in sorted([s for s in scored if s[2] == label], key=lambda s: (-s[0], s[1]))[:2]:
            inside = sorted([s for s in scored if s[2] != label and 50 * ps <= 100 * s[0] <= 90 * ps], key=lambda s: (-s[0], s[1]))[:3]
            expected += [(id, p, r, x, ps, s) for r, (s, x, _) in enumerate(inside, 1)]
    assert got(found) == sorted(expected, key=repr)
