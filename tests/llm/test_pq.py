import math

import numpy as np
import pytest

from sedge.llm import pq
from sedge.llm.pq import near_vectors

VECTOR = "vec_id long, embedding array<float>, label int, rep long, n long, class string"


def brute(rows, cosine):
    good = []
    for i, v, label in rows:
        ok = label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(np.float32(x) != 0 for x in v)
        good.append(np.array(v, np.float32).astype(np.float64) if ok else None)
    n, up = [0] * len(rows), {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = good[a], good[b]
            if x is None or y is None or rows[a][2] != rows[b][2] or len(x) != len(y):
                continue
            if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine or (x == y).all():
                n[a] += 1
                n[b] += 1
                u, v = root(rows[a][0]), root(rows[b][0])
                up[max(u, v)] = min(u, v)
    return sorted((r[0], n[k], root(r[0]), root(r[0]) == r[0]) for k, r in enumerate(rows))


def vectors(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    rows, base = [], rng.normal(size=(n // 4, dim))
    for i in range(n):
        v = base[rng.integers(len(base))] + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.25])
        rows.append((i, [float(x) for x in v * rng.uniform(0.1, 9)], int(rng.integers(3))))
    centre = rng.normal(size=dim)
    rows += [(n + i, [float(x) for x in centre + rng.normal(size=dim) * 0.03], 1) for i in range(n // 3)]  # one close group of a third
    rows += [(2 * n + i, rows[5][1], rows[5][2]) for i in range(20)]  # copies
    return rows


@pytest.mark.parametrize("lists, block, most", [(1000, 4096, 2048), (25, 30, 2048), (25, 30, 4)])
def test_against_brute_force(spark, monkeypatch, lists, block, most):
    monkeypatch.setattr(pq, "MAX_LISTS", most)
    monkeypatch.setattr(pq, "LIST_SIZE", lists)
    monkeypatch.setattr(pq, "BLOCK", block)
    rows = vectors(lists, 400)
    df = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], VECTOR).repartition(3)
    got = sorted(map(tuple, near_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect()))
    want = brute(rows, 0.98)
    if lists == 1000:
        assert got == want
    else:
        links = sum(w[1] for w in want)
        assert links > 1000 and all(g[1] <= w[1] for g, w in zip(got, want)) and sum(g[1] for g in got) >= 0.9 * links


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [None, 1.0], 1), (8, [1.0, 0.0, 0.0], 1), (9, [1.0, 0.0], 2), (10, [float("inf"), 0.0], 1), (11, [], 1), (12, [1e30, 0.0], 1), (12, [1e30, 0.0], 1)]
    df = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], VECTOR)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[12] == (3, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], VECTOR)).count() == 0
    one = near_vectors(spark.createDataFrame([(None, [1.0], 1, 1, 1, "c"), (2, [1.0], 1, 1, 1, "c")], VECTOR)).collect()
    assert {(r["vec_id"], r["n_links"]) for r in one} == {(None, 1), (2, 1)}


def test_recall_of_random_links():
    """Links in random directions at the threshold itself are found from one side or the other."""
    rng = np.random.default_rng(0)
    x = pq._unit(rng.normal(size=(4000, 64)))
    side = rng.normal(size=(4000, 64))
    side = pq._unit(side - (side * x).sum(1)[:, None] * x)
    y = 0.9805 * x + math.sqrt(1 - 0.9805**2) * side
    model = pq.Quantizer(np.concatenate([x, y]), 64)
    own_x, own_y = (model.encode(v)[0] for v in (x, y))
    ask_x, ask_y = (model.probes(v, pq.PROBE_REACH) for v in (x, y))
    found = [b in p or a in q for a, b, p, q in zip(own_x, own_y, ask_x, ask_y)]
    assert np.mean(found) > 0.99


@pytest.mark.parametrize("most", [64, 8])
def test_clusters_on_the_border_of_cells(monkeypatch, most):
    """Pairs right between two centroids, on either side: all are found with the full reach, and nearly all with the default."""
    monkeypatch.setattr(pq, "MAX_LISTS", most)
    rng = np.random.default_rng(1)
    model = pq.Quantizer(pq._unit(rng.normal(size=(4000, 64))), 64)
    centres = np.stack([model.centre(k) for k in range(64)])
    a, b = rng.integers(64, size=(2, 2000))
    middle = pq._unit((centres[a] + centres[b]) / 2 + 1e-3 * rng.normal(size=(2000, 64)))
    side = rng.normal(size=(2000, 64))
    side = pq._unit(side - (side * middle).sum(1)[:, None] * middle)
    half = math.acos(0.981) / 2
    x, y = math.cos(half) * middle + math.sin(half) * side, math.cos(half) * middle - math.sin(half) * side
    assert ((x * y).sum(1) >= 0.98).all()
    own_x, own_y = model.encode(x)[0], model.encode(y)[0]
    for reach, least in ((0.2, 1.0), (pq.PROBE_REACH, 0.99)):
        found = [i in p or j in q for i, j, p, q in zip(own_x, own_y, model.probes(y, reach), model.probes(x, reach))]
        assert np.mean(found) >= least and (own_x != own_y).mean() > 0.1


def test_memory_does_not_grow_with_rows_times_lists():
    import tracemalloc

    rng = np.random.default_rng(2)
    x = pq._unit(rng.normal(size=(20_000, 64)))
    tracemalloc.start()
    model = pq.Quantizer(x, 2_000)
    model.encode(x[:10_000])
    model.probes(x[:2_000], 0.1)
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()


def test_doubles_are_not_rounded(spark):
    """Two vectors whose cosine is 0.98 or more in double, and below it once rounded to float; and the other way round."""
    rng = np.random.default_rng(3)
    rows = []
    while len(rows) < 8:
        x = rng.normal(size=4)
        side = rng.normal(size=4)
        side -= side @ x / (x @ x) * x
        c = 0.98 + rng.uniform(-3e-8, 3e-8)
        y = x / np.sqrt(x @ x) * c + side / np.sqrt(side @ side) * math.sqrt(1 - c * c)
        cos = lambda u, v: (u @ v) / (np.sqrt(u @ u) * np.sqrt(v @ v))
        one, two = cos(x, y) >= 0.98, cos(x.astype("f4").astype("f8"), y.astype("f4").astype("f8")) >= 0.98
        if one != two and abs(cos(x, y) - 0.98) > 1e-12:
            rows += [(len(rows), x.tolist(), len(rows)), (len(rows) + 1, y.tolist(), len(rows))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = [int(cos(np.array(rows[k // 2 * 2][1]), np.array(rows[k // 2 * 2 + 1][1])) >= 0.98) for k in range(8)]
    assert [r["n_links"] for r in near_vectors(df).orderBy("vec_id").collect()] == want
