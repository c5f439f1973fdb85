import random
import re
import time
from collections import Counter, defaultdict

import pytest

from sedge.llm import mixing
from sedge.llm.mixing import mix_rows, mix_sources, targets


def water_fill(sizes, weights, share, cap):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, free = {}, share * sum(sizes.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if sizes[s] * cap <= weight[s] * level}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = sizes[s] * cap
            left -= out[s]
        free -= over
    return out


def corpus(seed=1, n=600):
    rng = random.Random(seed)
    sources = ["hot"] * 5 + ["a", "é", "b", "Z", None, "tiny"]
    return [(i, None if i % 50 == 0 else "w " * (1 + int(rng.paretovariate(1.2)) % 400), sources[rng.randrange(len(sources))] if i > 2 else "tiny") for i in range(n)]


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("fan", [8, 64])
def test_mix(spark, documents, monkeypatch, fan):
    monkeypatch.setattr(mixing, "FAN", fan)
    rows = corpus()
    got = mix_sources(documents(rows)).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = water_fill(sizes, (3, 1, 2), 1.5, 2)
    own = {i: (size(t), s) for i, t, s in rows}
    taken = defaultdict(int)
    assert sorted(r["doc_id"] for r in got) == sorted(own)
    for r in got:
        n, s = own[r["doc_id"]]
        assert r["size"] == n and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] == r["copies"] * n and 0 <= r["taken"] <= 2 * n
        if sizes[s]:
            assert r["copies"] in (int(want[s] / sizes[s]), int(want[s] / sizes[s]) + 1)
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max([400, *(own[i][0] for i in own if own[i][1] == s)])
    again = mix_sources(documents(rows[::-1]).repartition(3)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_expectation_is_kept(spark, documents):
    """Over many seeds a document is taken as often as its source's rate says."""
    rows = [(i, "w " * (1 + i % 7), "a" if i < 20 else "b") for i in range(40)]
    seen, rates = Counter(), {}
    for seed in range(40):
        for r in mix_sources(documents(rows), seed=seed * 100).collect():
            seen[r["doc_id"]] += r["copies"]
            rates[r["doc_id"]] = r["target"] / r["source_size"]
    mean = sum(seen[i] / 40 - rates[i] for i in rates) / len(rates)
    assert abs(mean) < 0.05 and all(abs(seen[i] / 40 - rates[i]) < 0.4 for i in rates)


def test_targets_of_many_sources(spark):
    rng = random.Random(2)
    sizes = {f"s{i}": rng.randrange(0, 1000) for i in range(500)} | {None: 10**6}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "_source string, source_size long")
    got = {r["_source"]: r["target"] for r in targets(df).collect()}
    want = water_fill(sizes, (3, 1, 2), 1.5, 2)
    assert got == pytest.approx(want)


def test_edges(spark, documents):
    assert mix_sources(documents([])).count() == 0 and mix_rows(documents([])).count() == 0
    empty = mix_sources(documents([(1, None, "a"), (2, "", None)])).collect()
    assert {(r["doc_id"], r["size"], r["taken"]) for r in empty} == {(1, 0, 0), (2, 0, 0)}
    same = mix_sources(documents([(7, "a b", "s")] * 5 + [(None, "a", "s")] * 5)).collect()
    assert len(same) == 10 and {r["size"] for r in same} == {1, 2}


@pytest.mark.parametrize("alike", [4096, 7])
def test_rows_are_repeated(spark, documents, monkeypatch, alike):
    rows = corpus(3, 200) + [(5, "w w", "a")] * 3 + [(5, "w w", None)] * 2 + [(None, "w w w", "b")] * 40 + [(None, f"{i} w w", "b") for i in range(9)]
    monkeypatch.setattr(mixing, "ALIKE", alike)
    decided = Counter()
    for r in mix_sources(documents(rows)).collect():
        decided[r["doc_id"], r["size"]] += r["copies"]
    made = mix_rows(documents(rows))
    assert made.columns == documents(rows).columns
    counted = Counter((r["doc_id"], size(r["text"])) for r in made.select("doc_id", "text").collect())
    assert counted == Counter({k: v for k, v in decided.items() if v})


@pytest.mark.parametrize("id", ["NULL", "id"])
def test_one_source_of_many_alike_rows(spark, id):
    """A million rows of one source and size, all of null id or each of its own."""
    docs = spark.range(0, 1_000_000, 1, 8).selectExpr(f"cast({id} AS long) AS doc_id", "'hot' AS source", "'w w' AS text").union(spark.sql("SELECT 1L, 'b', repeat('w ', 1000)"))
    began = time.perf_counter()
    got = mix_sources(docs).groupBy("size").agg({"taken": "sum", "target": "max", "*": "count"}).collect()
    found = {r["size"]: (r["sum(taken)"], r["max(target)"], r["count(1)"]) for r in got}
    assert found[2][2] == 1_000_000 and abs(found[2][0] - found[2][1]) <= 2 and time.perf_counter() - began < 90


def test_no_python_in_any_plan(spark, documents, monkeypatch):
    """Also not in what is written on the way."""
    plans = []
    write = mixing.cut
    told = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(mixing, "cut", lambda df, label: told(df) or write(df, label))
    told(mix_sources(documents(corpus(1, 60))))
    told(mix_rows(documents(corpus(1, 60))))
    assert len(plans) > 8 and not [p for p in plans for word in ("Python", "Arrow", "Pandas", "PythonRDD") if word in p]


def test_columns_named_like_the_operators_own(spark):
    """Every row comes back as it was, whatever its columns are called."""
    names = ["__id", "__source", "__size", "__n", "__ups", "__whole", "__copies", "__copy", "__part", "__rows", "___id", "__Arrival", "__arrival2"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(i, "a b c d", f"s{i % 3}", *[f"{n} {i}" for n in names]) for i in range(40)] + [(7, "a b c d", "s1", *["x"] * len(names))] * 600
    out = mix_rows(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "source", *names]
    assert {tuple(r) for r in out.collect()} <= set(rows) and out.where("`__id` LIKE '__id %'").count() > 0
