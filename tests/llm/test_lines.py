import random
from collections import defaultdict

import pytest

from sedge.llm.lines import dedup_lines, spread_lines

SPACES = " \t\n\x0b\x0c\r"


def brute(rows, least):
    sites, first = defaultdict(set), {}
    for i, text, site in rows:
        for line in (text or "").split("\n"):
            if k := line.strip(SPACES):
                sites[k].add(site)
                if i is not None:
                    first[k] = min(first.get(k, i), i)
    gone = lambda i, line: (k := line.strip(SPACES)) and len(sites[k]) >= least and (k not in first or first[k] != i)
    out = []
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if not gone(i, x)]
        out.append((i, text if len(left) == len(lines) else "\n".join(left), sum(bool(x.strip(SPACES)) for x in lines), len(lines) - len(left)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [3, 10])
def test_against_brute_force(spark, documents, least):
    rng = random.Random(least)
    pool = [f"line {k}" for k in range(60)]
    rows = []
    for i in range(300):
        lines = [rng.choice(["", " ", "\t"]) + pool[min(59, int(rng.expovariate(0.05)))] + rng.choice(["", " ", "\r"]) if rng.random() < 0.7 else rng.choice(["", " ", f"own {i} {rng.random()}"]) for _ in range(rng.randrange(12))]
        rows.append((i, "\n".join(lines), rng.choice([None, *"abcdefghijkl"])))
    rows += [(500, None, "a"), (501, "", "b"), (None, "line 0\nline 1", "zz"), rows[0], rows[0], (502, "line 0\n" * 30000, "c")]
    df = dedup_lines(documents(rows), least)
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in df.collect()), key=str) == brute(rows, least)
    assert df.columns == [*(c for c in documents(rows).columns if c != "n_lines"), "n_lines", "n_removed"]


def test_lines_without_an_id_lose_all(spark, documents):
    rows = [(None, "shared", s) for s in "abc"]
    assert [r["n_removed"] for r in dedup_lines(documents(rows), 3).collect()] == [1, 1, 1]


def test_lists_too_long_to_broadcast(spark, documents, monkeypatch):
    rows = [(i, f"shared line\nown {i}\nshared too", f"s{i % 12}") for i in range(60)] + [(None, None, None), (3, "shared line", "s1"), (3, "shared line", "s1")]
    small = dedup_lines(documents(rows))
    monkeypatch.setattr("sedge.llm.lines.LIST_BYTES", 0)
    merged = dedup_lines(documents(rows))
    told = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, small.collect())) == sorted(map(str, merged.collect())) and "BroadcastHashJoin" in told(small) and "SortMergeJoin" in told(merged)


def test_near_the_threshold_counts_are_exact(spark):
    rows = [(k, 0, site, k * 1000 + site) for k in range(95, 106) for site in range(k)] + [(1, 1, s % 5, s) for s in range(400)]
    lines = spark.createDataFrame(rows, "a long, b long, site long, id long")
    assert sorted(r["a"] for r in spread_lines(lines, 100, lg_k=8).collect()) == list(range(100, 106))


def test_empty(spark, documents):
    assert dedup_lines(documents([])).count() == 0


def test_columns_named_like_the_operators_own_stay(spark):
    names = ["__id", "__row", "__gone", "___id", "a", "b"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(i, "shared line\nown " + str(i), f"s{i}", *[f"{n} {i}" for n in names]) for i in range(12)]
    out = dedup_lines(spark.createDataFrame(rows, schema)).orderBy("doc_id").collect()
    assert [tuple(r)[3 : 3 + len(names)] for r in out] == [r[3:] for r in rows]
    assert [r["n_removed"] for r in out] == [0] + [1] * 11
