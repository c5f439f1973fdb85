"""Trigram search, the embedding cache, graph search by text, pages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sedge.functions import text as X
from sedge.functions.text import greek_analyzer
from sedge.operators import embedding, graph, paging, postings, retrieval, trigrams
from sedge.operators.store import Store

CHUNK = "id string, document_id string, content string, embedding array<float>, chunk_index int, metadata string, token_count int"


def grams_of(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def test_trigrams_against_a_scan(spark, tmp_path):
    rng = random.Random(4)
    words = ["ring", "spring", "string", "Stringer", "x", "ab", "RING-bolt", "écru", "100%", "a_b"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) for _ in range(120)]
    store = Store(spark, f"file://{tmp_path}/s", buckets=3, analyzer=trigrams.trigram_analyzer)
    rows = lambda some: spark.createDataFrame([(str(i), "d", texts[i], None, 0, None, 1) for i in some], CHUNK)
    store.insert(chunks=rows(range(70)))
    store.insert(chunks=rows(range(70, 120)))
    now = store.snapshot()
    for pattern in ("tring", "ING spr", "x", "g-b", "0%", "a_b", "", "nothing like it", "Écru"):
        assert sorted(int(r["id"]) for r in trigrams.containing(now, pattern).collect()) == [i for i, t in enumerate(texts) if pattern.lower() in t.lower()], pattern
    for text, least in (("spring string", 0.3), ("ring", 0.5), ("ab x", 0.05), ("écru ring", 1.0), ("--", 0.5)):
        want = {}
        for i, t in enumerate(texts):
            a, b = grams_of(t), grams_of(text)
            if b and a and len(a & b) / len(a | b) >= least:
                want[i] = round(len(a & b) / len(a | b), 9)
        assert {int(r["chunk_id"]): round(r["similarity"], 9) for r in trigrams.alike(now, text, least).collect()} == want, text
    with pytest.raises(ValueError):
        trigrams.alike(now, "ring", 0)


def test_a_second_run_calls_no_one(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def provider(texts):
        calls.add(len(texts))
        if "bad" in texts:
            raise RuntimeError("down")
        return [[float(len(t)), 1.0] for t in texts]

    path, config = f"file://{tmp_path}/cache", embedding.EmbeddingConfig("one", size=2, tries=1, batch=1)
    run = lambda texts, c=config, **o: {r["content"]: (r["embedding"], r["embedding_error"]) for r in embedding.embed_cached(spark.createDataFrame([(t,) for t in texts], "content string"), provider, path, c, **o).collect()}
    first = run(["a", "bb", "bb", None, "bad"])
    assert first["bb"] == ([2.0, 1.0], None) and first[None][0] == [0.0, 0.0] and first["bad"] == ([0.0, 0.0], "down")
    made = calls.value
    assert run(["a", "bb", "bb", None]) == {t: first[t] for t in ("a", "bb", None)} and calls.value == made
    run(["bad"])
    assert calls.value > made  # a failure is tried again
    made = calls.value
    run(["a", "ccc"])
    assert calls.value == made + 1
    run(["a"], embedding.EmbeddingConfig("two", size=2, tries=1, batch=1))
    assert calls.value == made + 2
    run(["a"], keep=1)  # the last folder is of the other model
    assert calls.value == made + 3 and len([f for f in (tmp_path / "cache").iterdir() if f.is_dir()]) == 2


def test_graph_search_by_text(spark):
    entities = spark.createDataFrame([("a", "A", "", [1.0, 0.0]), ("b", "B", "of b", [0.0, 1.0]), ("c", "C", "of c", [1.0, 0.0, 0.0])], "name_key string, name string, summary string, name_embedding array<float>")
    edges = spark.createDataFrame([("a", "b", "a knows b", "knows")], "src_key string, dst_key string, fact string, predicate string")
    provider = lambda texts: [[1.0, 0.1] if "a" in t else [0.0, 1.0] for t in texts]
    config = embedding.EmbeddingConfig("own", size=2, tries=1)
    assert [r["fact"] for r in retrieval.search_graph(entities, edges, "a", provider, config, 1).collect()] == ["a knows b"]
    assert [r["fact"] for r in retrieval.search_graph(entities, edges, "z", provider, config, 1).collect()] == ["B: of b"]

    def down(texts):
        raise RuntimeError("no model")

    told = []
    assert retrieval.or_nothing(lambda: retrieval.search_graph(entities, edges, "a", down, config), told.append) is None and told == ["no model"]
    assert retrieval.or_nothing(lambda: retrieval.search_graph(entities, edges, "a", provider, config)).count() == 2


def test_facts_as_rows(spark):
    entities = spark.createDataFrame([("a", "A")], "name_key string, name string")
    edges = spark.createDataFrame([("a", "b", "f", "p"), ("a", "b", "f", "p"), ("c", "a", "g", "q"), ("c", "d", "h", "q")], "src_key string, dst_key string, fact string, predicate string")
    assert sorted(map(tuple, graph.related_facts(entities, edges, " A ").collect())) == [("A", "in", "c", "q", "g"), ("A", "out", "b", "p", "f")]
    assert graph.related_facts(entities, edges, "b").count() == 0


def test_postings_of_another_analyzer(spark, tmp_path):
    """Greek texts, stemmed and without function words, by postings as by a scan."""
    rows = [("1", "d", "Οι άνθρωποι και η θάλασσα", None, 0, None, 1), ("2", "d", "ο άνθρωπος της θάλασσας, άνθρωπος", None, 1, None, 1), ("3", "e", None or "τίποτα", None, 0, None, 1)]
    store = Store(spark, f"file://{tmp_path}/s", analyzer=greek_analyzer)
    store.insert(chunks=spark.createDataFrame(rows, CHUNK))
    now = store.snapshot()
    for text in ("άνθρωπος", "θάλασσα ανθρώπων", "και"):
        found, rank = retrieval.text_scores(F.col("content"), text, greek_analyzer)
        want = {r["id"]: round(r["s"], 9) for r in now.read("chunks").where(found).select("id", rank.alias("s")).collect()}
        assert {r["chunk_id"]: round(r["score"], 9) for r in postings.search(now, text, analyzer=greek_analyzer).collect()} == want


def test_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paging, "RANGE", 4)
    rows = [(i * 7 % 500, i % 3, "x" if i % 5 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, `__page` int, `__n` string").repartition(5)
    pages = paging.Pages.write(df, f"file://{tmp_path}/p", F.col("__n").asc_nulls_first(), F.desc("id"), size=12)
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2], -r[0]))
    assert pages.count == 42 and pages.page(0).columns == df.columns
    for n in (0, 1, 20, 41, 42, 1000):
        assert [tuple(r) for r in pages.page(n).collect()] == order[12 * n : 12 * n + 12]
    whole = spark.read.parquet(f"file://{tmp_path}/p").inputFiles()
    assert len(pages.page(20).inputFiles()) == len(whole)  # before pruning
    plan = pages.page(20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(___range" in plan and "= 5)" in plan
    starts = {r["page"]: r["id"] for r in pages.starts().collect()}
    assert starts == {n: order[12 * n][0] for n in range(42)}
    none = paging.Pages.write(df.limit(0), f"file://{tmp_path}/none", F.col("id"))
    assert none.count == 0


def test_only_broken_texts_go_to_python(spark):
    df = spark.createDataFrame([("plain",), ("a \x0394 b",), (None,), ("---\nk: v\n---\nrest",), ("--- no",)], "t string")
    got = df.select(X.repair(F.col("t")).alias("r"), X.front_matter_of(F.col("t")).alias("f")).collect()
    assert [r["r"] for r in got] == ["plain", "a Δ b", None, "---\nk: v\n---\nrest", "--- no"]
    assert [r["f"] for r in got] == [None, None, None, '{"k": "v"}', None]
