import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.operators import consolidate, embedding, graph, retrieval, sessions
from sedge.operators.components import components
from sedge.functions.text import greek_analyzer
from sedge.operators.store import ENTITIES, Store
from sedge.plans import queries
from sedge.plans.ingest import IngestConfig, document_results, ingest_folder, rollup, run_ingest
from sedge.runtime import numbered
from sedge.sources.files import as_documents, text_files
from sedge.streaming.ingest import ingest_stream, stream_texts

CHUNKS = "id long, document_id long, content string, embedding array<float>, chunk_index int, metadata string, token_count int"
DOCUMENTS = "id long, title string, source string, content string, metadata string, created_at timestamp, updated_at timestamp"


def forest(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(80)]
    pairs += [(7, 7), (1, 2), (2, 1), (1, 2)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = {k: v for k, v in forest(pairs).items() if any(k in p for p in pairs if p[0] != p[1])}
    assert got == want


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_vector_topk_plan_and_ties(spark):
    rows = [(i, i, f"c{i}", [1.0, 0.0] if i < 3 else None if i == 3 else [0.0, 0.0], 0, "{}", 1) for i in range(6)]
    docs = spark.createDataFrame([(i, f"t{i}", "s", "c", "{}", None, None) for i in range(6)], DOCUMENTS)
    hits = retrieval.vector_topk(spark.createDataFrame(rows, CHUNKS), docs, [1.0, 0.0], 4)
    assert "TakeOrderedAndProject" in hits._jdf.queryExecution().executedPlan().toString()
    assert [(r["chunk_id"], r["similarity"]) for r in hits.collect()] == [(0, 1.0), (1, 1.0), (2, 1.0), (4, 0.0)]


@pytest.mark.parametrize("limit, ok", [(0, False), (1, True), (50, True), (51, False)])
def test_limits(limit, ok):
    if ok:
        assert retrieval.checked_limit(limit) == limit
    else:
        with pytest.raises(ValueError):
            retrieval.checked_limit(limit)


def test_hybrid_equals_the_outer_join(spark):
    rows = [(1, 1, "alpha beta", [1.0, 0.0], 0, "{}", 1), (2, 2, "alpha alpha", None, 0, "{}", 1), (3, 3, "gamma", [0.0, 1.0], 0, "{}", 1), (4, 4, "gamma", None, 0, "{}", 1)]
    docs = spark.createDataFrame([(i, f"t{i}", "s", "c", "{}", None, None) for i in range(1, 5)], DOCUMENTS)
    got = {r["chunk_id"]: (r["vector_similarity"], r["text_similarity"], r["combined_score"]) for r in retrieval.hybrid_topk(spark.createDataFrame(rows, CHUNKS), docs, [1.0, 0.0], "Alpha").collect()}
    assert set(got) == {1, 2, 3}
    assert got[1] == pytest.approx((1.0, 0.1, 0.73)) and got[2] == pytest.approx((0.0, 0.2, 0.06)) and got[3] == pytest.approx((0.0, 0.0, 0.0))
    two = retrieval.hybrid_topk(spark.createDataFrame(rows, CHUNKS), docs, [1.0, 0.0], "alpha beta").collect()
    assert {r["chunk_id"]: r["text_similarity"] for r in two}[1] == pytest.approx(0.1)


def test_unknown_documents(spark):
    docs, chunks = spark.createDataFrame([(1, "t", "s", "c", "{}", None, None)], DOCUMENTS), spark.createDataFrame([], CHUNKS)
    assert retrieval.get_document(docs, chunks, 9).count() == 0 and retrieval.document_chunks(chunks, 9).count() == 0
    assert retrieval.get_document(docs, chunks, 1).first()["chunks"] == []
    summary = retrieval.document_summaries(docs, chunks).first()
    assert (summary["chunk_count"], summary["avg_tokens_per_chunk"], summary["total_tokens"]) == (0, None, None)


def test_extraction():
    reply = '```json\n{"entities": [{"name": " \x0394 ", "summary": null}, {"name": ""}], "relationships": [{"subject": "a", "predicate": "p", "object": "b"}]}\n```'
    assert graph.parse_reply(reply) == {"entities": [{"name": "Δ", "type": "other", "summary": ""}], "relationships": [{"subject": "a", "predicate": "p", "object": "b", "fact": ""}]}
    assert graph.parse_reply("nothing") == {"entities": [], "relationships": []}


def test_extraction_column_agrees(spark):
    names = [f"n{i}" for i in range(5)]
    full = '{"entities": [%s], "relationships": [{"subject": "n0", "object": "n1", "predicate": "p", "fact": "f"}, {"subject": "n0", "object": "n4", "predicate": "p", "fact": "g"}]}' % ",".join(f'{{"name": "{n}"}}' for n in names)
    replies = [full, "```\n{\"entities\": []}\n```", "no", None, '{"entities": [{"name": " \x0394 "}]}']
    rows = graph.parse_replies(spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string"), most=2).orderBy("i").collect()
    for r, reply in zip(rows, replies):
        want = graph.parse_reply(reply, 2)
        assert [e.asDict() for e in r["entities"]] == want["entities"] and [x.asDict() for x in r["relationships"]] == want["relationships"]
    assert [x["fact"] for x in rows[0]["relationships"]] == ["f"]


def test_failed_chunks_are_recorded(spark):
    def extractor(text):
        if text == "bad":
            raise RuntimeError("down")
        return "{}"

    rows = graph.extract(spark.createDataFrame([(1, "good"), (2, "bad")], "i int, content string"), extractor).collect()
    assert {r["i"]: r["error"] for r in rows} == {1: None, 2: "down"}


def test_upsert_keeps_the_first_and_the_first_summary(spark):
    kind = "ord long, pos long, name_key string, name string, type string, summary string, source_doc string, created_at timestamp"
    first = graph.upsert_entities(None, spark.createDataFrame([(2, 0, "a", "A2", "x", "late", "d", None), (1, 5, "a", "A1", "y", "", "c", None)], kind))
    row = first.first()
    assert (row["name"], row["type"], row["summary"], row["source_doc"]) == ("A1", "y", "late", "c")
    again = graph.upsert_entities(first, spark.createDataFrame([(0, 0, "a", "A0", "z", "new", "b", None), (0, 1, "b", "B", "z", "", "b", None)], kind))
    assert {r["name_key"]: (r["name"], r["summary"]) for r in again.collect()} == {"a": ("A1", "late"), "b": ("B", "")}


def test_graph_search_falls_back_on_summaries(spark):
    nodes = spark.createDataFrame([("a", "A", "about a", [1.0, 0.0]), ("b", "B", "", [0.9, 0.1]), ("c", "C", "about c", [0.8, 0.1])], "name_key string, name string, summary string, name_embedding array<float>")
    edges = spark.createDataFrame([("a", "b", "", "p"), ("a", "c", "fact", "p")], "src_key string, dst_key string, fact string, predicate string")
    got = sorted((r["fact"], r["is_summary"]) for r in graph.graph_search(nodes, edges, [1.0, 0.0]).collect())
    assert got == [("C: about c", True), ("fact", False)]


def test_reachable(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("a", "a")], "src_key string, dst_key string")
    assert {r["key"]: r["depth"] for r in graph.reachable(edges, "A", 2).collect()} == {"a": 0, "b": 1, "c": 2}


@pytest.mark.parametrize("seed", range(3))
def test_grouping_by_component_equals_grouping_at_once(spark, seed):
    rng = random.Random(seed)
    n = 60
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(70)})
    linked = {}
    for a, b in pairs:
        linked.setdefault(a, set()).add(b)
    want = consolidate.greedy_leaders(list(range(n)), linked, 3)
    frames = spark.range(n).select(F.col("id").alias("ord")), spark.createDataFrame(pairs, "a long, b long")
    assert {r["ord"]: r["leader"] for r in consolidate.group_entities(*frames, most=3).collect()} == want


def grouped_as_at_once(spark, pairs, nodes, **options):
    linked = {}
    for a, b in pairs:
        linked.setdefault(min(a, b), set()).add(max(a, b))
    frames = spark.range(nodes).select(F.col("id").alias("ord")), spark.createDataFrame(pairs, "a long, b long")
    got = {r["ord"]: r["leader"] for r in consolidate.group_entities(*frames, **options).collect()}
    return got == consolidate.greedy_leaders(list(range(nodes)), linked, options.get("most", 20))


@pytest.mark.parametrize("seed", range(3))
def test_groups_over_many_ranges(spark, seed, monkeypatch):
    monkeypatch.setattr(consolidate, "SHOWN", 4)
    rng = random.Random(seed)
    pairs = [tuple(rng.sample(range(120), 2)) for _ in range(400)]
    assert grouped_as_at_once(spark, pairs + pairs[:9], 130, most=rng.choice([2, 4, 20]), links=40)


def test_groups_of_a_chain_and_a_hub(spark):
    """The orders that wait longest: each node for the one before it, and all for one that takes few of them."""
    chain = [(i, i + 1) for i in range(200)]
    assert grouped_as_at_once(spark, chain, 201, links=60)
    hub = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1, 300)] + [(i, 300) for i in range(300)]
    assert grouped_as_at_once(spark, hub, 301, links=200)
    assert grouped_as_at_once(spark, [(5, 5), (7, 3)], 9)


def test_no_task_of_grouping_holds_a_component(spark, monkeypatch):
    """One component of 6,000 links: no range has more than it was given."""
    rng, seen, settle = random.Random(3), [], consolidate._settle
    pairs = sorted({tuple(sorted(rng.sample(range(3000), 2))) for _ in range(6000)})
    cut = consolidate.cut
    monkeypatch.setattr(consolidate, "cut", lambda df, label: (lambda out: (seen.append(max((r["count"] for r in out.groupBy("range").count().collect()), default=0)) if label == "ranged" else None, out)[1])(cut(df, label)))
    assert settle and grouped_as_at_once(spark, pairs, 3000, links=1000)
    assert max(seen) < 2500 and len(seen) < 12


def test_pairs_in_blocks(spark):
    rng = random.Random(5)
    vectors = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(50)] + [[0.0] * 3, None, [1.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "ord long, name_embedding array<float>")
    whole = sorted((r["a"], r["b"]) for r in consolidate.similar_pairs(df, 0.8).collect())
    assert whole and whole == sorted((r["a"], r["b"]) for r in consolidate.similar_pairs(df, 0.8, block=7).collect())


@pytest.mark.parametrize("threshold", [0.3, 0.85, 0.999])
def test_pairs_by_lists_equal_those_of_all_blocks(spark, threshold, monkeypatch):
    monkeypatch.setattr("sedge.operators.lists.LIST_SIZE", 20)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(15, 16))
    vector = lambda: [float(x) for x in centres[rng.integers(15)] + 0.3 * rng.normal(size=16)]
    rows = [(i, vector(), vector() if i % 3 else None) for i in range(400)]
    rows += [(400, [0.0] * 16, None), (401, None, rows[1][2]), (402, [1.0, float("nan")], rows[1][2]), (403, [1.0, 2.0], None), (404, [2.0, 4.0], None), (405, rows[0][1], None), (406, [], None)]
    df = spark.createDataFrame(rows, "ord long, name_embedding array<float>, summary_embedding array<float>")
    pairs = lambda **o: {(r["a"], r["b"]): round(r["name_similarity"], 6) for r in consolidate.similar_pairs(df, threshold, **o).collect() if r["name_similarity"] == r["name_similarity"]}
    whole = pairs(pruned=False)
    assert whole and (403, 404) in whole and (0, 405) in whole
    assert pairs(pruned=True) == whole == pairs(pruned=True, block=16)


def test_a_vector_is_copied_once_for_each_part_it_asks(spark, monkeypatch):
    """Of vectors that lie evenly, each asks nearly all lists: what is shuffled grows with the parts, not with the lists; a list of many copies has parts of its own."""
    monkeypatch.setattr("sedge.operators.lists.LIST_SIZE", 10)
    rng, met = np.random.default_rng(2), []
    x = rng.normal(size=(1200, 24))
    x[:300] = x[0] + 0.01 * rng.normal(size=(300, 24))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.astype(np.float32).tolist())], "ord long, name_embedding array<float>")
    group_by = type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *c: (met.append(self.count()) if c in (("i", "j"), ("cell", "i", "j")) else None, group_by(self, *c))[1])
    got = {(r["a"], r["b"]) for r in consolidate.similar_pairs(df, 0.85, block=16).collect()}
    u = x.astype(np.float32).astype(np.float64)
    u /= np.sqrt((u * u).sum(1))[:, None]
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(u @ u.T >= 0.85, 1)))} and len(got) >= 300 * 299 // 2
    assert len(met) == 1 and met[0] <= 1200 * 16


def test_lists_that_are_far_apart_do_not_meet(spark):
    """Rows that are shuffled grow with the vectors, not with their square: no cluster asks another's list."""
    from sedge.operators.lists import Lists

    rng = np.random.default_rng(1)
    centres = np.eye(32)[:30]
    x = centres[rng.integers(0, 30, 3000)] + 0.05 * rng.normal(size=(3000, 32)) / np.sqrt(32)
    x /= np.sqrt((x * x).sum(1))[:, None]
    lists = Lists(centres)
    own, angle = lists.nearest(x)
    lists = lists.with_radii({i: float(angle[own == i].max()) for i in range(30)})
    assert sum(len(a) for a in lists.meeting(x, own, 0.85)) == 0


def test_rewire(spark):
    edge = "src_key string, dst_key string, fact string"
    entities = spark.createDataFrame([("a", "s"), ("b", ""), ("c", "")], "name_key string, summary string")
    edges = spark.createDataFrame([("c", "b", "f"), ("c", "b", "f"), ("c", "a", "f"), ("c", "a", "f"), ("b", "a", None), ("c", "c", "g")], edge)
    canonical = spark.createDataFrame([(0, "a", ["b"], "merged")], "leader long, canonical_key string, duplicate_keys array<string>, summary string")
    left, links = consolidate.rewire(entities, edges, canonical)
    assert sorted(map(tuple, left.collect())) == [("a", "merged"), ("c", "")]
    assert sorted(map(str, map(tuple, links.collect()))) == sorted(map(str, [("c", "a", "f"), ("c", "a", "f"), ("a", "a", None), ("c", "c", "g")]))


def test_a_session_created_at_this_moment_is_found(spark):
    now = F.expr("timestamp '2024-01-01 12:00:00'")
    asked = spark.createDataFrame([("x", "u", None), ("y", "u", None), (None, "u", None)], "id string, user_id string, metadata string")
    kept = sessions.new_sessions(asked.where("id = 'x'"), now)
    got = sessions.get_or_create(kept, asked, now).collect()
    assert sorted((str(r["id"]), r["found"]) for r in got) == [("None", False), ("x", True), ("y", False)]


def test_sessions(spark):
    now = F.expr("timestamp '2024-01-01 12:00:00'")
    asked = spark.createDataFrame([("x", "u", None)], "id string, user_id string, metadata string")
    fresh = sessions.new_sessions(asked, now, 30)
    row = fresh.first()
    assert row["metadata"] == "{}" and (row["expires_at"] - row["created_at"]).seconds == 1800
    later = F.expr("timestamp '2024-01-01 12:30:00'")
    assert sessions.active_sessions(fresh, now).count() == 1 and sessions.active_sessions(fresh, later).count() == 0
    change = spark.createDataFrame([("x", '{"a": 1}')], "id string, change string")
    assert [r["changed"] for r in sessions.merge_metadata(fresh, change, later).collect()] == [False]
    assert [(r["changed"], r["metadata"]) for r in sessions.merge_metadata(fresh, change, now).collect()] == [(True, '{"a":1}')]


def test_tool_calls(spark):
    runs = [("r", '[{"parts": [{"part_kind": "text"}, {"part_kind": "tool-call", "tool_name": "f", "args": "{\\"q\\": 1}", "tool_call_id": "1"}]}, {}]'), ("s", "broken"), ("t", None), ("u", '[{"parts": [{"part_kind": "tool-call", "args": "[1]", "tool_call_id": ""}]}]')]
    got = [(r["run_id"], r["tool_name"], r["args"], r["tool_call_id"]) for r in sessions.tool_calls(spark.createDataFrame(runs, "run_id string, messages string")).orderBy("run_id").collect()]
    assert got == [("r", "f", '{"q": 1}', "1"), ("u", "unknown", "{}", None)]


def test_embedding_retries():
    config, waits = embedding.EmbeddingConfig("other", tries=3, delay=1.0), []
    calls = []

    def limited(texts):
        calls.append(texts)
        if len(calls) < 3:
            raise embedding.RateLimited
        return [[1.0] * config.dimension for _ in texts]

    assert embedding.embed_batch(["a", " "], limited, config, waits.append)[1][0] == [0.0] * config.dimension
    assert waits == [1.0, 2.0]

    def picky(texts):
        if len(texts) > 1 or texts == ["bad"]:
            raise ValueError("no")
        return [[2.0]]

    found = embedding.embed_batch(["good", "bad"], picky, config, waits.append)
    assert found[0] == ([2.0], None) and found[1] == ([0.0] * config.dimension, "no")

    def always(texts):
        raise embedding.RateLimited

    with pytest.raises(embedding.RateLimited):
        embedding.embed_batch(["a"], always, config, waits.append)


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    docs = spark.sql("SELECT 'd1' AS id, 't' AS title, 's' AS source, 'c' AS content UNION ALL SELECT 'd2', 't', 's', 'c'")
    chunks = spark.sql("SELECT 'c1' AS id, 'd1' AS document_id, 'x' AS content, 0 AS chunk_index UNION ALL SELECT 'c2', 'd2', 'x', 0")
    store.insert(documents=docs, chunks=chunks)
    assert store.read("documents").count() == 2 and store.read("chunks").first()["metadata"] == "{}"
    store.upsert_documents(docs, chunks)
    assert store.read("documents").count() == 2 and store.read("chunks").count() == 2
    store.delete("documents", spark.sql("SELECT 'd1' AS id"))
    assert [r["id"] for r in store.read("chunks").collect()] == ["c2"]
    with pytest.raises(Exception, match="is null"):
        store.insert(messages=spark.sql("SELECT 'm' AS id"))
    assert store.read("messages").count() == 0
    store.clear()
    assert store.read("documents").count() == 0


def test_files_to_graph(spark, tmp_path):
    folder = tmp_path / "docs" / "sub"
    folder.mkdir(parents=True)
    (tmp_path / "docs" / "a.md").write_bytes("---\nyear: 2020\nline_count: 99\n---\n# Title A\r\nSome text here.\r\n".encode())
    (folder / "b.txt").write_bytes(b"caf\xe9 text")
    (folder / "c.bin").write_bytes(b"no")
    docs = as_documents(text_files(spark, f"file://{tmp_path}/docs"))
    rows = {r["source"]: r for r in docs.collect()}
    assert set(rows) == {"a.md", "sub/b.txt"} and rows["a.md"]["title"] == "Title A" and rows["sub/b.txt"]["content"] == "café text"
    assert '"year":2020' in rows["a.md"]["metadata"] and '"line_count":7' in rows["a.md"]["metadata"]
    extractor = lambda text: '{"entities": [{"name": "X"}, {"name": "Y"}], "relationships": [{"subject": "X", "predicate": "p", "object": "Y", "fact": "f"}]}'
    out = run_ingest(docs, embedding.hashing_provider(768), extractor, IngestConfig())
    assert out["entities"].count() == 2 and out["edges"].count() == 2 and out["chunks"].count() == 2
    total = rollup(document_results(docs, out["chunks"], out["episodes"])).first()
    assert (total["documents"], total["chunks_created"], total["relationships_created"], total["errors"]) == (2, 2, 2, 0)


def test_streamed_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("one. " * 50)
    store = Store(spark, f"file://{tmp_path}/store")
    for more in ("b.txt", "c.txt"):
        (folder / more).write_text("two. " * 50)
        ingest_stream(stream_texts(spark, f"file://{folder}"), store, f"file://{tmp_path}/check").awaitTermination(60)
    assert store.read("documents").count() == 3 and store.read("chunks").count() == 3


def test_sessions_end(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    from sedge.streaming.ingest import ended_sessions

    def put(name, rows):
        spark.createDataFrame(rows, "session_id string, at string").select("session_id", F.to_timestamp("at").alias("created_at")).coalesce(1).write.parquet(f"{source}/{name}")

    put("a", [("s", "2024-01-01 00:00:00"), ("s", "2024-01-01 00:05:00")])
    put("b", [("t", "2024-01-01 03:00:00")])
    stream = spark.readStream.schema("session_id string, created_at timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(source)).withWatermark("created_at", "1 minute")
    q = ended_sessions(stream, 60).writeStream.format("memory").queryName("ended").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    until = time.time() + 60
    while time.time() < until and not spark.sql("SELECT * FROM ended").count():
        q.processAllAvailable()
        time.sleep(0.5)
    q.stop()
    assert [(r["session_id"], r["messages"]) for r in spark.sql("SELECT * FROM ended").collect()] == [("s", 2)]


def test_a_single_text_joins_the_graph(spark):
    from sedge.plans.ingest import add_text, episode_names

    entities = spark.createDataFrame([("x", "X0", "t", "old", None, "d", None)], "name_key string, name string, type string, summary string, name_embedding array<float>, source_doc string, created_at timestamp")
    edges = spark.createDataFrame([], "src_key string, dst_key string, fact string, predicate string, source_doc string, chunk_id string, created_at timestamp")
    extractor = lambda text: '{"entities": [{"name": "X", "summary": "new"}], "relationships": [{"subject": "X", "predicate": "p", "object": "Y", "fact": "f"}]}'
    nodes, links = add_text("text", "s", extractor, entities, edges, "2024-01-01 00:00:00")
    assert {r["name_key"]: (r["name"], r["summary"]) for r in nodes.collect()} == {"x": ("X0", "old"), "y": ("Y", "")}
    assert [(r["src_key"], r["dst_key"], r["source_doc"]) for r in links.collect()] == [("x", "y", "s")]
    chunks = spark.createDataFrame([("1", 2)], "document_id string, chunk_index int")
    docs = spark.createDataFrame([("1", "T", "a/b.md")], "id string, title string, source string")
    assert tuple(episode_names(chunks, docs).first()) == ("1", 2, "a/b.md_2", "Document: T (Chunk: 2)")


def test_topk_of_more_queries_than_a_block_holds(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 7)
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(60, 3)).astype("f4"), rng.normal(size=(50, 3)).astype("f4")
    chunks = spark.createDataFrame([(i, 0, "", v.tolist(), 0, "{}", 0) for i, v in enumerate(x)] + [(99, 0, "", None, 0, "{}", 0)], CHUNKS)
    queries = spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(q)] + [(2000, None)], "query_id long, embedding array<float>").repartition(3)
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in retrieval.vector_topk_batch(chunks, queries, 4).collect()}
    unit = lambda m: m.astype("f8") / np.linalg.norm(m.astype("f8"), axis=1)[:, None]
    best = np.argsort(-unit(q) @ unit(x).T, axis=1)[:, :4]
    assert got == {(1000 + i, k + 1): int(c) for i, row in enumerate(best) for k, c in enumerate(row)}


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, order", [("vector_topk", ("similarity", "chunk_id")), ("hybrid_topk", ("combined_score", "chunk_id")), ("hybrid_terms", ("combined_score", "chunk_id")), ("vector_search_text", ("score", "chunk_id")), ("list_documents", ("created_at", "id"))])
def test_results_come_in_order(spark, name, order):
    rows = queries.QUERIES[name](spark, SF).collect()
    first, then = order
    assert len(rows) > 5 and rows == sorted(sorted(rows, key=lambda r: r[then]), key=lambda r: r[first], reverse=True)


def _chunks(spark):
    rows = [(1, 1, "alpha beta", [1.0, 0.0], 0, "{}", 1), (2, 2, "beta gamma", [-1.0, 0.0], 0, "{}", 1), (3, 3, "alpha", [1.0, 1.0, 1.0], 0, "{}", 1), (4, 4, "alpha beta alpha", None, 0, "{}", 1)]
    return spark.createDataFrame(rows, CHUNKS), spark.createDataFrame([(i, f"t{i}", "s", "c", "{}", None, None) for i in range(1, 5)], DOCUMENTS)


def test_search_by_text(spark):
    chunks, docs = _chunks(spark)
    config, provider = embedding.EmbeddingConfig("own", size=2), lambda texts: [[1.0, 0.0] for _ in texts]
    hits = retrieval.search_vector(chunks, docs, "alpha", provider, config)
    assert [(r["chunk_id"], r["score"]) for r in hits.collect()] == [(1, 1.0), (2, 0.0)]  # held to 0, and a vector of another model is none
    both = retrieval.search_hybrid(chunks, docs, "alpha beta", provider, config, 4, 0.5)
    assert [r["chunk_id"] for r in both.collect()] == [1, 4, 2]
    for bad in (0, 51):
        with pytest.raises(ValueError):
            retrieval.search_vector(chunks, docs, "alpha", provider, config, bad)
    with pytest.raises(ValueError):
        retrieval.search_hybrid(chunks, docs, "alpha", provider, config, 5, 1.5)
    with pytest.raises(RuntimeError):
        retrieval.query_vector("alpha", lambda texts: 1 / 0, embedding.EmbeddingConfig(tries=1))


def test_an_analyzer_may_split_and_drop(spark):
    chunks, docs = _chunks(spark)
    halves = lambda words: F.flatten(F.transform(words, lambda w: F.array(F.substring(w, 1, 2), F.substring(w, 3, 9))))
    rows = retrieval.hybrid_topk(chunks, docs, [1.0, 0.0], "alpha", analyzer=halves).collect()
    assert all(r["combined_score"] is not None for r in rows) and {r["chunk_id"] for r in rows if r["text_similarity"] > 0} == {1, 3, 4}
    greek = spark.createDataFrame([("Οι δρόμοι της πόλης και ο δρόμος",)], "t string").select(queries.X.tokens(F.col("t"), greek_analyzer).alias("x")).first()["x"]
    assert greek == ["δρομ", "πολ", "δρομ"]


def test_one_failing_search_leaves_the_other(spark):
    chunks, docs = _chunks(spark)
    good = lambda: retrieval.vector_topk(chunks, docs, [1.0, 0.0], 2)
    bad = lambda: chunks.select(F.raise_error(F.lit("no graph")).cast("string").alias("uuid"), F.lit("f").alias("fact"))
    rows = retrieval.comprehensive_search(good, bad).collect()
    assert [(r["leg"], r["id"], r["total_results"]) for r in rows] == [("vector", "1", 2), ("vector", "3", 2), ("graph", None, 2)] and "no graph" in rows[2]["error"]
    assert {r["leg"] for r in retrieval.comprehensive_search(good, None).collect()} == {"vector"}
    with pytest.raises(ValueError):
        retrieval.comprehensive_search(None, None)


@pytest.mark.parametrize("model, size, chars", [("text-embedding-3-small", 1536, 32764), ("text-embedding-3-large", 3072, 32764), ("text-embedding-ada-002", 1536, 32764), ("nomic-embed-text-v2-moe:latest", 768, 2048), ("another", 1536, 32764)])
def test_models(model, size, chars):
    config, seen = embedding.EmbeddingConfig(model), []
    embedding.embed_batch(["x" * 100_000], lambda texts: seen.extend(texts) or [[0.0]], config)
    assert (config.dimension, len(seen[0])) == (size, chars)
    assert embedding.EmbeddingConfig().model == "nomic-embed-text-v2-moe:latest"


def test_of_two_writers_none_is_lost(spark, tmp_path):
    one, two = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    row = lambda i: spark.sql(f"SELECT 'd{i}' AS id, 't' AS title, 's' AS source, 'c' AS content")
    publish, turns = one._publish, []

    def late(base, pointer):
        if not turns:  # the other writer gets in between
            turns.append(1)
            two.insert(documents=row(2))
        return publish(base, pointer)

    one._publish = late
    one.insert(documents=row(1))
    assert sorted(r["id"] for r in one.read("documents").collect()) == ["d1", "d2"] and one.versions() == [1, 2]
    assert len(list((tmp_path / "s" / "documents").iterdir())) == 2  # what lost is removed
    one.insert(entities=spark.createDataFrame([("k", "K", None, None, None, None, None)], ENTITIES.replace(" not null", "")))
    one.clear_graph()
    assert one.read("entities").count() == 0 and one.read("documents").count() == 2


def test_folder_to_store_to_consolidated_graph(spark, tmp_path):
    assert text_files(spark, f"file://{tmp_path}/nowhere").count() == 0
    folder = tmp_path / "docs"
    folder.mkdir()
    for name, who in (("b.md", "Ada Byron"), ("a.txt", "Ada Lovelace"), ("c.txt", "Else")):
        (folder / name).write_text(f"{who} wrote this.")
    assert [r["source"] for r in text_files(spark, f"file://{folder}").collect()] == ["a.txt", "b.md", "c.txt"]

    def extractor(text):
        who = " ".join(text.split()[: 2 if "Ada" in text else 1])
        return f'{{"entities": [{{"name": "{who}", "summary": "of {who}"}}], "relationships": [{{"subject": "{who}", "predicate": "wrote", "object": "This", "fact": "{who} wrote this"}}]}}'

    provider = lambda texts: [[1.0, 0.1 * ("Byron" in t)] if "Ada" in t else [0.0, 1.0 if "Else" in t else -1.0] for t in texts]
    store, config = Store(spark, f"file://{tmp_path}/store"), IngestConfig(embedding=embedding.EmbeddingConfig("own", size=2))
    figures = ingest_folder(f"file://{folder}", store, provider, extractor, config)
    total = rollup(figures).first()
    # an end that no chunk declares is a record as well
    assert (total["documents"], total["chunks_created"], total["entities_extracted"], total["relationships_created"]) == (3, 3, 6, 3)
    ingest_folder(f"file://{folder}", store, provider, extractor, config)
    counts = {n: store.read(n).count() for n in ("documents", "chunks", "entities", "edges")}
    assert counts == {"documents": 3, "chunks": 3, "entities": 4, "edges": 3}
    assert store.read("chunks").where("size(embedding) = 2").count() == 3
    dry = consolidate.consolidate_store(store, provider, config.embedding, 0.9, dry_run=True).first()
    assert (dry["groups_found"], dry["entities_merged"]) == (1, 0) and store.read("entities").count() == 4
    done = consolidate.consolidate_store(store, provider, config.embedding, 0.9).first()
    assert (done["total_entities"], done["entities_merged"]) == (4, 1)
    left = {r["name_key"]: r["summary"] for r in store.read("entities").collect()}
    assert set(left) == {"ada lovelace", "else", "this"} and set(left["ada lovelace"].split(" | ")) == {"of Ada Byron", "of Ada Lovelace"}
    assert {r["src_key"] for r in store.read("edges").collect()} == {"ada lovelace", "else"} and store.read("edges").count() == 3
    assert store.read("entities").where("name_embedding IS NULL").count() == 0
    ingest_folder(f"file://{folder}", store, provider, None, config, clean=True)
    assert store.read("entities").count() == 0 and store.read("documents").count() == 3


def test_missing_vectors_are_made(spark):
    rows = [("a", "A", "t", "said", [9.0, 9.0]), ("b", "B", "t", " ", None), ("c", "C", "t", None, [])]
    df = spark.createDataFrame(rows, "name_key string, name string, type string, summary string, name_embedding array<float>")
    got = {r["name_key"]: (r["name_embedding"], r["summary_embedding"]) for r in embedding.embed_missing(df, lambda texts: [[float(len(t)), 1.0] for t in texts], embedding.EmbeddingConfig("own", size=2)).collect()}
    assert got == {"a": ([9.0, 9.0], [4.0, 1.0]), "b": ([1.0, 1.0], None), "c": ([1.0, 1.0], None)}
    stamped = embedding.embed(spark.createDataFrame([("x",)], "content string"), lambda texts: [[1.0] for _ in texts]).first()
    assert stamped["embedding_generated_at"] is not None and stamped["embedding_model"] == embedding.EmbeddingConfig().model


def test_numbered(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("id", "CASE WHEN id % 10 = 0 THEN NULL ELSE id % 3 END AS g")
    rows = numbered(df, "n", F.col("g").asc_nulls_last(), F.col("id")).collect()
    order = sorted(((r["g"] is None, r["g"], r["id"], r["n"]) for r in rows), key=lambda x: (x[0], x[1] or 0, x[2]))
    assert [x[3] for x in order] == list(range(5000))
