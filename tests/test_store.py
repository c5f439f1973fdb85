"""The store against a plain model of it: versions, merges, sums and postings."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from sedge.functions.text import simple_analyzer
from sedge.operators import consolidate, embedding, postings, retrieval
from sedge.operators.store import ENTITIES, Change, Store
from sedge.plans.ingest import IngestConfig, ingest_folder

DOCUMENT = "id string, title string, source string, content string, metadata string, created_at timestamp, updated_at timestamp"
CHUNK = "id string, document_id string, content string, embedding array<float>, chunk_index int, metadata string, token_count int"
ENTITY = ENTITIES.replace(" not null", "")
EDGE = "src_key string, dst_key string, fact string, predicate string, source_doc string, chunk_id string, created_at timestamp"
WORDS = "red green blue grey pink teal".split()


def files(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


class Model:
    """What the store should hold, and the same changes made to both."""

    def __init__(self, spark, store, seed):
        self.spark, self.store, self.rng = spark, store, random.Random(seed)
        self.chunks = {}

    def rows(self, ids):
        made = {i: [" ".join(self.rng.choice(WORDS) for _ in range(self.rng.randint(0, 12))) for _ in range(self.rng.randint(0, 3))] for i in ids}
        docs = self.spark.createDataFrame([(i, "t", "s", "c", None, None, None) for i in ids], DOCUMENT)
        chunks = self.spark.createDataFrame([(f"{i}-{k}", i, t, None, k, None, None if k == 2 else len(t)) for i, ts in made.items() for k, t in enumerate(ts)], CHUNK)
        return made, docs, chunks

    def insert(self, ids):
        made, docs, chunks = self.rows(ids)
        self.store.insert(documents=docs, chunks=chunks)
        self.chunks |= made

    def upsert(self, ids):
        made, docs, chunks = self.rows(ids)
        self.store.upsert_documents(docs, chunks)
        self.chunks |= made

    def delete(self, ids):
        self.store.delete("documents", self.spark.createDataFrame([(i,) for i in ids], "id string"))
        for i in ids:
            self.chunks.pop(i, None)

    def check(self):
        now = self.store.snapshot()
        assert sorted(r["id"] for r in now.read("documents").collect()) == sorted(self.chunks)
        live = {f"{i}-{k}": t for i, ts in self.chunks.items() for k, t in enumerate(ts)}
        chunks = now.read("chunks").cache()
        assert {r["id"]: r["content"] for r in chunks.collect()} == live and chunks.count() == len(live)
        kept = {r["id"]: r[1:] for r in retrieval.kept_summaries(now.read("documents"), now.totals()).select("id", "chunk_count", "avg_tokens_per_chunk", "total_tokens").collect()}
        fresh = {r["id"]: r[1:] for r in retrieval.document_summaries(now.read("documents"), chunks).select("id", "chunk_count", "avg_tokens_per_chunk", "total_tokens").collect()}
        assert kept == fresh
        for text in ("red", "green blue", "pink teal red", "no such"):
            found, rank = retrieval.text_scores(F.col("content"), text)
            want = sorted(((-round(r["s"], 9), r["id"]) for r in chunks.where(found).select("id", rank.alias("s")).collect()))
            assert sorted((-round(r["score"], 9), r["chunk_id"]) for r in postings.search(now, text).collect()) == want
            assert [(-round(r["score"], 9), r["chunk_id"]) for r in postings.search(now, text, 5).collect()] == want[:5]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_model(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 4)
    store = Store(spark, f"file://{tmp_path}/s", buckets=3, analyzer=simple_analyzer)
    model, rng = Model(spark, store, seed), random.Random(seed)
    model.insert([f"d{i}" for i in range(12)])
    model.upsert([f"d{i}" for i in rng.sample(range(20), 5)])
    model.delete([f"d{i}" for i in rng.sample(range(20), 4)])
    model.check()
    pinned = store.snapshot()
    before = sorted(r["id"] for r in pinned.read("chunks").collect())
    store.compact(most=1)
    model.upsert(["d1", "d30"])
    model.check()
    assert store.compact(whole=True) and not store.compact(whole=True)
    assert all(not t.get("deletes") for t in store.snapshot().pointer["tables"].values())
    model.check()
    assert sorted(r["id"] for r in pinned.read("chunks").collect()) == before  # a version that is held does not change
    assert store.vacuum(seconds=-1) > 0 and len(store.versions()) == 1 and store.vacuum(seconds=-1) == 0
    model.upsert(["d2"])
    model.check()


def test_a_batch_writes_its_own_rows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=4)
    rng = random.Random(0)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    rows = lambda ids: (spark.createDataFrame([(f"d{i}", "t", "s", text(6000), None, None, None) for i in ids], DOCUMENT), spark.createDataFrame([(f"c{i}", f"d{i}", text(6000), None, 0, None, 5) for i in ids], CHUNK))
    store.upsert_documents(*rows(range(1000)))
    size = sum(files(tmp_path).values())
    for _ in range(3):
        store.upsert_documents(*rows(range(10)))
    grown = sum(files(tmp_path).values()) - size
    assert grown < 0.1 * size and store.read("documents").count() == 1000
    # a key's rows lie in one bucket
    assert len(store.read("documents", keys=["d5"]).inputFiles()) < len(store.read("documents").inputFiles()) / 2
    assert store.read("documents", keys=["d5"]).where("id = 'd5'").count() == 1


def test_small_folders_are_merged_with_their_like(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=1)
    row = lambda ids: spark.createDataFrame([(f"e{i}", hashlib.sha256(str(i).encode()).hexdigest(), None, None, None, None, None) for i in ids], ENTITY)
    store.insert(entities=row(range(50_000)))
    large = store.snapshot().entries("entities", "data")[0]["path"]
    for i in range(6):
        store.insert(entities=row([100_000 + i]))
    assert not store.compact(most=6) and store.compact(most=5)
    left = store.snapshot().entries("entities", "data")
    assert len(left) == 2 and large in [e["path"] for e in left] and store.read("entities").count() == 50_006


def test_only_the_terms_postings_are_opened(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    store = Store(spark, f"file://{tmp_path}/s", buckets=16, analyzer=simple_analyzer)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(f"c{i}", f"d{i}", " ".join(rng.choice(vocabulary) for _ in range(40)) + " common" * (40 if i in (7, 400) else 1 + i % 3), None, 0, None, 1) for i in range(600)]
    store.insert(chunks=spark.createDataFrame(rows, CHUNK))
    now = store.snapshot()
    every, terms = now.read("postings"), now.read("postings", keys=["common", "w5"])
    assert len(terms.inputFiles()) <= 2 < len(every.inputFiles())
    assert set(terms.inputFiles()) <= set(every.inputFiles())
    # shares whose bound is below the best ones' scores are not scored
    scored, whole = [], postings.matched
    monkeypatch.setattr(postings, "matched", lambda rows, terms, named: (scored.append(named.count()), whole(rows, terms, named))[1])
    assert [r["chunk_id"] for r in postings.search(now, "common", 2).collect()] == ["c400", "c7"]
    assert len(scored) == 2 and scored[1] <= 6 * 16 < 600


def test_an_indexed_store_wants_its_analyzer(spark, tmp_path):
    chunks = spark.createDataFrame([("c", "d", "one two", None, 0, None, 1)], CHUNK)
    Store(spark, f"file://{tmp_path}/s", analyzer=simple_analyzer).insert(chunks=chunks)
    with pytest.raises(ValueError, match="analyzer"):
        Store(spark, f"file://{tmp_path}/s").insert(chunks=chunks)


def late(store, act):
    """Let another writer in before the store's first publication."""
    publish, turns = store._publish, []

    def first(base, pointer):
        if not turns:
            turns.append(1)
            act()
        return publish(base, pointer)

    store._publish = first


def test_consolidation_keeps_what_others_insert(spark, tmp_path):
    one, two = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    entity = lambda k, v: (k, k.upper(), "t", "", v, None, None)
    one.insert(entities=spark.createDataFrame([entity("a", [1.0, 0.0]), entity("bb", [1.0, 0.01]), entity("c", [0.0, 1.0])], ENTITY), edges=spark.createDataFrame([("a", "c", "f", "p", "s", "1", None)], EDGE))
    late(one, lambda: two.insert(entities=spark.createDataFrame([entity("d", [-1.0, 0.0])], ENTITY), edges=spark.createDataFrame([("d", "a", "g", "p", "s", "2", None)], EDGE)))
    done = consolidate.consolidate_store(one, lambda texts: [[1.0, 0.0] for _ in texts], embedding.EmbeddingConfig("own", size=2), 0.99).first()
    assert done["total_entities"] == 4
    left = {r["name_key"] for r in one.read("entities").collect()}
    assert "d" in left and ("a" in left) != ("bb" in left)
    kept = "a" if "a" in left else "bb"
    assert {(r["src_key"], r["dst_key"], r["fact"]) for r in one.read("edges").collect()} == {(kept, "c", "f"), ("d", kept, "g")}


def test_ingestion_keeps_what_others_insert_and_first_times(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Ada wrote.")
    extractor = lambda text: '{"entities": [{"name": "Ada", "summary": "s"}], "relationships": [{"subject": "Ada", "predicate": "p", "object": "It", "fact": "f"}]}'
    provider, config = (lambda texts: [[1.0, 0.0] for _ in texts]), IngestConfig(embedding=embedding.EmbeddingConfig("own", size=2))
    one, two = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    act = lambda: two.insert(entities=spark.createDataFrame([("new", "New", "t", "", None, None, None)], ENTITY), edges=spark.createDataFrame([("new", "ada", "g", "p", "other", "2", None)], EDGE), documents=spark.createDataFrame([("x", "t", "other", "c", None, None, None)], DOCUMENT))
    late(one, act)
    ingest_folder(f"file://{folder}", one, provider, extractor, config)
    assert {r["name_key"] for r in one.read("entities").collect()} == {"new", "ada", "it"}
    assert {r["fact"] for r in one.read("edges").collect()} == {"f", "g"} and one.read("documents").count() == 2
    first = one.read("documents").where("source = 'a.txt'").first()
    os.utime(folder / "a.txt", (2e9, 2e9))
    ingest_folder(f"file://{folder}", one, provider, extractor, config)
    again = one.read("documents").where("source = 'a.txt'").first()
    assert again["created_at"] == first["created_at"] and again["updated_at"] > first["updated_at"]
    assert one.read("edges").count() == 2 and one.read("chunks").count() == 1


def test_a_failure_under_clean_leaves_the_old_store(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("text")
    store, config = Store(spark, f"file://{tmp_path}/s"), IngestConfig(embedding=embedding.EmbeddingConfig("own", size=2, tries=1))
    ingest_folder(f"file://{folder}", store, lambda texts: [[1.0, 0.0] for _ in texts], None, config)
    (folder / "b.txt").write_text("more")

    def down(texts):
        raise embedding.RateLimited

    with pytest.raises(Exception):  # noqa: B017
        ingest_folder(f"file://{folder}", store, down, None, config, clean=True)
    assert store.read("documents").count() == 1 and len(store.versions()) == 1
    ingest_folder(f"file://{folder}", store, lambda texts: [[1.0, 0.0] for _ in texts], None, config, clean=True)
    assert store.read("documents").count() == 2 and len(store.versions()) == 2


def test_merging_beside_a_writer(spark, tmp_path):
    """What is published while folders are merged stays, and deletes rows that were merged."""
    one, two = (Store(spark, f"file://{tmp_path}/s", buckets=2) for _ in range(2))
    row = lambda ids: spark.createDataFrame([(f"d{i}", "t", "s", "c", None, None, None) for i in ids], DOCUMENT)
    for i in range(3):
        one.insert(documents=row([i, 10 + i]))
    late(one, lambda: (two.insert(documents=row([50])), two.delete("documents", spark.createDataFrame([("d1",)], "id string"))))
    assert one.compact(whole=True)
    assert sorted(r["id"] for r in one.read("documents").collect()) == ["d0", "d10", "d11", "d12", "d2", "d50"]
    late(one, lambda: two.clear())
    assert not one.compact(whole=True) and one.read("documents").count() == 0


def test_a_failed_change_leaves_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    good = spark.createDataFrame([("d", "t", "s", "c", None, None, None)], DOCUMENT)
    with pytest.raises(Exception, match="is null"):
        store.commit(lambda old: Change(add={"documents": good, "messages": spark.sql("SELECT 'm' AS id")}))
    assert store.versions() == [] and files(tmp_path / "s" / "documents") == {}


def test_lists_against_a_scan(spark, tmp_path, monkeypatch):
    """Vectors in clusters, odd ones among them, changed after the lists were fitted: the rows of a scan from a part of the lists."""
    import numpy as np

    from sedge.operators import lists

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    vector = lambda i: [float(x) for x in centres[i % 40] + 0.2 * rng.normal(size=24)]
    rows = lambda ids: [(f"c{i}", f"d{i}", f"text {i}", vector(i), 0, None, 1) for i in ids]
    odd = [("z0", "z", "t", [0.0] * 24, 0, None, 1), ("z1", "z", "t", [1.0], 1, None, 1), ("z2", "z", "t", None, 2, None, 1), ("z3", "z", "t", [float("nan")] * 24, 3, None, 1)]
    documents = lambda ids: spark.createDataFrame([(f"d{i}", f"t{i}", "s", "c", None, None, None) for i in ids] + [("z", "z", "s", "c", None, None, None)], DOCUMENT)
    store = Store(spark, f"file://{tmp_path}/s", buckets=8)
    with pytest.raises(ValueError):
        lists.nearest(store.snapshot(), [1.0])
    store.insert(documents=documents(range(800)), chunks=spark.createDataFrame(rows(range(800)) + odd[:3], CHUNK))
    store.index_vectors(40)

    def check(opened):
        now = store.snapshot()
        for n in range(3):
            q = vector(n)
            hits, count = lists.nearest(now, q, 7)
            want = retrieval.vector_topk(now.read("chunks"), now.read("documents"), q, 7).collect()
            assert [(r["chunk_id"], round(r["similarity"], 9)) for r in hits.collect()] == [(r["chunk_id"], round(r["similarity"], 9)) for r in want]
            assert count <= opened
        found = retrieval.vector_topk_listed(now, q, 7)
        assert [r["chunk_id"] for r in found.collect()] == [r["chunk_id"] for r in want] and found.columns == retrieval.vector_topk(now.read("chunks"), now.read("documents"), q).columns
        return now

    now = check(30)
    assert len(now.read("vectors", keys=[3]).inputFiles()) < len(now.read("vectors").inputFiles())
    store.upsert_documents(documents(range(0, 800, 7)), spark.createDataFrame(rows(range(0, 800, 7)), CHUNK))
    store.delete("documents", spark.createDataFrame([(f"d{i}",) for i in range(0, 800, 11)], "id string"))
    check(30)
    assert store.compact(whole=True)
    now = check(30)
    # all rows, those without a direction at 0, and probes
    whole = lists.nearest(now, vector(0), 10_000)[0]
    assert whole.count() == now.read("chunks").where("embedding IS NOT NULL").count()
    recall = []
    for n in range(10):
        q = vector(n)
        want = {r["chunk_id"] for r in lists.nearest(now, q, 10)[0].collect()}
        hits, count = lists.nearest(now, q, 10, probes=5)
        assert count == 5
        recall.append(len(want & {r["chunk_id"] for r in hits.collect()}) / 10)
    assert np.mean(recall) >= 0.9
    store.clear()
    assert store.read("vectors").count() == 0
