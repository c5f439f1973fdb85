"""Queries over the driver's tables, one or more for each operator, and the DuckDB statements they are compared with.

Documents play the store's documents (and, whole, its chunks), embeddings their vectors, conversations its sessions and messages,
suppliers, nations and regions the entities, and line items the edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sedge.functions import text as X
from sedge.functions.chunking import STRUCTURE, ChunkConfig, chunk_column, fixed_stride, pieces_column
from sedge.functions.vectors import clamp, cosine_to
from sedge.operators import consolidate, embedding, graph, postings, retrieval, sessions, trigrams
from sedge.operators.paging import Pages
from sedge.operators.store import Change, Store, cascade
from sedge.plans import ingest
from sedge.runtime import cut, scratch_path, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
T0 = "timestamp '2020-01-01 00:00:00'"
TERM = "the"
TERMS = "the and of"


def query(sql: str | None = None):
    """Register a query under its function's name, with its statement."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    created = F.timestamp_seconds(F.lit(1577836800) + F.col("doc_id") * 60)
    return d.select(F.col("doc_id").alias("id"), F.element_at(F.split("text", "\n"), 1).alias("title"), "source", F.col("text").alias("content"), F.to_json(F.struct("lang", "n_chars")).alias("metadata"), created.alias("created_at"), created.alias("updated_at"))


D_SQL = f"""d AS (SELECT doc_id AS id, string_split(text, chr(10))[1] AS title, source, text AS content, lang, n_chars,
  {T0} + INTERVAL 1 MINUTE * doc_id AS created_at FROM documents)"""


def whole_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one chunk each, with a vector where there is one of the same number."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    both = d.join(e.select("vec_id", "embedding"), d["doc_id"] == F.col("vec_id"), "left")
    return both.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), F.col("text").alias("content"), "embedding", F.lit(0).alias("chunk_index"), F.to_json(F.struct("lang")).alias("metadata"), X.token_count(F.col("text")).alias("token_count"))


def stride_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 1000 characters with an overlap of 200, of all documents."""
    d = table(spark, sf_dir, "documents")
    pieces = d.select("doc_id", F.posexplode(fixed_stride(F.col("text"), 1000, 200)).alias("i", "content"))
    return pieces.select((F.col("doc_id") * 100000 + F.col("i")).alias("id"), F.col("doc_id").alias("document_id"), "content", F.col("i").alias("chunk_index"), F.lit("{}").alias("metadata"), X.token_count(F.col("content")).alias("token_count"))


P_SQL = """p AS (SELECT doc_id, i, substr(text, i * {step} + 1, {size}) AS content FROM (
  SELECT doc_id, text, unnest(range(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= {size} THEN 1 ELSE ceil((length(text) - {size}) / {step}.0)::BIGINT + 1 END)) AS i FROM documents))"""
C_SQL = P_SQL.format(step=800, size=1000) + """, c AS (SELECT doc_id * 100000 + i AS id, doc_id AS document_id, content, i::INT AS chunk_index, (length(content) // 4)::INT AS token_count FROM p)"""


def stored_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One vector, looked up by key."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


def _round(c: str):
    return F.round(F.col(c), 6).alias(c)


COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


# Retrieval


@query(f"""WITH {D_SQL} SELECT e.vec_id AS chunk_id, id AS document_id, content, round({COS}, 6) AS similarity, title AS document_title, source AS document_source
FROM embeddings e JOIN d ON d.id = e.vec_id ORDER BY {COS} DESC, e.vec_id LIMIT 10""")
def vector_topk(spark, sf_dir):
    chunks, docs = whole_chunks(spark, sf_dir), documents(spark, sf_dir)
    return retrieval.vector_topk(chunks, docs, stored_vector(spark, sf_dir)).select("chunk_id", "document_id", "content", _round("similarity"), "document_title", "document_source")


@query("""WITH q AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON vec_id = item_id),
s AS (SELECT query_id, vec_id AS chunk_id, list_cosine_similarity(embedding::DOUBLE[], v) AS s FROM embeddings, q)
SELECT query_id, chunk_id, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS rank FROM s) WHERE rank <= 5""")
def vector_topk_batch(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = table(spark, sf_dir, "benchmark").join(e, F.col("item_id") == F.col("id")).select(F.col("item_id").alias("query_id"), "embedding")
    return retrieval.vector_topk_batch(e, asked, 5).select("query_id", "chunk_id", _round("similarity"), F.col("rank").cast("long").alias("rank"))


ODD = f"CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 5 = 0 THEN 0.0 WHEN vec_id % 3 = 0 THEN 0.0 ELSE {COS} END"


def odd_vectors():
    """Null, zero and shortened vectors among the others."""
    return F.when(F.col("vec_id") % 7 == 0, F.lit(None).cast("array<float>")).when(F.col("vec_id") % 5 == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))


@query(f"""SELECT vec_id AS chunk_id, round({ODD}, 6) AS similarity FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 7 <> 0 ORDER BY round({ODD}, 9) DESC, vec_id LIMIT 10000""")
def vector_topk_nulls(spark, sf_dir):
    chunks = whole_chunks(spark, sf_dir).withColumn("vec_id", F.col("id")).withColumn("embedding", odd_vectors()).where("vec_id IS NOT NULL")
    return retrieval.vector_topk(chunks, documents(spark, sf_dir), stored_vector(spark, sf_dir), 10000).select("chunk_id", _round("similarity"))


@query(f"SELECT vec_id, round({ODD}, 6) AS similarity FROM embeddings")
def cosine_odd_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(cosine_to(odd_vectors(), stored_vector(spark, sf_dir)), 6).alias("similarity"))


@query("SELECT event_id, greatest(0.0, least(1.0, value / 50 - 0.5)) AS score FROM events")
def score_clamp(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", clamp(F.col("value") / 50 - 0.5).alias("score"))


TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query(f"SELECT doc_id, round(0.1::DOUBLE * len(list_filter({TOKENS}, lambda x: x = '{TERM}')), 6) AS score FROM documents WHERE list_contains({TOKENS}, '{TERM}')")
def fulltext_rank_one_term(spark, sf_dir):
    found, rank = retrieval.text_scores(F.col("text"), TERM)
    return table(spark, sf_dir, "documents").where(found).select("doc_id", F.round(rank, 6).alias("score"))


@query(f"SELECT doc_id FROM documents WHERE list_has_all({TOKENS}, ['the', 'and', 'of'])")
def fulltext_match_all_terms(spark, sf_dir):
    found, _ = retrieval.text_scores(F.col("text"), TERMS)
    return table(spark, sf_dir, "documents").where(found).select("doc_id")


#: Hits of the terms in order; the last places of all three, the sum so far and where the cover before began, folded over them.
_LEAST = "least(CASE WHEN x.t = 1 THEN x.p ELSE s.a END, CASE WHEN x.t = 2 THEN x.p ELSE s.b END, CASE WHEN x.t = 3 THEN x.p ELSE s.c END)"
R_SQL = f"""r AS (SELECT doc_id AS id, list_reduce(list_filter(list_transform({TOKENS}, lambda w, i: {{'t': CASE w WHEN 'the' THEN 1 WHEN 'and' THEN 2 WHEN 'of' THEN 3 ELSE 0 END, 'p': i, 'a': 0::BIGINT, 'b': 0::BIGINT, 'c': 0::BIGINT, 'sum': 0::DOUBLE, 'since': 0::BIGINT}}), lambda x: x.t > 0),
  lambda s, x: {{'t': 0, 'p': 0::BIGINT, 'a': CASE WHEN x.t = 1 THEN x.p ELSE s.a END, 'b': CASE WHEN x.t = 2 THEN x.p ELSE s.b END, 'c': CASE WHEN x.t = 3 THEN x.p ELSE s.c END,
    'sum': s.sum + CASE WHEN {_LEAST} > s.since THEN 0.1::DOUBLE / (x.p - {_LEAST} - 1) ELSE 0 END, 'since': greatest(s.since, {_LEAST})}},
  {{'t': 0, 'p': 0::BIGINT, 'a': 0::BIGINT, 'b': 0::BIGINT, 'c': 0::BIGINT, 'sum': 0::DOUBLE, 'since': 0::BIGINT}}).sum AS s FROM documents WHERE list_has_all({TOKENS}, ['the', 'and', 'of']))"""


@query(f"WITH {R_SQL} SELECT id AS doc_id, round(s, 6) AS score FROM r")
def fulltext_rank_cover(spark, sf_dir):
    found, rank = retrieval.text_scores(F.col("text"), TERMS)
    return table(spark, sf_dir, "documents").where(found).select("doc_id", F.round(rank, 6).alias("score"))


H_SQL = f"""WITH {D_SQL}, v AS (SELECT vec_id AS id, {COS} AS s FROM embeddings JOIN documents ON doc_id = vec_id),
t AS (SELECT doc_id AS id, 0.1::DOUBLE * len(list_filter({TOKENS}, lambda x: x = '{TERM}')) AS s FROM documents WHERE list_contains({TOKENS}, '{TERM}')),
h AS (SELECT coalesce(v.id, t.id) AS chunk_id, coalesce(v.s, 0) AS v, coalesce(t.s, 0) AS t FROM v FULL JOIN t ON v.id = t.id)
SELECT chunk_id, round(v * (1 - @w@::DOUBLE) + t * @w@::DOUBLE, 6) AS combined_score, round(v, 6)::DOUBLE AS vector_similarity, round(t, 6)::DOUBLE AS text_similarity, title AS document_title, source AS document_source
FROM h JOIN d ON d.id = chunk_id ORDER BY round(v * (1 - @w@::DOUBLE) + t * @w@::DOUBLE, 9) DESC, chunk_id LIMIT 10"""


def _hybrid(spark, sf_dir, weight, text=TERM):
    hits = retrieval.hybrid_topk(whole_chunks(spark, sf_dir), documents(spark, sf_dir), stored_vector(spark, sf_dir), text, 10, weight)
    return hits.select("chunk_id", _round("combined_score"), _round("vector_similarity"), _round("text_similarity"), "document_title", "document_source")


@query(H_SQL.replace("@w@", "0.3"))
def hybrid_topk(spark, sf_dir):
    return _hybrid(spark, sf_dir, 0.3)


@query(H_SQL.replace("@w@", "1.0"))
def hybrid_text_only(spark, sf_dir):
    return _hybrid(spark, sf_dir, 1.0)


@query(H_SQL.replace("@w@", "0.5").replace("WITH ", f"WITH {R_SQL}, ", 1).replace(H_SQL[H_SQL.index("t AS (SELECT doc_id") : H_SQL.index("h AS (")], "t AS (SELECT id, s FROM r),\n"))
def hybrid_terms(spark, sf_dir):
    return _hybrid(spark, sf_dir, 0.5, TERMS)


#: A question, and what the stand-in provider makes of it.
QUESTION, MODEL = "the", embedding.EmbeddingConfig("stand-in", size=64)
QUESTION_SQL = f"list_cosine_similarity(embedding::DOUBLE[], {embedding.hashing_provider(64)([QUESTION])[0]}::DOUBLE[])"


@query(f"""WITH {D_SQL} SELECT vec_id AS chunk_id, round(greatest(0, least(1, {QUESTION_SQL})), 6) AS score, title AS document_title
FROM embeddings JOIN d ON id = vec_id ORDER BY {QUESTION_SQL} DESC, vec_id LIMIT 20""")
def vector_search_text(spark, sf_dir):
    hits = retrieval.search_vector(whole_chunks(spark, sf_dir), documents(spark, sf_dir), QUESTION, embedding.hashing_provider(64), MODEL, 20)
    return hits.select("chunk_id", _round("score"), "document_title")


@query(f"""SELECT chunk_id, greatest(0, least(1, combined_score)) AS score, document_title FROM ({H_SQL.replace("@w@", "0.3").replace(COS, QUESTION_SQL)})""")
def hybrid_search_text(spark, sf_dir):
    hits = retrieval.search_hybrid(whole_chunks(spark, sf_dir), documents(spark, sf_dir), QUESTION, embedding.hashing_provider(64), MODEL)
    return hits.select("chunk_id", _round("score"), "document_title")


# The store: all documents as one chunk each, inserted, and those in German put in place of themselves


def indexed_store(spark, sf_dir):
    """Its chunks are all it holds; vectors and titles are read from the tables."""
    chunks = whole_chunks(spark, sf_dir).drop("embedding").where("content IS NOT NULL")
    again = chunks.where(F.get_json_object("metadata", "$.lang") == "de")
    store = Store(spark, scratch_path(spark, "store"), analyzer=X.simple_analyzer)
    store.insert(chunks=chunks)
    store.commit(lambda old: Change(drop={"chunks": again.select("id")}, add={"chunks": again}))
    return store


@query(ORACLE["fulltext_rank_cover"])
def fulltext_index(spark, sf_dir):
    hits = postings.search(indexed_store(spark, sf_dir).snapshot(), TERMS)
    return hits.select(F.col("chunk_id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {R_SQL} SELECT id AS doc_id, round(s, 6) AS score FROM r ORDER BY round(s, 9) DESC, id::VARCHAR LIMIT 20")
def fulltext_index_topk(spark, sf_dir):
    hits = postings.search(indexed_store(spark, sf_dir).snapshot(), TERMS, 20)
    return hits.select(F.col("chunk_id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"))


@query(ORACLE["hybrid_terms"])
def hybrid_index(spark, sf_dir):
    """The hybrid search with the store's postings for the words, and ids as numbers again so that ties fall as elsewhere."""
    found = postings.search(indexed_store(spark, sf_dir).snapshot(), TERMS)
    matches = found.select(F.col("chunk_id").cast("long").alias("chunk_id"), "score")
    hits = retrieval.hybrid_topk(whole_chunks(spark, sf_dir), documents(spark, sf_dir), stored_vector(spark, sf_dir), TERMS, 10, 0.5, matches=matches)
    return hits.select("chunk_id", _round("combined_score"), _round("vector_similarity"), _round("text_similarity"), "document_title", "document_source")


@query(ORACLE["vector_topk"])
def vector_lists(spark, sf_dir):
    """The vector search by lists: fitted on all chunks, the German ones put in place of themselves afterwards."""
    docs, chunks = documents(spark, sf_dir).where("content IS NOT NULL AND source IS NOT NULL"), whole_chunks(spark, sf_dir).where("content IS NOT NULL")
    again = F.get_json_object("metadata", "$.lang") == "de"
    store = Store(spark, scratch_path(spark, "store"))
    store.insert(documents=docs.withColumn("title", F.coalesce("title", F.lit(""))), chunks=chunks)
    store.index_vectors()
    store.upsert_documents(docs.withColumn("title", F.coalesce("title", F.lit(""))).where(again), chunks.where(again))
    hits = retrieval.vector_topk_listed(store.snapshot(), stored_vector(spark, sf_dir))
    return hits.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("document_id").cast("long").alias("document_id"), "content", _round("similarity"), "document_title", "document_source")


#: Every vector, and a copy of it without its first eight components.
_COPIES = "SELECT vec_id * 2 AS vec_id, embedding::DOUBLE[] AS e FROM embeddings UNION ALL SELECT vec_id * 2 + 1, list_transform(embedding, lambda x, i: CASE WHEN i <= 8 THEN 0 ELSE x END)::DOUBLE[] FROM embeddings"


@query(f"""WITH v AS ({_COPIES}) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS name_similarity
FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.85""")
def similar_pairs_by_lists(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"), "embedding")
    cropped = F.when(F.col("copy") == 1, F.transform("embedding", lambda x, i: F.when(i < 8, F.lit(0).cast("float")).otherwise(x))).otherwise(F.col("embedding"))
    found = consolidate.similar_pairs(e.select((F.col("vec_id") * 2 + F.col("copy")).alias("ord"), cropped.alias("name_embedding")))
    return found.select("a", "b", _round("name_similarity"))


def named_store(spark, sf_dir):
    """Names of parts as chunks, indexed by trigrams."""
    part = table(spark, sf_dir, "part")
    store = Store(spark, scratch_path(spark, "store"), analyzer=trigrams.trigram_analyzer)
    store.insert(chunks=part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("document_id"), F.concat_ws(" ", "p_name", "p_type").alias("content"), F.lit(0).alias("chunk_index")))
    return store.snapshot()


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_type), 'ing econ')")
def trigram_contains(spark, sf_dir):
    return trigrams.containing(named_store(spark, sf_dir), "ING econ").select(F.col("id").cast("long").alias("p_partkey"))


_GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""WITH t AS (SELECT p_partkey, {_GRAMS.format("p_name || ' ' || p_type")} AS a, {_GRAMS.format("(SELECT p_name || ' ' || p_type FROM part WHERE p_partkey = 1)")} AS b FROM part),
s AS (SELECT p_partkey, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS s FROM t)
SELECT p_partkey, round(s, 6) AS similarity FROM s WHERE s >= 0.6""")
def trigram_alike(spark, sf_dir):
    first = table(spark, sf_dir, "part").where("p_partkey = 1").select(F.concat_ws(" ", "p_name", "p_type")).first()[0]
    return trigrams.alike(named_store(spark, sf_dir), first, 0.6).select(F.col("chunk_id").cast("long").alias("p_partkey"), _round("similarity"))


_WIDE = P_SQL.format(step=1600, size=2000).replace("p AS", "wide AS", 1)


@query(f"""WITH {P_SQL.format(step=800, size=1000)}, {_WIDE}, c AS (SELECT doc_id, length(p.content) // 4 AS n FROM p JOIN documents USING (doc_id) WHERE lang NOT IN ('de', 'fr')
  UNION ALL SELECT doc_id, length(wide.content) // 4 FROM wide JOIN documents USING (doc_id) WHERE lang = 'de')
SELECT doc_id AS id, source, count(n) AS chunk_count, round(avg(n), 6) AS avg_tokens_per_chunk, sum(n)::BIGINT AS total_tokens FROM documents LEFT JOIN c USING (doc_id) WHERE lang <> 'fr' GROUP BY doc_id, source""")
def store_summaries(spark, sf_dir):
    """Sums by document that a store kept: all documents inserted, the German ones chunked anew, the French ones deleted, folders merged."""
    docs = documents(spark, sf_dir).withColumn("title", F.coalesce("title", F.lit(""))).where("content IS NOT NULL AND source IS NOT NULL")
    lang = F.get_json_object("metadata", "$.lang")
    wide = table(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id", F.posexplode(fixed_stride(F.col("text"), 2000, 400)).alias("i", "content"))
    wide = wide.select(F.concat_ws("-", "doc_id", "i").alias("id"), F.col("doc_id").alias("document_id"), "content", F.col("i").alias("chunk_index"), X.token_count(F.col("content")).alias("token_count"))
    store = Store(spark, scratch_path(spark, "store"))
    store.insert(documents=docs, chunks=stride_chunks(spark, sf_dir))
    store.upsert_documents(docs.where(lang == "de"), wide)
    store.compact(whole=True)
    store.delete("documents", docs.where(lang == "fr").select("id"))
    now = store.snapshot()
    return retrieval.kept_summaries(now.read("documents"), now.totals()).select(F.col("id").cast("long").alias("id"), "source", "chunk_count", _round("avg_tokens_per_chunk"), "total_tokens")


L_SQL = f"""WITH {D_SQL}, {C_SQL}, n AS (SELECT document_id, count(*) AS k FROM c GROUP BY document_id)
SELECT id, title, source, created_at, coalesce(k, 0) AS chunk_count FROM d LEFT JOIN n ON id = document_id {{where}} ORDER BY created_at DESC, id LIMIT {{limit}} OFFSET {{offset}}"""


def _listed(spark, sf_dir, *args):
    return retrieval.list_documents(documents(spark, sf_dir), stride_chunks(spark, sf_dir), *args).select("id", "title", "source", F.to_timestamp_ntz(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).alias("created_at"), "chunk_count")


@query(L_SQL.format(where="", limit=100, offset=0))
def list_documents(spark, sf_dir):
    return _listed(spark, sf_dir)


@query(L_SQL.format(where="", limit=20, offset=20))
def list_documents_page2(spark, sf_dir):
    return _listed(spark, sf_dir, 20, 20)


@query(L_SQL.format(where="WHERE lang = 'de'", limit=20, offset=0))
def list_documents_filtered(spark, sf_dir):
    return _listed(spark, sf_dir, 20, 0, {"lang": "de"})


@query(L_SQL.format(where="", limit=20, offset=140))
def list_documents_seek(spark, sf_dir):
    """The eighth page of a listing that was written by page."""
    docs, chunks = documents(spark, sf_dir), stride_chunks(spark, sf_dir)
    listed = docs.select("id", "title", "source", F.to_timestamp_ntz(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).alias("created_at"))
    listed = listed.join(retrieval.chunk_counts(chunks).select("document_id", "chunk_count"), F.col("id") == F.col("document_id"), "left").drop("document_id").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    return Pages.write(listed, scratch_path(spark, "pages"), F.desc("created_at"), F.col("id"), size=20).page(7)


@query("SELECT count(*) AS total FROM documents WHERE lang = 'de'")
def list_total(spark, sf_dir):
    return retrieval.count_documents(documents(spark, sf_dir), {"lang": "de"})


@query(f"""WITH {D_SQL}, {C_SQL} SELECT d.id, title, source, count(c.id) AS chunk_count, round(avg(token_count), 6) AS avg_tokens_per_chunk, sum(token_count)::BIGINT AS total_tokens
FROM d LEFT JOIN c ON d.id = document_id GROUP BY d.id, title, source""")
def document_summaries(spark, sf_dir):
    return retrieval.document_summaries(documents(spark, sf_dir), stride_chunks(spark, sf_dir)).select("id", "title", "source", "chunk_count", _round("avg_tokens_per_chunk"), "total_tokens")


@query(f"WITH {C_SQL} SELECT id AS chunk_id, content, chunk_index FROM c WHERE document_id = 3")
def document_chunks(spark, sf_dir):
    return retrieval.document_chunks(stride_chunks(spark, sf_dir), 3).drop("metadata")


@query(f"WITH {D_SQL}, {C_SQL} SELECT d.id, title, (SELECT string_agg(content, '|' ORDER BY chunk_index) FROM c WHERE document_id = d.id) AS chunks, (SELECT count(*) FROM c WHERE document_id = d.id) AS n FROM d WHERE d.id = 3")
def document_with_chunks(spark, sf_dir):
    found = retrieval.get_document(documents(spark, sf_dir), stride_chunks(spark, sf_dir), 3)
    return found.select("id", "title", F.array_join(F.transform("chunks", lambda c: c["content"]), "|").alias("chunks"), F.size("chunks").cast("long").alias("n"))


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE n_chars >= 1000 GROUP BY source")
def adhoc_sql(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("sedge_documents")
    return retrieval.run_sql(spark, "SELECT source, count(*) AS n, sum(n_chars) AS chars FROM sedge_documents WHERE n_chars >= ? GROUP BY source", 1000)


# Chunking


@query("WITH " + P_SQL.format(step=80, size=100) + " SELECT doc_id, i::INT AS chunk_index, content FROM p")
def chunk_fixed_stride(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(fixed_stride(F.col("text"), 100, 20)).alias("chunk_index", "content"))


B_SQL = """WITH RECURSIVE r AS (
  SELECT doc_id, text, 0::BIGINT AS start, 0 AS chunk_index FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, cut(text, start) - 50, chunk_index + 1 FROM (SELECT *, start + 300 < length(text) AS more FROM r) WHERE more)
SELECT doc_id, chunk_index, CASE WHEN start + 300 >= length(text) THEN substr(text, start + 1) ELSE substr(text, start + 1, cut(text, start) - start) END AS content FROM r"""
#: The cut behind the last sentence end in the 200 characters up to the one at start + 300.
CUT = "(CASE WHEN regexp_matches(substr(text, start + 102, 200), '[.!?\\n]') THEN start + 101 + 201 - strpos(regexp_replace(reverse(substr(text, start + 102, 200)), '[.!?\\n]', chr(1)), chr(1)) ELSE start + 300 END)"


@query(B_SQL.replace("cut(text, start)", CUT))
def chunk_boundary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(pieces_column(F.col("text"), ChunkConfig(300, 50, least=100))).alias("chunk_index", "content"))


def _chunked(spark, sf_dir, simple):
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.explode(chunk_column(F.col("text"), ChunkConfig(), simple)).alias("c"))
    return rows.select("doc_id", "c.*")


#: Paragraphs, cut behind sentence ends where they are above 1000 characters; parts joined up to that; where each chunk is, in turn.
W_SQL = r"""WITH RECURSIVE q AS (SELECT doc_id, unnest(string_split_regex(text, '\n\s*\n')) AS p, generate_subscripts(string_split_regex(text, '\n\s*\n'), 1) AS nth FROM documents),
r AS (SELECT doc_id, nth, trim(p, @ws) AS text, 0::BIGINT AS start, 0 AS i FROM q WHERE trim(p, @ws) <> ''
  UNION ALL SELECT doc_id, nth, text, greatest(cut(text, start) - 200, start + 1), i + 1 FROM r WHERE start + 1000 < length(text)),
parts AS (SELECT doc_id, nth, i, trim(CASE WHEN start + 1000 >= length(text) THEN substr(text, start + 1) ELSE substr(text, start + 1, cut(text, start) - start) END, @ws) AS part FROM r),
packed AS (SELECT doc_id, list_reduce(list({'done': []::VARCHAR[], 'held': part} ORDER BY nth, i),
  lambda a, x: CASE WHEN a.held = '' THEN {'done': a.done, 'held': x.held} WHEN length(a.held) + 2 + length(x.held) <= 1000 THEN {'done': a.done, 'held': a.held || chr(10) || chr(10) || x.held} ELSE {'done': list_append(a.done, a.held), 'held': x.held} END,
  {'done': []::VARCHAR[], 'held': ''}) AS s FROM parts WHERE part <> '' GROUP BY doc_id),
pieces AS (SELECT doc_id, CASE WHEN s.held <> '' THEN list_append(s.done, s.held) ELSE s.done END AS ps FROM packed),
found AS (SELECT doc_id, ps, list_reduce(list_transform(ps, lambda p: {'seen': 0::BIGINT, 'trues': []::BIGINT[], 'first': string_split(p, chr(10) || chr(10))[1]}),
  lambda a, x: {'seen': greatest(a.seen, CASE WHEN strpos(substr(text, a.seen + 1), x.first) = 0 THEN -1 ELSE a.seen + strpos(substr(text, a.seen + 1), x.first) - 1 END),
                'trues': list_append(a.trues, CASE WHEN strpos(substr(text, a.seen + 1), x.first) = 0 THEN -1 ELSE a.seen + strpos(substr(text, a.seen + 1), x.first) - 1 END), 'first': ''},
  {'seen': 0::BIGINT, 'trues': []::BIGINT[], 'first': ''}).trues AS trues FROM pieces JOIN documents USING (doc_id)),
c AS (SELECT doc_id, unnest(ps) AS content, unnest(trues) AS true_start, generate_subscripts(ps, 1) - 1 AS k FROM found)
SELECT doc_id, content, k::INT AS index, start::INT AS start_char, (start + length(content))::INT AS end_char, true_start::INT AS true_start, (length(content) // 4)::INT AS token_count, 'simple' AS split_method
FROM (SELECT *, coalesce(sum(greatest(0, length(content) - 200)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c)"""
#: The cut behind the last sentence end in the 200 characters up to the one at start + 1000.
CUT_WIDE = r"(CASE WHEN regexp_matches(substr(text, start + 802, 200), '[.!?\n]') THEN start + 1002 - strpos(regexp_replace(reverse(substr(text, start + 802, 200)), '[.!?\n]', chr(1)), chr(1)) ELSE start + 1000 END)"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(W_SQL.replace("cut(text, start)", CUT_WIDE).replace("@ws", BLANKS))
def chunk_simple_pack(spark, sf_dir):
    return _chunked(spark, sf_dir, True)


def _sections(k: int, pattern: str) -> str:
    """Sections split once more, in order; the separators are sections too."""
    pattern = pattern.replace("'", "''")
    parts = f"string_split(regexp_replace(s, '({pattern})', chr(1) || '\\1' || chr(1), 'gms'), chr(1))"
    return f"s{k} AS (SELECT doc_id, list_append(nth, i) AS nth, s FROM (SELECT doc_id, nth, unnest({parts}) AS s, generate_subscripts({parts}, 1) AS i FROM s{k - 1}) WHERE trim(s, @ws) <> '')"


#: Sections by each boundary in turn; runs of sections up to 2000 are joined up to 1000, longer ones cut behind sentence ends, pieces below 100 left out;
#: texts up to 1000, and those that leave no piece, are cut behind sentence ends as a whole.
M_SQL = (
    """WITH RECURSIVE s0 AS (SELECT doc_id, []::BIGINT[] AS nth, text AS s FROM documents WHERE length(text) > 1000 AND trim(text, @ws) <> ''), """
    + ", ".join(_sections(k, pattern) for k, pattern in enumerate(STRUCTURE, 1))
    + f""", sections AS (SELECT doc_id, s, row_number() OVER w AS n, length(s) > 2000 AS long, count(*) FILTER (length(s) > 2000) OVER (PARTITION BY doc_id ORDER BY nth ROWS UNBOUNDED PRECEDING) AS run
  FROM s{len(STRUCTURE)} WINDOW w AS (PARTITION BY doc_id ORDER BY nth)),
runs AS (SELECT doc_id, min(n) AS n, list_reduce(list({{'done': []::VARCHAR[], 'held': s}} ORDER BY n),
  lambda a, x: CASE WHEN a.held = '' THEN {{'done': a.done, 'held': x.held}} WHEN length(a.held) + 2 + length(x.held) <= 1000 THEN {{'done': a.done, 'held': a.held || chr(10) || chr(10) || x.held}} ELSE {{'done': list_append(a.done, a.held), 'held': x.held}} END,
  {{'done': []::VARCHAR[], 'held': ''}}) AS s FROM sections WHERE NOT long GROUP BY doc_id, run),
joined AS (SELECT doc_id, n, generate_subscripts(ps, 1) AS i, trim(unnest(ps), @ws) AS piece FROM (SELECT doc_id, n, list_append(s.done, s.held) AS ps FROM runs)),
r AS (SELECT doc_id, n, s AS text, 0::BIGINT AS start, 1 AS i FROM sections WHERE long UNION ALL SELECT doc_id, n, text, greatest(cut(text, start) - 200, start + 1), i + 1 FROM r WHERE start + 1000 < length(text)),
made AS (SELECT * FROM joined UNION ALL SELECT doc_id, n, i, CASE WHEN start + 1000 >= length(text) THEN substr(text, start + 1) ELSE substr(text, start + 1, cut(text, start) - start) END FROM r),
semantic AS (SELECT doc_id, list(piece ORDER BY n, i) AS ps FROM made WHERE length(trim(piece, @ws)) >= 100 GROUP BY doc_id),
t AS (SELECT doc_id, text, 0::BIGINT AS start, 1 AS i FROM documents WHERE trim(text, @ws) <> '' AND doc_id NOT IN (SELECT doc_id FROM semantic)
  UNION ALL SELECT doc_id, text, greatest(cut(text, start) - 200, start + 1), i + 1 FROM t WHERE start + 1000 < length(text)),
simple AS (SELECT doc_id, list(CASE WHEN start + 1000 >= length(text) THEN substr(text, start + 1) ELSE substr(text, start + 1, cut(text, start) - start) END ORDER BY i) AS ps FROM t GROUP BY doc_id),
every AS (SELECT doc_id, ps, 'semantic' AS how FROM semantic UNION ALL SELECT doc_id, ps, 'simple' FROM simple),
found AS (SELECT doc_id, how, ps, list_reduce(list_transform(ps, lambda p: {{'pos': 0::BIGINT, 'seen': 0::BIGINT, 'starts': []::BIGINT[], 'trues': []::BIGINT[], 'p': p}}),
  lambda a, x: {{'pos': CASE WHEN strpos(substr(text, a.pos + 1), x.p) = 0 THEN a.pos ELSE a.pos + strpos(substr(text, a.pos + 1), x.p) - 1 END + length(x.p),
                'seen': greatest(a.seen, CASE WHEN strpos(substr(text, a.seen + 1), x.p) = 0 THEN 0 ELSE a.seen + strpos(substr(text, a.seen + 1), x.p) END),
                'starts': list_append(a.starts, CASE WHEN strpos(substr(text, a.pos + 1), x.p) = 0 THEN a.pos ELSE a.pos + strpos(substr(text, a.pos + 1), x.p) - 1 END),
                'trues': list_append(a.trues, CASE WHEN strpos(substr(text, a.seen + 1), x.p) = 0 THEN -1 ELSE a.seen + strpos(substr(text, a.seen + 1), x.p) - 1 END), 'p': ''}},
  {{'pos': 0::BIGINT, 'seen': 0::BIGINT, 'starts': []::BIGINT[], 'trues': []::BIGINT[], 'p': ''}}) AS f FROM every JOIN documents USING (doc_id)),
c AS (SELECT doc_id, how, unnest(ps) AS piece, unnest(f.starts) AS start, unnest(f.trues) AS true_start, generate_subscripts(ps, 1) - 1 AS k FROM found)
SELECT doc_id, trim(piece, @ws) AS content, k::INT AS index, start::INT AS start_char, (start + length(piece))::INT AS end_char, true_start::INT AS true_start, (length(trim(piece, @ws)) // 4)::INT AS token_count, how AS split_method FROM c"""
)


@query(M_SQL.replace("cut(text, start)", CUT_WIDE).replace("@ws", BLANKS))
def chunk_semantic(spark, sf_dir):
    return _chunked(spark, sf_dir, False)


#: Replacements that make blank lines, headings, bullets, numbers, table rows and fences of what the texts have everywhere.
STRUCTURED = ((". ", ".\n\n"), ("\n\nT", "\n## T"), (", ", ",\n- "), (" the ", "\n1. the "), (" and ", "\n| and |\n"), (" on ", "\n```\non```\n"))


def _structured_sql(statement: str) -> str:
    text = "text"
    for old, new in STRUCTURED:
        text = f"replace({text}, '{old}', '{new}')".replace("\n", "' || chr(10) || '")
    head = f"WITH RECURSIVE structured AS (SELECT doc_id, {text} AS text FROM documents), "
    return head + statement.removeprefix("WITH RECURSIVE ").replace("FROM documents", "FROM structured").replace("JOIN documents", "JOIN structured")


def _chunked_structured(spark, sf_dir, simple):
    text = F.col("text")
    for old, new in STRUCTURED:
        text = F.replace(text, F.lit(old), F.lit(new))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(chunk_column(text, ChunkConfig(), simple)).alias("c"))
    return rows.select("doc_id", "c.*")


@query(_structured_sql(M_SQL.replace("cut(text, start)", CUT_WIDE).replace("@ws", BLANKS)))
def chunk_structured(spark, sf_dir):
    return _chunked_structured(spark, sf_dir, False)


@query(_structured_sql(W_SQL.replace("cut(text, start)", CUT_WIDE).replace("@ws", BLANKS)))
def chunk_structured_pack(spark, sf_dir):
    return _chunked_structured(spark, sf_dir, True)


@query("SELECT doc_id, (length(text) // 4)::INT AS token_count FROM documents")
def chunk_token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.token_count(F.col("text")).alias("token_count"))


@query("SELECT doc_id, length(text)::INT AS file_size, len(string_split(text, chr(10)))::INT AS line_count, len(regexp_extract_all(text, '\\S+'))::INT AS word_count FROM documents")
def doc_metadata(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length("text").alias("file_size"), X.line_count(F.col("text")).alias("line_count"), X.word_count(F.col("text")).alias("word_count"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'H' || source ELSE source || '-' || doc_id END AS title FROM documents")
def doc_title(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    headed = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("intro\n  # H"), "source", F.lit(" \n"), "text")).otherwise(F.col("text"))
    return d.select("doc_id", X.title(headed, F.concat(F.lit("/a/b.c/"), "source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("title"))


@query("SELECT doc_id, lower(trim(title, ' ')) AS name_key FROM (SELECT doc_id, upper(source) || ' ' || lang AS title FROM documents)")
def name_normal(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normal_name(F.concat(F.lit("  "), F.upper("source"), F.lit(" "), "lang", F.lit("\t"))).alias("name_key"))


# JSON


@query("SELECT event_id FROM events WHERE (props::JSON->>'k')::INT = 7")
def json_containment(spark, sf_dir):
    return table(spark, sf_dir, "events").where(X.json_contains(F.col("props"), {"k": 7})).select("event_id")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND ((props::JSON->>'k')::INT % 3 = 1 OR (props::JSON->>'k')::INT = 1)")
def json_containment_nested(spark, sf_dir):
    """An object in an object, and an element of an array."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    nested = F.to_json(F.struct(F.struct(F.array(k, k % 3).alias("l"), F.col("event_type").alias("t")).alias("a"), k.alias("k")))
    return e.where(X.json_contains(nested, {"a": {"l": [1], "t": "click"}})).select("event_id")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{\"k\":0,\"t\":\"' || event_type || '\"}' ELSE '{\"k\":' || (props::JSON->>'k') || ',\"t\":\"' || event_type || '\"}' END AS props FROM events")
def json_merged(spark, sf_dir):
    change = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"t":"'), "event_type", F.lit('","k":0}'))).otherwise(F.concat(F.lit('{"t":"'), "event_type", F.lit('"}')))
    return table(spark, sf_dir, "events").select("event_id", X.json_merge(F.col("props"), change).alias("props"))


# Sessions


def message_rows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    at = F.timestamp_seconds(F.lit(1577836800) + F.col("turn"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), "role", F.col("text").alias("content"), at.alias("created_at"))


def session_rows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    start = F.timestamp_seconds(F.lit(1577836800) + F.col("conv_id"))
    ends = F.when(F.col("conv_id") % 3 == 0, F.lit(None).cast("timestamp")).otherwise(start + F.make_interval(secs=F.col("n") * 30))
    return c.select(F.col("conv_id").alias("id"), F.concat(F.lit("u"), F.col("conv_id") % 5).alias("user_id"), F.concat(F.lit('{"n":'), "n", F.lit("}")).alias("metadata"), start.alias("created_at"), start.alias("updated_at"), ends.alias("expires_at"))


def now():
    return F.timestamp_seconds(F.lit(1577836920))


S_SQL = f"""s AS (SELECT conv_id AS id, 'u' || (conv_id % 5) AS user_id, count(*) AS n,
  conv_id % 3 = 0 OR {T0} + INTERVAL 1 SECOND * (conv_id + count(*) * 30) > timestamp '2020-01-01 00:02:00' AS live FROM conversations GROUP BY conv_id)"""


@query(f"WITH {S_SQL} SELECT id, user_id, '{{\"n\":' || n || '}}' AS metadata FROM s WHERE live")
def session_active(spark, sf_dir):
    return sessions.active_sessions(session_rows(spark, sf_dir), now()).select("id", "user_id", "metadata")


@query(f"WITH {S_SQL} SELECT id, live AND id % 2 = 0 AS changed, CASE WHEN live AND id % 2 = 0 THEN '{{\"a\":[1,2],\"n\":-1}}' ELSE '{{\"n\":' || n || '}}' END AS metadata FROM s")
def session_merge_metadata(spark, sf_dir):
    rows = session_rows(spark, sf_dir)
    changes = rows.where("id % 2 = 0").select("id", F.lit('{"n": -1, "a": [1, 2]}').alias("change"))
    return sessions.merge_metadata(rows, changes, now()).select("id", "changed", "metadata")


@query(f"WITH {S_SQL}, q AS (SELECT id * 2 AS id FROM s), l AS (SELECT id FROM s WHERE live) SELECT id, id IN (SELECT id FROM l) AS found FROM q")
def session_get_or_create(spark, sf_dir):
    rows = session_rows(spark, sf_dir)
    asked = rows.select((F.col("id") * 2).alias("id"), "user_id", F.lit(None).cast("string").alias("metadata"))
    return sessions.get_or_create(rows, asked, now()).select("id", F.when(F.col("id").isNotNull(), F.col("found")).alias("found"))


@query("SELECT conv_id * 1000 + turn AS id, role, text AS content FROM conversations WHERE conv_id = 1 ORDER BY turn LIMIT 3")
def session_messages(spark, sf_dir):
    return sessions.history(sessions.valid_messages(message_rows(spark, sf_dir)), 1, 3).select("id", "role", "content")


K_SQL = "k AS (SELECT conv_id AS session_id, role, text, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS up, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS down, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"


@query(f"WITH {K_SQL} SELECT session_id, turn + session_id * 1000 AS id, role, (up - greatest(least(n, 10) - 6, 0))::INT AS position FROM k WHERE up <= 10 AND up > least(n, 10) - 6")
def session_context(spark, sf_dir):
    return sessions.context(message_rows(spark, sf_dir)).select("session_id", "id", "role", "position")


@query(f"WITH {K_SQL} SELECT session_id, turn + session_id * 1000 AS id, role FROM k WHERE down <= 6")
def session_context_recent(spark, sf_dir):
    return sessions.context(message_rows(spark, sf_dir), mode="recent").select("session_id", "id", "role")


@query(f"WITH {K_SQL} SELECT session_id, string_agg(role || ': ' || text, chr(10) ORDER BY up) AS prompt FROM k WHERE up <= 10 AND up > least(n, 10) - 6 GROUP BY session_id")
def prompt_context(spark, sf_dir):
    return sessions.prompt_context(message_rows(spark, sf_dir))


@query("SELECT conv_id AS session_id, unnest(['user', 'assistant']) AS role, unnest([text, reverse(text)]) AS content FROM conversations WHERE turn = 0")
def save_turn(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("session_id"), F.col("text").alias("question"), F.reverse("text").alias("answer"))
    return sessions.turn_rows(asked, now()).select("session_id", "role", "content")


@query("SELECT conv_id AS run_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, 'search_' || role AS tool_name, turn::VARCHAR AS tool_call_id FROM conversations WHERE role <> 'user'")
def tool_calls(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role <> 'user'")
    parts = F.struct(F.array(F.struct(F.lit("tool-call").alias("part_kind"), F.concat(F.lit("search_"), "role").alias("tool_name"), F.to_json(F.struct("turn")).alias("args"), F.col("turn").cast("string").alias("tool_call_id"))).alias("parts"))
    runs = c.groupBy(F.col("conv_id").alias("run_id")).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("turn", parts.alias("m")))), lambda x: x["m"])).alias("messages"))
    return sessions.tool_calls(runs).select("run_id", F.col("position").cast("long").alias("position"), "tool_name", "tool_call_id")


@query(f"WITH {S_SQL} SELECT conv_id * 1000 + turn AS id FROM conversations JOIN s ON conv_id = id WHERE live")
def cascade_delete(spark, sf_dir):
    rows = session_rows(spark, sf_dir)
    gone = rows.join(sessions.active_sessions(rows, now()).select("id"), "id", "left_anti").select("id")
    return cascade(message_rows(spark, sf_dir), "session_id", gone).select("id")


# Graph


def episodes(spark, sf_dir):
    """One episode a supplier: the supplier (twice, under two spellings) and its nation as entities, and an edge to the region, which no episode declares."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows by definition
    entity = lambda name, kind, summary: F.struct(name.alias("name"), F.lit(kind).alias("type"), summary.alias("summary"))
    link = lambda a, p, b: F.struct(a.alias("subject"), F.lit(p).alias("predicate"), b.alias("object"), F.concat(a, F.lit(f" {p} "), b).alias("fact"))
    nation = F.when(F.col("s_suppkey") % 2 == 0, F.upper("n_name")).otherwise(F.lower("n_name"))
    return rows.select(
        F.col("s_suppkey").alias("ord"), F.lit("supplier").alias("source_doc"), F.col("s_suppkey").alias("chunk_id"), F.timestamp_seconds(F.lit(1577836800) + F.col("s_suppkey")).alias("created_at"),
        F.array(entity(F.col("s_name"), "supplier", F.lit("")), entity(nation, "nation", F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("seen by "), "s_name")).otherwise("")), entity(F.col("s_name"), "maker", F.lit("again"))).alias("entities"),
        F.array(link(F.col("s_name"), "located_in", nation), link(nation, "part_of", F.col("r_name"))).alias("relationships"),
    )


E_SQL = """f AS (SELECT s_suppkey AS ord, s_name, CASE WHEN s_suppkey % 2 = 0 THEN upper(n_name) ELSE lower(n_name) END AS nation, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
rec AS (SELECT ord, 0 AS pos, s_name AS name, 'maker' AS type, 'again' AS summary FROM f UNION ALL
        SELECT ord, 1, nation, 'nation', CASE WHEN ord % 3 = 0 THEN 'seen by ' || s_name ELSE '' END FROM f UNION ALL SELECT ord, 6, r_name, 'other', '' FROM f),
n AS (SELECT lower(name) AS name_key, arg_min(name, (ord, pos)) AS name, arg_min(type, (ord, pos)) AS type, coalesce(arg_min(summary, (ord, pos)) FILTER (summary <> ''), '') AS summary FROM rec GROUP BY 1),
e AS (SELECT lower(s_name) AS src_key, lower(nation) AS dst_key, s_name || ' located_in ' || nation AS fact, 'located_in' AS predicate, ord FROM f UNION ALL
      SELECT lower(nation), lower(r_name), nation || ' part_of ' || r_name, 'part_of', ord FROM f)"""


def entity_frames(spark, sf_dir):
    rows = cut(episodes(spark, sf_dir), "episodes")
    return graph.upsert_entities(None, graph.entity_records(rows)), graph.new_edges(rows)


@query(f"WITH {E_SQL} SELECT * FROM n")
def entity_upsert(spark, sf_dir):
    return entity_frames(spark, sf_dir)[0].select("name_key", "name", "type", "summary")


@query(f"WITH {E_SQL} SELECT src_key, dst_key, fact, predicate, ord::VARCHAR AS chunk_id FROM e")
def edge_append(spark, sf_dir):
    return entity_frames(spark, sf_dir)[1].select("src_key", "dst_key", "fact", "predicate", "chunk_id")


@query(f"WITH {E_SQL} SELECT (SELECT count(*) FROM n) AS entities, (SELECT count(*) FROM e) AS relationships")
def graph_stats(spark, sf_dir):
    return graph.graph_statistics(*entity_frames(spark, sf_dir))


def supply_edges(spark, sf_dir):
    """Parallel edges: a supplier supplies a part once for every line item."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.concat(F.lit("supplier-"), "l_suppkey").alias("src_key"), F.concat(F.lit("part-"), "l_partkey").alias("dst_key"), F.concat(F.lit("supplies with flag "), "l_returnflag").alias("fact"), F.lit("supplies").alias("predicate"), F.lit("lineitem").alias("source_doc"), F.col("l_orderkey").cast("string").alias("chunk_id"), F.col("l_shipdate").alias("created_at"))


@query("""SELECT DISTINCT 'out' AS direction, 'part-' || l_partkey AS related_key, 'supplies' AS predicate, 'supplies with flag ' || l_returnflag AS fact FROM lineitem WHERE l_suppkey = 1
UNION ALL SELECT DISTINCT 'in', 'supplier-' || l_suppkey, 'supplies', 'supplies with flag ' || l_returnflag FROM lineitem WHERE 'part-' || l_partkey = 'supplier-1'""")
def entity_relationships(spark, sf_dir):
    return graph.entity_relationships(supply_edges(spark, sf_dir), " Supplier-1 ")


@query("SELECT DISTINCT 'in' AS direction, 'supplier-' || l_suppkey AS related_key, 'supplies' AS predicate, 'supplies with flag ' || l_returnflag AS fact FROM lineitem WHERE l_partkey = 7")
def entity_relationships_in(spark, sf_dir):
    return graph.entity_relationships(supply_edges(spark, sf_dir), "part-7")


@query(f"WITH {E_SQL} SELECT name AS central_entity, (SELECT string_agg(DISTINCT k, ',' ORDER BY k) FROM (SELECT dst_key AS k FROM e WHERE src_key = 'nation_6' UNION SELECT src_key FROM e WHERE dst_key = 'nation_6')) AS related FROM n WHERE name_key = 'nation_6'")
def related_entities(spark, sf_dir):
    found = graph.related_entities(*entity_frames(spark, sf_dir), "NATION_6")
    return found.select("central_entity", F.array_join("related_entities", ",").alias("related"))


@query(f"""WITH {E_SQL} SELECT name AS central_entity, direction, related_key, predicate, fact FROM n, (SELECT DISTINCT 'out' AS direction, dst_key AS related_key, predicate, fact FROM e WHERE src_key = 'nation_6'
  UNION ALL SELECT DISTINCT 'in', src_key, predicate, fact FROM e WHERE dst_key = 'nation_6') WHERE name_key = 'nation_6'""")
def related_facts(spark, sf_dir):
    return graph.related_facts(*entity_frames(spark, sf_dir), "NATION_6")


@query("SELECT 'supplies with flag ' || l_returnflag AS fact, 'part-' || l_partkey AS related_key, l_shipdate AS valid_at FROM lineitem WHERE l_suppkey = 1")
def entity_timeline(spark, sf_dir):
    return graph.entity_timeline(supply_edges(spark, sf_dir), "supplier-1")


@query("""WITH v AS (SELECT l.vec_id, l.label FROM embeddings l), w AS (SELECT 'vector-' || vec_id AS name_key, 'Vector ' || vec_id AS name, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s, vec_id FROM embeddings),
k AS (SELECT * FROM w ORDER BY round(s, 9) DESC, name_key LIMIT 10)
SELECT name_key AS source_node, 'bought by ' || c_custkey AS fact, false AS is_summary FROM k JOIN customer ON c_custkey % 1000 = vec_id
UNION ALL SELECT name_key, name || ': vector ' || vec_id, true FROM k WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey % 1000 = vec_id)""")
def graph_search(spark, sf_dir):
    return graph_hits(spark, sf_dir).select("source_node", "fact", "is_summary")


def vector_graph(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    nodes = e.select(F.concat(F.lit("vector-"), "vec_id").alias("name_key"), F.concat(F.lit("Vector "), "vec_id").alias("name"), F.concat(F.lit("vector "), "vec_id").alias("summary"), F.col("embedding").alias("name_embedding"))
    edges = table(spark, sf_dir, "customer").select(F.concat(F.lit("vector-"), F.col("c_custkey") % 1000).alias("src_key"), F.concat(F.lit("customer-"), "c_custkey").alias("dst_key"), F.concat(F.lit("bought by "), "c_custkey").alias("fact"), F.lit("sold_to").alias("predicate"))
    return nodes, edges


def graph_hits(spark, sf_dir):
    nodes, edges = vector_graph(spark, sf_dir)
    return graph.graph_search(nodes, edges, stored_vector(spark, sf_dir))


_NEAR_SQL = """WITH w AS (SELECT 'vector-' || vec_id AS name_key, 'Vector ' || vec_id AS name, {0} AS s, vec_id FROM embeddings),
k AS (SELECT * FROM w ORDER BY round(s, 9) DESC, name_key LIMIT 10)
SELECT name_key AS source_node, 'bought by ' || c_custkey AS fact, false AS is_summary FROM k JOIN customer ON c_custkey % 1000 = vec_id
UNION ALL SELECT name_key, name || ': vector ' || vec_id, true FROM k WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey % 1000 = vec_id)"""


@query(_NEAR_SQL.format(QUESTION_SQL))
def graph_search_text(spark, sf_dir):
    nodes, edges = vector_graph(spark, sf_dir)
    return retrieval.search_graph(nodes, edges, QUESTION, embedding.hashing_provider(64), MODEL).select("source_node", "fact", "is_summary")


@query(f"""WITH RECURSIVE {E_SQL}, b AS (SELECT src_key AS x, dst_key AS y FROM e UNION SELECT dst_key, src_key FROM e),
r AS (SELECT 'europe' AS key, 0 AS depth UNION SELECT y, depth + 1 FROM r JOIN b ON x = key WHERE depth < 2)
SELECT key, min(depth)::INT AS depth FROM r GROUP BY key""")
def depth_k(spark, sf_dir):
    return graph.reachable(entity_frames(spark, sf_dir)[1], "Europe", 2)


@query(r"""WITH n AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '\S+'), lambda w: trim(w, '.,')), lambda w: regexp_full_match(w, '\p{L}+')) AS names FROM documents),
k AS (SELECT *, names[:8] AS kept FROM n)
SELECT doc_id, len(kept)::INT AS entities, (CASE WHEN len(names) > 8 THEN len(list_filter(range(1, len(names)), lambda i: list_contains(kept, names[i]) AND list_contains(kept, names[i + 1]))) ELSE greatest(len(names) - 1, 0) END)::INT AS relationships,
       NULL::VARCHAR AS error FROM k""")
def extraction_parse(spark, sf_dir):
    d = table(spark, sf_dir, "documents")

    def extractor(text: str) -> str:
        names = [n for w in text.split() if (n := w.strip(".,")).isalpha()]
        entities = ",".join(f'{{"name":"{n}","type":"word","summary":"in the text"}}' for n in names)
        links = ",".join(f'{{"subject":"{a}","predicate":"before","object":"{b}","fact":""}}' for a, b in zip(names, names[1:]))
        return "```json\n{\"entities\":[" + entities + "],\"relationships\":[" + links + "]}\n```"

    rows = graph.parse_replies(graph.extract(d.select("doc_id", "text"), extractor, "text"))
    return rows.select("doc_id", F.size("entities").alias("entities"), F.size("relationships").alias("relationships"), "error")


# Consolidation


THETA = 0.4


def vector_entities(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("ord"), F.concat(F.lit("k"), "vec_id").alias("name_key"), F.concat(F.lit("name"), F.repeat(F.lit("x"), (F.col("vec_id") % 7).cast("int"))).alias("name"), F.concat(F.lit("of "), "label").alias("summary"), F.col("embedding").alias("name_embedding"))


V_SQL = f"""v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {THETA})"""


@query(f"WITH {V_SQL} SELECT a, b, round(s, 6) AS name_similarity FROM p")
def similar_pairs(spark, sf_dir):
    return consolidate.similar_pairs(vector_entities(spark, sf_dir), THETA).select("a", "b", _round("name_similarity"))


@query(f"""WITH RECURSIVE {V_SQL}, g AS (
  SELECT 0::BIGINT AS i, MAP {{}}::MAP(BIGINT, BIGINT) AS m UNION ALL
  SELECT i + 1, CASE WHEN m[i] IS NOT NULL THEN m ELSE map_concat(m, map_from_entries(list_prepend(struct_pack(k := i, v := i),
    list_transform(list_filter(coalesce((SELECT list(b ORDER BY b) FROM p WHERE a = i), []::BIGINT[]), lambda x: m[x] IS NULL)[:19], lambda x: struct_pack(k := x, v := i))))) END
  FROM g WHERE i <= (SELECT max(vec_id) FROM v))
SELECT vec_id AS ord, m[vec_id] AS leader FROM v, (SELECT m FROM g ORDER BY i DESC LIMIT 1)""")
def consolidate_groups(spark, sf_dir):
    rows = vector_entities(spark, sf_dir)
    return consolidate.group_entities(rows, consolidate.similar_pairs(rows, THETA))


def _canonical(spark, sf_dir):
    """Groups of up to ten parts of one size and brand, so that merges are many at any size of the tables."""
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("part-"), "p_partkey").alias("name_key"), F.col("p_name").alias("name"), F.col("p_type").alias("summary"))
    leader = F.min("p_partkey").over(Window.partitionBy("p_brand", "p_size", F.floor(F.col("p_partkey") / 200)))
    return rows, consolidate.canonical_entities(rows, part.select(F.col("p_partkey").alias("ord"), leader.alias("leader")))


G_SQL = """g AS (SELECT p_partkey, 'part-' || p_partkey AS name_key, p_name, p_type, min(p_partkey) OVER (PARTITION BY p_brand, p_size, p_partkey // 200) AS leader FROM part),
k AS (SELECT leader, arg_max(name_key, (length(p_name), -p_partkey)) AS canonical_key, count(*) AS n FROM g GROUP BY leader HAVING count(*) > 1),
u AS (SELECT leader, string_agg(p_type, ' | ' ORDER BY o) AS summary FROM (SELECT leader, p_type, min(p_partkey) AS o FROM g WHERE p_type <> '' GROUP BY leader, p_type) GROUP BY leader)"""


@query(f"WITH {G_SQL} SELECT leader, canonical_key, summary, (n - 1)::INT AS duplicates FROM k JOIN u USING (leader)")
def consolidate_canonical(spark, sf_dir):
    return _canonical(spark, sf_dir)[1].select("leader", "canonical_key", "summary", F.size("duplicate_keys").alias("duplicates"))


@query(f"""WITH {G_SQL}, x AS (SELECT name_key AS dup, canonical_key FROM g JOIN k USING (leader) WHERE name_key <> canonical_key),
e AS (SELECT 'supplier-' || l_suppkey AS src_key, 'part-' || l_partkey AS dst_key, 'supplies with flag ' || l_returnflag AS fact, 'supplies' AS predicate, 'lineitem' AS source_doc, l_orderkey::VARCHAR AS chunk_id, l_shipdate AS created_at FROM lineitem),
m AS (SELECT DISTINCT src_key, canonical_key AS dst_key, fact, predicate, source_doc, chunk_id, created_at FROM e JOIN x ON dst_key = dup),
s AS (SELECT * FROM e WHERE dst_key NOT IN (SELECT dup FROM x)),
r AS (SELECT * FROM s UNION ALL SELECT * FROM (SELECT * FROM m EXCEPT SELECT * FROM s))
SELECT src_key, dst_key, fact, chunk_id FROM r""")
def consolidate_rewire(spark, sf_dir):
    rows, canonical = _canonical(spark, sf_dir)
    return consolidate.rewire(rows, supply_edges(spark, sf_dir), cut(canonical, "canonical"))[1].select("src_key", "dst_key", "fact", "chunk_id")


@query(f"""WITH {G_SQL} SELECT name_key, CASE WHEN name_key = canonical_key THEN u.summary ELSE p_type END AS summary FROM g LEFT JOIN k USING (leader) LEFT JOIN u USING (leader)
WHERE canonical_key IS NULL OR canonical_key = name_key""")
def consolidate_merged(spark, sf_dir):
    rows, canonical = _canonical(spark, sf_dir)
    return consolidate.rewire(rows, supply_edges(spark, sf_dir), cut(canonical, "canonical"))[0].select("name_key", "summary")


@query(f"WITH {G_SQL} SELECT (SELECT count(*) FROM part) AS total_entities, count(*) AS groups_found, sum(n - 1)::BIGINT AS duplicates_found, 0::BIGINT AS entities_merged FROM k")
def consolidate_dry_run(spark, sf_dir):
    rows, canonical = _canonical(spark, sf_dir)
    return consolidate.consolidation_stats(rows, canonical, dry_run=True)


# Embedding and ingestion


@query("SELECT count(*) AS rows, count(DISTINCT text) AS vectors FROM documents")
def embed_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    config = embedding.EmbeddingConfig()
    done = cut(embedding.embed(d, embedding.hashing_provider(config.dimension), config).select(F.md5("content").alias("k"), F.xxhash64("embedding").alias("v")), "embedded")
    return done.agg(F.count("*").alias("rows"), F.countDistinct("k", "v").alias("vectors"))


@query("SELECT count(*) AS rows, count(DISTINCT text) AS vectors, 0::BIGINT AS calls_again FROM documents")
def embed_cache(spark, sf_dir):
    """Two runs over all documents: the second finds every vector of the first."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    path, config = scratch_path(spark, "cache"), embedding.EmbeddingConfig("stand-in", size=16)
    calls, provider = spark.sparkContext.accumulator(0), embedding.hashing_provider(16)

    def counted(texts: list[str]) -> list[list[float]]:
        calls.add(len(texts))
        return provider(texts)

    embedding.embed_cached(d, provider, path, config)
    done = cut(embedding.embed_cached(d, counted, path, config).select(F.md5("content").alias("k"), F.xxhash64("embedding").alias("v")), "embedded")
    return done.agg(F.count("*").alias("rows"), F.countDistinct("k", "v").alias("vectors")).withColumn("calls_again", F.lit(calls.value).cast("long"))


@query(f"""SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS chunks_created, count(*) AS episodes_created, (2 * count(*))::BIGINT AS entities_extracted, count(*)::BIGINT AS relationships_created, 0::BIGINT AS errors
FROM ({W_SQL.replace("cut(text, start)", CUT_WIDE).replace("@ws", BLANKS)})""")
def ingest_rollup(spark, sf_dir):
    """Chunks of all documents, each an episode that names one entity and links it to one that it does not declare."""
    docs = cut(documents(spark, sf_dir), "documents")
    chunks = cut(ingest.chunk_documents(docs, ChunkConfig(), simple=True), "chunks")
    reply = '{"entities": [{"name": "Length %d"}], "relationships": [{"subject": "Reader", "predicate": "read", "object": "Length %d", "fact": "read"}]}'
    episodes = ingest.build_graph(chunks, docs, lambda text: reply % (len(text), len(text)))[2]
    return ingest.rollup(ingest.document_results(docs, chunks, episodes))


#: The same with chunks of 1500 and an overlap of 250, as rows of the store.
I_SQL = M_SQL.replace("cut(text, start)", CUT_WIDE.replace("start + 802", "start + 1302").replace("start + 1002", "start + 1502")).replace("start + 1000", "start + 1500").replace("> 1000", "> 1500").replace("<= 1000", "<= 1500").replace("- 200", "- 250").replace("@ws", BLANKS)


@query(f"""SELECT sha256(doc_id || '|' || index) AS id, doc_id AS document_id, index AS chunk_index, token_count,
  to_json({{'chunk_method': 'semantic', 'end_char': end_char, 'lang': lang, 'n_chars': n_chars, 'source': source, 'split_method': split_method, 'start_char': start_char,
           'title': string_split(text, chr(10))[1], 'total_chunks': count(*) OVER (PARTITION BY doc_id), 'true_start': true_start}})::VARCHAR AS metadata
FROM ({I_SQL}) JOIN documents USING (doc_id)""")
def ingest_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return ingest.chunk_documents(docs, ChunkConfig(1500, 250)).select("id", "document_id", "chunk_index", "token_count", "metadata")


@query(f"""WITH v AS (SELECT vec_id::VARCHAR AS id, {COS} AS s FROM embeddings JOIN documents ON doc_id = vec_id ORDER BY 2 DESC, vec_id LIMIT 10),
w AS (SELECT 'vector-' || vec_id AS name_key, 'Vector ' || vec_id AS name, {COS} AS s, vec_id FROM embeddings), k AS (SELECT * FROM w ORDER BY round(s, 9) DESC, name_key LIMIT 10),
g AS (SELECT sha256(name_key || '|customer-' || c_custkey || '|sold_to|bought by ' || c_custkey) AS id FROM k JOIN customer ON c_custkey % 1000 = vec_id
      UNION ALL SELECT sha256(name_key || '|' || name || ': vector ' || vec_id) FROM k WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey % 1000 = vec_id)),
n AS (SELECT (SELECT count(*) FROM v) + (SELECT count(*) FROM g) AS total_results)
SELECT 'vector' AS leg, id, round(s, 6) AS score, total_results FROM v, n UNION ALL SELECT 'graph', id, NULL, total_results FROM g, n""")
def comprehensive_search(spark, sf_dir):
    found = retrieval.comprehensive_search(
        lambda: retrieval.vector_topk(whole_chunks(spark, sf_dir), documents(spark, sf_dir), stored_vector(spark, sf_dir)),
        lambda: graph_hits(spark, sf_dir),
    )
    return found.select("leg", "id", _round("score"), "total_results")
