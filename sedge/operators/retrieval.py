"""Searches and listings over documents and chunks.

Frames: documents(id, title, source, content, metadata, created_at, updated_at) and chunks(id, document_id, content, embedding,
chunk_index, metadata, token_count). Results that are cut to k rows are ordered by id where scores tie.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from sedge.functions.text import Analyzer, json_contains, matches, query_terms, rank_cover, rank_one_term, simple_analyzer, tokens
from sedge.functions.vectors import clamp, cosine_to
from sedge.operators.embedding import EmbeddingConfig, Provider, embed_batch
from sedge.operators.graph import NEAREST, graph_search
from sedge.operators.lists import nearest as nearest_listed
from sedge.runtime import cut, scratch_path

MOST_RESULTS = 50
MOST_QUERIES = 4096


def checked_limit(limit: int) -> int:
    """A search's limit, which is 1 to 50."""
    if not 1 <= limit <= MOST_RESULTS:
        raise ValueError(f"limit must be between 1 and {MOST_RESULTS}")
    return limit


def check_dimension(embedding: Column, size: int) -> Column:
    """True for null embeddings and those of the store's length."""
    return embedding.isNull() | (F.size(embedding) == size)


def _titled(hits: DataFrame, documents: DataFrame, score: str) -> DataFrame:
    """Ranked hits with their document's title and source, best first. The ranking comes first, so k rows meet the documents and are
    sorted again, not all chunks."""
    names = documents.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), F.col("source").alias("document_source"))
    return hits.join(names, "document_id").orderBy(F.desc(score), "chunk_id")


def vector_topk(chunks: DataFrame, documents: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """The k chunks of greatest cosine to the query. Chunks without an embedding are left out; zero vectors have similarity 0.

    Every chunk has its document (the store's foreign key), so the top k is taken before the join.
    """
    scored = chunks.where(F.col("embedding").isNotNull()).select(F.col("id").alias("chunk_id"), "document_id", "content", cosine_to(F.col("embedding"), query).alias("similarity"), "metadata")
    return _titled(scored.orderBy(F.desc("similarity"), "chunk_id").limit(k), documents, "similarity")


def vector_topk_listed(snapshot, query: list[float], k: int = 10, probes: int | None = None) -> DataFrame:
    """The same from a store whose vectors are indexed: lists that can't hold one of the k best are not opened, nor are buckets without their chunks.

    With ``probes`` only so many lists are, and the result may miss some.
    """
    hits = cut(nearest_listed(snapshot, query, k, probes)[0], "hits")
    owners = [r[0] for r in hits.select("document_id").distinct().collect()]  # at most k
    chunks = snapshot.read("chunks", keys=owners).select(F.col("id").alias("chunk_id"), "content", "metadata")
    documents = snapshot.read("documents", keys=owners)
    return _titled(hits.join(chunks, "chunk_id").select("chunk_id", "document_id", "content", "similarity", "metadata"), documents, "similarity")


def vector_topk_batch(chunks: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, chunk_id, similarity, rank): the k best chunks for each of queries(query_id, embedding).

    Partitions are scanned once: each keeps its own k best of every query from a matrix product, and those meet
    in a window by query. More than MOST_QUERIES queries are dealt into blocks of about so many, with a scan for each block.
    """
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    first = asked.limit(MOST_QUERIES + 1).collect()
    if len(first) <= MOST_QUERIES:
        return _topk_block(chunks, first, k)
    asked = cut(asked, "queries")
    dealt = cut(asked.repartition(math.ceil(asked.count() / MOST_QUERIES)).withColumn("_block", F.spark_partition_id()), "query-blocks")
    paths, kind, base = [], None, scratch_path(chunks.sparkSession, "topk-blocks")
    for b in sorted(r[0] for r in dealt.select("_block").distinct().collect()):
        block = _topk_block(chunks, dealt.where(F.col("_block") == b).select("query_id", "embedding").collect(), k)
        paths.append(f"{base}/{b}")
        kind = block.schema
        block.write.option("compression", "zstd").parquet(paths[-1])
    return chunks.sparkSession.read.schema(kind).parquet(*paths)


def _topk_block(chunks: DataFrame, asked: list[Row], k: int) -> DataFrame:
    ids = [r["query_id"] for r in asked]
    by_size: dict[int, list[int]] = {}
    for i, r in enumerate(asked):
        by_size.setdefault(len(r["embedding"]), []).append(i)
    units = {n: (at, _unit(np.array([asked[i]["embedding"] for i in at], np.float64))) for n, at in by_size.items()}

    def best(batches):
        held = pd.DataFrame({"q": pd.Series(dtype="int64"), "chunk_id": pd.Series(dtype="object"), "similarity": pd.Series(dtype="float64")})
        for pdf in batches:
            found = [held]
            for i, part in pdf.groupby(pdf["embedding"].map(len)):
                at, q = units.get(i, ((), None))
                if not len(at):
                    continue
                scores = q @ _unit(np.stack(part["embedding"].to_numpy()).astype(np.float64)).T
                for row, query in zip(scores, at):
                    top = np.argsort(-row, kind="stable")[: 2 * k] if len(row) <= 2 * k else np.flatnonzero(row >= np.partition(row, -k)[-k])
                    found.append(pd.DataFrame({"q": query, "chunk_id": part["chunk_id"].to_numpy()[top], "similarity": row[top]}))
            held = pd.concat(found).sort_values(["q", "similarity", "chunk_id"], ascending=[True, False, True]).groupby("q").head(k)
        yield held

    kind = chunks.schema["id"].dataType.simpleString()
    partial = chunks.where(F.col("embedding").isNotNull()).select(F.col("id").alias("chunk_id"), "embedding").mapInPandas(best, f"q long, chunk_id {kind}, similarity double")
    ranked = partial.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "chunk_id"))).where(F.col("rank") <= k)
    names = F.array(*[F.lit(i) for i in ids]) if ids else F.array(F.lit(None).cast("long"))
    return ranked.select(F.get(names, F.col("q").cast("int")).alias("query_id"), "chunk_id", "similarity", "rank")


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.sqrt((x * x).sum(1))[:, None]
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def text_scores(text: Column, query: str, analyzer: Analyzer = simple_analyzer) -> tuple[Column, Column]:
    """(matches, rank) of a text for a plain query of all its terms."""
    words = tokens(text, analyzer)
    terms = query_terms(F.lit(query), analyzer)
    return matches(words, terms), F.when(F.size(terms) == 1, rank_one_term(words, F.get(terms, F.lit(0)))).otherwise(rank_cover(words, terms))


def hybrid_topk(chunks: DataFrame, documents: DataFrame, query: list[float], text: str, k: int = 10, text_weight: float = 0.3, analyzer: Analyzer = simple_analyzer, matches: DataFrame | None = None) -> DataFrame:
    """The k chunks of greatest similarity * (1 - w) + text rank * w; a missing side counts 0.

    Both sides are subsets of the same chunks, so the outer join of the two searches is one scan of the chunks that either takes. With ``matches``(chunk_id, score),
    what an index found for the text, no text is tokenised.
    """
    if matches is None:
        found, ranked = text_scores(F.col("content"), text, analyzer)
        either = chunks.withColumn("_match", found)
    else:
        told = matches.select(F.col("chunk_id").alias("_chunk"), F.col("score").alias("_score"))
        either, ranked = chunks.join(told, F.col("id") == F.col("_chunk"), "left").withColumn("_match", F.col("_score").isNotNull()), F.col("_score")
    either = either.where(F.col("embedding").isNotNull() | F.col("_match"))
    vector = F.coalesce(cosine_to(F.col("embedding"), query), F.lit(0.0))
    scored = either.withColumn("vector_similarity", vector).withColumn("text_similarity", F.when(F.col("_match"), ranked).otherwise(0.0))
    combined = F.col("vector_similarity") * (1 - text_weight) + F.col("text_similarity") * text_weight
    top = scored.select(F.col("id").alias("chunk_id"), "document_id", "content", combined.alias("combined_score"), "vector_similarity", "text_similarity", "metadata")
    return _titled(top.orderBy(F.desc("combined_score"), "chunk_id").limit(k), documents, "combined_score")


def as_results(hits: DataFrame, score: str) -> DataFrame:
    """Hits with their score held to 0..1, as results are shown."""
    return hits.withColumn("score", clamp(F.col(score))).drop(score)


def query_vector(text: str, provider: Provider, config: EmbeddingConfig = EmbeddingConfig()) -> list[float]:
    """The vector of a query's text, cut and tried again like any other; blank text gives zeros, and a failure is raised."""
    ((vector, error),) = embed_batch([text], provider, config)
    if error is not None:
        raise RuntimeError(error)
    return [float(x) for x in vector]


def search_vector(chunks: DataFrame, documents: DataFrame, text: str, provider: Provider, config: EmbeddingConfig = EmbeddingConfig(), limit: int = 10) -> DataFrame:
    """The best ``limit`` (1 to 50) chunks for a text, with scores held to 0..1, best first. Vectors of another length than the model's count as missing."""
    hits = vector_topk(_of_model(chunks, config), documents, query_vector(text, provider, config), checked_limit(limit))
    return as_results(hits, "similarity")


def search_hybrid(chunks: DataFrame, documents: DataFrame, text: str, provider: Provider, config: EmbeddingConfig = EmbeddingConfig(), limit: int = 10, text_weight: float = 0.3, analyzer: Analyzer = simple_analyzer) -> DataFrame:
    """The same by vectors and words; the weight of words is 0 to 1."""
    if not 0 <= text_weight <= 1:
        raise ValueError("text_weight must be between 0 and 1")
    hits = hybrid_topk(_of_model(chunks, config), documents, query_vector(text, provider, config), text, checked_limit(limit), text_weight, analyzer)
    return as_results(hits, "combined_score")


def search_graph(entities: DataFrame, edges: DataFrame, text: str, provider: Provider, config: EmbeddingConfig = EmbeddingConfig(), nearest: int = NEAREST) -> DataFrame:
    """Facts about the entities nearest to a text. Name vectors of another length than the model's count as missing."""
    fit = entities.withColumn("name_embedding", F.when(check_dimension(F.col("name_embedding"), config.dimension), F.col("name_embedding")))
    return graph_search(fit, edges, query_vector(text, provider, config), nearest)


def or_nothing(search: Callable[[], DataFrame], failed: Callable[[str], None] | None = None) -> DataFrame | None:
    """What a search finds, as a written table; None if it fails, after ``failed`` was told why. An agent goes on without it."""
    try:
        return cut(search(), "found")
    except Exception as e:  # the caller's other tools are worth having
        if failed is not None:
            failed(str(e).split("\n")[0])
        return None


def _of_model(chunks: DataFrame, config: EmbeddingConfig) -> DataFrame:
    return chunks.withColumn("embedding", F.when(check_dimension(F.col("embedding"), config.dimension), F.col("embedding")))


def count_documents(documents: DataFrame, metadata_filter: dict | None = None) -> DataFrame:
    """One row: ``total``, the number of documents that a listing goes through, whatever its page."""
    if metadata_filter:
        documents = documents.where(json_contains(F.col("metadata"), metadata_filter))
    return documents.agg(F.count("*").alias("total"))

def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Count, mean and sum of tokens by document, before any join with the wide documents."""
    return chunks.groupBy("document_id").agg(F.count("id").alias("chunk_count"), F.avg("token_count").alias("avg_tokens_per_chunk"), F.sum("token_count").alias("total_tokens"))


def list_documents(documents: DataFrame, chunks: DataFrame, limit: int = 100, offset: int = 0, metadata_filter: dict | None = None) -> DataFrame:
    """A page of documents, newest first, with their numbers of chunks; optionally those whose metadata contain an object."""
    if metadata_filter:
        documents = documents.where(json_contains(F.col("metadata"), metadata_filter))
    # a page is small, and is needed for its ids and again for its rows
    page = cut(documents.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit), "page")
    counts = chunks.join(page.select(F.col("id").alias("document_id")), "document_id", "left_semi").groupBy("document_id").agg(F.count("id").alias("chunk_count"))
    return page.join(counts, F.col("id") == F.col("document_id"), "left").select("id", "title", "source", "metadata", "created_at", "updated_at", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count")).orderBy(F.desc("created_at"), "id")


def document_summaries(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """All documents with count, mean and sum of their chunks' tokens; 0, null and null without chunks."""
    counts = chunk_counts(chunks)
    joined = documents.join(counts, F.col("id") == F.col("document_id"), "left")
    return joined.select("id", "title", "source", "created_at", "updated_at", "metadata", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "avg_tokens_per_chunk", "total_tokens")


def kept_summaries(documents: DataFrame, totals: DataFrame) -> DataFrame:
    """The same from sums that a store kept (``Snapshot.totals``), so that no chunk is read."""
    joined = documents.join(totals, F.col("id") == F.col("document_id"), "left")
    return joined.select("id", "title", "source", "created_at", "updated_at", "metadata", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "avg_tokens_per_chunk", "total_tokens")


def document_chunks(chunks: DataFrame, document_id) -> DataFrame:
    """A document's chunks in order; none for an unknown id."""
    return chunks.where(F.col("document_id") == document_id).orderBy("chunk_index").select(F.col("id").alias("chunk_id"), "content", "chunk_index", "metadata")


def get_document(documents: DataFrame, chunks: DataFrame, document_id) -> DataFrame:
    """A document with the array of its chunks in order; no row for an unknown id."""
    own = chunks.where(F.col("document_id") == document_id).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", F.col("id").alias("chunk_id"), "content"))).alias("chunks"))
    found = documents.where(F.col("id") == document_id).join(own, F.col("id") == F.col("document_id"), "left")
    return found.select("id", "title", "source", "content", "metadata", "created_at", "updated_at", F.coalesce("chunks", F.array().cast(own.schema["chunks"].dataType)).alias("chunks"))


def comprehensive_search(vector: Callable[[], DataFrame] | None, graph: Callable[[], DataFrame] | None) -> DataFrame:
    """Vector hits (chunk_id, content, similarity) and graph facts (uuid, fact) in one frame: leg, id, text, score, error and total_results.

    Either search may be left out. Each runs by itself, so that one that fails leaves the other's results, and a row of its own
    with its error; total_results counts results, not errors.
    """
    if vector is None and graph is None:
        raise ValueError("no search was asked for")
    shape = "leg string, id string, text string, score double, error string"
    columns = {
        "vector": ("chunk_id", "content", F.col("similarity").cast("double") if vector else None),
        "graph": ("uuid", "fact", F.lit(None).cast("double")),
    }
    legs, failed = [], []
    for leg, search in (("vector", vector), ("graph", graph)):
        if search is None:
            continue
        id, text, score = columns[leg]
        try:
            legs.append(cut(search().select(F.lit(leg).alias("leg"), F.col(id).cast("string").alias("id"), F.col(text).alias("text"), score.alias("score"), F.lit(None).cast("string").alias("error")), leg))
        except Exception as e:  # the other search's results are worth having
            failed.append((leg, None, None, None, str(e).split("\n")[0]))
    total = sum(x.count() for x in legs)
    if failed:
        legs.append(SparkSession.active().createDataFrame(failed, shape))
    return reduce(DataFrame.unionByName, legs).withColumn("total_results", F.lit(total).cast("long"))


def run_sql(spark, query: str, *args) -> DataFrame:
    """Any SQL with positional parameters."""
    return spark.sql(query, args=list(args)) if args else spark.sql(query)
