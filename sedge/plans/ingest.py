"""Ingestion: documents to chunks, vectors, entities and edges, and the figures of a run."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from sedge.functions.chunking import ChunkConfig, SectionSplitter, chunk_column
from sedge.functions.text import json_merge
from sedge.operators.embedding import EmbeddingConfig, Provider, embed
from sedge.operators.graph import Extractor, entity_records, extract, new_edges, parse_replies, upsert_entities
from sedge.operators.store import Change, Snapshot, Store, everything, upserted
from sedge.runtime import cut
from sedge.sources.files import as_documents, text_files


@dataclass(frozen=True)
class IngestConfig:
    chunks: ChunkConfig = field(default_factory=ChunkConfig)
    simple: bool = False
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)

    def __post_init__(self):
        c = self.chunks
        if not (100 <= c.size <= 5000 and 0 <= c.overlap <= 1000 and 500 <= c.most <= 10000):
            raise ValueError("chunk sizes are out of range")


def chunk_documents(documents: DataFrame, config: ChunkConfig = ChunkConfig(), simple: bool = False, long_section: SectionSplitter | None = None) -> DataFrame:
    """Chunk rows of documents, with ids made of the document's and the index, and metadata that tell of both."""
    method = "simple" if simple or not config.semantic else "semantic"
    made = documents.select(F.col("id").alias("document_id"), "title", "source", F.coalesce("metadata", F.lit("{}")).alias("m"), "created_at", chunk_column(F.col("content"), config, simple, long_section).alias("c"))
    rows = made.select("*", F.size("c").alias("total_chunks"), F.explode("c").alias("x"))
    base = F.to_json(F.struct("title", "source"))
    how = F.to_json(F.struct(F.lit(method).alias("chunk_method")))
    # a document's own metadata win over a simple chunk's method, and lose to a semantic one's
    told = json_merge(json_merge(base, how), F.col("m")) if simple else json_merge(json_merge(base, F.col("m")), how)
    facts = F.to_json(F.struct("total_chunks", F.col("x.split_method").alias("split_method"), F.col("x.start_char").alias("start_char"), F.col("x.end_char").alias("end_char"), F.col("x.true_start").alias("true_start")))
    return rows.select(F.sha2(F.concat_ws("|", F.col("document_id").cast("string"), "x.index"), 256).alias("id"), "document_id", "x.content", F.col("x.index").alias("chunk_index"), json_merge(told, facts).alias("metadata"), "x.token_count", "created_at")


def build_graph(chunks: DataFrame, documents: DataFrame, extractor: Extractor, entities: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, edges, episodes): what the chunks say, merged into ``entities``; episodes has counts and errors by chunk.

    Chunks are taken in order of source, document and index, whatever their place in the cluster. A chunk that fails is recorded and skipped.
    """
    episodes, counts = read_episodes(chunks, documents, extractor)
    return upsert_entities(entities, entity_records(episodes)), new_edges(episodes), counts


def read_episodes(chunks: DataFrame, documents: DataFrame, extractor: Extractor) -> tuple[DataFrame, DataFrame]:
    """(episodes, counts and errors by chunk): what the extractor reads in each chunk. The episodes are written once, as each call has its price."""
    sources = documents.select(F.col("id").alias("document_id"), F.col("source").alias("source_doc"))
    read = parse_replies(extract(chunks.select("document_id", "chunk_index", "content", "created_at"), extractor))
    read = cut(read.join(sources, "document_id").select("document_id", "chunk_index", "source_doc", F.col("chunk_index").cast("string").alias("chunk_id"), "created_at", "entities", "relationships", "error"), "episodes")
    episodes = read.withColumn("ord", F.struct("source_doc", "document_id", "chunk_index"))
    # as many entities as records are sent for a chunk: its own names and those of relationship ends, once each
    sent = entity_records(episodes).groupBy("ord").agg(F.count("*").alias("sent"))
    counts = episodes.join(sent, "ord", "left").select("document_id", "chunk_index", F.coalesce("sent", F.lit(0)).alias("entities_found"), F.size("relationships").alias("relationships_found"), "error")
    return episodes, counts


def run_ingest(documents: DataFrame, provider: Provider, extractor: Extractor | None = None, config: IngestConfig = IngestConfig()) -> dict[str, DataFrame]:
    """documents, chunks with vectors, and if there is an extractor entities, edges and episodes."""
    chunks = cut(embed(chunk_documents(documents, config.chunks, config.simple), provider, config.embedding), "chunks")
    out = {"documents": documents, "chunks": chunks}
    if extractor is not None:
        out["entities"], out["edges"], out["episodes"] = build_graph(chunks, documents, extractor)
    return out


def ingest_folder(folder: str, store: Store, provider: Provider, extractor: Extractor | None = None, config: IngestConfig = IngestConfig(), clean: bool = False) -> DataFrame:
    """Everything from a folder's text files to the store, published as one change; return the figures by document.

    Files that were read before replace what they gave, and keep the time when they were first created. With ``clean`` the same change empties all tables, so what is there stays until
    everything new is ready; without an ``extractor`` the graph is left as it is. What other writers publish meanwhile is kept: entities are
    merged into those of the version that the change is published on.
    """
    documents = cut(as_documents(text_files(store.spark, folder)), "documents")
    chunks = cut(embed(chunk_documents(documents, config.chunks, config.simple), provider, config.embedding), "chunks")
    if extractor is not None:
        episodes, counts = read_episodes(chunks, documents, extractor)
        counts = cut(counts, "counts")

    def build(old: Snapshot) -> Change:
        change = Change(add={"documents": documents, "chunks": chunks}, empty=everything()) if clean else upserted(old, documents, chunks)
        if extractor is not None:
            known = None if clean else old.read("entities")
            change.put["entities"] = upsert_entities(known, entity_records(episodes))
            change.add["edges"] = new_edges(episodes)
            if not clean:
                change.drop["edges"] = documents.select(F.col("source").alias("id"))
        return change

    store.commit(build)
    return document_results(documents, chunks, counts if extractor is not None else None)


def document_results(documents: DataFrame, chunks: DataFrame, episodes: DataFrame | None = None) -> DataFrame:
    """Figures by document: chunks_created, episodes_created, entities_extracted, relationships_created and errors."""
    made = chunks.groupBy("document_id").agg(F.count("*").alias("chunks_created"))
    out = documents.select("id", "title").join(made, F.col("id") == F.col("document_id"), "left").drop("document_id")
    if episodes is None:
        zero = [F.lit(0).cast("long").alias(c) for c in ("episodes_created", "entities_extracted", "relationships_created")]
        return out.select("id", "title", F.coalesce("chunks_created", F.lit(0)).alias("chunks_created"), *zero, F.array().cast("array<string>").alias("errors"))
    told = episodes.groupBy("document_id").agg(F.count(F.when(F.col("error").isNull(), 1)).alias("episodes_created"), F.sum("entities_found").alias("entities_extracted"), F.sum("relationships_found").alias("relationships_created"), F.sort_array(F.collect_list("error")).alias("errors"))
    out = out.join(told, F.col("id") == F.col("document_id"), "left")
    return out.select("id", "title", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks_created", "episodes_created", "entities_extracted", "relationships_created")], F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))


def rollup(results: DataFrame) -> DataFrame:
    """One row of totals over all documents."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("chunks_created", "episodes_created", "entities_extracted", "relationships_created")]
    return results.agg(F.count("*").alias("documents"), *sums, F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("errors"))


def episode_names(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, chunk_index, episode_id, description) of chunks; ids depend on source and index alone, so a repeat is the same episode."""
    named = chunks.join(documents.select(F.col("id").alias("document_id"), "title", "source"), "document_id")
    return named.select("document_id", "chunk_index", F.format_string("%s_%d", "source", "chunk_index").alias("episode_id"), F.format_string("Document: %s (Chunk: %d)", "title", "chunk_index").alias("description"))


def add_text(content: str, source: str, extractor: Extractor, entities: DataFrame, edges: DataFrame, created_at: str) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) with what a single text says merged in."""
    spark = entities.sparkSession
    text = spark.createDataFrame([(content,)], "content string")
    read = parse_replies(extract(text, extractor)).withColumn("source_doc", F.lit(source)).withColumn("chunk_id", F.lit(f"episode_{created_at}")).withColumn("created_at", F.to_timestamp(F.lit(created_at))).withColumn("ord", F.lit(0))
    read = cut(read.where("error IS NULL").select("ord", "source_doc", "chunk_id", "created_at", "entities", "relationships"), "episode")
    fresh = new_edges(read)
    return upsert_entities(entities, entity_records(read)), edges.unionByName(fresh.select(*edges.columns))
