"""Streaming ingestion of a folder (an extra): new files become documents and chunks, and sessions end by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sedge.functions.chunking import ChunkConfig
from sedge.operators.store import Store
from sedge.plans.ingest import chunk_documents
from sedge.sources.files import PATTERN, as_documents, as_texts

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_texts(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Text files of a folder as a stream, each once."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", PATTERN).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return as_texts(files, folder)


def ingest_stream(texts: DataFrame, store: Store, checkpoint: str, config: ChunkConfig = ChunkConfig()) -> StreamingQuery:
    """Upsert every batch into the store. Ids are those of the sources, so a batch that is repeated after a failure changes nothing.

    A batch writes its own rows and the ids that it replaces; small folders are merged as they add up.
    """

    def take(batch: DataFrame, _: int) -> None:
        documents = as_documents(batch)
        store.upsert_documents(documents, chunk_documents(documents, config))
        store.compact()

    return texts.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ended_sessions(events: DataFrame, minutes: int = 60) -> DataFrame:
    """(session_id, messages, last_at) of sessions without a message for so long, from a stream of (session_id, created_at) with a watermark."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, last = state.get
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "messages": [n], "last_at": [pd.Timestamp(last, unit="ms")]})
            return
        n, last = state.get if state.exists else (0, 0)
        for pdf in rows:
            n += len(pdf)
            last = max(last, int(pdf["created_at"].max().timestamp() * 1000))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last + minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    kind = events.schema["session_id"].dataType.simpleString()
    return events.groupBy("session_id").applyInPandasWithState(step, f"session_id {kind}, messages long, last_at timestamp", "messages long, last_ms long", "append", GroupStateTimeout.EventTimeTimeout)
