"""Embedding of texts by a pluggable provider, each different text once."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sedge.runtime import cut

#: Takes texts, returns a vector for each; it may raise RateLimited.
Provider = Callable[[list[str]], list[list[float]]]
# Dimensions and longest input in tokens of known models, and of any other.
MODELS = {
    "text-embedding-3-small": (1536, 8191),
    "text-embedding-3-large": (3072, 8191),
    "text-embedding-ada-002": (1536, 8191),
    "nomic-embed-text-v2-moe:latest": (768, 512),
}
OTHER_MODEL = (1536, 8191)
CHARS_PER_TOKEN = 4


class RateLimited(RuntimeError):
    """The provider asks to wait."""


@dataclass(frozen=True)
class EmbeddingConfig:
    model: str = "nomic-embed-text-v2-moe:latest"
    batch: int = 100
    tries: int = 3
    delay: float = 1.0
    #: Dimension of a model that is in no table.
    size: int | None = None

    @property
    def dimension(self) -> int:
        return self.size or MODELS.get(self.model, OTHER_MODEL)[0]

    @property
    def most_chars(self) -> int:
        return MODELS.get(self.model, OTHER_MODEL)[1] * CHARS_PER_TOKEN


def hashing_provider(dimension: int) -> Provider:
    """A deterministic provider without a model: unit vectors from hashed words, so equal texts are equal and shared words draw near."""

    def one(text: str) -> list[float]:
        v = [0.0] * dimension
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            v[h % dimension] += 1.0 if h >> 63 else -1.0
        norm = sum(x * x for x in v) ** 0.5
        return [x / norm for x in v] if norm else v

    return lambda texts: [one(t) for t in texts]


def embed_batch(texts: list[str | None], provider: Provider, config: EmbeddingConfig, sleep=time.sleep) -> list[tuple[list[float], str | None]]:
    """(vector, error) for each text. Long texts are cut at the model's limit, blank ones get a zero vector.

    A batch is tried again, waiting twice as long each time when the limit of calls is hit; if it goes on failing for another reason its texts
    are tried one by one, and what still fails gets a zero vector and the error. A limit that lasts is raised.
    """
    zero = [0.0] * config.dimension
    ready = [(t or "")[: config.most_chars] for t in texts]

    def attempt(some: list[str]) -> list[list[float]]:
        for n in range(config.tries):
            try:
                return provider(some)
            except RateLimited:
                if n == config.tries - 1:
                    raise
                sleep(config.delay * 2**n)
            except Exception:
                if n == config.tries - 1:
                    raise
                sleep(config.delay)
        return []

    try:
        found = [(v, None) for v in attempt(ready)]
    except RateLimited:
        raise
    except Exception:
        found = []
        for t in ready:
            try:
                found.append((attempt([t])[0] if t.strip() else zero, None))
            except Exception as e:  # the error is kept beside the row
                found.append((zero, str(e)))
    return [(zero, e) if not t.strip() else (v, e) for t, (v, e) in zip(ready, found)]


def embed(rows: DataFrame, provider: Provider, config: EmbeddingConfig = EmbeddingConfig(), text: str = "content") -> DataFrame:
    """``rows`` with embedding, embedding_model, embedding_generated_at and embedding_error. Equal texts are embedded once, found by the md5 of the text."""
    keyed = rows.withColumn("_key", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    once = keyed.groupBy("_key").agg(F.any_value(F.coalesce(F.col(text), F.lit(""))).alias("_text"))

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), config.batch):
                part = pdf.iloc[at : at + config.batch]
                done = embed_batch(part["_text"].tolist(), provider, config)
                yield pd.DataFrame({"_key": part["_key"].tolist(), "embedding": [v for v, _ in done], "embedding_error": [e for _, e in done]})

    vectors = once.mapInPandas(run, "_key string, embedding array<float>, embedding_error string")
    return keyed.drop("embedding").join(vectors, "_key", "left").drop("_key").withColumn("embedding_model", F.lit(config.model)).withColumn("embedding_generated_at", F.current_timestamp())


CACHE = "key string, model string, embedding array<float>, used_at timestamp"


def embed_cached(rows: DataFrame, provider: Provider, path: str, config: EmbeddingConfig = EmbeddingConfig(), text: str = "content", keep: int | None = None) -> DataFrame:
    """The same as :func:`embed`, with a table at ``path`` of what earlier calls made, by the text's md5 and the model; the provider sees only texts that are not there.

    Each call writes a folder with its texts' vectors and the time, new ones and those that it found, and the rows come from it; failures are not kept, so they are tried again. With ``keep``
    only the so many folders written last are looked at and the rest deleted, so what no call has used for so long goes.
    """
    spark = rows.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    made = sorted((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(root) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))) if fs.exists(root) else []
    folders = [name for _, name in made]
    kept = folders if keep is None else folders[max(0, len(folders) - keep) :]
    keyed = rows.withColumn("_md5", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    once = keyed.groupBy("_md5").agg(F.any_value(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    old = spark.read.schema(CACHE).parquet(*[f"{path}/{k}" for k in kept]) if kept else spark.createDataFrame([], CACHE)
    old = old.where(F.col("model") == config.model).groupBy("key").agg(F.max_by("embedding", "used_at").alias("embedding"))
    found = once.join(old, F.col("_md5") == F.col("key")).select("_md5", "embedding", F.lit(None).cast("string").alias("embedding_error"))
    fresh = embed(once.join(old, F.col("_md5") == F.col("key"), "left_anti"), provider, config, "_text").select("_md5", "embedding", "embedding_error")
    done = cut(found.unionByName(fresh), "embedded")
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    done.where("embedding_error IS NULL").select(F.col("_md5").alias("key"), F.lit(config.model).alias("model"), "embedding", F.current_timestamp().alias("used_at")).write.parquet(f"{path}/{name}")
    for gone in folders[: len(folders) - len(kept)]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{gone}"), True)
    return keyed.drop("embedding").join(done, "_md5", "left").drop("_md5").withColumn("embedding_model", F.lit(config.model)).withColumn("embedding_generated_at", F.current_timestamp())


def embed_missing(entities: DataFrame, provider: Provider, config: EmbeddingConfig = EmbeddingConfig()) -> DataFrame:
    """Entities with name vectors, made only where there is none, and summary vectors of all summaries that are not blank."""
    bare = embed(entities.where(F.coalesce(F.size("name_embedding"), F.lit(0)) <= 0), provider, config, "name")
    bare = bare.select(*[F.col("embedding").alias(c) if c == "name_embedding" else F.col(c) for c in entities.columns])
    named = entities.where(F.size("name_embedding") > 0).unionByName(bare)
    told = embed(named.where(F.trim(F.coalesce("summary", F.lit(""))) != "").select("name_key", "summary"), provider, config, "summary").select("name_key", F.col("embedding").alias("summary_embedding"))
    return named.join(told, "name_key", "left")
