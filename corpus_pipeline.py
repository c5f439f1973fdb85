"""The corpus pipeline: each stage is one operator applied to all that the stage before it kept.

Every stage returns the columns of documents, but for the last, which returns the digests of the encoded texts. A stage's
input is the parquet table that the one before it left, so a lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sedge.llm.bpe import roundtrip
from sedge.llm.lines import dedup_lines
from sedge.llm.mixing import mix_rows
from sedge.llm.omh import near_duplicates, text_hashes
from sedge.llm.quality import host_quality
from sedge.runtime import cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go."""
    return host_quality(docs, extra=COLUMNS).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten sites share go, but from the first document that has them; so does a document that has no other line.

    n_chars follows the text.
    """
    left = dedup_lines(docs).where("n_removed = 0 OR n_lines > n_removed")
    return left.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of least id stays, in as many rows as it came in; so does each row without an id."""
    kept = near_duplicates(docs, hashes=True).where("kept").select(F.col("doc_id").alias("_id"), F.col("h0").alias("_h0"), F.col("h1").alias("_h1")).distinct()
    h0, h1 = text_hashes("text")
    rows = docs.select(*COLUMNS, h0, h1)
    return rows.hint("merge").join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h0") == F.col("_h0")) & (F.col("h1") == F.col("_h1"))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: up to two rows each."""
    return mix_rows(docs).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of tokens, and digests of the ids and of what they decode to."""
    return roundtrip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "source"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]
#: The mix draws by hashes that SQL does not have; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
