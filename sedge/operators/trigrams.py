"""Search by trigrams: parts of texts and alike texts, found in the postings of a store whose analyzer is :func:`trigram_analyzer` and verified on the texts.

A word's trigrams are those of itself with two blanks before it and one behind, so words of any length have some. A text that holds a pattern holds the trigrams inside the
pattern's words; a text of a similarity, the trigrams that both have among all that either has, holds at least that share of the query's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from sedge.functions.text import TOKEN, query_terms, tokens
from sedge.operators.postings import slots


def grams(word: Column) -> Column:
    """The trigrams of a padded word."""
    return F.transform(F.sequence(F.lit(1), F.length(word) - 2), lambda i: F.substring(word, i, 3))


def trigram_analyzer(words: Column) -> Column:
    """The trigrams of all words; each but its first place in a text tells nothing more."""
    return F.flatten(F.transform(words, lambda w: grams(F.concat(F.lit("  "), w, F.lit(" ")))))


def similarity(text: Column, query: Column) -> Column:
    """Trigrams that two texts share among all that either has; 0 if neither has any."""
    a, b = F.array_distinct(tokens(text, trigram_analyzer)), F.array_distinct(tokens(query, trigram_analyzer))
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def _candidates(snapshot, wanted: list[str], least: int) -> DataFrame:
    """(chunk_id) of the chunks that hold at least ``least`` of some different trigrams."""
    rows = snapshot.read("postings", keys=wanted).where(F.col("lexeme").isin(wanted))
    found = slots(rows).groupBy("file", "part", "slot").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return found.join(snapshot.read("shares"), ["file", "part", "slot"]).select("chunk_id")


def containing(snapshot, pattern: str) -> DataFrame:
    """The chunks whose content holds ``pattern``, letter case aside, as they are in the store.

    A pattern without three letters or digits in a row names no trigram, so then all texts are looked at.
    """
    runs = snapshot.store.spark.range(1).select(F.regexp_extract_all(F.lower(F.lit(pattern)), F.lit(TOKEN), F.lit(0)).alias("r")).first()["r"]
    wanted = sorted({run[i : i + 3] for run in runs for i in range(len(run) - 2)})
    chunks = snapshot.read("chunks")
    if wanted:
        chunks = chunks.join(_candidates(snapshot, wanted, len(wanted)), F.col("id") == F.col("chunk_id"), "left_semi")
    return chunks.where(F.contains(F.lower("content"), F.lower(F.lit(pattern))))


def alike(snapshot, text: str, threshold: float = 0.3) -> DataFrame:
    """(chunk_id, document_id, content, similarity) of the chunks whose similarity to ``text`` is at least ``threshold``, above 0."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    wanted = snapshot.store.spark.range(1).select(query_terms(F.lit(text), trigram_analyzer).alias("g")).first()["g"]
    chunks = snapshot.read("chunks").select(F.col("id").alias("chunk_id"), "document_id", "content")
    if not wanted:
        return chunks.withColumn("similarity", F.lit(0.0)).limit(0)
    found = chunks.join(_candidates(snapshot, wanted, max(1, math.ceil(threshold * len(wanted) - 1e-9))), "chunk_id", "left_semi")
    return found.withColumn("similarity", similarity(F.col("content"), F.lit(text))).where(F.col("similarity") >= threshold)
