"""Postings of chunks by lexeme, and full-text search that opens the postings of its terms alone.

Chunks are numbered where they lie: a share is BLOCK rows in a row of one file of the store, and a chunk's slot is its place in the share. A row of postings is what one lexeme has in one share: slots,
positions, and the greatest number of occurrences in a chunk. So rows are made where the texts are read, a frequent lexeme has many rows of bounded size, and what the best chunk of a
share can reach is bounded by its rows' heads. The names of the slots are a table of their own, from which deleted documents are missing; postings are never rewritten for them.
Rows lie in order of lexeme and share, positions are delta-coded by the file format.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sedge.functions.text import LEXEME_WEIGHT, Analyzer, cover_sum, query_terms, simple_analyzer, tokens

#: ``data`` has the number of slots, the slots, where each slot's positions end, and the positions; most lexemes have one slot and one position in a share, so one array is all they carry.
POSTINGS = "lexeme string not null, file long not null, part int not null, most int not null, data array<int> not null"
SHARES = "file long not null, part int not null, slot int not null, chunk_id string not null, document_id string not null"
#: Chunks of a share.
BLOCK = 1024
#: Shares that are scored first, to learn what the others have to reach.
FIRST_SHARES = 4
#: Shares that are named to the reader, so that it skips the pages of others; more are told by a join.
NAMED = 1_000


def _numbered(chunks: DataFrame) -> DataFrame:
    """Chunks of a folder with their share and slot, which follow from where they lie."""
    row = F.col("_metadata.row_index")
    return chunks.withColumns({"file": F.xxhash64("_metadata.file_path"), "part": F.floor(row / BLOCK).cast("int"), "slot": (row % BLOCK).cast("int")})


def shares(chunks: DataFrame) -> DataFrame:
    """Rows of SHARES of a folder of chunks(id, document_id), as its reader gives them."""
    return _numbered(chunks).select("file", "part", "slot", F.col("id").alias("chunk_id"), "document_id")


def postings(chunks: DataFrame, analyzer: Analyzer = simple_analyzer) -> DataFrame:
    """Rows of POSTINGS of a folder of chunks(content), as its reader gives them. A share that two tasks read has two rows for a lexeme, each with slots of its own."""
    rows = _numbered(chunks).select("file", "part", "slot", tokens(F.col("content"), analyzer).alias("words"))
    return rows.mapInArrow(_by_lexeme, POSTINGS.replace(" not null", ""))


def _by_lexeme(batches):
    """Arrow function of (file, part, slot, words)."""
    for batch in batches:
        file, part = (batch.column(i).to_numpy() for i in (0, 1))
        bounds = np.flatnonzero(np.concatenate([[True], (file[1:] != file[:-1]) | (part[1:] != part[:-1]), [True]])) if len(file) else []
        for at, to in zip(bounds[:-1], bounds[1:]):
            yield from _share_postings(batch.slice(int(at), int(to - at)))


def _share_postings(share: pa.RecordBatch):
    words = share.column(3)
    sizes = words.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    flat = words.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    code = flat.indices.fill_null(-1).to_numpy().astype(np.int64)
    order = np.argsort(code * len(sizes) + row, kind="stable")  # by lexeme, then by slot, then by place
    order = order[code[order] >= 0]
    if not len(order):
        return
    row, place, code = row[order], place[order], code[order]
    lexeme = np.concatenate([[True], code[1:] != code[:-1]])
    slot = lexeme | np.concatenate([[True], row[1:] != row[:-1]])
    first, begins = np.flatnonzero(lexeme), np.flatnonzero(slot)
    ends = np.append(begins[1:], len(row))
    of = np.searchsorted(begins, first)  # the first slot of each lexeme
    counts = np.diff(np.append(of, len(begins)))
    # of each lexeme in turn: its number of slots, the slots, the ends, the places
    sizes = 1 + 2 * counts + np.diff(np.append(first, len(row)))
    starts = np.cumsum(sizes) - sizes
    data = np.zeros(sizes.sum(), np.int32)
    nth = np.arange(len(begins)) - np.repeat(of, counts)
    data[starts] = counts
    data[np.repeat(starts + 1, counts) + nth] = share.column(2).to_numpy()[row[begins]]
    data[np.repeat(starts + 1 + counts, counts) + nth] = ends - np.repeat(first, counts)
    data[np.repeat(starts + 1 + 2 * counts - first, np.diff(np.append(first, len(row)))) + np.arange(len(row))] = place
    yield pa.RecordBatch.from_arrays(
        [
            flat.dictionary.take(pa.array(code[first])), pa.array(np.full(len(first), share.column(0)[0].as_py())), pa.array(np.full(len(first), share.column(1)[0].as_py(), np.int32)),
            pa.array(np.maximum.reduceat(ends - begins, of).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(starts, len(data)).astype(np.int32)), pa.array(data)),
        ],
        ["lexeme", "file", "part", "most", "data"],
    )


def slots(rows: DataFrame) -> DataFrame:
    """(lexeme, file, part, slot, n, places): one row for each chunk that a lexeme is in."""
    n = F.get("data", F.lit(0))
    end = lambda i: F.when(i < 0, 0).otherwise(F.get("data", 1 + n + i))
    one = lambda i: F.struct(F.get("data", 1 + i).alias("slot"), (end(i) - end(i - 1)).alias("n"), F.slice("data", 2 + 2 * n + end(i - 1), end(i) - end(i - 1)).alias("places"))
    return rows.select("lexeme", "file", "part", F.explode(F.transform(F.sequence(F.lit(0), n - 1), one)).alias("p")).select("lexeme", "file", "part", "p.*")


def matched(rows: DataFrame, terms: list[str], named: DataFrame) -> DataFrame:
    """(chunk_id, document_id, score) of the chunks of ``named``, rows of SHARES, that hold every one of ``terms``, which differ."""
    each = slots(rows)
    if len(terms) == 1:
        scored = each.select("file", "part", "slot", (F.col("n") * F.lit(LEXEME_WEIGHT)).alias("score"))
    else:
        number = F.array_position(F.array(*[F.lit(t) for t in terms]), F.col("lexeme")).cast("int")
        chunks = each.groupBy("file", "part", "slot").agg(F.collect_list(F.struct(number.alias("t"), "places")).alias("found")).where(F.size("found") == len(terms))
        hits = F.array_sort(F.flatten(F.transform("found", lambda f: F.transform(f["places"], lambda p: F.struct(p.alias("p"), f["t"].alias("t"))))))
        scored = chunks.select("file", "part", "slot", cover_sum(hits, F.lit(len(terms))).alias("score"))
    return scored.join(named, ["file", "part", "slot"]).select("chunk_id", "document_id", "score")


def terms_of(spark, text: str, analyzer: Analyzer = simple_analyzer) -> list[str]:
    """The different lexemes of a plain query."""
    return spark.range(1).select(query_terms(F.lit(text), analyzer).alias("t")).first()[0]


def search(snapshot, text: str, k: int | None = None, analyzer: Analyzer = simple_analyzer) -> DataFrame:
    """(chunk_id, document_id, score) of a snapshot's chunks that hold all terms of a plain query: the best ``k`` in order, ties (to nine digits) by chunk_id, or all of them.

    Only the terms' buckets are opened. For the best k, the shares of highest bounds are scored first; the k-th best of theirs closes every share whose bound is lower. A bound is that
    of all occurrences being covers: the terms' greatest numbers, less the other terms. A query without terms finds nothing.
    """
    terms = terms_of(snapshot.store.spark, text, analyzer)
    if not terms:
        return snapshot.store.spark.createDataFrame([], "chunk_id string, document_id string, score double")
    rows, named = snapshot.read("postings", keys=terms).where(F.col("lexeme").isin(terms)), snapshot.read("shares")
    if k is None:
        return matched(rows, terms, named)
    best = lambda df: df.orderBy(F.desc(F.round("score", 9)), "chunk_id").limit(k)
    heads = rows.groupBy("file", "part", "lexeme").agg(F.max("most").alias("most")).groupBy("file", "part").agg(F.count("*").alias("n"), F.sum("most").alias("most"))
    reach = heads.where(F.col("n") == len(terms)).select("file", "part", ((F.col("most") - (len(terms) - 1)) * LEXEME_WEIGHT).alias("bound"))
    first = reach.orderBy(F.desc("bound"), "file", "part").limit(FIRST_SHARES).collect()
    seen = best(_scored(rows, named, terms, first)).select("score").collect()
    least = seen[-1]["score"] if len(seen) == k else 0.0
    left = reach.where(F.col("bound") >= least - 1e-9).select("file", "part")  # sums in another order may differ in their last digits
    some = left.limit(NAMED + 1).collect()
    if len(some) <= NAMED:
        return best(_scored(rows, named, terms, some))
    return best(matched(rows.join(left, ["file", "part"], "left_semi"), terms, named))


def _scored(rows: DataFrame, named: DataFrame, terms: list[str], some: list) -> DataFrame:
    """Matches in a few shares, which the reader is told, so that it skips the pages of others."""
    inside = _any_of(some)
    return matched(rows.where(inside), terms, named.where(inside))


def _any_of(some: list) -> Column:
    files = sorted({r["file"] for r in some})
    pairs = F.array(*[F.struct(F.lit(r["file"]).cast("long").alias("file"), F.lit(r["part"]).cast("int").alias("part")) for r in some])
    return F.col("file").isin(files) & F.array_contains(pairs, F.struct("file", "part")) if some else F.lit(False)
