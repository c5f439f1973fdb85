"""Hard negatives by product quantisation: lookup-table scores, give or take a bound from stored residual norms, leave the rows to score exactly.

Every row is stored with the codes of its sub-vectors and the length of what the codes leave over. The inner product of an anchor with the
coded row comes from tables, and differs from the true one by at most the product of the two lengths; so rows that can't be among the first of
a window are told without a look at their vectors, and the rest are scored in integers. Anchors and rows meet in cells of bounded size, each of which gives
a few rows for every window, and those meet in a window function.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sedge.llm.pq import k_means
from sedge.runtime import cut

SAMPLE = 8_192
#: Components of a sub-vector, and codes for it.
WIDTH = 2
CODES = 256
ROWS = 8_192
ANCHORS = 4_096
#: Numbers in a matrix that is made at once.
MATRIX = 2_000_000
#: Scores of vectors of up to this squared length are whole numbers that double precision holds.
MOST_SQUARE = float(2**53)
SCALE = 256


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1).astype(np.float64)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


class Codebooks:
    """Codebooks of consecutive sub-vectors, fitted on a sample."""

    def __init__(self, sample: np.ndarray):
        self.parts = [slice(at, at + WIDTH) for at in range(0, sample.shape[1], WIDTH)]
        self.books = [k_means(sample[:, p], CODES, rounds=5, seed=i) for i, p in enumerate(self.parts)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length of the residual) of rows."""
        codes, square = np.zeros((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for m, (p, book) in enumerate(zip(self.parts, self.books)):
            for at in range(0, len(x), max(1, MATRIX // len(book))):
                some = x[at : at + max(1, MATRIX // len(book)), p]
                codes[at : at + len(some), m] = ((book * book).sum(1)[None] - 2 * some @ book.T).argmin(1)
            square += ((x[:, p] - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(square)

    def scores(self, anchors: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products of anchors with coded rows, by table lookup."""
        total = np.zeros((len(anchors), len(codes)))
        for p, book, c in zip(self.parts, self.books, codes.T):
            total += (anchors[:, p] @ book.T)[:, c]
        return total


def _first(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by score, ties by id and then by row."""
    return np.lexsort((rows, ids, -scores))[:k]


def _least_of_first(low: np.ndarray, k: int) -> float:
    """What k rows reach at least."""
    return np.partition(low, -k)[-k] if len(low) >= k else -np.inf


class Cell:
    """Rows of a cell, and bounds of their scores for one anchor after another."""

    def __init__(self, cell: pa.Table, model: Codebooks):
        asks = _numbers(cell["asks"])
        own, self.asked = cell.filter(pa.array(~asks)), cell.filter(pa.array(asks))
        self.empty = not len(own) or not len(self.asked)
        if self.empty:
            return
        self.x, self.rows, self.ids, self.labels = _vectors(own["vec"]), _numbers(own["row"]), _numbers(own["id"]), own["label"].combine_chunks().dictionary_encode()
        self.label_names = self.labels.dictionary.to_pylist()
        self.labels = self.labels.indices.to_numpy()
        self.codes = np.frombuffer(b"".join(own["codes"].to_pylist()), np.uint8).reshape(len(own), -1)
        self.rest, self.model = _numbers(own["rest"]), model

    def anchors(self):
        """(number, vector, row, least scores, greatest scores) of each anchor."""
        q, rows = _vectors(self.asked["vec"]), _numbers(self.asked["row"])
        length = np.sqrt((q * q).sum(1))
        longest = np.sqrt((self.x * self.x).sum(1)).max()
        step = max(1, MATRIX // len(self.x))
        for start in range(0, len(q), step):
            some = slice(start, start + step)
            about = self.model.scores(q[some], self.codes)
            # the lookup's own rounding is far below a millionth of the lengths' product
            off = length[some, None] * (self.rest[None] + 1e-6 * longest)
            for i in range(len(about)):
                yield start + i, q[start + i], rows[start + i], about[i] - off[i], about[i] + off[i]

    def exact(self, anchor: np.ndarray, some: np.ndarray) -> np.ndarray:
        return (self.x[some] @ anchor).astype(np.int64)


def _nearest(model: dict[int, Codebooks], k: int):
    """Arrow function of a cell of one label: each anchor's k first other rows."""

    def run(cell: pa.Table) -> pa.Table:
        here = Cell(cell, model[cell["size"][0].as_py()])
        out: list[tuple] = []
        if not here.empty:
            for _, q, row, low, high in here.anchors():
                other = here.rows != row
                some = np.flatnonzero(other & (high >= _least_of_first(low[other], k)))
                scores = here.exact(q, some)
                for at in _first(scores, here.ids[some], here.rows[some], k):
                    out.append((row, here.ids[some[at]], here.rows[some[at]], scores[at]))
        columns = list(zip(*out)) or [[]] * 4
        return pa.table({n: pa.array(np.asarray(c, np.int64)) for n, c in zip(("anchor_row", "id", "row", "score"), columns)})

    return run


def _windowed(model: dict[int, Codebooks], k: int, least: int, most: int):
    """Arrow function of a cell of any labels: for each anchor's positives, the k first rows of other labels within ``least`` to ``most`` per cent of the positive's score."""

    def run(cell: pa.Table) -> pa.Table:
        here = Cell(cell, model[cell["size"][0].as_py()])
        out: list[tuple] = []
        if not here.empty:
            labels, wanted = here.asked["label"].to_pylist(), here.asked["wanted"].to_pylist()
            for i, q, row, low, high in here.anchors():
                other = here.labels != (here.label_names.index(labels[i]) if labels[i] in here.label_names else -1)
                for positive in wanted[i]:
                    at_least, at_most = least * positive["score"] / 100, most * positive["score"] / 100
                    sure = other & (low >= at_least) & (high <= at_most)
                    some = np.flatnonzero(other & (high >= max(at_least, _least_of_first(low[sure], k))) & (low <= at_most))
                    scores = here.exact(q, some)
                    inside = (least * positive["score"] <= 100 * scores) & (100 * scores <= most * positive["score"])
                    some, scores = some[inside], scores[inside]
                    for at in _first(scores, here.ids[some], here.rows[some], k):
                        out.append((row, positive["rank"], here.ids[some[at]], here.rows[some[at]], scores[at]))
        columns = list(zip(*out)) or [[]] * 5
        return pa.table({n: pa.array(np.asarray(c, np.int64)) for n, c in zip(("anchor_row", "positive", "id", "row", "score"), columns)})

    return run


def _cells(rows: DataFrame, asked: DataFrame, by: list[str], n_rows: int, n_anchors: int) -> DataFrame:
    """Rows and anchors dealt into blocks within ``by``, so that each block of one meets each of the other in a cell."""
    blocks = lambda df, size, name: df.groupBy(*by).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    counts = blocks(rows, n_rows, "m").join(blocks(asked, n_anchors, "a"), by)
    deal = lambda name: F.pmod(F.xxhash64("row"), F.col(name)).cast("int")
    all_of = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = rows.join(counts, by).withColumn("j", deal("m")).withColumn("i", all_of("a")).withColumn("asks", F.lit(False))
    right = asked.join(counts, by).withColumn("i", deal("a")).withColumn("j", all_of("m")).withColumn("asks", F.lit(True))
    return left.unionByName(right, allowMissingColumns=True).drop("m", "a")


def _encoded(model: dict[int, Codebooks]):
    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = _numbers(table["size"])
            for size in np.unique(sizes):
                part = table.filter(pa.array(sizes == size))
                codes, rest = model[int(size)].encode(_vectors(part["vec"]))
                part = part.append_column("codes", pa.array([c.tobytes() for c in codes], pa.binary())).append_column("rest", pa.array(rest))
                yield from part.to_batches()

    return run


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: int = SCALE, rows: int = ROWS, asked: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors(vec_id, label, embedding).

    A component x counts as floor(scale * x) in double precision, and a score is the integer inner product of two rows of one length. Rows for which the condition ``anchors`` holds
    are anchors. An anchor's positives are the ``positives`` first other rows of its label, and a positive's negatives the ``negatives`` first
    rows of other labels whose score is from ``least`` to ``most`` per cent of the positive's; first by score, then by smaller vec_id, null last.
    Rows take no part if the label or the vector is null, the vector is empty, any component is null or not finite, or the squared length of the
    scaled vector reaches 2**53, beyond which scores would not be exact. Vectors of different lengths are never compared. Rows that repeat a vec_id are rows of
    their own, so one may be the other's positive. Other columns are ignored; an empty table gives no rows.

    Codebooks are fitted for each length on SAMPLE rows of least hash; every row is coded. They only tell which rows need an exact score, and change no result.
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * scale).cast("double"), 2))
    valid = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & good & (square < MOST_SQUARE))
    last = (1 << 63) - 1
    kept = valid.select("vec_id", F.coalesce(F.col("vec_id").cast("long"), F.lit(last)).alias("id"), "label", F.size("embedding").alias("size"), F.transform(whole, lambda x: x.cast("int")).alias("vec"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    kept = cut(kept.withColumn("row", F.monotonically_increasing_id()), "scaled")
    model = {}
    for size in [r["size"] for r in kept.select("size").distinct().limit(65).collect()]:
        chosen = kept.where(F.col("size") == size).orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("vec").collect()
        model[size] = Codebooks(np.array([r["vec"] for r in chosen], np.float64))
    if len(model) > 64:
        raise ValueError("vectors have more than 64 different lengths")
    kind = vectors.schema["label"].dataType.simpleString()
    index = cut(kept.drop("vec_id").mapInArrow(_encoded(model), f"id long, label {kind}, size int, vec array<int>, anchor boolean, row long, codes binary, rest double"), "coded")
    ids = kept.select("row", "vec_id")
    asking = index.where("anchor").select("id", "label", "size", "vec", "row")
    stored = index.drop("anchor")
    near = _cells(stored, asking, ["label", "size"], rows, asked).groupBy("label", "size", "i", "j").applyInArrow(_nearest(model, positives), "anchor_row long, id long, row long, score long")
    place = F.row_number().over(Window.partitionBy("anchor_row").orderBy(F.desc("score"), "id", "row"))
    near = cut(near.withColumn("positive", place.cast("long")).where(F.col("positive") <= positives), "positives")
    wanted = near.groupBy(F.col("anchor_row").alias("row")).agg(F.collect_list(F.struct(F.col("positive").alias("rank"), "score")).alias("wanted"))  # at most ``positives`` each
    found = _cells(stored, asking.join(wanted, "row"), ["size"], rows, asked).groupBy("size", "i", "j").applyInArrow(_windowed(model, negatives, least, most), "anchor_row long, positive long, id long, row long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor_row", "positive").orderBy(F.desc("score"), "id", "row"))
    found = cut(found.withColumn("rank", rank).where(F.col("rank") <= negatives), "negatives")
    named = lambda df, row, name: df.join(ids.select(F.col("row").alias("_row"), F.col("vec_id").alias(name)), F.col(row) == F.col("_row")).drop("_row")
    chosen = named(near.select("anchor_row", "positive", F.col("row").alias("positive_row"), F.col("score").alias("positive_score")), "positive_row", "positive_id")
    out = found.select("anchor_row", "positive", "rank", F.col("row").alias("negative_row"), F.col("score").alias("negative_score")).join(chosen, ["anchor_row", "positive"])
    out = named(named(out, "negative_row", "negative_id"), "anchor_row", "anchor_id")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
