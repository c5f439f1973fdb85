"""Embedding near-dedup by product quantisation: coarse lists, residual codes, table-lookup distances, exact rerank.

The coarse lists are the cells of k-means centres; where there would be more than MAX_LISTS, they are the pairs of cells of
two halves of the vector, so that a model of a few thousand centres makes millions of lists of the same size.

Equal vectors of one label form a class first, and only its representative is indexed. Every representative sits in the
list of its nearest coarse centroid with the codes of its residual, and asks every list that can hold a vector within
reach. Within a list, table-lookup distances discard all pairs that the stored quantisation error proves
to be out of reach, and the rest are compared exactly in double precision. Lists are dealt out in blocks of bounded size, and a
block yields counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sedge.operators.components import components
from sedge.runtime import cut

SAMPLE = 20_000
LIST_SIZE = 1_000
#: Centres of one k-means; more lists are pairs.
MAX_LISTS = 2_048
SUBSPACES = 8
CODES = 256
BLOCK = 4_096
#: Numbers in a matrix that is made at once, so that memory does not grow with rows times lists.
MATRIX = 4_000_000
#: How far past its own cell a vector asks, in the direction of another centroid; the links' full reach at cosine 0.98 is 0.2,
#: of which a difference in any one of 64 directions has 0.025 on average. reach=0.2 misses nothing, at several times the work.
PROBE_REACH = 0.1
COSINE = 0.98


def _near(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


def _blocks(rows: int, width: int):
    """Slices of rows such that rows times width stays below MATRIX."""
    step = max(1, MATRIX // max(1, width))
    return (slice(at, at + step) for at in range(0, rows, step))


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, squared distance to it) of each row."""
    own, d = np.zeros(len(x), np.int64), np.zeros(len(x))
    for part in _blocks(len(x), len(centres)):
        all_d = _near(x[part], centres)
        own[part] = all_d.argmin(1)
        d[part] = all_d.min(1)
    return own, d


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Lloyd's centres of a bounded sample; an empty cell takes the row furthest from its centre."""
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own, d = _nearest(x, centres)
        order = own.argsort(kind="stable")
        n = np.bincount(own, minlength=k)
        filled = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[filled])[:-1]]))
        centres = x[d.argsort()[::-1][:k]].copy()
        centres[filled] = sums / n[filled][:, None]
    return centres


class Quantizer:
    """Coarse centroids and residual codebooks for unit vectors of one length, fitted on a sample."""

    def __init__(self, sample: np.ndarray, lists: int):
        dim = sample.shape[1]
        halves = 1 if lists <= MAX_LISTS or dim < 2 else 2
        self.halves = np.array_split(np.arange(dim), halves)
        each = lists if halves == 1 else min(MAX_LISTS, math.ceil(math.sqrt(lists)))
        self.coarse = [k_means(sample[:, h], each) for h in self.halves]
        residual = sample - self._centre(self._cells(sample))
        self.parts = np.array_split(np.arange(dim), min(SUBSPACES, dim))
        self.books = [k_means(residual[:, p], CODES, seed=1 + i) for i, p in enumerate(self.parts)]

    def _cells(self, unit: np.ndarray) -> list[np.ndarray]:
        return [_nearest(unit[:, h], c)[0] for h, c in zip(self.halves, self.coarse)]

    def _centre(self, cells: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([c[own] for c, own in zip(self.coarse, cells)], 1)

    def _number(self, cells) -> np.ndarray:
        """The number of a list from its cells in the halves."""
        number = cells[0]
        for c, k in zip(self.coarse[1:], cells[1:]):
            number = number * len(c) + k
        return number

    def centre(self, number: int) -> np.ndarray:
        cells = []
        for c in self.coarse[:0:-1]:
            number, k = divmod(number, len(c))
            cells.append(k)
        return np.concatenate([c[k] for c, k in zip(self.coarse, [number, *cells[::-1]])])

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, error): error is the distance from the vector to its reconstruction."""
        cells = self._cells(unit)
        residual = unit - self._centre(cells)
        codes = np.stack([_nearest(residual[:, p], b)[0] for p, b in zip(self.parts, self.books)], 1)
        rebuilt = np.concatenate([b[c] for b, c in zip(self.books, codes.T)], 1)
        return self._number(cells), codes.astype(np.uint8), np.sqrt(((residual - rebuilt) ** 2).sum(1))

    def probes(self, unit: np.ndarray, reach: float) -> list[np.ndarray]:
        """Lists whose cells begin within ``reach`` of each vector, measured towards the list's centroid; its own is among them."""
        asked: list[list[np.ndarray]] = []
        for h, c in zip(self.halves, self.coarse):
            asked.append([])
            for part in _blocks(len(unit), 2 * len(c)):
                d = _near(unit[part][:, h], c)
                own = d.argmin(1)
                beyond = d - d[np.arange(len(d)), own][:, None]
                inside = beyond <= 2 * reach * np.sqrt(_near(c[own], c)) + 1e-12
                asked[-1] += np.split(inside.nonzero()[1], np.cumsum(inside.sum(1))[:-1])
        if len(asked) == 1:
            return asked[0]
        return [self._number((np.repeat(one, len(two)), np.tile(two, len(one)))) for one, two in zip(*asked)]

    def distances(self, unit: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared asymmetric distances from vectors to the reconstructions of a list's members, by table lookup."""
        residual = unit - self.centre(cell)
        total = np.zeros((len(unit), len(codes)))
        for p, book, c in zip(self.parts, self.books, codes.T):
            total += _near(residual[:, p], book)[:, c]
        return total


def _matrix(packed, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _merge(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after the links u-v: every node has the least number that it is connected with."""
    while True:
        one, two = labels[u], labels[v]
        apart = one != two
        if not apart.any():
            return labels
        u, v, one, two = u[apart], v[apart], one[apart], two[apart]
        np.minimum.at(labels, np.maximum(one, two), np.minimum(one, two))
        while ((up := labels[labels]) != labels).any():
            labels = up


def _compare(model: Quantizer, cosine: float, kind: str):
    """Pandas function of one block: asked members against asking vectors of one label and list."""
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members, asking = pdf[pdf["codes"].notna()], pdf[pdf["codes"].isna()]
        none = pd.DataFrame({"rep": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "other": pd.Series(dtype="Int64")})
        if members.empty or asking.empty:
            return none
        cell = int(pdf["cell"].iloc[0])
        x, error = _matrix(members["vec"], kind), members["error"].to_numpy()
        codes = np.stack([np.frombuffer(c, np.uint8) for c in members["codes"]])
        x_norm, weights, q_n = np.sqrt((x * x).sum(1)), members["n"].to_numpy(), asking["n"].to_numpy()
        # all vectors of the block by number, in order of their ids
        nodes, number = np.unique(np.concatenate([members["rep"].to_numpy(), asking["rep"].to_numpy()]), return_inverse=True)
        ids, q_ids = number[: len(members)], number[len(members) :]
        # whether a member asks the list that an asking vector is of
        cells, q_cells = np.unique(asking["own"].to_numpy(), return_inverse=True)
        asks = np.stack([np.isin(cells, p) for p in members["probes"]])
        links, labels = np.zeros(len(nodes)), np.arange(len(nodes))
        step = max(1, MATRIX // len(members))
        for start in range(0, len(asking), step):
            some = slice(start, start + step)
            q = _matrix(asking["vec"].iloc[some], kind)
            near = model.distances(_unit(q), cell, codes) <= (reach + error[None]) ** 2
            near &= q_ids[some][:, None] != ids[None]
            at, to = np.nonzero(near)
            q_norm = np.sqrt((q * q).sum(1))
            for a in range(0, len(at), 1 << 16):
                i, j = at[a : a + (1 << 16)], to[a : a + (1 << 16)]
                found = (q[i] * x[j]).sum(1) / (q_norm[i] * x_norm[j]) >= cosine
                i, j = i[found] + start, j[found]
                links += np.bincount(q_ids[i], weights[j], len(nodes))
                alone = ~asks[j, q_cells[i]]  # the other does not ask this one's list: count for both
                links += np.bincount(ids[j[alone]], q_n[i[alone]], len(nodes))
                labels = _merge(labels, q_ids[i], ids[j])
        linked, joined = np.flatnonzero(links), np.flatnonzero(labels != np.arange(len(nodes)))
        if not len(linked):
            return none
        counts = pd.DataFrame({"rep": nodes[linked], "links": links[linked].astype(np.int64), "other": pd.array([pd.NA] * len(linked), "Int64")})
        return pd.concat([counts, pd.DataFrame({"rep": nodes[joined], "links": 0, "other": pd.array(nodes[labels[joined]], "Int64")})])

    return run


def _assign(models: dict[int, Quantizer], reach: float, kind: str):
    def run(batches):
        for pdf in batches:
            sizes = pdf["vec"].map(len) // np.dtype(kind).itemsize
            for size, part in pdf.groupby(sizes):
                unit = _unit(_matrix(part["vec"], kind))
                own, codes, error = models[size].encode(unit)
                yield part.assign(size=size, own=own, codes=[c.tobytes() for c in codes], error=error, probes=models[size].probes(unit, reach))

    return run


def _pack(vector, kind: str):
    """The bytes of vectors; null where a vector can link with nothing."""

    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        def one(v):
            if v is None or len(v) == 0:
                return None
            x = np.asarray([np.nan if y is None else y for y in v] if v.dtype == object else v, dtype=kind)
            return x.tobytes() if np.isfinite(x).all() and (x != 0).any() else None

        return values.map(one)

    return pack(vector)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, reach: float = PROBE_REACH, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept.

    Vectors link if their labels are equal and not null and their cosine is at least ``cosine``. Null, empty or zero vectors and those
    with null or non-finite components link with nothing and stand alone, as do vectors without a label. Vectors of different lengths do not link. Rows
    that repeat a vec_id are vectors of their own. Other columns are ignored; an empty table gives no rows. Quantizers are
    fitted on at most ``sample`` vectors of each length, those of least id hash; every vector is indexed. Arrays of float are
    compared as they are, those of any other number as double.

    ``reach`` is how far past its own cell a vector asks other lists. At sqrt(2 - 2 cosine) no link is missed; at the default, half of that
    for 0.98, a link is missed if most of the difference of its ends points from both cells to the other.
    """
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    width = np.dtype(kind).itemsize
    rows = vectors.select("vec_id", "label", F.when(F.col("label").isNotNull(), _pack(F.col("embedding"), kind)).alias("vec"))
    rows = cut(rows.withColumn("class", F.when(F.col("vec").isNotNull(), F.sha2(F.concat(F.encode(F.col("label").cast("string"), "utf-8"), F.lit(b"\0"), "vec"), 256))), "vectors")
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("label").alias("label"), F.any_value("vec").alias("vec"))
    classes = cut(classes.where("rep IS NOT NULL"), "vector-classes")
    lengths = {r["size"]: r["n"] for r in classes.groupBy((F.length("vec") / width).cast("int").alias("size")).agg(F.count("*").alias("n")).limit(65).collect()}
    if len(lengths) > 64:
        raise ValueError("vectors have more than 64 different lengths")
    models = {}
    for size, n in lengths.items():
        chosen = classes.where(F.length("vec") == width * size).orderBy(F.xxhash64("rep"), "rep").limit(sample).select("vec").collect()
        models[size] = Quantizer(_unit(_matrix([bytes(r["vec"]) for r in chosen], kind)), max(1, round(n / LIST_SIZE)))
    schema = "rep long, n long, label {0}, vec binary, size int, own long, codes binary, error double, probes array<long>".format(classes.schema["label"].dataType.simpleString())
    index = cut(classes.select("rep", "n", "label", "vec").mapInPandas(_assign(models, reach, kind), schema), "pq-index")
    found = None
    for size, model in models.items():
        part = index.where(F.col("size") == size)
        members = part.withColumn("cell", F.col("own"))
        asking = part.withColumn("cell", F.explode("probes")).withColumn("codes", F.lit(None).cast("binary")).withColumn("probes", F.lit(None).cast("array<long>"))
        counts = members.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m")).join(asking.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("a")), ["label", "cell"])
        # a grid over each list: a member block meets an asking block in one group
        deal = lambda by, k: F.pmod(F.xxhash64(by, F.lit(k)), F.col("a" if k else "m")).cast("int")
        all_of = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
        left = members.join(counts, ["label", "cell"]).withColumn("i", deal("rep", 0)).withColumn("j", all_of("a"))
        right = asking.join(counts, ["label", "cell"]).withColumn("j", deal("rep", 1)).withColumn("i", all_of("m"))
        names = ["label", "cell", "i", "j", "rep", "n", "vec", "own", "codes", "error", "probes"]
        both = left.select(*names).unionByName(right.select(*names))
        one = both.groupBy("label", "cell", "i", "j").applyInPandas(_compare(model, cosine, kind), "rep long, links long, other long")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found, "vector-links")
    links = found.where("other IS NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.where("other IS NOT NULL").select(F.col("rep").alias("u"), F.col("other").alias("v")))
    known = classes.select("class", "rep", "n").join(links, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
    known = known.select("class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "class").join(known, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
