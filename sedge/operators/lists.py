"""Coarse lists of vectors: each vector lies in the list of its nearest centre, and bounds on angles tell which lists can hold what is sought.

A store keeps its chunks' vectors by list beside the chunks, once lists have been fitted (``Store.index_vectors``): the centres, the vectors with their lists, and for every change the
greatest angle in each list that it added to. What has no direction, or another length than the centres, lies in list ODD, where all similarities are 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sedge.functions.vectors import cosine_to

#: Vectors that centres are fitted on, of least hash; centres at most, and vectors of a list on average as long as there are fewer.
SAMPLE = 20_000
MOST_LISTS = 1_024
LIST_SIZE = 1_000
#: What rounding can do to an angle, or to a distance.
SLACK = 1e-6
ODD = -1
CENTRES = "list int not null, centre array<double> not null"
VECTORS = "list int not null, id string not null, document_id string not null, vector array<float> not null, angle double"
HEADS = "list int not null, radius double, vectors long not null"
#: Lists that are searched first, to learn what the others have to reach.
FIRST_LISTS = 4


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, all components finite, not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    norms = np.sqrt((x * x).sum(1))[:, None]
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


class Lists:
    """Unit centres of the lists, and after :meth:`with_radii` the greatest angle between each centre and a vector of its list."""

    def __init__(self, centres: np.ndarray, radii: np.ndarray | None = None):
        self.centres, self.radii = centres, radii

    @classmethod
    def fit(cls, vectors: DataFrame, column: str, lists: int | None = None, rounds: int = 6) -> Lists:
        """Centres of usable vectors of one length, from a bounded sample: directions of means, moved ``rounds`` times."""
        lists = lists or min(MOST_LISTS, max(1, -(-vectors.count() // LIST_SIZE)))
        sample = vectors.orderBy(F.xxhash64(column), column).select(column).limit(SAMPLE).collect()
        x = unit(np.array([r[0] for r in sample], np.float64))
        centres = x[np.random.default_rng(0).permutation(len(x))[:lists]]
        for _ in range(rounds):
            own = (x @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            moved = unit(sums)
            centres = np.where((moved != 0).any(1)[:, None], moved, centres)
        return cls(centres)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, angle to its centre) of unit vectors."""
        near = x @ self.centres.T
        own = near.argmax(1)
        return own, np.arccos(np.clip(near[np.arange(len(x)), own], -1, 1))

    def with_radii(self, radii: dict[int, float]) -> Lists:
        return Lists(self.centres, np.array([radii.get(i, -1.0) for i in range(len(self.centres))]))

    def most_alike(self, query: np.ndarray) -> np.ndarray:
        """The greatest cosine that a vector of each list can have to a unit vector, -2 for empty lists."""
        angle = np.arccos(np.clip(self.centres @ query, -1, 1)) - self.radii - SLACK
        return np.where(self.radii < 0, -2.0, np.cos(np.maximum(angle, 0)))

    def meeting(self, x: np.ndarray, own: np.ndarray, least: float) -> list[np.ndarray]:
        """For each unit vector, the other lists than its own that can hold one of cosine ``least`` or more.

        Such a vector is within an angle of the list's ball, and within a chord of the plane that parts the two centres' cells.
        """
        near = x @ self.centres.T
        ball = np.arccos(np.clip(near, -1, 1)) - self.radii[None] <= math.acos(max(-1.0, min(1.0, least))) + SLACK
        gap = np.sqrt(np.maximum(2 - 2 * self.centres @ self.centres.T, 0))
        beyond = near[np.arange(len(x)), own][:, None] - near
        plane = beyond <= (math.sqrt(max(0.0, 2 - 2 * least)) + SLACK) * gap[own] + SLACK
        asked = ball & plane & (self.radii >= 0)[None] & (np.arange(len(self.centres))[None] != own[:, None])
        return [np.flatnonzero(row) for row in asked]


def listed(chunks: DataFrame, lists: Lists) -> DataFrame:
    """Rows of VECTORS of the chunks(id, document_id, embedding) that have a vector."""
    dimension = lists.centres.shape[1]
    rows = chunks.where("embedding IS NOT NULL").select("id", "document_id", F.col("embedding").alias("vector"), (usable(F.col("embedding")) & (F.size("embedding") == dimension)).alias("good"))

    def assign(batches):
        for pdf in batches:
            good = pdf["good"].to_numpy(bool)
            number, angle = np.full(len(pdf), ODD), np.full(len(pdf), np.nan)
            if good.any():
                number[good], angle[good] = lists.nearest(unit(np.stack(pdf["vector"][good].to_numpy()).astype(np.float64)))
            yield pd.DataFrame({"list": number, "id": pdf["id"], "document_id": pdf["document_id"], "vector": pdf["vector"], "angle": pd.Series(angle).where(good, None)})

    return rows.mapInPandas(assign, VECTORS.replace(" not null", ""))


def heads(rows: DataFrame) -> DataFrame:
    """Rows of HEADS of new vectors."""
    return rows.groupBy("list").agg(F.max("angle").alias("radius"), F.count("*").alias("vectors"))


def stored(snapshot) -> Lists | None:
    """A store's lists with their radii; None if it has none."""
    centres = {r["list"]: r["centre"] for r in snapshot.read("centres").collect()}  # at most MOST_LISTS
    if not centres:
        return None
    radii = {r["list"]: r["r"] for r in snapshot.read("heads").groupBy("list").agg(F.max("radius").alias("r")).collect() if r["r"] is not None}
    return Lists(np.array([centres[i] for i in range(len(centres))])).with_radii(radii)


def nearest(snapshot, query: list[float], k: int = 10, probes: int | None = None) -> tuple[DataFrame, int]:
    """((chunk_id, document_id, similarity) of the k chunks of greatest cosine in order, ties by chunk_id; the number of lists that were opened).

    Lists are taken in order of the greatest cosine that they can hold: the first few, and then those that can still reach the k-th best of these, so the result is that of a scan of all
    vectors. With ``probes`` only so many lists are opened, those whose centres are nearest, and a chunk in another list may be missed.
    """
    lists = stored(snapshot)
    if lists is None:
        raise ValueError("the store has no lists of vectors")
    q = unit(np.array([query], np.float64))[0]
    fits = len(q) == lists.centres.shape[1] and q.any()
    bound = lists.most_alike(q) if fits else np.where(lists.radii < 0, -2.0, 0.0)
    bounds = {i: b for i, b in enumerate(bound.tolist()) if b > -2} | {ODD: 0.0}
    order = sorted(bounds, key=lambda i: (-bounds[i], i))
    if probes is not None and fits:
        order = sorted((i for i in bounds if i != ODD), key=lambda i: (-(lists.centres[i] @ q), i))[:probes]
    score = cosine_to(F.col("vector"), query).alias("similarity")
    best = lambda some: snapshot.read("vectors", keys=some).where(F.col("list").isin(some)).select(F.col("id").alias("chunk_id"), "document_id", score).orderBy(F.desc("similarity"), "chunk_id").limit(k)
    if probes is not None:
        return best(order), len(order)
    some = order[:FIRST_LISTS]
    seen = best(some).select("similarity").collect()
    least = seen[-1]["similarity"] if len(seen) == k else -2.0
    some = [i for i in order if i in some or bounds[i] >= least - SLACK]
    return best(some), len(some)
