"""Near-dedup by Order MinHash: ordered samples of occurrence-labelled k-mers, verified by banded alignment.

A k-mer is K words; with the number of its earlier occurrences as a label each occurs once, however often a text repeats itself. A band takes the
L labelled k-mers least under its own hash and keys them in text order, and once more the L least of the different k-mers, each where it
first occurs; texts that share a band's key are candidates. Two texts are near copies if the best alignment of their labelled k-mers, or of
their different ones, within a band of diagonals matches M of n and m with M / (n + m - M) at least the threshold: the Jaccard similarity
of their shingles, less what is out of order. By labels, long repeated passages count as often as they are said, as in an edit distance; by different k-mers,
a text that says twice what the other says once is a copy of it.

Equal texts form a class first. Buckets are not expanded into pairs: each member is compared with one pivot at a time, and
only what is still unconnected after some rounds is compared with all other components in its buckets. Members of buckets in which more than FEW
are outside the largest component meet by their rarest k-mers instead: of two sets that share enough, each has a shared element among so many of its first in
any order, so with the order by rarity a passage that all share brings none of them together. The links found connect whatever comparing
every candidate pair would connect.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sedge.llm.quality import SPACES
from sedge.operators.components import components
from sedge.runtime import cut

K = 5
L = 5
BANDS = 20
#: Bands of L_SHORT k-mers for texts of up to SHORT k-mers, where L of L+1 seldom agree.
SHORT, L_SHORT, BANDS_SHORT = 60, 2, 10
THRESHOLD = 0.8
#: Diagonals that an alignment may leave the main one by, as a share of the longer text.
BAND_SHARE = 0.25
BLOCK = 65_536
#: Different k-mers that are kept for a look at a pair before it is aligned: all of a text of so many, else one in 2, 4, 8 ... by hash.
SAMPLED = 256
#: How far below the threshold the similarity of what is kept may be: for all k-mers, as short codes may coincide, and for a share of them, 4.5 deviations.
SLACK_WHOLE, SLACK_SAMPLED = 0.01, 0.15
#: Members outside a bucket's largest component that are compared with every other member, so that a member costs as many comparisons at most.
FEW = 2_048
STAR_ROUNDS = 2

_rng = np.random.default_rng(20)
_odd = lambda n: _rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE, _BASE = _odd(256), _odd(1)[0]
_SPOT, _MULTIPLY, _ADD, _ORDER = _odd(K), _odd(BANDS + BANDS_SHORT), _odd(BANDS + BANDS_SHORT), _odd(L)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16, 2 * len(_powers[0]) if len(_powers[0]) < 1 << 24 else 0)
        grown = []
        for step in (_BASE, _INVERSE):
            p = np.full(size, step, np.uint64)
            p[0] = 1
            grown.append(np.cumprod(p))
        _powers = tuple(grown)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word (run of bytes that are not ASCII white space), from prefix sums over the text's bytes."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.concatenate([[False], ~_SPACES[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _scales(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:-1], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def kmers(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(labelled, different) hashes of a text's k-mers in text order; none for fewer than K words.

    ``labelled`` has all of them, told apart by their number; ``different`` the first of each.
    """
    words = word_hashes(text)
    n = len(words) - K + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    plain = np.zeros(n, np.uint64)
    for i, a in enumerate(_SPOT):
        plain += words[i : i + n] * a
    plain = _mix(plain)
    order = np.argsort(plain, kind="stable")
    ranked = plain[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if fresh.all():
        return plain, plain
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    seen = np.empty(n, np.int64)
    seen[order] = np.arange(n) - first
    labelled = np.where(seen > 0, _mix(plain + seen.astype(np.uint64) * _BASE), plain)
    return labelled, plain[seen == 0]


def _least(values: np.ndarray, bands: slice, size: int) -> np.ndarray:
    """For each band the positions of its ``size`` least k-mers in text order; long texts go block by block."""
    multiply, add = _MULTIPLY[bands, None], _ADD[bands, None]
    best = np.zeros((multiply.shape[0], 0), np.int64)
    for at in range(0, len(values), BLOCK):
        here = np.concatenate([best, np.broadcast_to(np.arange(at, min(at + BLOCK, len(values))), (multiply.shape[0], min(BLOCK, len(values) - at)))], 1)
        ranks = values[here] * multiply + add if best.shape[1] else values[at : at + BLOCK][None] * multiply + add
        best = np.take_along_axis(here, np.argpartition(ranks, size - 1, axis=1)[:, :size], 1) if here.shape[1] > size else here
    return np.sort(best, 1)


def band_keys(values: np.ndarray) -> np.ndarray:
    """Band keys of a text's labelled k-mers, as signed 64-bit numbers; none for none."""
    keys = []
    for bands, size in ((slice(0, BANDS), L), (slice(BANDS, BANDS + BANDS_SHORT), L_SHORT)):
        if len(values) and (size == L or len(values) <= SHORT):
            chosen = values[_least(values, bands, size)]
            keys.append(_mix((chosen * _ORDER[None, : chosen.shape[1]]).sum(1, dtype=np.uint64) + _ADD[bands]))
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)


def all_keys(labelled: np.ndarray, different: np.ndarray) -> np.ndarray:
    """Band keys of a text's labelled and of its different k-mers; both have the same keys if no k-mer occurs again."""
    keys = band_keys(different)
    return keys if len(labelled) == len(different) else np.unique(np.concatenate([keys, band_keys(labelled)]))


def sampled(values: np.ndarray) -> tuple[int, np.ndarray]:
    """(level, codes): 16-bit codes of the k-mers whose hashes end in ``level`` zero bits, negative if the next bit is one.

    The level is the least that leaves about SAMPLED; dropping negative codes gives the sample of the next level.
    """
    level = max(0, int(np.ceil(np.log2(max(len(values), 1) / SAMPLED))))
    hashes = _mix(values + _BASE)
    kept = hashes[hashes & np.uint64((1 << level) - 1) == 0]
    code = ((kept >> np.uint64(40)) & np.uint64(0x7FFF)).astype(np.int32) - 32768 * ((kept >> np.uint64(level)) & np.uint64(1)).astype(np.int32)
    return level, np.unique(code).astype(np.int16)


def alignment(a: np.ndarray, b: np.ndarray, share: float = BAND_SHARE) -> float:
    """Similarity of two texts by their k-mers: M / (n + m - M) for the longest alignment of M matches within the band.

    As each k-mer is there once, it is a longest increasing subsequence of the matched positions.
    """
    if not len(a) or not len(b):
        return 0.0
    _, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(at - to) <= max(K, share * max(len(a), len(b)))
    to = to[near][np.argsort(at[near])]
    if len(to) and (np.diff(to) > 0).all():
        m = len(to)
    else:
        tails: list[int] = []
        for x in to.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        m = len(tails)
    return m / (len(a) + len(b) - m)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The greater of the similarities by labelled and by different k-mers."""
    found = alignment(a[0], b[0])
    return found if len(a[0]) == len(a[1]) and len(b[0]) == len(b[1]) else max(found, alignment(a[1], b[1]))


#: Numbers, levels and samples of the different k-mers, and of the labelled ones where these are more.
SKETCH = "id long, h0 long, h1 long, worded boolean, n long, bands array<long>, level int, codes array<smallint>, all_n long, all_level int, all_codes array<smallint>"
SKETCH_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int16()), pa.int64(), pa.int32(), pa.list_(pa.int16())]
MEASURED = ("n", "level", "codes", "all_n", "all_level", "all_codes")


def _sketch(batches):
    for batch in batches:
        made = []
        for text in batch.column(4).to_pylist():
            labelled, different = kmers(text)
            more = (len(labelled), *sampled(labelled)) if len(labelled) > len(different) else (None, None, None)
            made.append((len(different), all_keys(labelled, different), *sampled(different), *more))
        columns = [pa.array(x, t) for x, t in zip(zip(*made), SKETCH_TYPES[4:])] if made else [pa.array([], t) for t in SKETCH_TYPES[4:]]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), *columns], [f.split()[0] for f in SKETCH.split(", ")])


def _verify(threshold: float):
    def run(batches):
        last, values = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kept = []
            for k, (one, other) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if b[k] != last:  # pairs arrive by their second text
                    last, values = b[k], kmers(other)
                if similarity(kmers(one), values) >= threshold:
                    kept.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in kept], pa.int64()), pa.array([b[k] for k in kept], pa.int64())], ["u", "v"])

    return run


def _masked(codes: Column) -> Column:
    return F.transform(codes, lambda c: F.when(c < 0, c + F.lit(32768)).otherwise(c.cast("int")).cast("smallint"))


def _bare(codes: Column) -> Column:
    """The sample of the next level."""
    return F.filter(codes, lambda c: c >= 0)


def _measures(of: str) -> list[tuple[Column, Column, Column]]:
    """(n, level, codes) of the different k-mers and of all labelled ones, which are the same where none is repeated."""
    own = [F.col(f"{of}{c}") for c in MEASURED]
    return [tuple(own[:3]), tuple(F.coalesce(more, same) for more, same in zip(own[3:], own[:3]))]


def _alike(a: str, b: str, threshold: float) -> Column:
    """Whether two sketches can be near copies by either measure: lengths within the threshold, and enough of the kept k-mers in common.

    For texts of up to SAMPLED k-mers this is their Jaccard similarity; for longer ones an estimate that pairs at the threshold
    pass but for one in some hundred thousand. Lengths within the threshold are one level apart at most.
    """

    def close(x, y):
        (n, k, one), (m, j, other) = x, y
        one, other = (F.when(k == j, p).when(near, _bare(p)).otherwise(_masked(p)) for p, near in ((one, k < j), (other, j < k)))
        shared, least = F.size(F.array_intersect(one, other)), F.when(F.greatest(k, j) == 0, threshold - SLACK_WHOLE).otherwise(threshold - SLACK_SAMPLED)
        return (F.least(n, m) >= F.lit(threshold) * F.greatest(n, m)) & (shared * (1 + least) >= least * (F.size(one) + F.size(other)))

    different, labelled = (close(x, y) for x, y in zip(_measures(f"{a}."), _measures(f"{b}.")))
    repeats = F.col(f"{a}.all_n").isNotNull() | F.col(f"{b}.all_n").isNotNull()
    # each different k-mer that only one of them has takes one of its labelled ones at least; known for all where samples are whole
    whole = (F.col(f"{a}.level") == 0) & (F.col(f"{b}.level") == 0)
    in_both = F.size(F.array_intersect(_masked(F.col(f"{a}.codes")), _masked(F.col(f"{b}.codes"))))
    (n, _, _), (all_n, _, _) = _measures(f"{a}.")
    (m, _, _), (all_m, _, _) = _measures(f"{b}.")
    most, least = F.least(all_n - n, all_m - m) + in_both, threshold - SLACK_WHOLE
    possible = ~whole | (most * (1 + least) >= least * (all_n + all_m))
    return different | (repeats & labelled & possible)


class _Search:
    def __init__(self, buckets: DataFrame, sketches: DataFrame, texts: DataFrame, threshold: float):
        self.buckets, self.sketches, self.texts, self.threshold = buckets, sketches, texts, threshold
        self.tested: list[DataFrame] = []
        self.links: list[DataFrame] = []
        self.groups: DataFrame | None = None

    def members(self) -> DataFrame:
        """Bucket members with their components so far, of buckets that hold several."""
        if self.groups is None:
            return self.buckets.withColumn("comp", F.col("rep"))
        known = self.buckets.join(self.groups, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
        several = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        return cut(known.join(several, "key"), "open-buckets")

    def compare(self, pairs: DataFrame) -> int:
        """Align new pairs (u < v) and connect those that pass; return how many pairs there were."""
        if self.tested:
            pairs = pairs.join(reduce(DataFrame.unionByName, self.tested), ["u", "v"], "left_anti")
        pairs = cut(pairs, "pairs")
        self.tested.append(pairs)
        if not (n := pairs.count()):
            return 0
        one, other = (self.texts.select(F.col("rep").alias(k), F.col("text").alias(f"text_{k}")) for k in "uv")
        both = pairs.join(one.hint("merge"), "u").join(other.hint("merge"), "v").select("u", "v", "text_u", "text_v")
        self.links.append(cut(both.mapInArrow(_verify(self.threshold), "u long, v long"), "links"))
        self.groups = cut(components(reduce(DataFrame.unionByName, self.links)), "groups")
        return n

    def star(self, turn: int) -> int:
        """Compare every member with the pivot, of another component, with which it shares most buckets."""
        mask = 0 if turn == 0 else int(np.random.default_rng(turn).integers(1, 2**62))
        members = self.members()
        # a table of known size, so that members are not dealt by key, which may be hot, while their pivots are few enough to broadcast
        pivots = cut(members.groupBy("key").agg(F.min(F.col("rep").bitwiseXOR(F.lit(mask))).alias("p")).select("key", F.col("p").bitwiseXOR(F.lit(mask)).alias("pivot")), "pivots")
        met = members.join(pivots, "key").where("rep <> pivot")
        if self.groups is not None:
            met = met.join(self.groups.select(F.col("node").alias("pivot"), F.col("component").alias("theirs")), "pivot", "left").where(F.coalesce("theirs", "pivot") != F.col("comp"))
        counted = met.groupBy("rep", "pivot").agg(F.count("*").alias("shared"))
        alike = counted.join(self.sketches.alias("a"), F.col("rep") == F.col("a.id")).join(self.sketches.alias("b"), F.col("pivot") == F.col("b.id")).where(_alike("a", "b", self.threshold)).select("rep", "pivot", "shared")
        # a member has a pivot for each of its keys at most
        first = alike.withColumn("k", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("shared"), "pivot"))).where("k = 1")
        return self.compare(first.select(F.least("rep", "pivot").alias("u"), F.greatest("rep", "pivot").alias("v")).distinct())

    def rest(self) -> int:
        """Compare the pairs of a bucket that still are of different components; one of a pair is outside the bucket's largest.

        A pair that shares several buckets comes from the one of least key.
        """
        members = self.members()
        most = members.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("size")).select("key", F.col("m.comp").alias("main"), (F.col("size") - F.col("m.n")).alias("outside"))
        # marked first, so that the join of a key's members is a join alone, whose hot keys adaptive execution splits
        marked = cut(members.join(cut(most, "largest"), "key"), "marked")
        known = self.sketches.select("id", "bands", *MEASURED)
        rows = marked.where(F.col("outside") <= FEW).join(known, F.col("rep") == F.col("id")).select("key", "rep", "comp", "main", "bands", *MEASURED)
        apart = (F.col("a.comp") != F.col("b.comp")) & ((F.col("a.comp") == F.col("a.main")) | (F.col("a.rep") < F.col("b.rep")))
        first = F.array_min(F.array_intersect("a.bands", "b.bands")) == F.col("a.key")
        pairs = rows.alias("a").join(rows.where("comp <> main").alias("b"), (F.col("a.key") == F.col("b.key")) & apart & first & _alike("a", "b", self.threshold))
        pairs = pairs.select(F.least("a.rep", "b.rep").alias("u"), F.greatest("a.rep", "b.rep").alias("v"))
        many = cut(marked.where(F.col("outside") > FEW).select("rep", "comp").distinct(), "crowded")
        if not many.isEmpty():
            pairs = pairs.unionByName(self._by_rarest(many))
        return self.compare(pairs.distinct())

    def _by_rarest(self, members: DataFrame) -> DataFrame:
        """(u, v): pairs of members(rep, comp) of different components that look alike and share one of their rarest k-mers, by either measure.

        A set of n that is alike to another shares threshold * n of its k-mers or more, so one of any n - ceil(threshold * n) + 1. These are
        taken in order of how many members have them; those that one alone has come first and meet nothing.
        """
        tokens = cut(self.texts.join(members.select("rep"), "rep").mapInArrow(_tokens, "rep long, m int, n long, h long"), "k-mers")
        shared = tokens.groupBy("m", "h").agg(F.count("*").alias("seen")).where("seen > 1")
        some = tokens.join(shared, ["m", "h"])
        place = F.row_number().over(Window.partitionBy("rep", "m").orderBy("seen", "h"))
        alone = F.col("n") - F.count("*").over(Window.partitionBy("rep", "m"))
        # a bit more than the threshold asks for, against rounding
        most = F.col("n") - F.ceil(F.col("n") * (self.threshold - 1e-9)) + 1
        prefix = cut(some.withColumn("place", place).withColumn("alone", alone).where(F.col("place") + F.col("alone") <= most).select("rep", "m", "h"), "prefixes")
        known = prefix.join(members, "rep").join(self.sketches, F.col("rep") == F.col("id")).select("rep", "comp", "m", "h", *MEASURED)
        met = known.alias("a").join(known.alias("b"), (F.col("a.m") == F.col("b.m")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.rep") < F.col("b.rep")) & (F.col("a.comp") != F.col("b.comp")) & _alike("a", "b", self.threshold))
        return cut(met.select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v")).distinct(), "met")


def _tokens(batches):
    """(rep, measure, number of its k-mers, k-mer) of texts: the different ones, and all labelled ones where these are more."""
    for batch in batches:
        for rep, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            labelled, different = kmers(text)
            for m, values in enumerate([different, labelled][: 1 + (len(labelled) > len(different))]):
                for at in range(0, len(values), BLOCK):
                    part = values[at : at + BLOCK].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), rep)), pa.array(np.full(len(part), m, np.int32)), pa.array(np.full(len(part), len(values))), pa.array(part)], ["rep", "m", "n", "h"])


def text_hashes(text: str) -> tuple[Column, Column]:
    """h0 and h1, which tell texts apart; a null text counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(whole).alias("h0"), F.xxhash64(F.lit(K), whole).alias("h1")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id: str = "doc_id", text: str = "text", hashes: bool = False) -> DataFrame:
    """One row per document: doc_id, n_kmers, class_id (the least id of its class) and kept (whether it is that one).

    Equal texts are one class, as are texts that a chain of near copies connects. Texts without a word (null, empty) stand alone;
    texts of fewer than five words are compared for equality only. Ids are integers; a null id stands alone. Rows that repeat
    an id and text are copies of each other, all kept or none. Other columns are ignored; an empty table gives no rows.
    With ``hashes`` the rows also have h0 and h1, the text_hashes of their texts.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).cast("long").alias("id"), *text_hashes(text), (F.translate(whole, SPACES, "") != "").alias("worded"), whole.alias("text"))
    sketched = cut(rows.mapInArrow(_sketch, SKETCH), "sketches")
    classes = sketched.where("worded AND id IS NOT NULL").groupBy("h0", "h1").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = cut(classes, "text-classes")
    reps = sketched.join(classes.select(F.col("rep").alias("id"), "h0", "h1"), ["id", "h0", "h1"]).where("n > 0")
    reps = cut(reps.select("id", "h0", "h1", "bands", *MEASURED), "representatives")
    keyed = reps.select(F.explode("bands").alias("key"), F.col("id").alias("rep")).distinct()
    shared = keyed.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    buckets = cut(keyed.join(shared, "key"), "buckets")
    wanted = buckets.select("rep").distinct().join(reps.select(F.col("id").alias("rep"), "h0", "h1"), "rep")
    texts = cut(rows.hint("merge").join(wanted.hint("merge"), (F.col("id") == F.col("rep")) & (rows["h0"] == wanted["h0"]) & (rows["h1"] == wanted["h1"])).select("rep", "text"), "candidates")
    search = _Search(buckets, reps.select("id", "bands", *MEASURED), texts, threshold)
    for turn in range(STAR_ROUNDS):
        if not search.star(turn):
            break
    search.rest()
    out = sketched.join(classes, ["h0", "h1"], "left")
    group = F.coalesce("rep", "id")
    if search.groups is not None:
        out = out.join(search.groups, F.col("rep") == F.col("node"), "left")
        group = F.coalesce("component", "rep", "id")
    return out.select(F.col("id").alias(id), F.col("n").alias("n_kmers"), group.alias("class_id"), F.coalesce(group == F.col("id"), F.lit(True)).alias("kept"), *(["h0", "h1"] if hashes else []))
