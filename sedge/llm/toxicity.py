"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text, window lengths under both, calibrated thresholds.

A window is one word or run of marks of the text in lower case, with a space on either side. zstd writes a match of five letters in about as
many bytes as the letters themselves, so lengths of plain bytes tell nothing of single words; every byte is therefore widened to three (a fixed
one-to-one code), and every window begins with a lead that both dictionaries end in, so that no window is too small to be compressed.

The toxic dictionary is trained on those windows of toxic texts that toxic texts explain better than ordinary ones do: training
texts are cut into halves, and a window stays if its length with the other half's toxic text as dictionary is LEAST_GAIN bytes below
its length with ordinary text, first among all windows, then twice more with what is left of the other half as the dictionary. The ordinary one is trained
on windows of ordinary texts. A window is a hit if its length under the toxic dictionary is at most one threshold and its length under the ordinary
one longer by at least another; both thresholds, and the logistic function of hits and windows that gives the score, are fitted on labelled rows that
no dictionary has seen.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from sedge.runtime import cut

#: Bounds of the labelled sample that is learnt from, by class (ordinary, toxic): rows of least id hash.
SAMPLE = (8_000, 4_000)
#: Windows of one labelled text that dictionaries are trained on, evenly spaced over the whole text.
SAMPLE_WINDOWS = 1_000
#: A longer word goes in pieces.
WINDOW = regex.compile(r"[\p{L}\p{M}\p{N}]{1,64}|[^\p{L}\p{M}\p{N}\s]{1,64}")
BATCH_CHARS = 1_500_000
WIDE = [np.array([(b * m + c) & 255 for b in range(256)], np.uint8) for m, c in ((1, 0), (73, 41), (151, 97))]
LEAD = bytes(range(128, 160))
#: Bytes of widened text that stand for a half of a class while windows are chosen (of its windows once each, if the text is more), and of the trained dictionaries (both: ordinary, toxic).
TEXT_BYTES, DICTIONARY_BYTES = (3_000_000, 1_500_000), (131_072, 8_192)
LEAST_GAIN = 8
#: Thresholds among which calibration chooses: most bytes under the toxic dictionary, and least bytes more under the ordinary one.
MOST, GAINS = (18, 19, 20, 21, 22, 24), (4, 6, 8, 10, 12, 14)
CACHED_WINDOWS = 300_000
BATCH_WINDOWS = 200_000
THRESHOLD = 0.3


def windows(text: str | None) -> Iterator[list[str]]:
    """All windows of a text, some at a time if it is long."""
    text = (text or "").lower()
    if len(text) <= BATCH_CHARS:
        yield WINDOW.findall(text)
        return
    found = (m.group() for m in WINDOW.finditer(text))
    while some := list(islice(found, BATCH_WINDOWS)):
        yield some


def widened(raw: bytes) -> bytes:
    x = np.frombuffer(raw, np.uint8)
    return np.stack([code[x] for code in WIDE], 1).tobytes()


def _compressor(content: bytes, kind: int) -> zstandard.ZstdCompressor:
    """Lengths under a dictionary; the lead comes last in it, where it is reached cheapest. The search goes deep, as many words begin alike."""
    how = zstandard.ZstdCompressionParameters.from_level(9, min_match=6, strategy=zstandard.STRATEGY_LAZY2, window_log=22, chain_log=21, hash_log=18, search_log=9, write_content_size=0, write_checksum=0, write_dict_id=0)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content + LEAD, dict_type=kind), compression_params=how)


def _lengths(compressor: zstandard.ZstdCompressor, some: list[str]) -> np.ndarray:
    parts = [np.zeros(0, np.int64)]
    for at in range(0, len(some), 8192):
        raw = [f" {w} ".encode() for w in some[at : at + 8192]]
        wide, ends = widened(b"".join(raw)), (3 * np.cumsum([0, *map(len, raw)])).tolist()
        ready = [LEAD + wide[x:y] for x, y in zip(ends, ends[1:])]
        parts.append(np.fromiter(map(len, compressor.multi_compress_to_buffer(ready, threads=0)), np.int64, len(ready)))
    return np.concatenate(parts)


def _known(texts: list[list[str]], counts: Counter, most: int) -> zstandard.ZstdCompressor:
    """The compressor with the words of texts as they stand as its dictionary. If these are more than ``most`` bytes, each window that two texts hold (``counts``) stands there once, the commonest last, where they are reached cheapest."""
    content, size = [], 0
    if 3 * sum(len(w.encode()) + 1 for some in texts for w in some) + 6 * len(texts) <= most:
        return _compressor(b"".join(widened(f" {' '.join(some)} ".encode()) for some in texts), zstandard.DICT_TYPE_RAWCONTENT)
    for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        if n < 2 or size >= most:
            break
        content.append(widened(f" {w} ".encode()))
        size += len(content[-1])
    return _compressor(b"".join(reversed(content))[-most:], zstandard.DICT_TYPE_RAWCONTENT)


def _train(some: list[str], size: int) -> bytes:
    """A dictionary trained on windows; b"" if there are too few to train one."""
    try:
        return zstandard.train_dictionary(size, [widened(f" {w} ".encode()) for w in some], k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionaries(ordinary: list[list[str]], toxic: list[list[str]]) -> tuple[bytes, bytes]:
    """Dictionaries (ordinary, toxic) from the windows of each class's texts; empty ones where there is too little text."""
    halves = [(ordinary[i::2], toxic[i::2]) for i in (0, 1)]
    # documents that hold a window; each is compressed once and trained on as often
    held = [[Counter(w for text in some for w in set(text)) for some in half] for half in halves]
    plain = [_known(half[0], counts[0], TEXT_BYTES[0]) for half, counts in zip(halves, held)]
    toxic_text = [_known(half[1], counts[1], TEXT_BYTES[1]) for half, counts in zip(halves, held)]
    left = [counts[1] for counts in held]
    for _ in range(3):
        kept = []
        for i in (0, 1):
            some = sorted(left[i])
            gain = _lengths(plain[1 - i], some) - _lengths(toxic_text[1 - i], some)
            kept.append(Counter({w: left[i][w] for w, g in zip(some, gain.tolist()) if g >= LEAST_GAIN}))
        left, toxic_text = kept, [_known([sorted(k.elements())], k, TEXT_BYTES[1]) for k in kept]
    common = held[0][0] + held[1][0]
    return _train(_spread(common), DICTIONARY_BYTES[0]), _train(_spread(left[0] + left[1]), DICTIONARY_BYTES[1])


def _spread(counts: Counter) -> list[str]:
    """Windows as often as counted, in an order without pattern, as the trainer picks the best segment of each stretch of its samples."""
    return random.Random(0).sample(some := sorted(counts.elements()), len(some))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    thresholds: tuple[int, int] = (MOST[0], GAINS[-1])
    weights: tuple[float, ...] = (-4.0, 4.0, -0.5)
    cache: dict = field(default_factory=dict)

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic, "thresholds": self.thresholds, "weights": self.weights}

    def __setstate__(self, state):
        self.__init__(**state)

    def _compressor(self, name: str) -> zstandard.ZstdCompressor:
        made = self.cache.setdefault("compressors", {})
        if name not in made:
            content = getattr(self, name)
            made[name] = _compressor(content, zstandard.DICT_TYPE_FULLDICT if content else zstandard.DICT_TYPE_RAWCONTENT)
        return made[name]

    def learn(self, some: set[str]) -> dict[str, int]:
        """Length under the toxic dictionary, times 4096, and 2048 and the bytes more under the ordinary one, of all windows in ``some``; each is compressed once while the cache lasts."""
        known = self.cache.setdefault("lengths", {})
        fresh = some - known.keys()
        if len(known) + len(fresh) > CACHED_WINDOWS:
            known.clear()
            fresh = some
        if fresh:
            listed = list(fresh)
            under, plain = (_lengths(self._compressor(name), listed) for name in ("toxic", "ordinary"))
            known.update(zip(listed, (under * 4096 + 2048 + plain - under).tolist()))
        return known

    def _each(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text, lengths, gains) of the windows of texts in order; a long text comes in pieces."""
        held: list[tuple[int, list[str]]] = []
        n = 0
        for k, text in enumerate(texts):
            for some in windows(text):
                held.append((k, some))
                n += len(some)
                if n >= BATCH_WINDOWS:
                    yield from self._measured(held)
                    held, n = [], 0
        yield from self._measured(held)

    def _measured(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        known = self.learn(set().union(*(some for _, some in held)))
        for k, some in held:
            both = np.fromiter(map(known.__getitem__, some), np.int64, len(some))
            yield k, both >> 12, (both & 4095) - 2048

    def grids(self, texts: list[str | None]) -> list[list[int]]:
        """For each text the number of windows, then of hits for each pair of thresholds."""
        found = np.zeros((len(texts), 1 + len(MOST) * len(GAINS)), np.int64)
        for k, length, gain in self._each(texts):
            found[k] += np.array([len(length), *(((length <= m) & (gain >= g)).sum() for m in MOST for g in GAINS)])
        return found.tolist()

    def scores(self, texts: list[str | None]) -> list[float]:
        counts = np.zeros((len(texts), 2))
        for k, length, gain in self._each(texts):
            counts[k] += np.count_nonzero((length <= self.thresholds[0]) & (gain >= self.thresholds[1])), len(length)
        z = self.weights[0] + np.log1p(counts) @ np.array(self.weights[1:])
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()

    def calibrate(self, grids: list[list[int]], labels: list[int]) -> None:
        """Choose the thresholds and weights of greatest likelihood, by ridge-penalised Newton steps; left as they are if a class is missing."""
        if len(set(labels)) < 2:
            return
        counts, y, best = np.log1p(np.array(grids, float)), np.array(labels, float), None
        ridge = np.diag([1e-6, 0.05, 0.05])
        for k in range(counts.shape[1] - 1):
            x, w = np.stack([np.ones(len(y)), counts[:, 1 + k], counts[:, 0]], 1), np.zeros(3)
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
            p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
            loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + 0.5 * w @ ridge @ w)
            if best is None or loss < best[0] - 1e-9:
                best = (loss, (MOST[k // len(GAINS)], GAINS[k % len(GAINS)]), tuple(map(float, w)))
        _, self.thresholds, self.weights = best


def fold(id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.encode(id.cast("string"), "utf-8")) % 4


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: tuple[int, int] = SAMPLE, held_out: int = 2) -> Model:
    """A model from labelled documents outside fold ``held_out``.

    Of several labels of an id the greatest counts; null labels and null ids are left out. At most ``sample`` ids of each
    class are taken, those of least id hash, found by a join with this bounded list. Fold 3 calibrates, the others make the
    dictionaries, where equal texts count once and a text gives at most SAMPLE_WINDOWS windows. One task trains on this bounded
    sample; the driver sees dictionaries and counts, never texts. Without labels of both classes the
    dictionaries are empty and no document has hits.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("_id")).agg((F.max(label) > 0).cast("int").alias("_label"))
    known = known.where(fold(F.col("_id")) != held_out)
    chosen = [known.where(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(n) for k, n in enumerate(sample)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most sum(sample) rows
    rows = docs.select(F.col(id).alias("_doc"), F.col(text).alias("_text")).join(few, F.col("_doc") == F.col("_id"))
    rows = cut(rows.select("_label", (fold(F.col("_id")) == 3).alias("_rest"), F.xxhash64("_id").alias("_at"), "_text"), "labelled")
    once = rows.where("NOT _rest").groupBy("_label", F.sha2(F.coalesce("_text", F.lit("")), 256).alias("_h")).agg(F.any_value("_text").alias("_text"))
    told = cut(once.select("_label", "_h", "_text").mapInArrow(_sampled, "label int, h string, windows array<string>"), "label-windows")
    made = told.repartition(1).mapInArrow(_trained, "ordinary binary, toxic binary").first()
    model = Model(bytes(made["ordinary"]), bytes(made["toxic"]))
    rest = sorted((r["at"], r["label"], list(r["grid"])) for r in rows.where("_rest").select("_label", "_at", "_text").mapInArrow(_grids(model), "at long, label int, grid array<long>").collect())
    model.calibrate([g for *_, g in rest], [y for _, y, _ in rest])
    return model


def _sampled(batches):
    for batch in batches:
        kept = []
        for text in batch.column(2).to_pylist():
            n = sum(map(len, windows(text)))
            # where the evenly spaced windows are
            wanted = set(range(n)) if n <= SAMPLE_WINDOWS else set(np.linspace(0, n - 1, SAMPLE_WINDOWS).astype(int).tolist())
            at, own = 0, []
            for some in windows(text):
                own += [w for k, w in enumerate(some, at) if k in wanted]
                at += len(some)
            kept.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.list_(pa.string()))], ["label", "h", "windows"])


def _trained(batches):
    """One row: the dictionaries of a bounded sample that comes to one task."""
    rows = sorted((h, label, some) for batch in batches for label, h, some in zip(*(batch.column(k).to_pylist() for k in range(3))))
    made = dictionaries(*([some for _, label, some in rows if label == k and some] for k in (0, 1)))
    yield pa.RecordBatch.from_arrays([pa.array([made[k]], pa.binary()) for k in (0, 1)], ["ordinary", "toxic"])


def _grids(model: Model):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(model.grids(batch.column(2).to_pylist()), pa.list_(pa.int64()))], ["at", "label", "grid"])

    return run


def score_toxicity(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", held_out: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score and predicted, from the whole text alone.

    Null and empty texts get the score of a text without windows. A null id is not held out. Repeated rows repeat their
    result, other columns are ignored, an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            scores = model.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], [id, "held_out", "score", "predicted"])

    part = F.coalesce(fold(F.col(id)) == held_out, F.lit(False))
    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, part.alias("held_out"), F.col(text).alias("_text")).mapInArrow(run, f"`{id}` {kind}, held_out boolean, score double, predicted int")
