"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

Recursive queries join token positions with the merge table and contract them until nothing can merge. SHORT contracts every
word's leftmost pair of least rank each round. A word of more than SHORT_BYTES would take as many rounds over as many rows, so LONG contracts
every round the pairs that nothing else in the word can reach before their turn, and, should there be none, the least pair of each region that no
token can leave. Decoding joins the ids of whole documents with the vocabulary and aggregates their bytes in order. Texts are
never shuffled; what a partition has encoded is kept by word in a cache of bounded size, so repeated words cost one lookup.

Which pairs LONG may contract: spans are the stretches of bytes that are tokens; what the merge table can make of the present tokens are
the spans that begin and end at their borders, ordered by (rank, start). A pair (a, m, b) keeps its turn if no lesser span of this
kind begins or ends at a, m or b: then nothing that comes first touches it, nothing that its merge makes possible comes first
either, and doing it now changes no other step. Of equal pairs that overlap (one token again and again) every second is taken,
from the left. So the result is that of one merge at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import cache, cached_property
from itertools import chain, islice

import ahocorasick
import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

CACHED_WORDS = 600_000
#: Words of up to so many bytes, and how many of them, that one query contracts pair by pair.
SHORT_BYTES, CHUNK_WORDS = 32, 12_000
#: Bytes of longer words that one query contracts; a word beyond that is swept in stretches of so many.
CHUNK_BYTES = 128 << 10
BATCH_CHARS = 1_500_000
#: Words of a text that are held at once, and ids that are decoded at once.
BATCH_WORDS, BATCH_IDS = 250_000, 1_000_000
DATABASE = {"threads": 1, "memory_limit": "300MB", "temp_directory": ""}

SHORT = """
WITH RECURSIVE state(w, toks, live) AS (
  SELECT w, toks, true FROM start
  UNION ALL
  SELECT s.w, CASE WHEN k IS NULL THEN toks ELSE toks[:(k & 4294967295) - 1] || [(k >> 32)::INT] || toks[(k & 4294967295) + 2:] END, k IS NOT NULL
  FROM state s LEFT JOIN (
    SELECT w, min((merged::BIGINT << 32) | pos) AS k
    FROM (SELECT w, unnest(toks[:-2]) AS tok, unnest(toks[2:]) AS next, generate_subscripts(toks[2:], 1) AS pos FROM state WHERE live AND len(toks) > 1)
    JOIN merges ON pair = (tok::BIGINT << 32) | next
    GROUP BY w) least USING (w)
  WHERE live
)
SELECT w, array_to_string(toks, ' ') AS ids FROM state WHERE NOT live
"""
LONG = """
WITH RECURSIVE state(a, e, id) USING KEY (a) AS (
  SELECT a, e, id FROM start
  UNION
  (WITH token AS (SELECT a, e FROM recurring.state WHERE e > 0),
   live AS (SELECT s.a, t.e AS m, s.b, id, u.a = t.e AS pair, (id::BIGINT << 32) | s.a AS k
            FROM spans s JOIN token t ON t.a = s.a JOIN token u ON u.e = s.b WHERE s.b > t.e),
   begins AS (SELECT p, min(k) AS k FROM (SELECT a AS p, k FROM live UNION ALL SELECT p, k FROM beyond JOIN token ON a = p) GROUP BY p),
   ends AS (SELECT b AS p, min(k) AS k FROM live GROUP BY p),
   calm AS (SELECT x.*, coalesce(ends.k = twin, false) AS chained
            FROM (SELECT *, CASE WHEN m >= b - a THEN (id::BIGINT << 32) | (m - (b - a)) ELSE k END AS twin FROM live WHERE pair) x
            JOIN begins one ON one.p = x.a AND one.k = x.k JOIN ends two ON two.p = x.b AND two.k = x.k
            LEFT JOIN begins ON begins.p = m LEFT JOIN ends ON ends.p = m
            WHERE coalesce(begins.k > x.k, true) AND coalesce(ends.k >= least(twin, x.k), true)),
   follow AS (SELECT *, chained AND coalesce(lag(k) OVER (ORDER BY a) = twin AND lag(m) OVER (ORDER BY a) = a, false) AS follows FROM calm),
   runs AS (SELECT *, sum((NOT follows)::INT) OVER (ORDER BY a ROWS UNBOUNDED PRECEDING) AS run FROM follow),
   placed AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY a) AS nth, first(chained) OVER (PARTITION BY run ORDER BY a) AS held FROM runs),
   chosen AS (SELECT a, m, b, id FROM placed WHERE nth % 2 = 1 AND NOT held {rest})
   SELECT a, b, id FROM chosen UNION ALL SELECT m, 0, -1 FROM chosen)
)
SELECT a, e, id FROM state WHERE e > 0 ORDER BY a
"""
#: The least pair of each region, which is a stretch that no span crosses the border of.
REGIONS = """
UNION SELECT a, m, b, id FROM live JOIN (
  SELECT min(k) FILTER (pair) AS k FROM (
    SELECT *, sum(fresh) OVER (ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS region FROM (
      SELECT *, coalesce(a >= max(b) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh
      FROM (SELECT a, b, k, pair FROM live UNION ALL SELECT p, 2147483647, k, false FROM beyond JOIN token ON a = p)))
  GROUP BY region HAVING max(b) < 2147483647) USING (k) WHERE pair
"""
OWN = "SELECT w, id FROM words JOIN vocabulary ON piece = word"
DECODE = """
SELECT w, string_agg(piece, '' ORDER BY pos) AS piece, count(*) AS n FROM coded JOIN vocabulary USING (id) GROUP BY w ORDER BY w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a file with a base64 token and its rank on every line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Coder:
    """Encoder and decoder over one vocabulary; made once in each Python worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.pattern = read_ranks(path), regex.compile(pattern)
        self.longest = max(map(len, self.ranks))
        self.db = duckdb.connect(config=DATABASE)
        # latin-1 maps bytes to the first 256 code points and back, so that pieces of characters can be aggregated
        with self._given(given=pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "piece": [b.decode("latin-1") for b in self.ranks]})):
            self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        merges = [(left << 32 | right, k) for b, k in self.ranks.items() for i in range(1, len(b)) if (left := self.ranks.get(b[:i])) is not None and (right := self.ranks.get(b[i:])) is not None]
        with self._given(given=pa.table({"pair": pa.array([p for p, _ in merges], pa.int64()), "merged": pa.array([k for _, k in merges], pa.int32())})):
            self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        #: The ids of a word as text. The old generation goes when the young one is half of all.
        self.coded: dict[str, str] = {}
        self.old: dict[str, str] = {}

    @cached_property
    def finder(self) -> ahocorasick.Automaton:
        """Finds all spans of bytes that are tokens of two bytes or more: what the merge table can make."""
        found = ahocorasick.Automaton()
        for piece, k in self.ranks.items():
            if len(piece) > 1:
                found.add_word(piece.decode("latin-1"), len(piece) << 32 | k)
        found.make_automaton()
        return found

    @contextmanager
    def _given(self, **tables: pa.Table):
        for name, rows in tables.items():
            self.db.register(name, rows)
        try:
            yield
        finally:
            for name in tables:
                self.db.unregister(name)

    def words(self, text: str | None) -> Iterator[list[str]]:
        """The words of a text, some at a time if it is long."""
        text = text or ""
        if len(text) <= BATCH_CHARS:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while some := list(islice(found, BATCH_WORDS)):
            yield some

    def _spans(self, pieces: list[bytes], at: int = 0) -> tuple[np.ndarray, ...]:
        """(start, end, id) of the tokens in pieces laid end to end from ``at``."""
        joined = "\u0100".join(p.decode("latin-1") for p in pieces)
        found = np.fromiter(chain.from_iterable(self.finder.iter(joined)), np.int64).reshape(-1, 2)
        seams = np.cumsum([len(p) + 1 for p in pieces])
        end = found[:, 0] + 1
        end -= np.searchsorted(seams, end)
        return end - (found[:, 1] >> 32) + at, end + at, found[:, 1] & 0xFFFFFFFF

    def _bytes(self, raw: bytes, at: int = 0) -> tuple[np.ndarray, ...]:
        starts = np.arange(at, at + len(raw))
        return starts, starts + 1, self.byte[np.frombuffer(raw, np.uint8)]

    def _contract(self, tokens: tuple, spans: tuple, beyond: tuple = ((), ())) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """(tokens, whether each span is still to be made) at the fixpoint of tokens (start, end, id) under spans (start, end, id).

        ``beyond`` (start, key) are spans that leave the bytes at hand: what they touch waits.
        """
        table = lambda names, columns, kinds: pa.table({n: pa.array(np.asarray(c, k)) for n, c, k in zip(names, columns, kinds)})
        a, b, _ = spans
        for rest in ("", REGIONS):
            given = {"start": table(("a", "e", "id"), tokens, ("i4",) * 3), "spans": table(("a", "b", "id"), spans, ("i4",) * 3), "beyond": table(("p", "k"), beyond, ("i4", "i8"))}
            with self._given(**given):
                done = self.db.sql(LONG.format(rest=rest)).to_arrow_table()
            tokens = tuple(done[c].to_numpy() for c in ("a", "e", "id"))
            size = int(max(tokens[1][-1], b.max(initial=0))) + 1
            end, ends = np.full(size, -1), np.zeros(size, bool)
            end[tokens[0]], ends[tokens[1]] = tokens[1], True
            live = (end[a] > 0) & ends[b] & (end[a] != b)
            if not live.any():
                break
        return tokens, live

    def _sweep(self, word: bytes) -> np.ndarray:
        """Ids of a word above CHUNK_BYTES, stretch by stretch; what a stretch's end leaves open goes on in the next one."""
        done, open_, hi = [], tuple(np.zeros(0, np.int64) for _ in range(3)), 0
        while True:
            lo, at = int(open_[0][0]) if len(open_[0]) else hi, hi
            hi = min(hi + CHUNK_BYTES, len(word))
            a, b, k = self._spans([word[lo : hi + self.longest - 1]], lo)
            inside, beyond = b <= hi, (a < hi) & (b > hi)
            # positions count from lo, so that they stay small
            tokens = tuple(np.concatenate([x, y]) - shift for x, y, shift in zip(open_, self._bytes(word[at:hi], at), (lo, lo, 0)))
            (start, end, ids), live = self._contract(tokens, (a[inside] - lo, b[inside] - lo, k[inside]), (a[beyond] - lo, k[beyond] << 32 | a[beyond] - lo))
            if hi == len(word):
                return np.concatenate([*done, ids])
            from_here = min((a[inside] - lo)[live].min(initial=hi - lo), (x := a[beyond] - lo)[np.isin(x, start)].min(initial=hi - lo))
            settled = start < from_here
            done.append(ids[settled])
            open_ = (start[~settled] + lo, end[~settled] + lo, ids[~settled])

    def _pairwise(self, pieces: list[bytes]) -> list[str]:
        ends = np.cumsum([0, *map(len, pieces)], dtype=np.int32)
        toks = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.byte[np.frombuffer(b"".join(pieces), np.uint8)]))
        with self._given(start=pa.table({"w": pa.array(np.arange(len(pieces), dtype=np.int32)), "toks": toks})):
            done = self.db.sql(SHORT).to_arrow_table().sort_by("w")
        return done["ids"].to_pylist()

    def _together(self, pieces: list[bytes]) -> list[str]:
        if sum(map(len, pieces)) > CHUNK_BYTES:
            found = list(map(self._sweep, pieces))
        else:
            (starts, _, ids), _ = self._contract(self._bytes(b"".join(pieces)), self._spans(pieces))
            found = np.split(ids, np.searchsorted(starts, np.cumsum([len(p) for p in pieces])[:-1]))
        return [" ".join(map(str, x.tolist())) for x in found]

    def encode_words(self, words: list[str]) -> list[str]:
        """Token ids of each word, as text. A word that is a token itself is that token."""
        raw = [w.encode() for w in words]
        with self._given(words=pa.table({"w": pa.array(np.arange(len(raw), dtype=np.int32)), "word": pa.array([r.decode("latin-1") if len(r) <= self.longest else "" for r in raw], pa.string())})):
            own = self.db.sql(OWN).to_arrow_table()
        done = dict(zip(own["w"].to_pylist(), map(str, own["id"].to_pylist())))
        left = [n for n in range(len(raw)) if n not in done]
        for way, numbers in ((self._pairwise, [n for n in left if len(raw[n]) <= SHORT_BYTES]), (self._together, [n for n in left if len(raw[n]) > SHORT_BYTES])):
            chunk, size = [], 0
            for n in [*numbers, None]:
                if chunk and (n is None or len(chunk) == CHUNK_WORDS or size + len(raw[n]) > CHUNK_BYTES):
                    done.update(zip(chunk, way([raw[k] for k in chunk])))
                    chunk, size = [], 0
                if n is not None:
                    chunk.append(n)
                    size += len(raw[n])
        return [done[n] for n in range(len(raw))]

    def decode_lists(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of lists of ids laid end to end; ValueError for an id that is not in the vocabulary."""
        rows = pa.table({"w": pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)), "pos": pa.array(np.arange(len(ids), dtype=np.int32)), "id": pa.array(ids, pa.int32())})
        with self._given(coded=rows):
            done = self.db.sql(DECODE).to_arrow_table()
        if done["n"].to_numpy().sum() != len(ids):
            raise ValueError("an id is not in the vocabulary")
        out = [b""] * len(sizes)
        for w, piece in zip(done["w"].to_pylist(), done["piece"].to_pylist()):
            out[w] = piece.encode("latin-1")
        return out

    def learn(self, words: set[str]) -> None:
        """Put words that the young generation lacks into it."""
        missing = words - self.coded.keys()
        if len(self.coded) + len(missing) > CACHED_WORDS // 2:
            self.old, self.coded, missing = self.coded, {}, words
        for word in missing & self.old.keys():
            self.coded[word] = self.old[word]
        fresh = list(missing - self.coded.keys())
        for at in range(0, len(fresh), BATCH_WORDS):
            chunk = fresh[at : at + BATCH_WORDS]
            self.coded.update(zip(chunk, self.encode_words(chunk)))

    def pieces(self, texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
        """(text, ids as text joined by spaces) of all texts in order; a long text has several in a row."""
        held: list[tuple[int, list[str]]] = []
        chars = n = 0

        def flush():
            self.learn(set().union(*(w for _, w in held)))
            return [(k, " ".join(map(self.coded.__getitem__, w))) for k, w in held]

        for k, text in enumerate(texts):
            for some in self.words(text):
                held.append((k, some))
                chars, n = chars + min(len(text or ""), BATCH_CHARS), n + len(some)
                if chars >= BATCH_CHARS or n >= BATCH_WORDS:
                    yield flush()
                    held, chars, n = [], 0, 0
        yield flush()


@cache
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def _ids(own: Coder, texts: list[str | None]) -> list[tuple]:
    found: list[list[int]] = [[] for _ in texts]
    for some in own.pieces(texts):
        for k, joined in some:
            found[k] += map(int, joined.split())
    return [(x,) for x in found]


def _digest(own: Coder, texts: list[str | None]) -> list[tuple]:
    """(number of ids, digest of the ids, digest of what the ids decode to) of each text."""
    n, ids, plain = [0] * len(texts), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
    for some in own.pieces(texts):
        for k, joined in some:
            if joined:
                ids[k].update((b" " if n[k] else b"") + joined.encode())
                n[k] += joined.count(" ") + 1
        for part in _slices(some):
            sizes = np.array([j.count(" ") + bool(j) for _, j in part], np.int64)
            numbers = np.fromstring(" ".join(j for _, j in part if j), np.int32, sep=" ") if sizes.any() else np.zeros(0, np.int32)
            for (k, _), piece in zip(part, own.decode_lists(numbers, sizes)):
                plain[k].update(piece)
    return [(a, b.hexdigest(), c.hexdigest()) for a, b, c in zip(n, ids, plain)]


def _slices(some: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """The same in stretches of about BATCH_IDS ids, at five characters an id."""
    part, size = [], 0
    for k, joined in some:
        for at in _cuts(joined):
            part.append((k, at))
            size += len(at)
            if size >= 5 * BATCH_IDS:
                yield part
                part, size = [], 0
    yield part


def _cuts(joined: str) -> Iterator[str]:
    while len(joined) > 5 * BATCH_IDS and (end := joined.find(" ", 5 * BATCH_IDS)) > 0:
        yield joined[:end]
        joined = joined[end + 1 :]
    yield joined


TYPES = {_ids: [pa.list_(pa.int32())], _digest: [pa.int64(), pa.string(), pa.string()]}
NAMES = {_ids: ["ids"], _digest: ["n_tokens", "ids_sha256", "decoded_sha256"]}


def _mapper(path: str, pattern: str, value):
    """mapInArrow function: all columns but the last, then what ``value`` makes of the last, a text."""

    def run(batches):
        own = coder(path, pattern)
        for batch in batches:
            rows = value(own, batch.column(batch.num_columns - 1).to_pylist())
            kept = [batch.column(k) for k in range(batch.num_columns - 1)]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), TYPES[value])] if rows else [pa.array([], t) for t in TYPES[value]]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*batch.schema.names[:-1], *NAMES[value]])

    return run


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ids (array of int) of every whole text, as the vocabulary's library encodes ordinary text.

    Special tokens are not looked for. Null text: empty, no ids. Rows are independent: repeated rows repeat their result, an empty
    table gives none, other columns are dropped.
    """
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(_mapper(path, pattern, _ids), f"{schema}, ids array<int>")


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and bytes (binary) of every array of ids; null or empty: empty. An unknown id fails the query."""

    def run(batches):
        own = coder(path, "")
        for batch in batches:
            lists = [np.array(x or [], np.int32) for x in batch.column(batch.num_columns - 1).to_pylist()]
            done = own.decode_lists(np.concatenate([np.zeros(0, np.int32), *lists]), np.array([len(x) for x in lists], np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(done, pa.binary())], [*batch.schema.names[:-1], "bytes"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(ids).alias("_ids")).mapInArrow(run, f"{schema}, bytes binary")


def roundtrip(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    Encoding and decoding in one pass, so that ids need not leave the worker: the ids of whole documents are decoded by the
    ordered aggregation, and their bytes hashed. Null and empty texts have no tokens. A word may be of any length; queries
    hold CHUNK_BYTES of it and what the stretch before left open.
    """
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(_mapper(path, pattern, _digest), f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string")
