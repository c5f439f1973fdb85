"""Substring dedup by suffix arrays: bytes go that a string of ``length`` bytes covers which also starts earlier.

Documents are packed into shards of bounded size as they are read. Strings are sampled at places that their content alone names: of the grams in a window of ``length``
bytes, the one of least hash. Equal windows have equal samples, so a window whose sample is found nowhere else repeats nothing, and
a shard need not sort it. The rest goes in three steps, none of which moves a whole text:

1. Shards are compared by their sorted samples: each run is cut at range bounds, and looked up by binary search in the merged order of all runs of the range.
2. A shard builds the suffix array of its text around shared samples (Larsson-Sadakane: prefix doubling that sorts open groups only), takes common prefixes by
   Kasai's rule, and settles what repeats inside the shard. Windows that are the shard's first of their kind go on, as pieces by sample, where other shards have the sample too.
3. Pieces of a sample meet; equal ones fold into one, and the different ones are merged in a suffix array of their own. A sample that more than HOT pieces
   could share sends digests of windows instead, whose least id comes from an aggregate that combines on the map side.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sedge.runtime import cut

LENGTH = 100
#: Bytes of text in a shard, but for a longer document, which is a shard of its own.
SHARD = 4 << 20
#: Samples of a range, all shards together, and bytes of pieces that one task merges, both on average.
RANGE = 1 << 20
PIECES = 4 << 20
#: Different pieces of a sample that meet in one task.
HOT = 1 << 15
KEY_BITS = 48
#: How a sample is shared: not at all, inside its shard alone, with other shards, with too many.
ALONE, HERE, SHARED, CROWDED = range(4)
NO_ID = (1 << 63) - 1
ODD = np.uint64(0x9E3779B97F4A7C15)


def _pack(values: np.ndarray) -> bytes:
    """Numbers as zstd frames of their bytes, first all first bytes."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 3)


def _unpack(data: bytes, kind) -> np.ndarray:
    raw, width = np.frombuffer(zstandard.decompress(data), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def gram_length(length: int) -> int:
    """The power of two between a sixth and a third of the window: short enough for sparse samples, long enough to be rare."""
    return 1 << max(0, (length // 3).bit_length() - 1)


def samples(text: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, place, key) of runs of window starts with one sample: the least gram of the window, leftmost of equal ones.

    ``text`` is that of all documents, ``sizes`` their lengths; windows that cross documents have none.
    """
    ends = np.cumsum(sizes)
    edges = np.zeros(len(text) + 1, np.int32)
    long = sizes >= length
    np.add.at(edges, (ends - sizes)[long], 1)
    np.add.at(edges, ends[long] - length + 1, -1)
    windows = len(text) - length + 1
    if not long.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    valid = np.cumsum(edges[:windows]) > 0
    hashes, gram, factor = text.astype(np.uint64) + np.uint64(1), 1, int(ODD)
    while gram < gram_length(length):
        hashes = hashes[:-gram] * np.uint64(factor) + hashes[gram:]
        factor, gram = factor * factor % 2**64, 2 * gram
    hashes = _mixed(hashes)
    # 32 bits of hash over the place: the least is the leftmost of the least
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    reach, wanted = 1, length - gram + 1
    while reach < wanted:
        step = min(reach, wanted - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    moved = place[1:] != place[:-1]
    starts, stops = valid.copy(), valid.copy()
    starts[1:] &= moved | ~valid[:-1]
    stops[:-1] &= moved | ~valid[1:]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(stops), place[first], (hashes[place[first]] * ODD) >> np.uint64(64 - KEY_BITS)


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``codes`` (0 is a separator) in order of their first ``depth`` symbols, equal ones by place.

    Larsson-Sadakane refinement: suffixes are sorted by as many symbols as a word holds, then groups that are still open by the rank of what
    follows, which doubles the symbols each time. Groups of one are never touched again. Each sort is one of packed words where they fit.
    """
    n = len(codes)
    place_bits, symbol_bits = max(1, n.bit_length()), max(1, int(codes.max(initial=0)).bit_length())
    sorted_to = min(depth, (64 - place_bits) // symbol_bits)
    padded = np.concatenate([codes, np.zeros(depth, codes.dtype)])
    word = np.zeros(n, np.uint64)
    for k in range(sorted_to):
        word = (word << np.uint64(symbol_bits)) | padded[k : k + n].astype(np.uint64)
    word = np.sort((word << np.uint64(place_bits)) | np.arange(n, dtype=np.uint64))
    order = (word & np.uint64((1 << place_bits) - 1)).astype(np.int64)
    word >>= np.uint64(place_bits)
    rank = np.zeros(n + depth, np.int64)  # 0 beyond the end, else one more than the place of the group's first
    slots, members, opens = np.arange(n), order, np.concatenate([[True], word[1:] != word[:-1]])[:n]
    while True:
        heads = np.maximum.accumulate(np.where(opens, slots, 0))
        rank[members] = heads + 1
        alone = opens & np.concatenate([opens[1:], [True]])[: len(opens)]
        slots, members, heads = slots[~alone], members[~alone], heads[~alone]
        if sorted_to >= depth or not len(slots):
            return order
        step = min(sorted_to, depth - sorted_to)
        follows = rank[members + step].astype(np.uint64)
        group = np.cumsum(np.concatenate([[False], heads[1:] != heads[:-1]])).astype(np.uint64)
        index_bits, group_bits = len(slots).bit_length(), int(group[-1]).bit_length()
        if group_bits + place_bits + 1 + index_bits <= 64:
            word = (((group << np.uint64(place_bits + 1)) | follows) << np.uint64(index_bits)) | np.arange(len(slots), dtype=np.uint64)
            word.sort()
            moved = (word & np.uint64((1 << index_bits) - 1)).astype(np.int64)
            word >>= np.uint64(index_bits)
            opens = np.concatenate([[True], word[1:] != word[:-1]])
        else:
            moved = np.lexsort((follows, group))
            opens = np.concatenate([[True], (group[moved][1:] != group[moved][:-1]) | (follows[moved][1:] != follows[moved][:-1])])
        members = members[moved]
        order[slots] = members
        sorted_to += step


def common_prefixes(codes: np.ndarray, order: np.ndarray, most: int, lane: int = 256) -> np.ndarray:
    """Symbols that each suffix in ``order``, sorted by ``most`` symbols, shares with the one before it, up to ``most``.

    Kasai's rule: walking the text, what a place shares is at least one less than the place before it did. As the order tells nothing beyond ``most`` symbols,
    the rule holds behind a place that shares fewer, or if the suffix before has moved on by one as well. The text is walked in lanes side by side. Two
    separators never stand together.
    """
    n = len(codes)
    if n < 2:
        return np.zeros(n, np.int64)
    before = np.full(n, n, np.int64)  # none before the first: it is compared with what is beyond the end
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    buffer = np.concatenate([codes.astype(np.uint8), np.zeros(most + 16, np.uint8)])
    words = np.ndarray(len(buffer) - 8, "<u8", buffer.tobytes(), 0, (1,))  # the eight symbols from each place on
    starts = np.arange(0, n, lane)
    known, was = np.zeros(len(starts), np.int64), np.full(len(starts), n)
    for t in range(lane):
        place = starts + t
        if place[-1] >= n:
            starts, known, place, was = starts[:-1], known[:-1], place[:-1], was[:-1]
            if not len(starts):
                break
        other = before[place]
        known = np.where((other == was + 1) | ((known < most) & (was < n)), np.maximum(known - 1, 0), 0)
        was = other
        open = np.arange(len(place))
        while len(open):
            at = known[open]
            differ = words[place[open] + at] ^ words[other[open] + at]
            lowest = differ & (~differ + np.uint64(1))
            more = np.where(differ == 0, 8, (np.frexp(lowest.astype(np.float64))[1] - 1) >> 3)
            known[open] = np.minimum(at + more, most)
            open = open[(differ == 0) & (known[open] < most)]
        shared[place] = known
    out = shared[order]
    out[0] = 0
    return out


def joined(pieces: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, piece, place of each byte) of ``pieces``, bytes in a row of which ``starts`` marks the first of each piece, with separators between."""
    number = np.cumsum(starts) - 1
    at = np.arange(len(pieces)) + number
    seen = np.bincount(pieces, minlength=256) > 0
    symbols = np.zeros(256, np.uint16)
    symbols[seen] = np.arange(1, seen.sum() + 1)
    codes = np.zeros(len(pieces) + (int(number[-1]) + 1 if len(number) else 0), np.uint16)
    codes[at] = symbols[pieces]
    piece = np.full(len(codes), -1, np.int64)
    piece[at] = number
    return codes, piece, at


def repeats(codes: np.ndarray, piece: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, first) of windows inside a piece: the places of all windows that occur more than once, classes in a row, and the first place of the class."""
    order = suffix_order(codes, length)
    # 256 different bytes and a separator do not fit in a byte: then symbols are compared as two halves
    same = common_prefixes(codes, order, length) >= length if codes.max(initial=0) < 256 else _same_wide(codes, order, length)
    last = np.minimum(order + length - 1, len(codes) - 1)
    inside = (order + length <= len(codes)) & (piece[order] >= 0) & (piece[last] == piece[order])
    same &= inside
    member = same | np.concatenate([same[1:], [False]])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else order
    return order[member], order[head][member]


def _same_wide(codes: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    halves = [common_prefixes(h, order, length) for h in ((codes & 255).astype(np.uint8), (codes >> 8).astype(np.uint8))]
    return np.minimum(*halves) >= length


def _different(text: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(sample, about how many different runs of windows have it) of a shard, sorted: runs differ if their extent or their first, middle or last eight bytes do."""
    first, last, place, key = samples(text, sizes, length)
    if not len(key):
        return key, np.zeros(0, np.int64)
    words = np.ndarray(len(text) - 7, "<u8", text.tobytes(), 0, (1,))
    run = key.copy()
    for part in ((last - first) * length + place - first, words[first], words[(first + last + length) // 2 - 4], words[last + length - 8]):
        run = _mixed(run ^ part.astype(np.uint64)) * ODD
    at = np.unique(run, return_index=True)[1]
    keys, counts = np.unique(key[at], return_counts=True)
    # one run that occurs twice is shared as well
    total = np.unique(key, return_counts=True)[1]
    return keys, np.where(total > 1, np.maximum(counts, 2), counts)


def _sharded(length: int, most: int):
    """Arrow function: documents to shards with their texts and sorted samples."""

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple[int, bytes]] = []
        size = 0

        def shard():
            nonlocal made, held, size
            held.sort(key=lambda x: x[0])
            sizes = np.array([len(t) for _, t in held], np.int64)
            text = b"".join(t for _, t in held)
            keys, counts = _different(np.frombuffer(text, np.uint8), sizes, length)
            row = {"shard": [(task << 32) | made], "texts": [zstandard.compress(text, 3)], "ids": [[i for i, _ in held]], "sizes": [sizes], "n_keys": [len(keys)], "n_bytes": [len(text)]}
            row |= {"keys": [_pack(np.diff(keys, prepend=np.uint64(0)))], "counts": [_pack(np.minimum(counts, 65535).astype(np.uint16))]}
            made, held, size = made + 1, [], 0
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            ids, texts = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False), batch.column(1)
            for k, id in enumerate(ids):
                text = texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b""
                if held and size + len(text) > most:
                    yield shard()
                held.append((int(id), text))
                size += len(text)
        if held:
            yield shard()

    return run


def _cut_runs(ranges: int):
    """Arrow function: a shard's sorted samples, cut at the bounds of the ranges."""
    bounds = np.array([(r << KEY_BITS) // ranges for r in range(ranges + 1)], np.uint64)

    def run(batches):
        for batch in batches:
            for shard, packed, counted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                keys, counts = np.cumsum(_unpack(packed, np.uint64)), _unpack(counted, np.uint16)
                at = np.searchsorted(keys, bounds)
                some = np.flatnonzero(np.diff(at))
                if not len(some):
                    continue
                parts = [(keys[at[r] : at[r + 1]], counts[at[r] : at[r + 1]]) for r in some]
                yield pa.RecordBatch.from_pydict({"range": pa.array(some, pa.int32()), "shard": [shard] * len(some), "keys": [_pack(np.diff(k, prepend=np.uint64(0))) for k, _ in parts], "counts": [_pack(c) for _, c in parts]})

    return run


def _compare_runs(hot: int):
    """Arrow function of all shards' runs of a range: how each sample of each run is shared, by binary search in the merged order."""

    def run(table: pa.Table) -> pa.Table:
        runs = [np.cumsum(_unpack(k, np.uint64)) for k in table["keys"].to_pylist()]
        counts = [_unpack(c, np.uint16).astype(np.int64) for c in table["counts"].to_pylist()]
        merged = np.concatenate(runs)
        order = merged.argsort(kind="stable")
        merged, upto = merged[order], np.concatenate([[0], np.cumsum(np.concatenate(counts)[order])])
        told = []
        for own_keys, own in zip(runs, counts):
            total = upto[np.searchsorted(merged, own_keys, "right")] - upto[np.searchsorted(merged, own_keys, "left")]
            told.append(_pack(np.where(total > hot, CROWDED, np.where(total > own, SHARED, np.where(own > 1, HERE, ALONE))).astype(np.uint8)))
        return pa.table({"range": table["range"], "shard": table["shard"], "told": pa.array(told, pa.binary())})

    return run


def _shard_text(shard: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text = np.frombuffer(zstandard.decompress(shard["texts"][0].as_py()), np.uint8)
    return text, np.array(shard["ids"][0].as_py(), np.int64), np.array(shard["sizes"][0].as_py(), np.int64)


PIECE = "shard long, kind int, key long, shift int, id long, at long, data binary"
SETTLED, SENT, DIGEST = range(3)


def _settle(length: int):
    """Arrow function of a shard and how its samples are shared: windows that repeat an earlier one of the shard, and what other shards have to be asked."""

    def run(shard: pa.Table, told: pa.Table) -> pa.Table:
        number = shard["shard"][0].as_py()
        text, ids, sizes = _shard_text(shard)
        first, last, place, key = samples(text, sizes, length)
        rows: list[tuple] = []
        if len(first):
            keys, which = np.unique(key, return_inverse=True)
            how = np.concatenate([_unpack(t, np.uint8) for t in told.sort_by("range")["told"].to_pylist()])[which]
            gone = np.zeros(len(text), bool)
            some = how != ALONE
            if some.any():
                edges = np.zeros(len(text) + 1, np.int64)
                np.add.at(edges, first[some], 1)
                np.add.at(edges, last[some] + length, -1)
                inside = np.cumsum(edges)[:-1] > 0
                row_of = np.repeat(np.arange(len(sizes)), sizes)
                begins = inside.copy()
                begins[1:] &= ~inside[:-1] | (row_of[1:] != row_of[:-1])
                origin = np.flatnonzero(inside)
                codes, piece, at = joined(text[origin], begins[origin])
                back = np.zeros(len(codes), np.int64)
                back[at] = origin
                member, head = (back[x] for x in repeats(codes, piece, length))
                # of one row the class's places are in a row, so the one before tells whether the row has it earlier
                again = np.concatenate([[False], row_of[member[1:]] == row_of[member[:-1]]])[: len(member)] & (member != head)
                gone[member] = again | (ids[row_of[member]] > ids[row_of[head]])
                row_ids = ids[row_of[first]]
                data = text.tobytes()
                for i in np.flatnonzero(how >= SHARED):
                    live = np.flatnonzero(~gone[first[i] : last[i] + 1])
                    if not len(live):
                        continue
                    if how[i] == SHARED:
                        a, b = int(first[i] + live[0]), int(first[i] + live[-1])
                        rows.append((SENT, int(key[i]), int(a - place[i]), int(row_ids[i]), a, data[a : b + length]))
                    else:
                        for a in (first[i] + live).tolist():
                            rows.append((DIGEST, None, None, int(row_ids[i]), a, hashlib.blake2b(data[a : a + length], digest_size=16).digest()))
                if gone.any():
                    rows.append((SETTLED, None, None, None, None, zstandard.compress(np.packbits(gone).tobytes(), 3)))
        columns = list(zip(*rows)) or [[]] * 6
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        names = ("kind", "key", "shift", "id", "at", "data")
        return pa.table({"shard": pa.array([number] * len(rows), pa.int64()), **{n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)}})

    return run


def _merge_pieces(length: int):
    """Arrow function of pieces by sample: (shard, first, last) of windows that a smaller id has too."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("shard", "ascending"), ("at", "ascending")])
        shards, ids, places = (table[c].to_numpy() for c in ("shard", "id", "at"))
        contents, keys = table["data"].to_pylist(), table["key"].to_numpy()
        out: list[tuple[int, int, int]] = []
        holders: dict[tuple[int, int, bytes], list[int]] = {}
        kinds: dict[int, int] = {}
        for i, what in enumerate(zip(keys.tolist(), table["shift"].to_pylist(), contents)):
            same = holders.setdefault(what, [])
            if not same:
                kinds[what[0]] = kinds.get(what[0], 0) + 1
            if not same or ids[same[0]] == ids[i]:
                same.append(i)
            else:  # a smaller id has all of it
                out.append((int(shards[i]), int(places[i]), int(places[i]) + len(what[2]) - length))
        several = [(what[2], same) for what, same in holders.items() if kinds[what[0]] > 1]
        if several:
            sizes = np.array([len(x) for x, _ in several])
            starts = np.zeros(sizes.sum(), bool)
            starts[np.cumsum(sizes) - sizes] = True
            codes, piece, at = joined(np.frombuffer(b"".join(x for x, _ in several), np.uint8), starts)
            member, head = repeats(codes, piece, length)
            least = np.array([ids[same[0]] for _, same in several])
            later = np.sort(member[least[piece[member]] > least[piece[head]]])  # pieces stand in order of id
            breaks = np.flatnonzero(np.diff(later) != 1) + 1  # separators part the windows of two pieces
            begins = np.cumsum(sizes) - sizes + np.arange(len(sizes))
            for span in np.split(later, breaks) if len(later) else []:
                own = int(piece[span[0]])
                for i in several[own][1]:
                    shift = int(places[i]) - int(begins[own])
                    out.append((int(shards[i]), int(span[0]) + shift, int(span[-1]) + shift))
        columns = list(zip(*out)) or [[]] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("shard", "first", "last"), columns)})

    return run


def _cleaned(length: int):
    """Arrow function of a shard and its windows that go: its documents without them."""

    def run(shard: pa.Table, found: pa.Table) -> pa.Table:
        if not len(shard):
            return pa.table({"id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "kept": pa.array([], pa.binary()), "spans": pa.array([], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})
        text, ids, sizes = _shard_text(shard)
        edges = np.zeros(len(text) + 1, np.int64)
        for bits in found["bits"].drop_null().to_pylist():
            gone = np.flatnonzero(np.unpackbits(np.frombuffer(zstandard.decompress(bits), np.uint8), count=len(text)))
            np.add.at(edges, gone, 1)
            np.add.at(edges, gone + length, -1)
        spans = found.filter(found["first"].is_valid()) if len(found) else found
        np.add.at(edges, spans["first"].to_numpy(), 1)
        np.add.at(edges, spans["last"].to_numpy() + length, -1)
        covered = np.cumsum(edges)[:-1] > 0
        ends = np.cumsum(sizes)
        kept_upto = np.concatenate([[0], np.cumsum(~covered)])
        kept = text[~covered].tobytes()
        begins, stops = ends - sizes, ends
        starts = covered.copy()
        starts[1:] &= ~covered[:-1]
        starts[begins[sizes > 0]] |= covered[begins[sizes > 0]]  # a run ends with its document
        first = np.flatnonzero(starts)
        closes = covered.copy()
        closes[:-1] &= ~covered[1:]
        closes[stops[sizes > 0] - 1] |= covered[stops[sizes > 0] - 1]
        last = np.flatnonzero(closes)
        per = np.searchsorted(first, begins), np.searchsorted(first, stops)
        own = np.repeat(np.arange(len(sizes)), per[1] - per[0])
        struct = pa.StructArray.from_arrays([pa.array(first - begins[own]), pa.array(last + 1 - begins[own])], ["start", "end"])
        offsets = pa.array(np.concatenate([[0], np.cumsum(per[1] - per[0])]).astype(np.int32))
        return pa.table({
            "id": pa.array(ids), "n_bytes": pa.array(sizes), "kept": pa.array([kept[a:b] for a, b in zip(kept_upto[begins].tolist(), kept_upto[stops].tolist())], pa.binary()),
            "spans": pa.ListArray.from_arrays(offsets, struct),
        })

    return run


def dedup_substrings(docs: DataFrame, length: int = LENGTH, id: str = "doc_id", text: str = "text", shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(id, n_bytes, kept, spans) of each row of ``docs``: its UTF-8 bytes without those covered by a string of ``length`` bytes that also starts earlier.

    Earlier is in a row of smaller id, or further left in the same row; strings are judged on the input, not on what is left. ``kept`` is binary, as a run may
    begin inside a character; ``spans`` are the maximal runs removed, in bytes from the row's start. Null text counts as empty. Rows of one id are documents
    of their own, neither of which is earlier, so equal rows keep the same. Rows without an id come after all others, none before another. Texts shorter
    than ``length`` lose nothing. Other columns are ignored; an empty table gives no rows. ``length`` is at least 8. ``shard`` (bytes) and ``hot`` (pieces of a
    sample) change the work alone.
    """
    if length < 8:
        raise ValueError("length must be at least 8")
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    shards = cut(rows.mapInArrow(_sharded(length, shard), "shard long, texts binary, ids array<long>, sizes array<long>, n_keys long, n_bytes long, keys binary, counts binary"), "shards")
    ranges = max(1, -(-(shards.agg(F.sum("n_keys")).first()[0] or 0) // RANGE))
    runs = shards.select("shard", "keys", "counts").mapInArrow(_cut_runs(ranges), "range int, shard long, keys binary, counts binary")
    told = runs.groupBy("range").applyInArrow(_compare_runs(hot), "range int, shard long, told binary")
    texts = shards.select("shard", "texts", "ids", "sizes")
    sent = cut(texts.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_settle(length), PIECE), "pieces")
    pieces = sent.where(F.col("kind") == SENT)
    parts = max(1, -(-(pieces.agg(F.sum(F.length("data"))).first()[0] or 0) // PIECES))
    spans = "shard long, first long, last long"
    merged = pieces.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))).repartition(parts, "part").groupBy("part").applyInArrow(_merge_pieces(length), spans)
    digests = sent.where(F.col("kind") == DIGEST).select("shard", "at", "id", "data")
    least = digests.groupBy("data").agg(F.min("id").alias("least"))
    crowded = digests.join(least, "data").where("id > least").select("shard", F.col("at").alias("first"), F.col("at").alias("last"))
    found = merged.unionByName(crowded).withColumn("bits", F.lit(None).cast("binary"))
    found = found.unionByName(sent.where(F.col("kind") == SETTLED).select("shard", F.col("data").alias("bits")), allowMissingColumns=True)
    out = texts.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(_cleaned(length), "id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id), "n_bytes", "kept", "spans")
