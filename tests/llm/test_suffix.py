import random

import numpy as np
import pytest

from sedge.llm.suffix import common_prefixes, dedup_substrings, gram_length, joined, repeats, samples, suffix_order


def spans_of(gone):
    edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
    return [(int(a), int(b)) for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))]


def brute(rows, length):
    """(id, bytes, bytes kept, spans) by looking up every string in every document."""
    out = []
    for id, text in rows:
        own, gone = (text or "").encode(), np.zeros(len((text or "").encode()), bool)
        for i in range(len(own) - length + 1):
            s = own[i : i + length]
            if own.find(s) < i or any(other is not None and (id is None or other < id) and s in (t or "").encode() for other, t in rows):
                gone[i : i + length] = True
        out.append((id, len(own), bytes(np.frombuffer(own, np.uint8)[~gone]), spans_of(gone)))
    return sorted(out, key=repr)


def got(df):
    return sorted([(r["doc_id"], r["n_bytes"], bytes(r["kept"]), [(s["start"], s["end"]) for s in r["spans"]]) for r in df.collect()], key=repr)


def symbols(rng, n, kinds):
    """Random symbols without two separators (0) in a row, one at the end."""
    x = [rng.randint(0, kinds) for _ in range(n)]
    if rng.random() < 0.5:
        x = x + x[: n // 2] + x
    return np.array([v or (1 if i and not x[i - 1] else 0) for i, v in enumerate(x)] + ([0] if x[-1] else []), np.uint16)


@pytest.mark.parametrize("depth", [4, 7, 20, 100])
def test_suffix_order_and_common_prefixes(depth):
    rng = random.Random(depth)
    for _ in range(60):
        codes = symbols(rng, rng.randint(1, 300), rng.choice([1, 2, 4, 200]))
        padded = np.concatenate([codes, np.zeros(depth, np.uint16)])
        text = lambda p: tuple(padded[p : p + depth])  # noqa: E731, B023
        order = suffix_order(codes, depth)
        assert sorted(order) == list(range(len(codes)))
        assert [text(p) for p in order] == sorted(map(text, range(len(codes))))
        assert all(a < b for a, b in zip(order, order[1:]) if text(a) == text(b) and 0 not in text(a))
        shared = common_prefixes(codes, order, depth, lane=16)
        for i in range(1, len(codes)):
            same = np.array(text(order[i - 1])) == np.array(text(order[i]))
            assert shared[i] == (depth if same.all() else same.argmin())


def test_classes_of_windows_stay_inside_pieces():
    rng = random.Random(1)
    for _ in range(40):
        pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 8))]
        starts = np.zeros(sum(map(len, pieces)), bool)
        starts[np.cumsum([0, *map(len, pieces)])[:-1]] = True
        codes, piece, at = joined(np.frombuffer(b"".join(pieces), np.uint8), starts)
        member, head = repeats(codes, piece, 6)
        windows, begin = {}, 0
        for p in pieces:
            for i in range(len(p) - 5):
                windows.setdefault(p[i : i + 6], []).append(begin + i)
            begin += len(p) + 1
        expected = {p: places[0] for places in windows.values() if len(places) > 1 for p in places}
        assert dict(zip(member.tolist(), head.tolist())) == expected


def test_equal_windows_have_equal_samples():
    rng = random.Random(2)
    passage = bytes(rng.choice(b"abcd ") for _ in range(300))
    texts = [bytes(rng.choice(b"abcd ") for _ in range(rng.randint(0, 150))) + passage[rng.randint(0, 100) :] for _ in range(20)]
    first, last, place, key = samples(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), 100)
    whole, seen = b"".join(texts), {}
    for a, z, m, k in zip(first, last, place, key):
        for p in range(a, z + 1):
            assert p <= m <= p + 100 - gram_length(100)
            assert seen.setdefault(whole[p : p + 100], (m - p, k)) == (m - p, k)
    assert sum(z - a + 1 for a, z in zip(first, last)) == sum(max(0, len(t) - 99) for t in texts)


def corpus(seed, alphabet="ab é中\n"):
    """Texts from shared passages, repeated ids and texts, nulls, empty and short ones."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [word(rng.randint(20, 90)) for _ in range(6)]
    rows = [(None, passages[0] * 2), (None, passages[0] * 2), (3, None), (4, ""), (5, "a" * 300), (5, "a" * 300), (6, passages[1]), (6, passages[1] + passages[2]), (2**40, passages[3]), (-7, passages[3])]
    for i in range(40):
        rows.append((rng.randint(0, 30), "".join(rng.choice(passages) if rng.random() < 0.6 else word(rng.randint(0, 40)) for _ in range(rng.randint(0, 6)))))
    return rows


@pytest.mark.parametrize(("shard", "hot"), [(1 << 22, 1 << 15), (300, 1 << 15), (1, 1 << 15), (300, 3), (1, 0)])
def test_against_every_string_looked_up(spark, shard, hot):
    rows = corpus(shard + hot)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(dedup_substrings(docs, 24, shard=shard, hot=hot)) == brute(rows, 24)


def test_long_windows_over_shards(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 300))) + passage[rng.randint(0, 400) : rng.randint(400, 700)]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for hot in (1 << 15, 2):
        assert got(dedup_substrings(docs, shard=1000, hot=hot)) == brute(rows, 100)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, shard string, kept string")
    assert dedup_substrings(empty).collect() == []
    rows = [(1, "x" * 50 + "y" * 120, "s", 1, 2), (2, "z" + "x" * 50 + "y" * 120, "t", 3, 4), (3, None, None, None, None), (4, "k" * 99, "", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, shard long, id long")
    assert got(dedup_substrings(docs)) == brute([r[:2] for r in rows], 100)
    with pytest.raises(ValueError):
        dedup_substrings(docs, 3)


def test_very_long_text(spark):
    text = "".join(chr(97 + (i * i + i // 7) % 23) for i in range(200_000))
    rows = [(1, text), (2, "new " + text[50_000:150_000] + " end"), (3, text[::-1])]
    out = {r["doc_id"]: r for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), shard=50_000).collect()}
    assert bytes(out[2]["kept"]) == b"new  end" and [(s["start"], s["end"]) for s in out[2]["spans"]] == [(4, 100_004)]
