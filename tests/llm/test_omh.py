import bisect
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from sedge.llm.omh import alignment, band_keys, kmers, near_duplicates, sampled, word_hashes


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"new{rng.random()}"
        elif kind == 1:
            words.insert(at, f"new{rng.random()}")
        elif len(words) > 6:
            del words[at]
    return words


def corpus(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    phrase = fresh(40)
    rows = []
    for _ in range(60):
        base = fresh(rng.randrange(6, 250))
        rows.append(base)
        rows += [edited(rng, base, rng.choice([0, 1, 2, 6])) for _ in range(rng.randrange(3))]
    hot = fresh(120)
    rows += [edited(rng, hot, rng.randrange(5)) for _ in range(80)]
    rows += [hot] * 30
    rows += [phrase + fresh(80) for _ in range(40)]  # a common passage makes no copies
    rows += [["is", "on"] * 60 + fresh(30) for _ in range(25)]  # nor does a phrase said over and over
    texts = [rng.choice([" ", "\n", "  "]).join(w) for w in rows] + ["", None, " \n", "one two", "one two", "one two three", "a b c d e", "a b c d e", "long word " * 20000]
    return [(i, t, "s") for i, t in enumerate(texts)]


def shingles(text):
    """(all with the number of earlier ones, first ones) of a text's runs of five words."""
    words = re.findall(r"[^ \t\n\x0b\x0c\r]+", text or "")
    seen, every, first = Counter(), [], []
    for i in range(len(words) - 4):
        s = tuple(words[i : i + 5])
        every.append((s, seen[s]))
        if not seen[s]:
            first.append(s)
        seen[s] += 1
    return every, first


def aligned(a, b):
    """M / (n + m - M) for the most shingles that both have in the same order, at most a quarter of the longer text apart."""
    if not a or not b:
        return 0.0
    where = {s: i for i, s in enumerate(b)}
    to = [where[s] for i, s in enumerate(a) if s in where and abs(where[s] - i) <= max(5, 0.25 * max(len(a), len(b)))]
    piles = []  # patience sorting: as many piles as the longest increasing run has cards
    for card in to:
        k = next((k for k, top in enumerate(piles) if top >= card), len(piles)) if len(piles) < 50 else bisect.bisect_left(piles, card)
        piles[k : k + 1] = [card]
    return len(piles) / (len(a) + len(b) - len(piles))


def brute(rows, threshold=0.8):
    """Classes by plain Python: nothing of the module under test."""
    up = {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    def join(a, b):
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)

    first, reps = {}, []
    for i, t, _ in rows:
        if not (t or "").strip():
            continue
        if t in first:
            join(first[t], i)
        else:
            first[t] = i
            reps.append((i, *shingles(t)))
    for k, (i, *a) in enumerate(reps):
        for j, *b in reps[:k]:
            if root(i) != root(j) and any(min(len(x), len(y)) >= threshold * max(len(x), len(y)) and aligned(x, y) >= threshold for x, y in zip(a, b)):
                join(i, j)
    return {i: root(i) for i in up}


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, documents, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in near_duplicates(documents(rows).repartition(3)).collect()}
    want = brute(rows)
    assert {i: c for i, (c, _) in got.items()} == want
    assert all(kept == (i == c) for i, (c, kept) in got.items())


def test_alignment():
    a = kmers("a b c d e f g h i j")[1]
    assert alignment(a, a) == 1 and alignment(a, a[:0]) == 0
    assert alignment(a, a[::-1]) == pytest.approx(1 / 11)  # all shared, one in order
    assert alignment(a[:5], a) == pytest.approx(5 / 6)
    far = np.arange(1000, dtype=np.uint64)
    assert alignment(far, np.roll(far, 500)) < 0.1  # outside the band


def test_hashes_and_sketches():
    assert len(word_hashes(" a\tb\n\x0bc ")) == 3 and len(word_hashes(None)) == 0 and len(word_hashes("\xa0x")) == 1
    assert (word_hashes("x y x")[[0, 2]] == word_hashes("x")).all() and len(set(word_hashes("ab ba abb").tolist())) == 3
    labelled, different = kmers("a a a a a a a a")
    assert len(labelled) == 4 and len(different) == 1 and len(kmers("a b c d")[0]) == 0
    assert len(band_keys(labelled)) == 30 and len(band_keys(labelled[:0])) == 0
    long = kmers(" ".join(f"w{i}" for i in range(200_000)))[0]
    assert len(band_keys(long)) == 20 and len(set(band_keys(long).tolist())) == 20
    level, codes = sampled(long)
    assert level == 10 and 120 < len(codes) < 280 and (sampled(long[::-1])[1] == codes).all() and sampled(long[:0])[1].tolist() == []
    assert sampled(long[:256])[0] == 0 and 250 <= len(sampled(long[:256])[1]) <= 256


def test_sampling_finds_what_is_similar():
    rng = np.random.default_rng(1)
    hits = 0
    for _ in range(300):
        both = rng.integers(0, 2**63, 160, dtype=np.uint64)
        one, two = rng.integers(0, 2**63, (2, 20), dtype=np.uint64)
        a, b = np.concatenate([both, one]), np.concatenate([both, two])  # 160 of 200
        hits += bool(set(band_keys(a).tolist()) & set(band_keys(b).tolist()))
    assert hits >= 298


def test_edges(spark, documents):
    assert near_duplicates(documents([])).count() == 0
    rows = [(1, "alone here", "s"), (None, "a b c d e f", "s"), (None, "a b c d e f", "s"), (3, "same id twice and more", "s"), (3, "same id twice and more", "s"), (4, None, "s"), (5, None, "s")]
    got = sorted(((r["doc_id"], r["class_id"], r["kept"]) for r in near_duplicates(documents(rows)).collect()), key=str)
    assert got == sorted([(1, 1, True), (None, None, True), (None, None, True), (3, 3, True), (3, 3, True), (4, 4, True), (5, 5, True)], key=str)


def test_passage_said_twice_against_brute_force(spark, documents):
    """Copies that say once what the original says twice are as similar by their different k-mers, and as likely candidates."""
    rng = random.Random(5)
    rows = []
    for i in range(80):
        base = [f"w{rng.randrange(100_000)}" for _ in range(rng.choice([40, 150, 300, 600]))]
        copy = edited(rng, base, rng.randrange(max(1, len(base) // 60)))
        rows += [base + base, copy] if i % 2 else [base[: len(base) // 2] + base, copy]
    rows = [(i, " ".join(w), "s") for i, w in enumerate(rows)]
    want = brute(rows)
    assert sum(i != c for i, c in want.items()) >= 60
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates(documents(rows)).collect()} == want


def test_repeated_passages_count_as_often_as_they_are_said(spark, documents):
    """Texts that repeat one phrase at length and differ in a few words are copies, as few edits make one of the other."""
    rng = random.Random(6)
    rows = []
    for _ in range(12):
        phrase = [f"w{rng.randrange(100_000)}" for _ in range(rng.randrange(8, 30))]
        base = phrase * (2400 // len(phrase)) + [f"w{rng.randrange(100_000)}" for _ in range(8)]
        rows += [base, base[:-8] + [f"w{rng.randrange(100_000)}" for _ in range(8)], phrase * (300 // len(phrase)) + base[-8:]]
    rows = [(i, " ".join(w), "s") for i, w in enumerate(rows)]
    want = brute(rows)
    assert all(want[3 * k + 1] == 3 * k for k in range(12))
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates(documents(rows)).collect()} == want


@pytest.mark.parametrize("few", [2048, 64, 2])
def test_large_buckets(spark, documents, monkeypatch, few):
    """Buckets of any size give the same classes, also where texts of several lengths share a passage, and some of them are copies."""
    monkeypatch.setattr("sedge.llm.omh.FEW", few)
    monkeypatch.setattr("sedge.llm.omh.STAR_ROUNDS", 0 if few == 2 else 2)
    rng = random.Random(7)
    fresh = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    shared = fresh(60)
    rows = []
    for _ in range(100):
        base = fresh(rng.choice([0, 8, 12, 30])) + shared + fresh(rng.choice([3, 8, 20, 300]))
        rows += [base, *(edited(rng, base, rng.randrange(1, 4)) for _ in range(rng.randrange(2)))]
    rows = [(i, " ".join(w), "s") for i, w in enumerate(rows)]
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates(documents(rows)).collect()} == brute(rows)


def test_a_shared_passage_costs_rows_in_proportion(spark, documents, monkeypatch):
    """Texts that share a passage, but are no copies, meet in linear numbers."""
    from sedge.llm import omh

    monkeypatch.setattr(omh, "FEW", 64)
    met = {}
    for n in (400, 1600):
        rng = random.Random(8)
        passage = " ".join(f"p{k}" for k in range(24))
        rows = [(i, passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)), "s") for i in range(n)]
        pairs = []
        cut = omh.cut
        monkeypatch.setattr(omh, "cut", lambda df, label: (out := cut(df, label), pairs.append(out.count()) if label in ("met", "pairs", "prefixes") else None)[0])
        assert near_duplicates(documents(rows)).where("kept").count() == n
        monkeypatch.setattr(omh, "cut", cut)
        met[n] = sum(pairs)
    assert met[1600] <= 8 * max(met[400], 50)


def test_recall_by_similarity():
    """The share of pairs that meet in a band, by the similarity of their k-mers, for texts of 20 to 400 of them."""
    rng = np.random.default_rng(4)
    for similar, least in ((0.8, 0.99), (0.85, 0.995), (0.9, 1.0)):
        hits = 0
        for _ in range(200):
            n = int(rng.integers(20, 400))
            both = rng.integers(0, 2**63, round(n * similar), dtype=np.uint64)
            one, two = rng.integers(0, 2**63, (2, max(1, (n - len(both)) // 2)), dtype=np.uint64)
            hits += bool(set(band_keys(np.concatenate([both, one])).tolist()) & set(band_keys(np.concatenate([both, two])).tolist()))
        assert hits >= least * 200
