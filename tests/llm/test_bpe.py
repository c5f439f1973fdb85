import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from sedge.llm import bpe
from sedge.llm.bpe import Coder, decode, encode, read_ranks, roundtrip

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return Coder(PATH, PATTERN)


def texts(seed, n):
    rng = random.Random(seed)
    odd = ["\x1c", "\x85", "\xa0", "​", "\r", "\n", "\t", "  ", "'s", "'LL", "é", "日本", "😀", "<|endoftext|>", "0", "12", "..", "the", " of", "ing", "Ω"]
    return ["".join(rng.choice(odd) if rng.random() < 0.5 else chr(rng.randrange(33, 0x3000)) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_words_are_encoded_as_the_library_does(own, library):
    for text in texts(1, 150):
        (words,) = own.words(text)
        own.learn(set(words))
        assert " ".join(own.coded[w] for w in words) == " ".join(map(str, library.encode_ordinary(text)))


def random_vocabulary(tmp_path, seed):
    """Ranks in no order that training would give, so that merges make pairs of lesser rank possible."""
    rng = random.Random(seed)
    pieces = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 8))).encode() for _ in range(60)}
    order = [bytes([i]) for i in range(256)] + sorted(sorted(pieces), key=lambda _: rng.random())
    path = tmp_path / f"{seed}.tiktoken"
    path.write_text("".join(f"{base64.b64encode(b).decode()} {k}\n" for k, b in enumerate(order)))
    return str(path)


def one_at_a_time(ranks, word):
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while pairs := [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]:
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@pytest.mark.parametrize("seed", range(4))
def test_both_queries_contract_one_pair_at_a_time(tmp_path, monkeypatch, seed):
    path, rng = random_vocabulary(tmp_path, seed), random.Random(seed)
    words = ["".join(rng.choice("aaabbc") for _ in range(rng.randrange(1, 60))) for _ in range(150)] + [p * n for p in ("a", "ab", "abca") for n in range(1, 30)]
    want = [" ".join(map(str, one_at_a_time(read_ranks(path), w.encode()))) for w in words]
    coder = Coder(path, "x")
    for short, chunk, n in ((1 << 20, 1 << 20, 300), (0, 1 << 20, 300), (0, 16, 40)):
        monkeypatch.setattr(bpe, "SHORT_BYTES", short)
        monkeypatch.setattr(bpe, "CHUNK_BYTES", chunk)
        assert coder.encode_words(words[-n:]) == want[-n:] and coder.encode_words(words[:n]) == want[:n]


def test_unspaced_texts(own, library):
    rng = random.Random(2)
    cjk = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n))
    long = ["".join(rng.choice("abcdeghinorst") for _ in range(n)) for n in (33, 257, 1000, 400_000)] + ["a" * 300_000, "=" * 200_000, "thequickbrownfox" * 20_000]
    words = [cjk(85) for _ in range(3000)] + [cjk(100_000), "".join(chr(rng.randrange(0xE01, 0xE2F)) for _ in range(100_000)), *long]
    for word, ids in zip(words, own.encode_words(words)):
        assert ids == " ".join(map(str, library._encode_single_piece(word.encode())))


def test_a_wrong_id_shows_in_what_is_decoded(library):
    coder = Coder(PATH, PATTERN)
    text = "some ordinary words"
    want = hashlib.sha256(text.encode()).hexdigest()
    assert bpe._digest(coder, [text])[0][2] == want
    word = " ordinary"
    coder.coded[word] = coder.coded[word].replace(coder.coded[word].split()[0], "11", 1)
    assert bpe._digest(coder, [text])[0][2] != want


def test_long_texts_come_in_pieces(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_CHARS", 500)
    monkeypatch.setattr(bpe, "BATCH_WORDS", 40)
    monkeypatch.setattr(bpe, "BATCH_IDS", 30)
    some = [None, "", *texts(5, 30), "one word after another " * 200, "", "x" * 3000]
    for text, got in zip(some, bpe._digest(own, some)):
        ids = library.encode_ordinary(text or "")
        assert got == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_bounded_cache(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 40)
    coder = Coder(PATH, PATTERN)
    for text in texts(3, 60):
        (words,) = coder.words(text)
        coder.learn(set(words))
        assert " ".join(coder.coded[w] for w in words) == " ".join(map(str, library.encode_ordinary(text)))
        assert len(coder.coded) <= 20 + len(set(words))


def test_round_trip(spark, documents, library):
    rows = [(i, t, "s") for i, t in enumerate([None, "", " ", *texts(4, 40), "long " * 50000])] + [(1, "again", "s"), (1, "again", "s"), (None, "no id", None)]
    df = documents(rows)
    digests = {(r["doc_id"], r["decoded_sha256"]): r for r in roundtrip(df, PATH, PATTERN).collect()}
    ids = encode(df, PATH, PATTERN)
    for i, text, _ in rows:
        r = digests[i, hashlib.sha256((text or "").encode()).hexdigest()]
        want = library.encode_ordinary(text or "")
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert sorted(bytes(r["bytes"]) for r in decode(ids, PATH).collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert roundtrip(documents([]), PATH, PATTERN).count() == 0 and encode(documents([]), PATH, PATTERN).count() == 0


def test_unknown_ids_fail(spark):
    with pytest.raises(Exception, match="vocabulary"):
        decode(spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>"), PATH).collect()
    assert bytes(decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first()["bytes"]) == b""
