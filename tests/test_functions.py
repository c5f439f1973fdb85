import random

import pytest
from pyspark.sql import functions as F

from sedge.functions import text as X
from sedge.functions.chunking import ChunkConfig, chunk_column, chunk_semantic, chunk_simple, fixed_stride, pack_paragraphs, split_boundaries, split_semantic, split_structure
from sedge.functions.vectors import clamp, cosine, cosine_to


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def checked_pieces(text, pieces, size, overlap, least):
    """Every cut is behind the last sentence end of its stretch, or at the size if it has none; starts follow from the cuts."""
    at = 0
    for piece in pieces[:-1]:
        assert text.startswith(piece, at)
        stretch = range(max(at + least, at + size - 200) + 1, at + size + 1)
        ends = [i + 1 for i in stretch if text[i] in ".!?\n"]
        assert at + len(piece) == (ends or [at + size])[-1]
        at += len(piece) - overlap
    assert not pieces and not text or text[at:] == pieces[-1] and len(pieces[-1]) <= size


def test_boundaries_follow_the_rule():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab c.!\n") for _ in range(rng.randrange(0, 900)))
        size = rng.randrange(40, 400)
        least = rng.randrange(1, size)
        overlap = rng.randrange(0, min(size, max(least, size - 200)))
        checked_pieces(text, split_boundaries(text, ChunkConfig(size, overlap, least=least)), size, overlap, least)


def test_boundaries_always_end():
    text = ("x" * 99 + ".") * 20
    pieces = split_boundaries(text, ChunkConfig(150, 140, least=100))
    assert pieces[-1].endswith(".") and len(pieces) < len(text)


def test_config_is_checked():
    with pytest.raises(ValueError):
        ChunkConfig(100, 100)
    with pytest.raises(ValueError):
        ChunkConfig(100, 10, least=0)


def test_empty_and_blank_texts_have_no_chunks():
    for text in (None, "", " \n "):
        assert chunk_simple(text, ChunkConfig()) == [] and chunk_semantic(text, ChunkConfig()) == []


def test_paragraphs_are_packed_and_numbered():
    text = "First paragraph here.\n\nSecond paragraph.\n \nThird one."
    chunks = chunk_simple(text, ChunkConfig(45, 10, least=5))
    assert [c[0] for c in chunks] == ["First paragraph here.\n\nSecond paragraph.", "Third one."]
    assert [c[1] for c in chunks] == [0, 1]
    assert chunks[1][2] == len(chunks[0][0]) - 10


def test_oversize_lines_are_split_near_the_size():
    text = "Ο Αριστοτέλης ήταν φιλόσοφος. " * 50
    assert all(len(p) <= 101 for p in pack_paragraphs(text, ChunkConfig(100, 20, least=20)))


def test_structure_keeps_headings():
    sections = split_structure("Intro\n# Head\nBody text\n\n- item one\n- item two\n")
    assert any("# Head" in s for s in sections) and all(s.strip() for s in sections)


def test_semantic_uses_and_survives_a_splitter():
    text = "# T\n" + "word " * 700
    config = ChunkConfig(200, 20, most=500, least=20)
    good, how = split_semantic(text, config, lambda s: ["y" * 100, "z" * 5])
    assert "y" * 100 in good and "z" * 5 not in good and how == "semantic"

    def broken(_):
        raise RuntimeError

    assert split_semantic(text, config, broken)[0]
    assert split_semantic("short", config) == (["short"], "simple")


def test_chunk_columns(spark):
    df = spark.createDataFrame([(1, "a\n\nb" * 50), (2, None), (3, "")], "id int, t string")
    rows = {r["id"]: r["c"] for r in df.select("id", chunk_column(F.col("t"), ChunkConfig(50, 5, least=5), True).alias("c")).collect()}
    assert rows[1] and rows[2] == [] and rows[3] == []
    strides = {r["id"]: r["c"] for r in df.select("id", fixed_stride(F.col("t"), 10, 2).alias("c")).collect()}
    assert strides[3] == [] and "".join(p[: 8] for p in strides[1][:-1]) + strides[1][-1] == "a\n\nb" * 50


def test_cosine(spark):
    a, b, z = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, cosine(a, b)) == pytest.approx(1)
    assert one(spark, cosine(a, z)) == 0 and one(spark, cosine(a, F.array(F.lit(1.0)))) == 0
    assert one(spark, cosine(a, F.lit(None).cast("array<double>"))) is None
    assert one(spark, cosine_to(a, [2.0, 4.0])) == pytest.approx(1)
    assert one(spark, cosine_to(a, [0.0, 0.0])) == 0 and one(spark, cosine_to(a, [1.0])) == 0 and one(spark, cosine_to(z, [1.0, 1.0])) == 0
    assert one(spark, cosine_to(F.array_repeat(F.lit(1.0), 300), [1.0] * 300)) == pytest.approx(1)


@pytest.mark.parametrize("value, expected", [(1.5, 1.0), (-0.5, 0.0), (0.85, 0.85), (float("nan"), 1.0)])
def test_clamp(spark, value, expected):
    assert one(spark, clamp(F.lit(value))) == expected


def test_repair_and_names(spark):
    assert X.repaired("\x0394\x03b7") == "Δη" and X.repaired("\x000e9t") == "ét"
    assert X.repaired("clean") == "clean" and X.repaired("") == "" and X.repaired(None) is None
    assert one(spark, X.normal_name(F.lit("  ΣΩΚΡΑΤΗΣ\n"))) == "σωκρατης"
    assert one(spark, X.normal_name(F.lit(None).cast("string"))) == ""


def test_rank(spark):
    words = X.tokens(F.lit("a b x a c b"))
    assert one(spark, X.rank_one_term(words, F.lit("a"))) == pytest.approx(0.2)
    assert one(spark, X.rank_cover(words, F.array(F.lit("a"), F.lit("b")))) == pytest.approx(0.1 + 0.1 / 2 + 0.1 / 2)
    assert one(spark, X.matches(words, X.query_terms(F.lit("A c")))) and not one(spark, X.matches(words, X.query_terms(F.lit("a q"))))
    assert not one(spark, X.matches(words, X.query_terms(F.lit(""))))


def test_title_and_counts(spark):
    assert one(spark, X.title(F.lit("x\n  #  Name \ny"), F.lit("/d/f.md"))) == "Name"
    assert one(spark, X.title(F.lit("x"), F.lit("/d/f.tar.gz"))) == "f.tar"
    assert one(spark, X.title(F.lit("\n" * 10 + "# late"), F.lit("/d/f"))) == "f"
    assert one(spark, X.word_count(F.lit(" \n"))) == 0 and one(spark, X.token_count(F.lit("abcdefg"))) == 1


def test_front_matter():
    assert X.front_matter("---\nauthor: X\ndate: 2020-01-02\n---\nbody") == '{"author": "X", "date": "2020-01-02"}'
    assert X.front_matter("---\n- a\n---\n") is None and X.front_matter("---\n: : :\n---\n") is None and X.front_matter("no") is None


def test_json(spark):
    doc = F.lit('{"a": {"b": [1, 2], "c": "x"}, "t": true, "n": null, "s": "1"}')
    for wanted, expected in [({"a": {"c": "x"}}, True), ({"a": {"b": [2]}}, True), ({"a": {"b": [3]}}, False), ({"t": True}, True), ({"n": None}, True), ({"s": 1}, False), ({"s": "1"}, True), ({"q": 1}, False), ({}, True)]:
        assert one(spark, X.json_contains(doc, wanted)) is expected, wanted
    assert not one(spark, X.json_contains(F.lit(None).cast("string"), {"a": 1}))
    assert one(spark, X.json_merge(F.lit('{"b":{"x":1},"a":1}'), F.lit('{"b":{"y":2}}'))) == '{"a":1,"b":{"y":2}}'
    assert one(spark, X.json_merge(F.lit(None).cast("string"), F.lit('{"b":1}'))) == '{"b":1}'
