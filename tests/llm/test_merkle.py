import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sedge.llm.merkle import BLOCK, FAN, Subtree, fold, height, merkle_paths, paths, proof_digest


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """All levels of a tree, by the rule."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([H("".join(low[i : i + FAN])) for i in range(0, len(low), FAN)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        run = at - at % FAN
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + FAN])))
        at //= FAN
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 73, 511, 512, 513, 600, 4095, 4096])
def test_traversal_gives_the_siblings_of_every_leaf(n):
    leaves = [H(str(i)) for i in range(n)]
    levels = tree(leaves)
    assert height(n) == len(levels) - 1
    assert list(paths(leaves, height(n))) == [siblings(levels, i) for i in range(n)]
    whole = Subtree(height(n), height(n))
    for digest in leaves:
        whole.push(digest)
    assert whole.close().root == levels[-1][0]


def test_a_lone_block_at_the_end_keeps_all_its_levels():
    """The last block of a larger tree may have one leaf, which is hashed by itself at each level."""
    assert [p for p in paths([H("x")], 4)] == [[("", "")] * 4]


def expected(rows):
    """Rows of (doc_id, text, lang, source, n_chars) to (leaf, path, subroot, root), sorted."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H("".join(field(r[i]) for i in (0, 3, 2, 4, 1)))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([h for _, h in sorted(groups[g])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, h in enumerate(trees[g][0]):
            out.append((h, siblings(trees[g], i) + siblings(top, at), trees[g][-1][0], top[-1][0]))
    return sorted(out)


def got(df):
    return sorted((r["digest"], [(s["left"], s["right"]) for s in r["path"]], r["subroot"], r["root"]) for r in df.collect())


def test_against_the_rule(spark):
    rng = random.Random(3)
    langs = [None, "", "a", "b", "é", "zz", "Z", "中", "𝄞", "�", "x"]
    rows = [(rng.choice([None, *range(-5, 200)]), rng.choice([None, "", "Text é", "b" * 5000]), rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, 0, -3])) for _ in range(400)]
    rows += [rows[0]] * 20 + [(i, str(i), "big", "s", i) for i in range(1000)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string, place long, tree int")
    assert got(merkle_paths(docs)) == expected(rows)


def test_trees_of_more_than_a_block(spark):
    rows = [(i, None, "a", None, None) for i in range(2 * BLOCK + 1)] + [(i, "t", "b", None, None) for i in range(BLOCK)] + [(1, "t", "c", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    found = merkle_paths(docs, seen=F.lit("0" * 64)).cache()
    assert got(found) == expected(rows)
    bad = found.where((fold(F.col("digest"), F.col("path")) != F.col("root")) | (fold(F.col("seen"), F.col("path")) == F.col("root")))
    assert bad.count() == 0


def test_small_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert merkle_paths(spark.createDataFrame([], schema)).collect() == []
    row = merkle_paths(spark.createDataFrame([(None, None, None, None, None)], schema)).withColumn("proof", proof_digest(F.col("path"))).first()
    assert row["path"] == [] and row["digest"] == row["subroot"] == row["root"] == H("-----") and row["proof"] == H("")
