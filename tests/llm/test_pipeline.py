import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from sedge.llm.bpe import read_ranks
from sedge.llm.queries import OP6_SQL, OP9_SQL
from tests.llm.test_mixing import size, water_fill
from tests.llm.test_omh import brute
from tests.support import SF


def by_sql(path, statement):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    found = db.execute(statement)
    names = [d[0] for d in found.description]
    return [dict(zip(names, r)) for r in found.fetchall()]


def check_stages(spark, docs, folder):
    """Every stage against DuckDB, plain Python or another library, each on what the stage before it left."""
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})

    def written(df, name):
        assert df.columns == list(corpus_pipeline.COLUMNS)
        df.coalesce(1).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}"), [r.asDict() for r in spark.read.parquet(f"{folder}/{name}").collect()]

    docs, rows = written(docs, "documents")
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: str((r["doc_id"], r["text"]))
    counted = lambda rows: Counter(map(key, rows))
    kept, kept_rows = written(stages["quality"](spark, docs, SF), "quality")
    verdicts = Counter((r["doc_id"], r["n_words"]) for r in by_sql(f"{folder}/documents/*.parquet", OP9_SQL) if r["kept"])
    assert Counter((r["doc_id"], size(r["text"])) for r in kept_rows) == verdicts
    lines, lines_rows = written(stages["line_dedup"](spark, kept, SF), "line_dedup")
    left = [r for r in by_sql(f"{folder}/quality/*.parquet", OP6_SQL) if not r["n_removed"] or r["n_lines"] > r["n_removed"]]
    assert counted(lines_rows) == counted(left) and all(r["n_chars"] == len(r["text"] or "") for r in lines_rows)
    near, near_rows = written(stages["near_dedup"](spark, lines, SF), "near_dedup")
    own = [(r["doc_id"], r["text"], r["source"]) for r in lines_rows if r["doc_id"] is not None]
    if len({i for i, _, _ in own}) == len(own):
        classes = brute(own)
        assert sorted(r["doc_id"] for r in near_rows if r["doc_id"] is not None) == sorted(i for i, c in classes.items() if i == c)
    assert not counted(near_rows) - counted(lines_rows)
    mixed, mixed_rows = written(stages["mixing"](spark, near, SF), "mixing")
    sizes = defaultdict(int)
    for r in near_rows:
        sizes[r["source"]] += size(r["text"])
    want, taken, largest = water_fill(sizes, (3, 1, 2), 1.5, 2) if sizes else {}, defaultdict(int), defaultdict(int)
    for r in mixed_rows:
        taken[r["source"]] += size(r["text"])
    for r in near_rows:
        largest[r["source"]] = max(largest[r["source"]], size(r["text"]))
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    before, after = counted(near_rows), counted(mixed_rows)
    for r in near_rows:
        rate = want[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert math.floor(rate) * before[key(r)] <= after[key(r)] <= math.ceil(rate) * before[key(r)] or not size(r["text"])
    assert not set(after) - set(before)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    got = Counter((r["doc_id"], r["source"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in stages["encoding"](spark, mixed, SF).collect())
    ids = [(r, library.encode_ordinary(r["text"] or "")) for r in mixed_rows]
    assert got == Counter((r["doc_id"], r["source"], len(x), digest(" ".join(map(str, x)).encode()), digest((r["text"] or "").encode())) for r, x in ids)
    return kept_rows, lines_rows, near_rows, mixed_rows


def test_stages_against_others(spark, tmp_path):
    kept, lines, near, mixed = check_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), tmp_path)
    assert len(kept) >= len(lines) > len(near) > 50 and len(mixed) > len(near)


def test_stages_of_odd_rows(spark, documents, tmp_path):
    """Nulls in every column, empty and blank texts, one long text, ties, rows that repeat, ids that repeat."""
    words = lambda a, n=30: " ".join(f"w{a}x{k}" for k in range(n))
    rows = [(i, words(i), "s") for i in range(12)] + [(None, words(50), "s"), (None, words(50), None), (20, words(51), None), (21, None, "s"), (22, "", "t"), (23, " \n\t", "t")]
    rows += [(30, words(52), "t")] * 3 + [(30, words(53), "t"), (31, words(54, 3_000), "t"), (32, words(55, 60) + "\n" + words(55, 61), "u"), (33, words(55, 60) + "\n" + words(55, 61), "u")]
    check_stages(spark, documents(rows).select(*corpus_pipeline.COLUMNS), tmp_path)


def test_brute_force_of_odd_ids(spark, documents, tmp_path):
    """The same with ids of their own, so that near dedup is compared as well."""
    words = lambda a, n=30: " ".join(f"w{a}x{k}" for k in range(n))
    rows = [(i, words(i % 9, 30 + i // 9), f"s{i % 3}") for i in range(27)] + [(40, None, None), (41, "", "s1"), (42, words(99, 3_000), None)]
    check_stages(spark, documents(rows).select(*corpus_pipeline.COLUMNS), tmp_path)


def test_run_gives_the_same_rows(spark):
    rows = [sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]


@pytest.mark.parametrize("at", range(5))
def test_stages_take_nothing(spark, at):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[at][1](spark, docs, SF).count() == 0


def test_near_dedup_of_repeated_rows(spark, documents):
    one, two, three = ("a b c d e f g", "h i j k l m n", "o p q r s t u")
    rows = [(1, one, "s")] * 3 + [(None, two, "s")] * 2 + [(None, one, "s"), (2, one, "s"), (2, three, "s"), (4, None, "s"), (4, None, "s")]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, documents(rows).select(*corpus_pipeline.COLUMNS), SF).collect()]
    want = [(1, one)] * 3 + [(None, two)] * 2 + [(None, one), (2, three), (4, None), (4, None)]  # the copy of 1 that is numbered 2 goes
    assert sorted(got, key=str) == sorted(want, key=str)
