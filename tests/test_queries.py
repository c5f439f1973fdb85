import pytest

from sedge.plans.queries import ORACLE, QUERIES
from tests.support import check_query


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    check_query(spark, QUERIES[name], ORACLE.get(name))


def test_entry_imports_without_the_llm_folders(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/sedge", tmp_path / "sedge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_topk' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_what_the_subpackage_needs_is_not_swallowed(tmp_path):
    """Only the subpackage and the pipeline may be missing; another module that is not there is an error."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.exists(f"{root}/corpus_pipeline.py"):
        pytest.skip("the pipeline is left out")
    shutil.copytree(f"{root}/sedge", tmp_path / "sedge", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(f"{root}/{name}", tmp_path)
    (tmp_path / "public_tokenizers.py").write_text("import a_module_that_is_not_there")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.returncode and "a_module_that_is_not_there" in done.stderr


def test_extraction_reads_whole_texts(spark, tmp_path):
    texts = [" ".join(["1"] * 30 + ["alpha", "beta", "gamma."]), " ".join(["word"] * 40), "one two", "a b c d e f g h i j a b", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["entities"], r["relationships"]) for r in QUERIES["extraction_parse"](spark, str(tmp_path)).collect()}
    assert got == {0: (3, 2), 1: (8, 39), 2: (2, 1), 3: (8, 8), 4: (0, 0)}


def test_documents_without_chunks(spark):
    """No document of the tables lacks chunks, so it is tested here."""
    from sedge.operators import retrieval

    docs = spark.sql("SELECT id, 't' AS title, 's' AS source, 'c' AS content, '{}' AS metadata, timestamp_seconds(id) AS created_at, timestamp_seconds(id) AS updated_at FROM range(4)")
    chunks = spark.sql("SELECT id, id % 2 AS document_id, 'c' AS content, cast(id AS int) AS chunk_index, '{}' AS metadata, 3 AS token_count FROM range(5)")
    assert [(r["id"], r["chunk_count"]) for r in retrieval.list_documents(docs, chunks).collect()] == [(3, 0), (2, 0), (1, 2), (0, 3)]
    assert sorted((r["id"], r["chunk_count"], r["total_tokens"]) for r in retrieval.document_summaries(docs, chunks).collect()) == [(0, 3, 9), (1, 2, 6), (2, 0, None), (3, 0, None)]
    assert retrieval.get_document(docs, chunks, 3).first()["chunks"] == [] and [r["chunk_index"] for r in retrieval.document_chunks(chunks, 0).collect()] == [0, 2, 4]


def test_sessions_that_begin_now_and_null_ids(spark, tmp_path, monkeypatch):
    """Conversation 120 begins at the query's now, and is on no table of the smallest sizes."""
    import shutil

    from tests import support

    for t in support.TABLES:
        if t != "conversations":
            shutil.copy(f"{support.SF}/{t}.parquet", tmp_path)
    rows = [(i, 0) for i in (60, 120, 119, 238, 7)] + [(None, 0), (None, 1)]
    spark.createDataFrame(rows, "conv_id long, turn int").coalesce(1).write.parquet(f"{tmp_path}/written")
    shutil.copy(next(tmp_path.glob("written/part*")), f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(support, "SF", str(tmp_path))
    check_query(spark, QUERIES["session_get_or_create"], ORACLE["session_get_or_create"])
