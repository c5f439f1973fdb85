import time

import pytest

from sedge.llm.shards import Conflict, Shard, ShardStore, shard


def test_plan_merges_neighbours_of_a_tier():
    shards = [Shard(f"s{i}", 1, 1000) for i in range(5)] + [Shard(f"b{i}", 1, 1 << 20) for i in range(3)] + [Shard("big", 1, 200 << 20)]
    groups = ShardStore.plan(shards, target_bytes=128 << 20)
    assert [sorted(s.path for s in g) for g in groups] == [["s0", "s1", "s2", "s3", "s4"]]
    packed = ShardStore.plan(shards, target_bytes=128 << 20, final=True)
    assert sum(len(g) for g in packed) == 8 and all(sum(s.bytes for s in g) <= 128 << 20 for g in packed)
    assert ShardStore.plan([], 100) == [] and ShardStore.plan(shards[:1], 100000, final=True) == []


def test_arrivals_and_compaction(spark, documents, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    rows = [(i, None if i % 9 == 0 else "text " * (i % 50), None if i % 7 == 0 else "s") for i in range(300)] + [(5, "x" * 500000, "s")] * 2
    for at in range(0, len(rows), 50):
        store.append(documents(rows[at : at + 50]).coalesce(2), shard_rows=20)
    before = store.manifest()
    assert before[0] == 7 and len(before[1]) > 20
    version = store.compact(fan=4)
    after = store.manifest()
    assert version == after[0] > 7 and len(after[1]) < len(before[1]) and sum(s.rows for s in after[1]) == len(rows)
    order = ("doc_id", "text", "source")
    same = lambda df: sorted(map(str, df.select(*order).collect()))
    assert same(store.read()) == same(documents(rows)) == same(store.read(7))
    assert store.vacuum() > 0 and store.versions() == [after[0]] and same(store.read()) == same(documents(rows))
    with pytest.raises(ValueError):
        store.append(documents(rows).select("doc_id"))


def test_one_of_two_writers_commits(spark, documents, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    store.append(documents([(1, "a", "s")]))
    _, shards, schema = store.manifest()
    store.commit(1, shards, schema)
    with pytest.raises(Conflict):
        store.commit(1, [], schema)
    assert store.versions() == [1, 2] and store.read().count() == 1


def test_empty(spark, documents, tmp_path):
    with pytest.raises(ValueError):
        ShardStore(spark, f"file://{tmp_path}/none").read()
    store = shard(documents([]), f"file://{tmp_path}/s")
    assert store.read().count() == 0 and store.read().columns == documents([]).columns


def test_shard_merges_by_tiers(spark, tmp_path, monkeypatch):
    passes = []
    plan = ShardStore.plan
    monkeypatch.setattr(ShardStore, "plan", staticmethod(lambda *a: passes.append((a[3], plan(*a))) or passes[-1][1]))
    rows = spark.range(0, 400, 1, 2).selectExpr("id", "cast(id AS string) AS text")
    store = shard(rows, f"file://{tmp_path}/s", shard_rows=10)
    assert sum(bool(groups) for final, groups in passes if not final) >= 2
    assert sorted(r["id"] for r in store.read().collect()) == list(range(400))


TYPES = """
SELECT id, timestamp '1500-01-01 00:00:00' + make_dt_interval(cast(id AS int) * 10000) AS at, timestamp_ntz '9999-12-31 23:59:59.999999' AS plain, timestamp '2024-03-10 02:30:00.123456' AS late,
       date_add(date '0001-01-01', cast(id * 1000 AS int)) AS day, cast(id / 3 AS decimal(38, 10)) AS money, cast(id AS decimal(5, 2)) AS small,
       map('k', id, 'n', null) AS pairs, named_struct('a', id, 'b', array('x', null), 'c', named_struct('d', cast(null AS string))) AS nested,
       cast(concat('b', id) AS binary) AS raw, array(array(id), null, array()) AS lists, cast(id AS byte) AS tiny, cast(id AS short) AS short,
       cast('nan' AS double) AS odd, cast(id AS float) AS single, id % 2 = 0 AS yes, cast(null AS string) AS none, make_dt_interval(1, 2, 3, 4.5) AS span, make_ym_interval(1, 2) AS months
FROM range(0, 60, 1, 3)
"""


def test_all_types_come_back(spark, tmp_path):
    rows = spark.sql(TYPES)
    store = shard(rows, f"file://{tmp_path}/s", shard_rows=4)
    # as JSON, since Python has no values for some of these
    same = lambda df: sorted(r[0] for r in df.selectExpr("to_json(struct(*)) || cast(plain AS string) || cast(at AS string)").collect())
    assert store.read().schema.simpleString() == rows.schema.simpleString() and len(store.manifest()[1]) == 1
    assert same(store.read()) == same(rows)


def test_planning_a_million_shards():
    shards = [Shard(f"data/r/{i}", 10, 1 << 20) for i in range(1_000_000)]
    began = time.perf_counter()
    groups = ShardStore.plan(shards)
    assert len(groups) == 7813 and time.perf_counter() - began < 20


def test_files_of_failed_tasks_go(spark, documents, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    store.append(documents([(1, "a", "s")]))
    folder = tmp_path / "s" / "data" / "lost"
    folder.mkdir()
    (folder / "x.parquet").write_bytes(b"half a file")
    assert store.vacuum() == 0 and store.vacuum(grace=-60) >= 1 and not (folder / "x.parquet").exists() and store.read().count() == 1


def test_the_query_merges_by_tiers(spark, tmp_path, monkeypatch):
    """As the query shards: some tasks' files in each arrival, merged by tier as they come; every version counts all rows so far."""
    kept = []
    commit = ShardStore.commit
    monkeypatch.setattr(ShardStore, "commit", lambda self, base, shards, schema: kept.append(shards) or commit(self, base, shards, schema))
    store = shard(spark.range(0, 4000, 1, 8).selectExpr("id", "repeat(cast(id AS string), 20) AS text"), f"file://{tmp_path}/s")
    assert [len(s) for s in kept] == [8, 1, 9, 2, 10, 3, 11, 4, 1] or max(map(len, kept)) > len(store.manifest()[1])
    assert [sum(x.rows for x in s) for s in kept][-1] == 4000 and len(store.manifest()[1]) == 1


def test_columns_named_like_the_operators_own_stay(spark, tmp_path):
    df = spark.range(0, 50, 1, 3).selectExpr("id", "cast(id % 4 AS int) AS __arrival", "'x' AS ___arrival", "id AS __Arrival_")
    back = shard(df, f"file://{tmp_path}/s").read()
    assert back.columns == df.columns and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    few = shard(spark.range(2), f"file://{tmp_path}/few").read()
    assert sorted(r["id"] for r in few.collect()) == [0, 1]
