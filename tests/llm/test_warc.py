import hashlib

import zstandard
from pyspark.sql import functions as F

from sedge.llm.warc import Bundle, parse, read_archives, write_archives

PAGE = "page_id long, url string, html string, digest string, n long, first long"


def test_archives(spark, tmp_path):
    long = "<p>same</p>" * 20
    rows = [(3, "http://a", long), (1, "http://b\r\nX: y", long), (2, None, "é" * 60), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "big" * 500000), (1, "http://b\r\nX: y", long), (None, "u", long), (9, "u", "\r\n\r\n" * 40)]
    df = spark.createDataFrame([(*r, "d", 1, 2) for r in rows], PAGE).repartition(3)
    index = write_archives(df, f"file://{tmp_path}/warc", frame_bytes=1000)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read_archives(index).collect()), key=str)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        shared = html == long and i != 1
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if shared else "response", 1 if shared else None))
    assert got == sorted(want, key=str)
    for r in index.collect():
        record = Bundle(r["bundle"]).record(r["frame"], r["offset"])
        assert record.headers["WARC-Record-ID"].startswith(f"<urn:page:{'' if r['page_id'] is None else r['page_id']}:") and record.kind == r["record_type"]


def test_record_ids(spark, tmp_path):
    """Pages that share an id, or have none, have records of their own; a revisit refers to a record that is there."""
    rows = [(1, "u", "one" * 60), (1, "u", "two" * 60), (2, "u", "two" * 60), (None, "u", "x"), (None, "u", "y"), (None, "u", "x")]
    index = write_archives(spark.createDataFrame([(*r, "d", 1, 2) for r in rows], PAGE), f"file://{tmp_path}/w")
    records = [Bundle(r["bundle"]).record(r["frame"], r["offset"]) for r in index.collect()]
    ids = [r.headers["WARC-Record-ID"] for r in records]
    assert len(set(ids)) == 6 and [r.headers["WARC-Refers-To"] in ids for r in records if r.kind == "revisit"] == [True]


def test_frames_are_read_in_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("sedge.llm.warc.READ_BYTES", 20_000)
    df = spark.createDataFrame([(i, "u", f"page {i} " * 300, "d", 1, 2) for i in range(100)], PAGE).coalesce(1)
    read = read_archives(write_archives(df, f"file://{tmp_path}/w", frame_bytes=2000))
    assert read.rdd.getNumPartitions() >= 10 and read.count() == 100 and read.withColumn("t", F.spark_partition_id()).select("t").distinct().count() >= 5


def test_bundles_are_plain_zstandard(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 30, "d", 1, 2) for i in range(50)], PAGE).coalesce(1)
    index = write_archives(df, f"file://{tmp_path}/w", frame_bytes=2000)
    path = index.first()["bundle"].removeprefix("file://")
    with open(path, "rb") as f:
        data = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    at = n = 0
    while at < len(data):
        _, at = parse(data, at)
        n += 1
    assert n == 51 and index.select("frame").distinct().count() > 5


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], PAGE)
    assert read_archives(write_archives(df, f"file://{tmp_path}/w")).count() == 0
