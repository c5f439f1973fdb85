"""Size-tiered compaction of immutable shards under versioned manifests.

A store is a folder. ``data/`` holds parquet shards that are never changed; ``manifests/`` holds one JSON file a version,
listing the shards that make up the store then. A version appears by a rename that fails if the version is there already, so of
two writers one commits and the other has to start again from the new version. Shards of failed tasks are never listed, and
``vacuum`` finds them. The driver holds one small entry a shard, as many as the store has files.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sedge.runtime import own_prefix, scratch_path

TARGET_BYTES = 128 << 20
FAN = 4
BASE_BYTES = 64 << 10
#: Appends that shard() makes of its input.
ARRIVALS = 4


#: Seconds that files which no version lists are left alone, as they may be another writer's.
GRACE = 86_400.0


@dataclass(frozen=True, slots=True)
class Shard:
    path: str
    rows: int
    bytes: int

    @property
    def tier(self) -> int:
        """0 up to BASE_BYTES, one more for every factor of FAN."""
        return max(0, math.ceil(math.log(max(self.bytes, 1) / BASE_BYTES, FAN)))


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm = spark, root.rstrip("/"), spark.sparkContext._jvm

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("manifests")
        if not fs.exists(folder):
            return []
        return sorted(int(n[1:-5]) for s in fs.listStatus(folder) if (n := s.getPath().getName()).startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard], str | None]:
        """(version, shards, schema) of a version, by default the latest; version 0 is the empty store."""
        version = max(self.versions(), default=0) if version is None else version
        if version == 0:
            return 0, [], None
        # one small line a shard; read through Spark so that any store will do
        text = "".join(r[0] for r in self.spark.read.text(f"{self.root}/manifests/v{version:08d}.json", wholetext=True).collect())
        found = json.loads(text)
        return version, [Shard(**s) for s in found["shards"]], found["schema"]

    def commit(self, base: int, shards: list[Shard], schema: str) -> int:
        """Make ``shards`` the version after ``base``; Conflict if that version exists."""
        fs, version = self._fs(), base + 1
        fs.mkdirs(self._path("manifests"))
        draft = self._path(f"manifests/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]}).encode())
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, self._path(f"manifests/v{version:08d}.json"), options)
        except Exception as error:
            fs.delete(draft, False)
            if fs.exists(self._path(f"manifests/v{version:08d}.json")):
                raise Conflict(f"version {version} exists") from error
            raise
        return version

    def append(self, df: DataFrame, shard_rows: int = 0) -> int:
        """Add the rows of ``df`` as small shards, one a task, or several of at most ``shard_rows`` rows, and commit. No shuffle."""
        base, shards, schema = self.manifest()
        if schema is not None and T.StructType.fromJson(json.loads(schema)) != df.schema:
            raise ValueError("the rows have another schema than the store")
        run = f"data/{uuid.uuid4().hex}"
        with _microseconds(self.spark):
            df.write.option("maxRecordsPerFile", shard_rows).option("compression", "zstd").parquet(f"{self.root}/{run}")
        counts = self.spark.read.schema(df.schema).parquet(f"{self.root}/{run}").groupBy(F.input_file_name().alias("p")).agg(F.count("*").alias("n"))
        rows = {r["p"].rpartition("/")[2]: r["n"] for r in counts.collect()}  # one small row a shard, as in the manifest
        fresh = [Shard(f"{run}/{n}", rows[n], s.getLen()) for s in self._fs().listStatus(self._path(run)) if rows.get(n := s.getPath().getName())]
        return self.commit(base, [*shards, *sorted(fresh, key=lambda s: s.path)], df.schema.json())

    @staticmethod
    def plan(shards: list[Shard], target_bytes: int = TARGET_BYTES, fan: int = FAN, final: bool = False) -> list[list[Shard]]:
        """Groups to merge: neighbours in size of one tier, up to the target together.

        A tier is left to grow while it has fewer than ``fan`` shards. With ``final`` all shards below the target are packed,
        small next to small, whatever their tier.
        """
        small = sorted((s for s in shards if s.bytes < target_bytes // 2), key=lambda s: (s.bytes, s.path))
        tiers: dict[int, list[Shard]] = {}
        for s in small:
            tiers.setdefault(0 if final else s.tier, []).append(s)
        groups = []
        for members in tiers.values():
            if len(members) < (2 if final else fan):
                continue
            group: list[Shard] = []
            size = 0
            for s in members:
                if group and size + s.bytes > target_bytes:
                    groups.append(group)
                    group, size = [], 0
                group.append(s)
                size += s.bytes
            groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self, target_bytes: int = TARGET_BYTES, fan: int = FAN, final: bool = False) -> int:
        """Merge similarly sized shards until no group is left, one commit a pass; return the version.

        Every group is one row, and one task streams its shards into a new file, row group by row group. Nothing is shuffled.
        """
        while True:
            base, shards, schema = self.manifest()
            groups = self.plan(shards, target_bytes, fan, final)
            if not groups:
                return base
            rows = [(k, [f"{self.root}/{s.path}" for s in g]) for k, g in enumerate(groups)]
            jobs = self.spark.createDataFrame(rows, "k int, paths array<string>").repartition(len(rows), "k")
            merged = jobs.mapInArrow(_merge(self.root, f"data/{uuid.uuid4().hex}"), "path string, rows long, bytes long").collect()  # one small row a new shard
            gone = {s.path for g in groups for s in g}
            self.commit(base, [*(s for s in shards if s.path not in gone), *sorted((Shard(*r) for r in merged), key=lambda s: s.path)], schema)
            if final:
                return base + 1

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; an empty store has no schema and can't be read."""
        _, shards, schema = self.manifest(version)
        if schema is None:
            raise ValueError("the store is empty")
        kind = T.StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.root}/{s.path}" for s in shards])

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> int:
        """Delete shards that none of the latest ``keep`` versions lists, and the older manifests; return how many shards went.

        Files that no version at all lists, which failed tasks and writers that lost leave, go once they are ``grace`` seconds old.
        """
        versions = self.versions()
        listed = {s.path for v in versions[-keep:] for s in self.manifest(v)[1]}
        earlier = {s.path for v in versions[:-keep] for s in self.manifest(v)[1]}
        fs, n = self._fs(), 0
        if fs.exists(self._path("data")):
            found = fs.listFiles(self._path("data"), True)
            while found.hasNext():
                status = found.next()
                path = "/".join(["data", *status.getPath().toString().split("/")[-2:]])
                old = status.getModificationTime() <= (time.time() - grace) * 1000
                if path not in listed and path.endswith(".parquet") and (path in earlier or old):
                    fs.delete(status.getPath(), False)
                    n += 1
        for v in versions[:-keep]:
            fs.delete(self._path(f"manifests/v{v:08d}.json"), False)
        return n


@contextmanager
def _microseconds(spark: SparkSession):
    """Timestamps are written as microseconds: other readers take the default's 96 bits for nanoseconds, which end in 2262."""
    name, was = "spark.sql.parquet.outputTimestampType", spark.conf.get("spark.sql.parquet.outputTimestampType")
    spark.conf.set(name, "TIMESTAMP_MICROS")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def _merge(root: str, run: str):
    def merge(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(f"{base}/{run}", recursive=True)
        for batch in batches:
            for paths in batch.column(1).to_pylist():
                name, rows, writer = f"{run}/{uuid.uuid4().hex}.parquet", 0, None
                source = pads.dataset([pafs.FileSystem.from_uri(p)[1] for p in paths], filesystem=fs)
                for piece in source.to_batches(batch_size=4096, batch_readahead=1, fragment_readahead=1):
                    writer = writer or pq.ParquetWriter(f"{base}/{name}", piece.schema, filesystem=fs, compression="zstd")
                    writer.write_batch(piece, row_group_size=16384)
                    rows += piece.num_rows
                if writer is not None:
                    writer.close()
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64()), pa.array([fs.get_file_info(f"{base}/{name}").size], pa.int64())], ["path", "rows", "bytes"])

    return merge


def shard(df: DataFrame, root: str, target_bytes: int = TARGET_BYTES, shard_rows: int = 0, arrivals: int = ARRIVALS) -> ShardStore:
    """Append ``df`` to the store at ``root`` in parts, each followed by tiered merges; pack what is left small, and drop
    what no version needs.

    Rows are kept as they are: nulls, long texts, repeated rows and all columns of all types that Spark's parquet files hold. An empty
    table commits a version without shards.
    """
    store = ShardStore(df.sparkSession, root)
    # by position in the input, so that equal rows do not have to be told apart; each arrival is a folder, so that it is read alone
    part, path = f"{own_prefix(df)}arrival", scratch_path(df.sparkSession, "arrivals")
    with _microseconds(df.sparkSession):
        df.withColumn(part, F.pmod(F.monotonically_increasing_id(), F.lit(arrivals)).cast("int")).write.partitionBy(part).option("compression", "zstd").parquet(path)
    fs = store.jvm.org.apache.hadoop.fs.Path(path).getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    folders = [f for k in range(arrivals) if fs.exists(store.jvm.org.apache.hadoop.fs.Path(f := f"{path}/{part}={k}"))]
    for rows in [df.sparkSession.read.schema(df.schema).parquet(f) for f in folders] or [df.limit(0)]:
        store.append(rows, shard_rows)
        store.compact(target_bytes)
    store.compact(target_bytes, final=True)
    store.vacuum()
    return store
