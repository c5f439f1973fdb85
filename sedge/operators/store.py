"""A store of versioned parquet tables that is written by the change and merged when it is read.

A change adds folders beside what is there: new rows, and keys whose earlier rows are gone. Rows and keys are dealt into buckets by the table's key, so a
reader that knows its keys opens their buckets alone, and a bucket can be merged without the others. A version is a small file that lists the folders
of all tables, each with the number of the version it came with; keys of version s take away rows of versions before s. It appears by a rename
that fails if there is one of its number, so of two writers one publishes. The other publishes its folders as they are on top of the new version, or,
if it had read a table that has changed since, makes its change again from the new version. Readers see a change whole or not at all, and a version they
hold stays as it is until it is vacuumed.

Sums by document follow each change of the chunks by its own rows, and so do the postings of a store that has an analyzer, and the lists of one whose vectors are indexed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sedge.functions.text import Analyzer
from sedge.operators import lists as L, postings as P
from sedge.runtime import cut

DOCUMENTS = "id string not null, title string not null, source string not null, content string not null, metadata string, created_at timestamp, updated_at timestamp"
CHUNKS = "id string not null, document_id string not null, content string not null, embedding array<float>, chunk_index int not null, metadata string, token_count int, created_at timestamp"
SESSIONS = "id string not null, user_id string, metadata string, created_at timestamp, updated_at timestamp, expires_at timestamp"
MESSAGES = "id string not null, session_id string not null, role string not null, content string not null, metadata string, created_at timestamp"
ENTITIES = "name_key string not null, name string, type string, summary string, name_embedding array<float>, source_doc string, created_at timestamp"
EDGES = "src_key string not null, dst_key string not null, fact string, predicate string, source_doc string, chunk_id string, created_at timestamp"
#: Parts of sums by document: chunks, chunks with a number of tokens, and those numbers' sum.
TOTALS = "document_id string not null, chunks long not null, counted long not null, tokens long"
TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS, "sessions": SESSIONS, "messages": MESSAGES, "entities": ENTITIES, "edges": EDGES, "totals": TOTALS, "postings": P.POSTINGS, "shares": P.SHARES, "centres": L.CENTRES, "vectors": L.VECTORS, "heads": L.HEADS}
#: The column that deals a table's rows into buckets, and by whose values they are deleted; tables of BY_DOCUMENT are deleted by document.
KEYS = {"documents": "id", "chunks": "document_id", "sessions": "id", "messages": "session_id", "entities": "name_key", "edges": "source_doc", "totals": "document_id", "postings": "lexeme", "shares": "file", "centres": "list", "vectors": "list", "heads": "list"}
#: The order of rows in files of tables that are read by a few values of their first columns, so that pages can be told by them.
ORDER = {"postings": ("lexeme", "file", "part"), "shares": ("file", "part", "slot"), "vectors": ("list", "id")}
GRAPH = ("entities", "edges")
#: Tables that follow the chunks.
DERIVED = ("totals", "postings", "shares", "vectors", "heads")
BY_DOCUMENT = ("shares", "vectors")
#: Child table by the parent whose id its key names.
CHILDREN = {"documents": "chunks", "sessions": "messages"}
#: Times that a change is published again because another writer was first.
TRIES = 20
BUCKETS = 8
#: Folders of a bucket that are left beside one another.
MOST_FOLDERS = 8
#: A folder this many times smaller than the bucket's largest is merged with its like, not with that.
TIER = 4


@dataclass
class Change:
    """Rows to ``add``, tables to ``put`` in place of what there is, ids (column ``id``) whose rows to ``drop`` first, and tables to ``empty``."""

    add: dict[str, DataFrame] = field(default_factory=dict)
    put: dict[str, DataFrame] = field(default_factory=dict)
    drop: dict[str, DataFrame] = field(default_factory=dict)
    empty: Iterable[str] = ()


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


class Snapshot:
    """The tables of one version. It remembers which of them were read."""

    def __init__(self, store: Store, version: int, pointer: dict):
        self.store, self.version, self.pointer, self.seen = store, version, pointer, set()

    def entries(self, name: str, kind: str) -> list[dict]:
        return self.pointer.get("tables", {}).get(name, {}).get(kind, [])

    def parts(self, name: str, keys: list | None = None) -> tuple[DataFrame, DataFrame | None]:
        """(rows with ``_seq``, the version they came with or a later one that deletes no more of them; deleted keys (key, deleted_at), None if there are none), of the buckets of ``keys``."""
        self.seen.add(name)
        buckets = None if keys is None else self.store.buckets_of(keys, self.pointer)
        deletes = sorted({e["seq"] for e in self.entries(name, "deletes")})
        # rows that the same deletions come after are read at once
        epochs: dict[int, list[str]] = {}
        for e in self.entries(name, "data"):
            until = next((d - 1 for d in deletes if d > e["seq"]), deletes[-1] if deletes else 0)
            epochs.setdefault(until, []).extend(self.store.bucket_paths(e, buckets))
        kind = self.store.schema(name)
        read = [self.store.spark.read.schema(kind).parquet(*paths).withColumn("_seq", F.lit(seq).cast("long")) for seq, paths in sorted(epochs.items()) if paths]
        rows = reduce(DataFrame.unionByName, read) if read else self.store.spark.createDataFrame([], kind).withColumn("_seq", F.lit(0).cast("long"))
        # documents have nothing to do with the buckets of these
        gone = [(e["seq"], paths) for e in self.entries(name, "deletes") if (paths := self.store.bucket_paths(e, None if name in BY_DOCUMENT else buckets))]
        if not gone:
            return rows, None
        keys_gone = reduce(DataFrame.unionByName, [self.store.spark.read.schema("key string").parquet(*paths).withColumn("deleted_at", F.lit(seq).cast("long")) for seq, paths in gone])
        return rows, keys_gone.groupBy("key").agg(F.max("deleted_at").alias("deleted_at"))

    def read(self, name: str, keys: list | None = None) -> DataFrame:
        """The rows of a table; with ``keys`` those of the keys' buckets alone, which hold all rows of these keys and others."""
        rows, gone = self.parts(name, keys)
        return _alive(rows, gone, "document_id" if name in BY_DOCUMENT else KEYS[name]).drop("_seq")

    def totals(self) -> DataFrame:
        """(document_id, chunk_count, avg_tokens_per_chunk, total_tokens) of documents that have chunks, from the sums that were kept with every change."""
        sums = self.read("totals").groupBy("document_id").agg(F.sum("chunks").alias("chunk_count"), F.sum("counted").alias("_counted"), F.sum("tokens").alias("total_tokens"))
        return sums.select("document_id", "chunk_count", F.when(F.col("_counted") > 0, F.col("total_tokens") / F.col("_counted")).alias("avg_tokens_per_chunk"), "total_tokens")


def _alive(rows: DataFrame, gone: DataFrame | None, key: str) -> DataFrame:
    """Rows that no later version deleted."""
    if gone is None:
        return rows
    kept = rows.join(gone, F.col(key) == F.col("key"), "left").where(F.col("deleted_at").isNull() | (F.col("deleted_at") <= F.col("_seq")))
    return kept.drop("key", "deleted_at")


class Store:
    """``buckets`` holds for a store's first version and is kept from then on. With an ``analyzer`` chunks are indexed by their lexemes; every writer has to name the same."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, analyzer: Analyzer | None = None):
        self.spark, self.root, self.jvm = spark, root.rstrip("/"), spark.sparkContext._jvm
        self.buckets, self.analyzer = buckets, analyzer

    # Files

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("versions")
        if not fs.exists(folder):
            return []
        return sorted(int(n[1:-5]) for s in fs.listStatus(folder) if (n := s.getPath().getName()).startswith("v") and n.endswith(".json"))

    def _pointer(self, version: int | None = None) -> tuple[int, dict]:
        """(version, its lists), of the latest version if none is named."""
        version = max(self.versions(), default=0) if version is None else version
        if version == 0:
            return 0, {"buckets": self.buckets, "tables": {}}
        return version, json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/versions/v{version:08d}.json", wholetext=True).collect()))

    def _publish(self, base: int, pointer: dict) -> bool:
        """Make ``pointer`` the version after ``base``; False if another writer was first."""
        fs, draft, target = self._fs(), self._path(f"versions/draft-{uuid.uuid4().hex}"), self._path(f"versions/v{base + 1:08d}.json")
        fs.mkdirs(self._path("versions"))
        out = fs.create(draft, True)
        out.write(json.dumps(pointer).encode())
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, target, options)
        except Exception:
            fs.delete(draft, False)
            if fs.exists(target):
                return False
            raise
        return True

    def buckets_of(self, keys: list, pointer: dict) -> set[int]:
        """The buckets of a few known keys."""
        rows = self.spark.createDataFrame([(str(k),) for k in keys], "key string")
        return {r[0] for r in rows.select(bucket_of(F.col("key"), pointer["buckets"])).collect()}

    def bucket_paths(self, entry: dict, buckets: set[int] | None) -> list[str]:
        return [f"{self.root}/{entry['path']}/bucket={b}" for b in entry["bytes"] if buckets is None or int(b) in buckets]

    @staticmethod
    def schema(name: str) -> T.StructType:
        return T.StructType.fromDDL(TABLES[name])

    def _write(self, name: str, df: DataFrame, key: str, buckets: int) -> dict:
        """A new folder of ``df`` by buckets: its path, and the bytes of each bucket."""
        path = f"{name}/{uuid.uuid4().hex}"
        dealt = df.withColumn("bucket", bucket_of(F.col(key), buckets)).hint("rebalance", "bucket")
        if name in ORDER:
            dealt = dealt.sortWithinPartitions("bucket", *ORDER[name])
        dealt.write.partitionBy("bucket").option("compression", "zstd").option("parquet.writer.version", "v2").parquet(f"{self.root}/{path}")
        fs = self._fs()
        found = [s.getPath() for s in fs.listStatus(self._path(path)) if s.isDirectory()]
        return {"path": path, "bytes": {p.getName().split("=")[1]: fs.getContentSummary(p).getLength() for p in found if p.getName().startswith("bucket=")}}

    def _shaped(self, name: str, df: DataFrame) -> DataFrame:
        """Rows in the table's shape; a null in a column that must have a value fails the write."""
        columns = []
        for f in self.schema(name).fields:
            c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit("{}" if f.name == "metadata" else None).cast(f.dataType)
            columns.append((c if f.nullable else F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"{name}.{f.name} is null")))).alias(f.name))
        return df.select(*columns)

    def _drop(self, staged: list[dict]) -> None:
        for entry in staged:
            self._fs().delete(self._path(entry["path"]), True)

    # Changes

    def _staged(self, change: Change, old: Snapshot, indexed: bool) -> tuple[list[tuple[str, str, dict]], list[str]]:
        """(table, kind, folder) of everything that a change writes, and the tables that it empties."""
        buckets, empty = old.pointer["buckets"], [*change.empty, *change.put]
        if "chunks" in empty:
            empty += DERIVED
        # lists are fitted once, so chunks are put into those that there are
        lists = L.stored(old) if "chunks" in {*change.add, *change.put} and "centres" not in empty and old.entries("centres", "data") else None
        folders: list[tuple[str, str, dict]] = []

        def write(name: str, df: DataFrame, key: str, *uses: tuple[str, str]) -> dict:
            entry = self._write(name, df, key, buckets)
            folders.extend((table, kind, entry) for table, kind in uses)
            return entry

        def delete(ids: DataFrame, names: list[str]) -> None:
            uses = [*names, *(["totals", *BY_DOCUMENT] if "chunks" in names else [])]
            write(f"{names[0]}-deletes", ids.select(F.col("id").cast("string").alias("key")).where("key IS NOT NULL").distinct(), "key", *[(n, "deletes") for n in uses])

        def add(name: str, df: DataFrame) -> None:
            entry = write(name, self._shaped(name, df), KEYS[name], (name, "data"))
            if name == "chunks" and entry["bytes"]:
                fresh = self.spark.read.schema(self.schema("chunks")).parquet(*self.bucket_paths(entry, None))
                sums = fresh.groupBy("document_id").agg(F.count("*").alias("chunks"), F.count("token_count").alias("counted"), F.sum("token_count").alias("tokens"))
                derived = [lambda: write("totals", sums, "document_id", ("totals", "data"))]
                if indexed:
                    derived += [lambda: write("postings", P.postings(fresh, self.analyzer), "lexeme", ("postings", "data")), lambda: write("shares", P.shares(fresh), "file", ("shares", "data"))]
                if lists is not None:
                    derived.append(lambda: listed(fresh))
                self._at_once(derived)

        def listed(fresh: DataFrame) -> None:
            entry = write("vectors", L.listed(fresh, lists), "list", ("vectors", "data"))
            if entry["bytes"]:
                rows = self.spark.read.schema(self.schema("vectors")).parquet(*self.bucket_paths(entry, None))
                write("heads", L.heads(rows), "list", ("heads", "data"))

        alike: dict[int, tuple[DataFrame, list[str]]] = {}
        for name, ids in change.drop.items():  # the same ids of a parent and its children are written once
            alike.setdefault(id(ids), (ids, []))[1].append(name)
        try:
            self._at_once([*[lambda x=x: delete(*x) for x in alike.values()], *[lambda x=x: add(*x) for x in [*change.put.items(), *change.add.items()]]])
        except BaseException:
            self._drop([e for _, _, e in folders])
            raise
        return folders, empty

    def _at_once(self, jobs: list[Callable[[], object]]) -> None:
        """Run jobs side by side, as small ones leave most of a cluster idle; when all have ended, raise the first error."""
        with ThreadPoolExecutor(max(1, len(jobs))) as pool:
            running = [pool.submit(inheritable_thread_target(self.spark)(job)) for job in jobs]
        for done in running:
            done.result()

    @staticmethod
    def _applied(pointer: dict, folders: list[tuple[str, str, dict]], empty: list[str], seq: int) -> dict:
        """``pointer`` after a change: tables emptied, then keys deleted, then rows added."""
        tables = {n: {k: list(v) for k, v in t.items()} for n, t in pointer["tables"].items() if n not in empty}
        for name, kind, entry in sorted(folders, key=lambda f: f[1] == "data"):
            if entry["bytes"] and not (kind == "deletes" and not tables.get(name, {}).get("data")):  # nothing that could be deleted
                tables.setdefault(name, {}).setdefault(kind, []).append({**entry, "seq": seq})
        return {**pointer, "tables": tables}

    def commit(self, build: Callable[[Snapshot], Change]) -> int:
        """Publish the change that ``build`` makes of a snapshot, and return its version.

        If another writer is first, the folders are published on top of its version, unless it changed a table that ``build`` read: then ``build`` is called again. What is not published is removed.
        """
        for _ in range(TRIES):
            base, pointer = self._pointer()
            snapshot = Snapshot(self, base, pointer)
            change = build(snapshot)
            indexed = pointer.get("indexed", self.analyzer is not None)
            if indexed and self.analyzer is None and "chunks" in {*change.add, *change.put}:
                raise ValueError("the store's chunks are indexed; open it with their analyzer")
            folders, empty = self._staged(change, snapshot, indexed)
            try:
                current = {**pointer, "indexed": indexed}
                for _ in range(TRIES):
                    if self._publish(base, self._applied(current, folders, empty, base + 1)):
                        return base + 1
                    base, latest = self._pointer()
                    if any(latest["tables"].get(n) != pointer["tables"].get(n) for n in snapshot.seen) or latest["buckets"] != pointer["buckets"] or latest.get("indexed") != indexed:
                        break
                    current = latest
            except BaseException:
                self._drop([e for _, _, e in folders])
                raise
            self._drop([e for _, _, e in folders])
        raise RuntimeError(f"other writers were first {TRIES} times")

    def snapshot(self, version: int | None = None) -> Snapshot:
        return Snapshot(self, *self._pointer(version))

    def read(self, name: str, version: int | None = None, keys: list | None = None) -> DataFrame:
        return self.snapshot(version).read(name, keys)

    def insert(self, **rows: DataFrame) -> int:
        """Append to several tables in one published change."""
        return self.commit(lambda _: Change(add=rows))

    def replace(self, **rows: DataFrame) -> int:
        """Put new contents in place of several tables in one published change. Rows that were made from the store belong into :meth:`commit`."""
        return self.commit(lambda _: Change(put=rows))

    def upsert_documents(self, documents: DataFrame, chunks: DataFrame) -> int:
        """Documents with their chunks, in place of those of the same ids, so that reading a file again does not double it."""
        return self.commit(lambda old: upserted(old, documents, chunks))

    def delete(self, parent: str, ids: DataFrame) -> int:
        """Delete rows by id, and the rows of other tables that name them."""
        return self.commit(lambda _: Change(drop={n: ids for n in (parent, CHILDREN.get(parent)) if n}))

    def clear(self, graph: bool = True) -> int:
        """Empty all tables, those of the graph as well unless told otherwise."""
        return self.commit(lambda _: Change(empty=everything(graph)))

    def clear_graph(self) -> int:
        """Empty the graph's tables alone."""
        return self.commit(lambda _: Change(empty=GRAPH))

    def index_vectors(self, lists: int | None = None) -> int:
        """Fit lists on the chunks' vectors and keep the vectors by list; from then on every change of the chunks is followed. Vectors of the length that is there most often are listed, others lie apart."""

        def build(old: Snapshot) -> Change:
            chunks = old.read("chunks").where("embedding IS NOT NULL")
            sizes = chunks.where(L.usable(F.col("embedding"))).groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
            if sizes is None:
                raise ValueError("no chunk has a vector")
            fitted = L.Lists.fit(chunks.where(L.usable(F.col("embedding")) & (F.size("embedding") == sizes["size"])).select("embedding"), "embedding", lists)
            rows = cut(L.listed(chunks, fitted), "vectors")
            centres = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(fitted.centres)], L.CENTRES)
            return Change(put={"centres": centres, "vectors": rows, "heads": L.heads(rows)})

        return self.commit(build)

    # Upkeep

    def compact(self, whole: bool = False, most: int = MOST_FOLDERS) -> bool:
        """Merge folders of buckets that have more than ``most``, or more than so many of deleted keys; ``whole`` leaves one folder a bucket and no deleted keys.

        Of a bucket's folders those much smaller than its largest are merged with one another, as long as deleted keys are few; so a row is rewritten as often as its folder's size
        grows by a factor, not with every batch. Other writers go on meanwhile: what they publish stays beside or behind what was merged. False if there was nothing to merge,
        or what was merged has been replaced in the meantime.
        """
        base, pointer = self._pointer()
        old = Snapshot(self, base, pointer)
        merged: list[tuple[str, dict, dict[str, set[str]], set[str]]] = []
        try:
            for name, table in pointer["tables"].items():
                chosen, cleared = _chosen(table, most, whole, by_bucket=name not in BY_DOCUMENT)
                if not chosen:
                    continue
                part = Snapshot(self, base, {**pointer, "tables": {name: {"data": [{**e, "bytes": {b: n for b, n in e["bytes"].items() if b in chosen.get(e["path"], ())}} for e in table["data"]], "deletes": table.get("deletes", [])}}})
                if name == "totals":
                    rows = part.read(name).groupBy("document_id").agg(*[F.sum(c).alias(c) for c in ("chunks", "counted", "tokens")])
                elif name == "heads":
                    rows = part.read(name).groupBy("list").agg(F.max("radius").alias("radius"), F.sum("vectors").alias("vectors"))
                else:
                    rows = part.read(name)
                merged.append((name, {**self._write(name, rows, KEYS[name], pointer["buckets"]), "seq": base}, chosen, cleared))
            now, latest = base, pointer
            for _ in range(TRIES if merged else 0):
                tables = _with_merged(latest, merged, base)
                if tables is None:
                    return False
                if self._publish(now, {**latest, "tables": tables}):
                    merged = []
                    return True
                now, latest = self._pointer()
            return False
        finally:
            self._drop([entry for _, entry, _, _ in merged])

    def vacuum(self, keep: int = 1, seconds: float = 3600) -> int:
        """Delete versions but the last ``keep``, and folders and buckets that none of these names; those younger than ``seconds`` stay, as a writer may be about to publish them. Return how many went."""
        fs, versions = self._fs(), self.versions()
        kept = versions[-keep:]
        named: dict[str, set[str]] = {}
        for version in kept:
            for table in self._pointer(version)[1]["tables"].values():
                for e in [*table.get("data", []), *table.get("deletes", [])]:
                    named.setdefault(e["path"], set()).update(e["bytes"])
        for version in versions[: -len(kept)]:
            fs.delete(self._path(f"versions/v{version:08d}.json"), False)
        old, went = (time.time() - seconds) * 1000, 0
        for s in fs.listStatus(self._path("versions")) if kept else []:
            if s.getPath().getName().startswith("draft-") and s.getModificationTime() <= old:
                fs.delete(s.getPath(), False)
        for name in [*TABLES, *(f"{n}-deletes" for n in TABLES)]:
            for s in fs.listStatus(self._path(name)) if fs.exists(self._path(name)) else []:
                buckets = named.get(f"{name}/{s.getPath().getName()}")
                if s.getModificationTime() > old:
                    continue
                if buckets is None:
                    fs.delete(s.getPath(), True)
                    went += 1
                    continue
                for b in fs.listStatus(s.getPath()):
                    if b.isDirectory() and b.getPath().getName().split("=")[-1] not in buckets:
                        fs.delete(b.getPath(), True)
                        went += 1
        return went


def _chosen(table: dict, most: int, whole: bool, by_bucket: bool) -> tuple[dict[str, set[str]], set[str]]:
    """(buckets to merge of each folder, buckets whose deleted keys are done with then). Tables whose deleted keys hold for all buckets are merged all or not at all."""
    data, deletes = table.get("data", []), table.get("deletes", [])
    chosen: dict[str, set[str]] = {}
    cleared: set[str] = set()
    of_all = {b for e in [*data, *deletes] for b in e["bytes"]}
    if not by_bucket:
        if (whole and (len(data) > 1 or deletes)) or len(data) > most or len(deletes) > most:
            return {e["path"]: set(e["bytes"]) for e in data}, of_all
        return {}, set()
    for bucket in of_all:
        sizes = {e["path"]: e["bytes"][bucket] for e in data if bucket in e["bytes"]}
        gone = sum(bucket in e["bytes"] for e in deletes)
        if gone > most or (whole and (gone or len(sizes) > 1)):
            these = set(sizes)
        else:
            small = {p for p, n in sizes.items() if n * TIER <= max(sizes.values())}
            these = small if len(small) > most else set(sizes) if len(sizes) - len(small) > most else set()
        if these == set(sizes) and (these or gone):
            cleared.add(bucket)
        for path in these:
            chosen.setdefault(path, set()).add(bucket)
    return chosen, cleared


def _with_merged(pointer: dict, merged: list[tuple[str, dict, dict[str, set[str]], set[str]]], read: int) -> dict | None:
    """The tables of a version with merged folders in place of those that were read for them at version ``read``; None if some of those are no longer there."""
    tables = dict(pointer["tables"])
    for name, entry, chosen, cleared in merged:
        data, deletes = tables.get(name, {}).get("data", []), tables.get(name, {}).get("deletes", [])
        if not all(any(e["path"] == path and buckets <= set(e["bytes"]) for e in data) for path, buckets in chosen.items()):
            return None
        left = [{**e, "bytes": {b: n for b, n in e["bytes"].items() if b not in chosen.get(e["path"], ())}} for e in data]
        gone = [{**e, "bytes": {b: n for b, n in e["bytes"].items() if e["seq"] > read or b not in cleared}} for e in deletes]
        tables[name] = {"data": sorted((e for e in [*left, entry] if e["bytes"]), key=lambda e: e["seq"]), "deletes": [e for e in gone if e["bytes"]]}
    return tables


def everything(graph: bool = True) -> list[str]:
    """All tables, those of the graph as well unless told otherwise."""
    return [n for n in TABLES if graph or n not in GRAPH]


def upserted(old: Snapshot, documents: DataFrame, chunks: DataFrame) -> Change:
    """The change that puts documents and their chunks in place of those of the same ids. A document keeps the time when it was first created."""
    ids = documents.select("id").distinct()
    first = old.read("documents").select(F.col("id").alias("_id"), F.col("created_at").alias("_first"))
    created = F.coalesce("_first", F.col("created_at").cast("timestamp")) if "created_at" in documents.columns else F.col("_first")
    stamped = documents.join(first, F.col("id").cast("string") == F.col("_id"), "left").withColumn("created_at", created).drop("_id", "_first")
    return Change(drop={"documents": ids, "chunks": ids}, add={"documents": stamped, "chunks": chunks})


def cascade(children: DataFrame, column: str, deleted: DataFrame) -> DataFrame:
    """Children whose parent is not among the deleted ids."""
    return children.join(deleted.select(F.col("id").alias(column)), column, "left_anti")
