"""Merkle manifest of a dataset, with an authentication path for every row, by fractal traversal.

Rows are the leaves of one tree a group (say, a language), and the groups' roots those of the tree above. A tree's nodes are dealt out
in aligned blocks of FAN ** LEVELS. Blocks give their tops, tops are nodes of the next blocks, up to one node a tree. Then the paths come
down: a task walks its block's leaves in order, with a stack of existing subtrees that hold the siblings of the leaf at hand, and of desired
subtrees that grow by a leaf for each path given out, so that each is ready when the one before it is used up. What a block keeps besides its
leaves is two subtrees of FAN ** STACK nodes for each STACK levels. The path above a block is the same for all its leaves; it comes from
the blocks above in a cogroup.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sedge.runtime import cut

FAN = 8
#: Levels of a block, and of a subtree on the traversal's stack.
LEVELS = 4
STACK = 2
BLOCK = FAN**LEVELS
PATH = "array<struct<left:string,right:string>>"


def node(run: list[str]) -> str:
    """Digest of consecutive nodes, which are hex digests."""
    return hashlib.sha256("".join(run).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


class Subtree:
    """An aligned subtree that takes its leaves one at a time and keeps the nodes from level ``low`` to below level ``high``, and one open run a level."""

    def __init__(self, low: int, high: int):
        self.low, self.high, self.root = low, high, None
        self.open: list[list[str]] = [[] for _ in range(high)]
        self.nodes: list[list[str]] = [[] for _ in range(low, high)]

    def push(self, digest: str, level: int = 0) -> None:
        while level < self.high:
            if level >= self.low:
                self.nodes[level - self.low].append(digest)
            run = self.open[level]
            run.append(digest)
            if len(run) < FAN:
                return
            digest = node(run)
            run.clear()
            level += 1
        self.root = digest

    def close(self) -> Subtree:
        """Make nodes of the runs that are not full; there are no more leaves."""
        for level, run in enumerate(self.open):
            if run:
                digest = node(run)
                run.clear()
                self.push(digest, level + 1)
        return self


def paths(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf in turn, bottom up, what stands left and right of its node in the node's run."""
    stack = [(low, min(low + STACK, levels)) for low in range(0, levels, STACK)]
    existing, desired = [], []
    for low, high in stack:
        first = Subtree(low, high)
        for digest in leaves[: FAN**high]:
            first.push(digest)
        existing.append(first.close())
        desired.append(Subtree(low, high))
    for i in range(len(leaves)):
        path = []
        for (low, high), subtree in zip(stack, existing):
            inside = i % FAN**high
            for level in range(low, high):
                at = inside // FAN**level
                run = at - at % FAN
                nodes = subtree.nodes[level - low]
                path.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + FAN])))
        yield path
        for s, (low, high) in enumerate(stack):
            span = FAN**high
            if i + span < len(leaves):
                desired[s].push(leaves[i + span])
            if (i + 1) % span == 0:
                existing[s], desired[s] = desired[s].close(), Subtree(low, high)


def _levels(total: int) -> int:
    """Levels of a block of a tree of so many nodes."""
    return LEVELS if total > BLOCK else height(total)


def _top(block: pa.Table) -> pa.Table:
    block = block.sort_by("place")
    total = block["total"][0].as_py()
    levels = _levels(total)
    tree = Subtree(levels, levels)
    for digest in block["digest"].to_pylist():
        tree.push(digest)
    tree.close()
    above = -(-total // BLOCK)
    return pa.table({"tree": block["tree"][:1], "place": block["block"][:1], "total": pa.array([above], pa.int64()), "digest": [tree.root]})


def _prove(names: list[str]):
    """Arrow function of a block and the path above it: the columns ``names`` of its leaves with their whole paths."""

    def run(block: pa.Table, upper: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        rest = [(p["left"], p["right"]) for p in upper["path"][0].as_py()]
        offsets, left, right = [0], [], []
        for path in paths(block["digest"].to_pylist(), _levels(block["total"][0].as_py())):
            path = path + rest
            left += [p[0] for p in path]
            right += [p[1] for p in path]
            offsets.append(len(left))
        steps = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
        told = {c: pa.array([upper[c][0].as_py()] * len(block), pa.string()) for c in ("subroot", "root")}
        return pa.table({**{n: block[n] for n in names}, "path": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps), **told})

    return run


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / BLOCK).cast("long"))


def placed(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with ``place``, their number within the tree in an order that is total, and ``total``, the number of all of them.

    Ranges are sorted apart and shifted by the counts before them, so a tree of a third of all rows is spread like any other.
    """
    ranged = cut(rows.repartitionByRange(F.col(tree), *[F.col(c).asc_nulls_first() for c in order]).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range", tree).agg(F.count("*").alias("_n"))
    of = Window.partitionBy(tree)
    before = counts.select("_range", tree, (F.sum("_n").over(of.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(of).alias("total"))
    place = F.row_number().over(Window.partitionBy("_range", tree).orderBy(*[F.col(c).asc_nulls_first() for c in order])) - 1 + F.col("_before")
    return ranged.join(before, ["_range", tree]).withColumn("place", place.cast("long")).drop("_range", "_before")


def climb(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(nodes of each height of blocks, roots of the trees that end there as (tree, digest)), from nodes(tree, place, total, digest)."""
    heights, roots = [_blocked(nodes)], []
    while True:
        tops = cut(heights[-1].select("tree", "block", "place", "total", "digest").groupBy("tree", "block").applyInArrow(_top, "tree string, place long, total long, digest string"), "tops")
        roots.append(tops.where("total = 1").select("tree", "digest"))
        above = tops.where("total > 1")
        if above.isEmpty():
            return heights, roots
        heights.append(_blocked(above))


def descend(heights: list[DataFrame], roots: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest nodes with ``path``, ``subroot`` and ``root``, from ``above``: the same of each tree's root, as (tree, path, subroot, root)."""
    found = None
    for nodes, ended in zip(reversed(heights), reversed(roots)):
        upper = above.join(ended.select("tree"), "tree", "left_semi").select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
        if found is not None:
            upper = upper.unionByName(found.select("tree", F.col("place").alias("block"), "path", "subroot", "root"))
        kept = [f for f in nodes.schema if f.name not in ("total", "block")]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", path {PATH}, subroot string, root string"
        found = nodes.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(_prove([f.name for f in kept]), schema)
        if nodes is not heights[0]:
            found = cut(found, "upper-paths")
    return found


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value, integers in decimal."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """Digest of a row's values, each told from the next by its length."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that a digest and the siblings on its path lead to."""
    return F.aggregate(path, digest, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def merkle_paths(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id: str = "doc_id", group: str = "lang", **carried: Column) -> DataFrame:
    """(id, digest, path, subroot, root) and the ``carried`` columns, one row for each of ``docs``: the manifest's leaves with their authentication paths.

    A leaf is the digest of ``fields``; null differs from the empty text. A group's leaves stand in order of id, null first, rows of one id in order of their
    digests, so equal rows may change places without any effect. Groups stand in bytewise order, null first. A run of up to FAN consecutive nodes
    becomes one, the last of a level though it be one alone, until one is left; a single leaf is its group's root, a single group's
    root is the dataset's. The path's siblings are hex digests, joined. An empty table gives no rows. Other columns, whatever their names, are
    ignored. Texts are read once, for their digests, and never moved.
    """
    rows = docs.select(F.col(id).alias("_id"), F.when(F.col(group).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group).cast("string"))).alias("tree"), leaf(*[F.col(c) for c in fields]).alias("digest"), *[c.alias(n) for n, c in carried.items()])
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    heights, roots = climb(cut(placed(rows, "tree", "_id", "digest", "_row").drop("_row"), "placed"))
    subroots = reduce(DataFrame.unionByName, roots).select(F.col("tree").alias("of"), F.lit("").alias("tree"), "digest")
    forest, tops = climb(cut(placed(subroots, "tree", "of"), "subroots"))
    none = F.array().cast(PATH).alias("path")
    total = reduce(DataFrame.unionByName, tops).select("tree", none, F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    above = cut(descend(forest, tops, total).select(F.col("of").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "subroot-paths")
    return descend(heights, roots, above).select(F.col("_id").alias(id), "digest", "path", "subroot", "root", *carried)
