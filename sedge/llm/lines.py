"""Line dedup by spread over sites: sketches find lines that many sites share, exact counts settle the close ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sedge.llm.quality import SPACES, let
from sedge.runtime import cut, own_prefix

MIN_SITES = 10
LG_K = 12
#: Sketch estimates within this share of the threshold (about six standard errors at 2**12 registers), or within two sites, are counted exactly.
CLOSE = 0.1
#: Lists of removed lines go to the texts by broadcast up to so many bytes, at 64 a list and 4 a line, and are merged with them beyond.
LIST_BYTES = 64 << 20


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(a, b, first): 128-bit hashes of the lines that at least ``min_sites`` different sites hold, and the least id that holds each.

    ``lines`` has a, b, site (long) and id. A line that one site alone holds, which most are, needs no sketch: its least and
    greatest site are equal. For the rest one HyperLogLog sketch a line is merged by partial aggregation. All aggregates
    combine on the map side, so a line in a third of all rows is no hot spot.
    """
    wide = lines.groupBy("a", "b").agg(F.min("site").alias("lo"), F.max("site").alias("hi"), F.min("id").alias("first"), F.count("*").alias("n"))
    wide = cut(wide.where((F.col("lo") < F.col("hi")) & (F.col("n") >= min_sites)).select("a", "b", "first"), "shared-lines")
    shared = lines.join(wide, ["a", "b"]).groupBy("a", "b").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("first").alias("first"))
    about = cut(shared.select("a", "b", "first", F.hll_sketch_estimate("sketch").alias("sites")), "line-sites")
    slack = max(2.0, CLOSE * min_sites)
    sure = about.where(F.col("sites") > min_sites + slack)
    near = about.where(F.abs(F.col("sites") - min_sites) <= slack)
    exact = lines.select("a", "b", "site").join(near.select("a", "b"), ["a", "b"]).distinct().groupBy("a", "b").agg(F.count("*").alias("exact")).where(F.col("exact") >= min_sites)
    return sure.select("a", "b", "first").unionByName(near.join(exact, ["a", "b"]).select("a", "b", "first"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, id: str = "doc_id", site: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with lines that at least ``min_sites`` sites share removed, but from the document of least id that holds them.

    Adds n_lines (lines with a word) and n_removed (long). Lines are compared without the white space around them; lines without a word
    are neither counted nor removed. Null text stays null. A null site is a site of its own. Null ids never count
    as the least; if a line has no other, all its documents lose it. Repeated rows lose the same lines. All other columns are
    kept as they are, but for earlier ones of the added names. An empty table gives no rows.

    Lines travel as hashes, one narrow row each. Texts stay where they are read while the lists of their removed lines are few enough to
    broadcast, and move once otherwise, to meet them.
    """
    docs = docs.drop("n_lines", "n_removed")
    own = own_prefix(docs)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(F.col(site), F.col(site).isNull()).alias("site"), F.xxhash64(whole, F.length(whole)).alias("row"), F.posexplode(_split(F.col(text))).alias("pos", "line"))
    line = F.btrim("line", F.lit(SPACES))
    rows = cut(rows.where(line != "").select("id", "site", "row", "pos", F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b")), "lines")
    boiler = spread_lines(rows.select("a", "b", "site", "id"), min_sites, lg_k)
    gone = rows.join(boiler, ["a", "b"]).where(F.col("first").isNull() | ~F.col("id").eqNullSafe(F.col("first")))
    gone = cut(gone.groupBy("id", "row").agg(F.collect_set("pos").alias(f"{own}gone")), "removed").select(F.col("id").alias(f"{own}id"), F.col("row").alias(f"{own}row"), f"{own}gone")
    size = gone.agg(F.sum(64 + 4 * F.size(f"{own}gone"))).first()[0] or 0
    joined = docs.join(F.broadcast(gone) if size <= LIST_BYTES else gone.hint("merge"), F.col(id).eqNullSafe(F.col(f"{own}id")) & (F.xxhash64(whole, F.length(whole)) == F.col(f"{own}row")), "left")
    words = F.filter(_split(F.col(text)), lambda x: F.translate(x, SPACES, "") != "")
    left = let(_split(F.col(text)), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(f"{own}gone")), lambda p: F.get(x, p)), "\n"))
    new = F.when(F.col(f"{own}gone").isNull(), F.col(text)).otherwise(left)
    keep = [new.alias(c) if c == text else F.col(c) for c in docs.columns]
    return joined.select(*keep, F.size(words).cast("long").alias("n_lines"), F.coalesce(F.size(f"{own}gone"), F.lit(0)).cast("long").alias("n_removed"))
