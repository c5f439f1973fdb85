"""Mixing sources to target weights by pivotal dependent rounding. Only DataFrame functions are used.

Rows of one source, id and size are one narrow row with their number: they stand for each other, so all but one of them are settled
outright (of n rows wanted p times each, the whole part of n p is taken). What is left, one fraction for each id and size, is dealt
into buckets of a bounded expected size; each bucket is folded to decided rows and one residual, and residuals of up to FAN buckets meet
at the next level, so no task ever holds a source, and a source of n ids takes log_FAN(n) levels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sedge.llm.quality import WORD, let
from sedge.runtime import cut, own_prefix

#: Fractions that one fold pairs; it copies what it has decided at every step, so it stays small.
FAN = 64
#: Rows of one source, id and size that are numbered together; more are dealt into groups of so many.
ALIKE = 4096


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Add ``weight`` and ``target`` to one row per source (``_source``, ``source_size``).

    Weights repeat over the sources in code-point order, null last; the rank comes from range partitions and their
    counts, not from one task. Targets share ``share`` times all sizes by weight, stop at ``cap`` times the source's
    size, and the excess is reshared by weight until none is above. The level at which it settles is found with
    one-row aggregates.
    """
    order = F.col("_source").asc_nulls_last()
    ranged = cut(sizes.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("_part").agg(F.count("*").alias("n"))  # one row per partition
    before = parts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order)) + F.col("_before") - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int") + 1)
    ranked = cut(ranged.join(before, "_part").withColumn("weight", weight).drop("_part", "_before"), "ranked")
    total, w = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (share * total / w if w else 0.0), -1
    while True:
        above = F.col("source_size") * cap <= F.col("weight") * level
        n, held, w = ranked.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == full or not w:
            break
        full, level = n, (share * total - cap * (held or 0)) / w
    return ranked.withColumn("target", F.when(above, F.col("source_size") * cap).otherwise(F.col("weight") * level))


def _chance(*by: Column) -> Column:
    """A number in [0, 1) that depends on nothing but ``by``."""
    return F.shiftrightunsigned(F.xxhash64(*by), 11).cast("double") / float(2**53)


def _fold(items: Column, id_type: str, seed: int) -> Column:
    """(decided, held) of an array of (size, key, id, n, sure, p): neighbours pass words until one of the two is 0 or 1.

    One of a pair grows by as many words as the other shrinks: p of size s changes by t / s. The two directions have
    odds that keep each document's expectation, and every step settles one document. The wanted words are therefore kept
    exactly until the last residual; large documents go first, so that many small ones are left to settle them.
    """
    item = lambda of, p: F.struct(*[of[c].alias(c) for c in ("size", "key", "id", "n", "sure")], p.alias("p"))
    done = lambda of, up: F.array(F.struct(*[of[c].alias(c) for c in ("size", "id", "n")], (of["sure"] + up.cast("long")).alias("ups")))

    def step(acc, e):
        held = acc["held"]
        p, q, s, r = held["p"], e["p"], held["size"], e["size"]
        grow, shrink = F.least((1 - p) * s, q * r), F.least(p * s, (1 - q) * r)
        grows = _chance(held["key"], e["key"], F.lit(seed)) * (grow + shrink) < shrink
        # the held document settles if its room is the smaller one
        settles = F.when(grows, (1 - p) * s <= q * r).otherwise(p * s <= (1 - q) * r)
        left = F.when(settles, F.when(grows, q - grow / r).otherwise(q + shrink / r)).otherwise(F.when(grows, p + grow / s).otherwise(p - shrink / s))
        move = F.struct((~settles).alias("stay"), (settles == grows).alias("up"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), left)).alias("p"))

        def moved(m):
            return F.struct(
                F.concat(acc["decided"], F.when(m["stay"], done(e, m["up"])).otherwise(done(held, m["up"]))).alias("decided"),
                F.when(m["stay"], item(held, m["p"])).otherwise(item(e, m["p"])).alias("held"),
            )

        return let(move, moved)

    none = F.array().cast(f"array<struct<size:bigint,id:{id_type},n:bigint,ups:bigint>>")
    return let(F.sort_array(items, asc=False), lambda a: F.aggregate(F.slice(a, 2, F.size(a)), F.struct(none.alias("decided"), a[0].alias("held")), step))


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def _decide(docs: DataFrame, weights, share: float, cap: float, seed: int, id: str, source: str, text: str) -> DataFrame:
    """A row for each _source, _id and size: n (its rows), ups (how many of them get a copy more), whole (copies of all), source_size and target."""
    base = cut(docs.select(F.col(id).alias("_id"), F.col(source).alias("_source"), words(F.col(text)).alias("size")).groupBy("_source", "_id", "size").agg(F.count("*").alias("n")), "sizes")
    sizes = base.groupBy("_source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("keys"))
    plan = targets(sizes, weights, share, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = cut(plan.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("buckets", F.ceil(F.col("keys") / FAN)), "plan")
    most = plan.agg(F.max("buckets")).first()[0] or 0
    own = plan.select(F.col("_source").alias("_s"), "rate", "whole", "buckets")
    bucket = F.pmod(F.xxhash64("_id", "size", F.lit(seed + 1)), "buckets")
    wanted = F.col("n") * (F.col("rate") - F.col("whole"))
    dealt = base.join(own, F.col("_source").eqNullSafe(F.col("_s"))).select("_source", bucket.alias("bucket"), "size", F.xxhash64("_id", "size", F.lit(seed)).alias("key"), F.col("_id").alias("id"), "n", F.floor(wanted).alias("sure"), (wanted - F.floor(wanted)).alias("p"))
    decided = [dealt.where("p = 0 OR size = 0").select("_source", "size", "id", "n", F.col("sure").alias("ups"))]
    level, kind = dealt.where("p > 0 AND size > 0"), base.schema["_id"].dataType.simpleString()
    while most > 0:
        folded = level.groupBy("_source", "bucket").agg(F.collect_list(F.struct("size", "key", "id", "n", "sure", "p")).alias("items"))
        folded = cut(folded.select("_source", "bucket", _fold(F.col("items"), kind, seed + 1 + len(decided)).alias("f")).select("_source", "bucket", "f.*"), "pivotal")
        decided.append(folded.select("_source", F.explode("decided").alias("d")).select("_source", "d.*"))
        level = folded.select("_source", F.floor(F.col("bucket") / FAN).alias("bucket"), "held.*")
        if most <= 1:
            break
        most = -(-most // FAN)
    decided.append(level.select("_source", "size", "id", "n", (F.col("sure") + (_chance(F.col("key"), F.lit(seed)) < F.col("p")).cast("long")).alias("ups")))
    sums = plan.select(F.col("_source").alias("_s"), "source_size", "target", "whole")
    out = reduce(DataFrame.unionByName, decided).join(sums, F.col("_source").eqNullSafe(F.col("_s")))
    return out.select("_source", F.col("id").alias("_id"), "size", "n", "ups", F.col("whole").cast("long").alias("whole"), "source_size", "target")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 0, id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size (words), source_size, target, taken (words the mix takes) and copies.

    A document is wanted target / source_size times. The whole part is taken outright, the rest is a probability that
    pivotal rounding makes 0 or 1. Chances are hashes of ids, so reruns agree on any cluster. Null text: size 0. Null
    source: a source of its own, last in order. Rows of the same source, id and size are rows of their own and stand
    for each other. Null ids count as one id. Empty table: no rows.
    """
    decided = _decide(docs, weights, share, cap, seed, id, source, text)
    # numbers of the rows that stand for each other, in blocks that are dealt out where there are many
    number = F.explode(F.sequence(F.col("from"), F.least(F.col("from") + (ALIKE - 1), F.col("n")))).alias("k")
    few = decided.where(F.col("n") <= ALIKE).withColumn("from", F.lit(1).cast("long"))
    many = decided.where(F.col("n") > ALIKE).withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(ALIKE).cast("long")))).repartition("_source", "_id", "size", "from")
    copies = F.col("whole") + (F.col("k") <= F.col("ups")).cast("long")
    rows = few.unionByName(many).select("_id", "size", "source_size", "target", "whole", "ups", number)
    return rows.select(F.col("_id").alias(id), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def _key(c: Column) -> Column:
    """A column as a string that null has a value of its own in."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def mix_rows(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 0) -> DataFrame:
    """The mix itself: the rows of ``docs`` as many times as :func:`mix_sources` takes them, all columns kept, whatever their names.

    Texts move once, to meet their decisions by source, id and size. Rows that agree in these are numbered, by their texts' hashes, and
    as many as were decided get the copy more. Where more than ALIKE rows agree, they are written apart first, dealt into groups of about so many
    by place, and each group gets its part of the copies.
    """
    own = own_prefix(docs)
    names = [f"{own}id", f"{own}source", f"{own}size"]
    decided = _decide(docs, weights, share, cap, seed, id, source, text).where("whole > 0 OR ups > 0")
    decided = cut(decided.select(_key(F.col("_id")).alias(f"{own}id"), _key(F.col("_source")).alias(f"{own}source"), F.col("size").alias(f"{own}size"), "n", "ups", "whole"), "decided").withColumnsRenamed({c: f"{own}{c}" for c in ("n", "ups", "whole")})
    keyed = docs.withColumn(f"{own}id", _key(F.col(id))).withColumn(f"{own}source", _key(F.col(source))).withColumn(f"{own}size", words(F.col(text)))
    hot = decided.where(F.col(f"{own}n") > ALIKE)

    def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(text)))
        copies = F.col(f"{own}whole") + (nth <= F.col(f"{own}ups")).cast("long")
        return rows.withColumn(f"{own}copies", copies).where(f"{own}copies > 0").withColumn(f"{own}copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{own}copies")))).select(*docs.columns)

    out = numbered(keyed.hint("merge").join(decided.where(F.col(f"{own}n") <= ALIKE).hint("merge"), names), names)
    if hot.isEmpty():
        return out
    apart = cut(keyed.join(hot, names).withColumn(f"{own}part", F.floor(F.monotonically_increasing_id() / ALIKE)), "alike")
    parts = apart.groupBy(*names, f"{own}part").agg(F.count("*").alias(f"{own}rows"), F.any_value(f"{own}ups").alias(f"{own}ups"))
    before = F.sum(f"{own}rows").over(Window.partitionBy(*names).orderBy(f"{own}part")) - F.col(f"{own}rows")
    quota = parts.select(*names, f"{own}part", F.greatest(F.lit(0), F.least(F.col(f"{own}rows"), F.col(f"{own}ups") - before)).cast("long").alias(f"{own}ups"))
    return out.unionByName(numbered(apart.drop(f"{own}ups").join(quota, [*names, f"{own}part"]), [*names, f"{own}part"]))
