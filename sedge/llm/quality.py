"""Host-level quality rules: per-document rule failures, shrunk to host verdicts, joined back to documents.

Only DataFrame functions are used. Everything per document is computed inside the scan (no shuffle of texts);
what is shuffled is one narrow row per document and one row per host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sedge.runtime import cut

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column) -> Column:
    """Words under the windows whose hash occurs twice or more. Sorting keeps it at n log n for any text."""
    tagged = F.sort_array(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))

    def twin(s):
        def same(e, k):
            before, after = F.get(s, k - 1), F.get(s, k + 1)
            return F.coalesce(before["h"] == e["h"], F.lit(False)) | F.coalesce(after["h"] == e["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(s, same), lambda e: e["p"]))

    def length(at):
        steps = F.transform(at, lambda p, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), p - F.get(at, k - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(tagged, lambda s: let(twin(s), length))


def _repeated(words: Column) -> Column:
    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    # as many distinct words as words: no window can recur, and most short texts end here
    found = let(let(hashed, windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h)))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(found)


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of a text; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return let(
        whole,
        lambda t: let(
            F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                _repeated(w).cast("long").alias("n_repeat_words"),
            ),
        ),
    )


def host_rules() -> dict[str, Column]:
    """Failures that are counted by host: the base rule, symbol-heavy text, and texts made of repeated lines."""
    return {
        "base": F.col("base_failed"),
        "symbols": F.col("n_symbols") * 5 > F.col("word_chars"),
        "lines": F.col("n_dup_lines") * 2 > F.col("n_lines_floor"),
    }


def host_quality(docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = 0.5, extra: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: ``extra``, the measures, base_failed, host_failed and kept.

    A host's failure rate for each rule is shrunk by a beta prior fitted to all hosts (method of moments), so
    that a host of few documents needs stronger evidence. A host whose shrunk rate is above ``max_rate`` for any rule is
    rejected with all its documents; kept is neither base_failed nor host_failed.

    A null text counts as empty (so it fails), a null host is a host of its own, repeated rows are judged and
    returned each, other columns are ignored, and an empty table gives no rows. Documents with the same host are
    counted by map-side combined sums; the verdicts are a table of known size, which Spark broadcasts if that is small, and whose skewed hosts
    it otherwise splits.
    """
    names = [f"_x{i}" for i in range(len(extra))]
    base = docs.select(*[F.col(c).alias(n) for c, n in zip(extra, names)], F.col(host).alias("_host"), measures(F.col(text)).alias("_m"))
    base = base.select(*names, "_host", "_m.*")
    base = base.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    base = cut(base, "quality")
    # a line holds ten words or so; the floor keeps one repeated line of a short text from counting
    rules = {k: v.cast("long") for k, v in host_rules().items()}
    flagged = base.withColumn("n_lines_floor", F.greatest(F.col("n_words") / 10, F.lit(4.0)))
    hosts = flagged.groupBy("_host").agg(F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in rules.items()])
    total = hosts.agg(F.sum("n").alias("all_n"), *[(F.sum(k) / F.sum("n")).alias(f"mu_{k}") for k in rules])
    mean = F.broadcast(total)  # one row
    spread = hosts.join(mean, F.lit(True)).agg(*[(F.sum(F.col("n") * F.pow(F.col(k) / F.col("n") - F.col(f"mu_{k}"), 2)) / F.sum("n")).alias(f"var_{k}") for k in rules])
    # strength of the prior in documents: mu (1 - mu) / var - 1, held between 10 and 10,000
    judged = hosts.join(mean, F.lit(True)).join(F.broadcast(spread), F.lit(True))
    bad = F.lit(False)
    for k in rules:
        mu, var = F.col(f"mu_{k}"), F.col(f"var_{k}")
        strength = F.when(var > 0, F.greatest(F.lit(10.0), F.least(F.lit(10000.0), mu * (1 - mu) / F.greatest(var, F.lit(1e-12)) - 1))).otherwise(F.lit(10000.0))
        bad = bad | ((F.col(k) + mu * strength) / (F.col("n") + strength) > max_rate)
    verdicts = cut(judged.select(F.col("_host").alias("_h"), bad.alias("host_failed")), "verdicts")
    out = base.join(verdicts, F.col("_host").eqNullSafe(F.col("_h")), "left").withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
    kept = ~F.col("base_failed") & ~F.col("host_failed")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, extra)], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", kept.alias("kept"))
