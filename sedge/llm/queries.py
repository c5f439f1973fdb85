"""Registered queries of this subpackage and, where SQL can say the same, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sedge.llm.bpe import roundtrip
from sedge.llm.chat import chat_digest, format_chat, to_turns
from sedge.llm.lines import dedup_lines
from sedge.llm.merkle import fold, leaf, merkle_paths, proof_digest
from sedge.llm.mixing import mix_sources
from sedge.llm.negatives import hard_negatives
from sedge.llm.omh import near_duplicates
from sedge.llm.pq import near_vectors
from sedge.llm.quality import host_quality
from sedge.llm.shards import shard
from sedge.llm.suffix import dedup_substrings
from sedge.llm.toxicity import score_toxicity, train
from sedge.llm.warc import read_archives, write_archives
from sedge.runtime import scratch_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    control = "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(control))
    return chat_digest(format_chat(to_turns(rows)))


OP1_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(i, r)),
e AS (SELECT *, length(role) + length(text) + 20 AS plain,
             length(role || text) - length(replace(role || text, '\', ''))
             + len(regexp_extract_all(role, '</?s>|\[/?INST\]')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]')) AS marks FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(plain + marks)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""".replace("\\\\", "\\").replace("'\\\\'", "'\\'")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 3, 1, 2 over their sources, 150 % of all words."""
    return mix_sources(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the public 50k ranks and decoded."""
    return roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to seekable bundles and read back."""
    return read_archives(write_archives(table(spark, sf_dir, "pages")))


OP4_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten sites or more share, which stay in the first document that has them."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, * FROM documents),
l AS (SELECT rid, doc_id, source, i, ls[i] AS line, trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
      FROM (SELECT rid, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM d)),
b AS (SELECT k, min(doc_id) AS first FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT coalesce('s' || source, 'n')) >= 10),
m AS (SELECT l.*, b.k IS NOT NULL AND doc_id IS DISTINCT FROM first AS gone FROM l LEFT JOIN b USING (k)),
r AS (SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS left_over,
             count(*) FILTER (k <> '') AS n_lines, count(*) FILTER (gone) AS n_removed FROM m GROUP BY rid)
SELECT doc_id, CASE WHEN n_removed > 0 THEN left_over ELSE text END AS text, n_lines, n_removed FROM d JOIN r USING (rid)
"""


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, linked within labels at cosine 0.98."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
                     WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
                       AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS n, vec_id AS c FROM embeddings UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.n),
g AS (SELECT n, min(c) AS c FROM r GROUP BY n),
k AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN g ON vec_id = n LEFT JOIN k ON vec_id = u
"""


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents appended as small shards, compacted, and read back from the manifest's latest version."""
    store = shard(table(spark, sf_dir, "documents"), scratch_path(spark, "shards"))
    return store.read().select("doc_id", "lang", "source", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


OP8_SQL = """
SELECT doc_id, lang, source, length(text)::BIGINT AS n_chars, sha256(text) AS text_sha256 FROM documents
"""


def op9_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts for all documents: base rules and their shrunk host rates."""
    return host_quality(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS k
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)),
twice AS (SELECT rid, k FROM g GROUP BY rid, k HAVING count(*) > 1),
covered AS (SELECT rid, count(DISTINCT i + o) AS n FROM g JOIN twice USING (rid, k), range(8) AS r(o) GROUP BY rid),
m AS (SELECT rid, doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN covered c USING (rid)),
b AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM m),
f AS (SELECT source, base_failed::INT::BIGINT AS r1, (n_symbols * 5 > word_chars)::INT::BIGINT AS r2,
             (n_dup_lines * 2 > greatest(n_words / 10, 4.0))::INT::BIGINT AS r3 FROM b),
l AS (SELECT source, rule, sum(bad)::DOUBLE AS k, count(*)::DOUBLE AS n
      FROM (SELECT source, unnest([1, 2, 3]) AS rule, unnest([r1, r2, r3]) AS bad FROM f) GROUP BY ALL),
mu AS (SELECT rule, sum(k) / sum(n) AS mu FROM l GROUP BY rule),
v AS (SELECT l.rule, any_value(mu) AS mu, sum(n * (k / n - mu) * (k / n - mu)) / sum(n) AS var FROM l JOIN mu USING (rule) GROUP BY l.rule),
s AS (SELECT *, CASE WHEN var > 0 THEN greatest(10.0, least(10000.0, mu * (1 - mu) / greatest(var, 1e-12) - 1)) ELSE 10000.0 END AS s FROM v),
h AS (SELECT source, bool_or((k + mu * s) / (n + s) > 0.5) AS host_failed FROM l JOIN s USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed, NOT base_failed AND NOT host_failed AS kept
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source
"""

def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the classes that near copies of 0.8 in words of five form."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that a string of 100 covers which starts earlier too."""
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed")
    return found.select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: All windows; those that a smaller id or the same row has earlier, in runs; what is left between the runs, in hex.
OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT rid, doc_id, i, b[i + 1 : i + 100] AS s FROM (SELECT *, unnest(range(0, n - 99)) AS i FROM d)),
c AS (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least, min(i) OVER (PARTITION BY s, rid) AS first FROM w),
g AS (SELECT rid, i, coalesce(i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 100, true) AS new FROM c WHERE least < doc_id OR (doc_id IS NULL AND least IS NOT NULL) OR first < i),
r AS (SELECT rid, min(i) AS a, max(i) + 100 AS z FROM (SELECT *, sum(new::INT) OVER (PARTITION BY rid ORDER BY i) AS run FROM g) GROUP BY rid, run),
k AS (SELECT rid, b, z AS a, lead(a, 1, n) OVER (PARTITION BY rid ORDER BY z) AS z FROM (SELECT d.rid, b, n, 0 AS a, 0 AS z FROM d UNION ALL SELECT d.rid, b, n, r.a, r.z FROM d JOIN r USING (rid)))
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, kept AS kept_sha256
FROM d LEFT JOIN (SELECT rid, sum(z - a) AS removed, count(*) AS spans FROM r GROUP BY rid) USING (rid)
JOIN (SELECT rid, sha256(unhex(coalesce(string_agg(CASE WHEN z > a THEN hex(b[a + 1 : z]) ELSE '' END, '' ORDER BY a), ''))) AS kept FROM k GROUP BY rid) USING (rid)
"""

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authentication paths of all documents; those whose id's checksum 3 divides are tampered with, and found out."""
    values = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    lowered = F.translate("text", LETTERS, LETTERS.lower())
    seen = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf(*{**values, "text": lowered}.values())).otherwise(leaf(*values.values()))
    found = merkle_paths(table(spark, sf_dir, "documents"), seen=seen)
    folded = found.withColumn("folded_root", fold(F.col("seen"), F.col("path")))
    return folded.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
#: Levels of the groups' trees, then of the tree of their roots; what stands left and right of every node; steps of all leaves in order, folded.
OP12_SQL = f"""
WITH RECURSIVE crc AS (SELECT *, row_number() OVER () AS rid, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, c: list_reduce(list_concat([xor(a, c)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc FROM documents),
d AS (SELECT rid, doc_id, lang, {_LEAF.format("text")} AS leaf, CASE WHEN crc % 3 = 0 THEN {_LEAF.format(f"translate(text, '{LETTERS}', '{LETTERS.lower()}')")} ELSE {_LEAF.format("text")} END AS seen FROM crc),
p AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM d),
low AS (SELECT tree, 0 AS level, place, n, leaf AS h FROM p
  UNION ALL SELECT tree, level + 1, place // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY place)) FROM low WHERE n > 1 GROUP BY tree, level, place // 8, n),
sub AS (SELECT tree, h FROM low WHERE n = 1),
high AS (SELECT 0 AS level, tree AS place, count(*) OVER () AS n, h FROM sub
  UNION ALL SELECT level + 1, place // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY place)) FROM high WHERE n > 1 GROUP BY level, place // 8, n),
nodes AS (SELECT 0 AS part, tree, level, place, h FROM low WHERE n > 1 UNION ALL SELECT 1, 0, level, place, h FROM high WHERE n > 1),
sides AS (SELECT a.part, a.tree, a.level, a.place, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
  FROM nodes a JOIN nodes b ON a.part = b.part AND a.tree = b.tree AND a.level = b.level AND a.place // 8 = b.place // 8 GROUP BY ALL),
steps AS (SELECT rid, 0 AS part, level, l, r FROM p JOIN sides s ON s.part = 0 AND s.tree = p.tree AND s.place = p.place // (8 ** s.level)::BIGINT
  UNION ALL SELECT rid, 1, level, l, r FROM p JOIN sides s ON s.part = 1 AND s.place = p.tree // (8 ** s.level)::BIGINT),
folded AS (SELECT p.rid, sha256(coalesce(string_agg(l || r, '' ORDER BY part, level), '')) AS proof,
  list_reduce(list_prepend({{'l': '', 'r': '', 'h': any_value(seen)}}, coalesce(list({{'l': l, 'r': r, 'h': ''}} ORDER BY part, level) FILTER (l IS NOT NULL), [])), lambda a, x: {{'l': '', 'r': '', 'h': sha256(x.l || a.h || x.r)}}).h AS h
  FROM p LEFT JOIN steps USING (rid) GROUP BY p.rid)
SELECT doc_id, leaf, sub.h AS subroot, root.h AS root, proof AS proof_sha256, folded.h AS folded_root, folded.h = root.h AS verified
FROM p JOIN sub USING (tree) JOIN folded USING (rid), (SELECT h FROM high WHERE n = 1) AS root
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, among all; every seventh label is moved on by one first."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
           FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score QUALIFY rank <= 5
"""


QUERIES: dict[str, Query] = {
    "op1_chat_format": op1_chat_format,
    "op2_mixing": op2_mixing,
    "op3_bpe": op3_bpe,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_sharding": op8_sharding,
    "op9_host_quality": op9_host_quality,
    "op10_order_minhash": op10_order_minhash,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_merkle": op12_merkle,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE: dict[str, str] = {
    "op1_chat_format": OP1_SQL,
    "op4_warc": OP4_SQL,
    "op6_line_dedup": OP6_SQL,
    "op7_embedding_dedup": OP7_SQL,
    "op8_sharding": OP8_SQL,
    "op9_host_quality": OP9_SQL,
    "op11_suffix_dedup": OP11_SQL,
    "op12_merkle": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
