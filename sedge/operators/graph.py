"""Entity graph: building, upserts, searches and walks.

Frames: entities(name_key, name, type, summary, name_embedding, created_at, source_doc) with one row a key, and
edges(src_key, dst_key, fact, predicate, source_doc, chunk_id, created_at), a bag: parallel edges stay.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from sedge.functions.text import normal_name, repair, repaired, reply_object
from sedge.functions.vectors import cosine_to

MOST_ENTITIES = 8
#: Rows that are handed on at a time, as replies may be many times longer than their texts.
REPLIES = 64
NEAREST = 10
EXTRACTED = "struct<entities:array<struct<name:string,type:string,summary:string>>,relationships:array<struct<subject:string,predicate:string,object:string,fact:string>>>"

Extractor = Callable[[str], str]


def extract(chunks: DataFrame, extractor: Extractor, content: str = "content") -> DataFrame:
    """Add ``reply``, the extractor's answer for each chunk, and ``error``, null unless the call failed."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)

    def run(batches):
        for pdf in (batch.iloc[at : at + REPLIES] for batch in batches for at in range(0, len(batch), REPLIES)):
            replies, errors = [], []
            for text in pdf[content]:
                try:
                    replies.append(extractor(text))
                    errors.append(None)
                except Exception as e:  # a failed chunk is recorded and the rest go on
                    replies.append(None)
                    errors.append(str(e))
            yield pdf.assign(reply=replies, error=errors)

    return chunks.mapInPandas(run, f"{kept}, reply string, error string")


def parse_replies(rows: DataFrame, reply: str = "reply", most: int = MOST_ENTITIES) -> DataFrame:
    """Add ``entities`` and ``relationships`` parsed from a reply.

    Broken characters are repaired, texts are stripped, missing types are ``other``, unnamed entities go. Of more than ``most``
    entities the first stay, and only then do relationships with an end that did not stay go. A reply that is no JSON object has neither.
    """
    strip = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", "")
    parsed = rows.withColumn("_x", F.from_json(reply_object(repair(F.col(reply))), EXTRACTED))
    none_e, none_r = (F.array().cast(t) for t in ("array<struct<name:string,type:string,summary:string>>", "array<struct<subject:string,predicate:string,object:string,fact:string>>"))
    entities = F.transform(F.coalesce("_x.entities", none_e), lambda e: F.struct(strip(e["name"]).alias("name"), strip(F.coalesce(e["type"], F.lit("other"))).alias("type"), strip(e["summary"]).alias("summary")))
    links = F.transform(F.coalesce("_x.relationships", none_r), lambda r: F.struct(*[strip(r[k]).alias(k) for k in ("subject", "predicate", "object", "fact")]))
    parsed = parsed.withColumn("_e", F.filter(entities, lambda e: e["name"] != "")).withColumn("_r", links)
    kept = F.slice("_e", 1, most)
    names = F.transform(kept, lambda e: e["name"])
    few = F.when(F.size("_e") > most, F.filter("_r", lambda r: F.array_contains(names, r["subject"]) & F.array_contains(names, r["object"]))).otherwise(F.col("_r"))
    return parsed.withColumn("entities", kept).withColumn("relationships", few).drop("_x", "_e", "_r")


def parse_reply(reply: str | None, most: int = MOST_ENTITIES) -> dict:
    """The same for one reply, outside Spark."""
    text = (repaired(reply) or "").strip()
    try:
        found = json.loads(text[text.index("{") : text.rindex("}") + 1])
    except ValueError:
        return {"entities": [], "relationships": []}
    clean = lambda x, default="": (repaired(str(x)) or "").strip() if x is not None else default
    entities = [{"name": clean(e.get("name")), "type": clean(e.get("type"), "other"), "summary": clean(e.get("summary"))} for e in found.get("entities", [])]
    links = [{k: clean(r.get(k)) for k in ("subject", "predicate", "object", "fact")} for r in found.get("relationships", [])]
    entities = [e for e in entities if e["name"]]
    if len(entities) > most:
        entities = entities[:most]
        names = {e["name"] for e in entities}
        links = [r for r in links if r["subject"] in names and r["object"] in names]
    return {"entities": entities, "relationships": links}


def entity_records(episodes: DataFrame) -> DataFrame:
    """Records to upsert, from episodes(ord, source_doc, chunk_id, created_at, entities, relationships).

    Names are those of entities and then of relationship ends, once each, in the order first seen. Of several entities of a name
    the last gives type and summary; a name that is an end only is of type ``other`` without a summary.
    """
    named = F.transform(F.coalesce("entities", F.array().cast("array<struct<name:string,type:string,summary:string>>")), lambda e, i: F.struct(e["name"].alias("name"), i.alias("pos"), F.coalesce(e["type"], F.lit("other")).alias("type"), F.coalesce(e["summary"], F.lit("")).alias("summary"), F.lit(True).alias("own")))
    n = F.coalesce(F.size("entities"), F.lit(0))
    ends = F.flatten(F.transform(F.coalesce("relationships", F.array().cast("array<struct<subject:string,predicate:string,object:string,fact:string>>")), lambda r, i: F.array(*[F.struct(r[k].alias("name"), (n + 2 * i + j).alias("pos"), F.lit("other").alias("type"), F.lit("").alias("summary"), F.lit(False).alias("own")) for j, k in enumerate(("subject", "object"))])))
    rows = episodes.select("ord", "source_doc", "created_at", F.explode(F.concat(named, ends)).alias("x")).where(F.coalesce("x.name", F.lit("")) != "")
    last = F.max_by(F.struct("x.type", "x.summary"), F.struct("x.own", F.when(F.col("x.own"), F.col("x.pos")).otherwise(-1)))
    one = rows.groupBy("ord", "source_doc", "created_at", F.col("x.name").alias("name")).agg(F.min("x.pos").alias("pos"), last.alias("l"))
    return one.select("ord", "pos", normal_name(F.col("name")).alias("name_key"), "name", "l.type", "l.summary", "source_doc", "created_at")


def upsert_entities(entities: DataFrame | None, records: DataFrame) -> DataFrame:
    """Entities after records(ord, pos, name_key, name, type, summary, name_embedding?, source_doc, created_at) are merged in.

    In order of (ord, pos), behind what is there already, the first record of a key gives its name, type, embedding, time
    and source; the first summary that is not empty stays. One aggregation on the key, combined on the map side.
    """
    if "name_embedding" not in records.columns:
        records = records.withColumn("name_embedding", F.lit(None).cast("array<float>"))
    rows = records.select("name_key", "name", "type", "summary", "name_embedding", "source_doc", "created_at", F.struct(F.lit(1).alias("r"), F.col("ord").alias("o"), F.col("pos").cast("long").alias("p")).alias("at"))
    if entities is not None:
        rows = rows.unionByName(entities.select("name_key", "name", "type", "summary", "name_embedding", "source_doc", "created_at", F.struct(F.lit(0).alias("r"), F.lit(None).cast(records.schema["ord"].dataType).alias("o"), F.lit(0).cast("long").alias("p")).alias("at")))
    first = lambda c, cond=None: F.min_by(c, F.when(F.col(c).isNotNull() if cond is None else cond, F.col("at")))
    merged = rows.groupBy("name_key").agg(first("name").alias("name"), first("type").alias("type"), F.coalesce(first("summary", F.col("summary") != ""), F.lit("")).alias("summary"), first("name_embedding").alias("name_embedding"), F.min_by("source_doc", "at").alias("source_doc"), F.min_by("created_at", "at").alias("created_at"))
    return merged


def new_edges(episodes: DataFrame) -> DataFrame:
    """Edges of episodes, one for each relationship with both ends named; equal ones stay apart."""
    rows = episodes.select("source_doc", F.col("chunk_id").cast("string").alias("chunk_id"), "created_at", F.explode("relationships").alias("r"))
    named = rows.where((F.coalesce("r.subject", F.lit("")) != "") & (F.coalesce("r.object", F.lit("")) != ""))
    return named.select(normal_name(F.col("r.subject")).alias("src_key"), normal_name(F.col("r.object")).alias("dst_key"), F.coalesce("r.fact", F.lit("")).alias("fact"), F.coalesce("r.predicate", F.lit("relates_to")).alias("predicate"), "source_doc", "chunk_id", "created_at")


def graph_search(entities: DataFrame, edges: DataFrame, query: list[float], nearest: int = NEAREST, summary_fallback: bool = True) -> DataFrame:
    """(uuid, fact, source_node, is_summary): facts of the edges that leave the entities nearest to a query.

    Empty facts are left out. An entity without edges gives ``name: summary`` if it has a summary.
    """
    near = entities.where(F.col("name_embedding").isNotNull()).select("name_key", "name", "summary", cosine_to(F.col("name_embedding"), query).alias("score"))
    near = F.broadcast(near.orderBy(F.desc("score"), "name_key").limit(nearest))  # at most ``nearest`` rows
    out = edges.select("src_key", "dst_key", "fact", "predicate").join(near, F.col("src_key") == F.col("name_key"))
    facts = out.where(F.coalesce("fact", F.lit("")) != "").select(F.sha2(F.concat_ws("|", "src_key", "dst_key", "predicate", "fact"), 256).alias("uuid"), "fact", F.col("src_key").alias("source_node"), F.lit(False).alias("is_summary"))
    if not summary_fallback:
        return facts
    bare = near.where(F.coalesce("summary", F.lit("")) != "").join(out.select("src_key").distinct(), F.col("name_key") == F.col("src_key"), "left_anti")
    text = F.concat("name", F.lit(": "), "summary")
    return facts.unionByName(bare.select(F.sha2(F.concat_ws("|", "name_key", text), 256).alias("uuid"), text.alias("fact"), F.col("name_key").alias("source_node"), F.lit(True).alias("is_summary")))


def entity_relationships(edges: DataFrame, name: str) -> DataFrame:
    """(direction, related_key, predicate, fact) one hop out of and into an entity, different rows once each."""
    key = normal_name(F.lit(name))
    out = edges.where(F.col("src_key") == key).select(F.lit("out").alias("direction"), F.col("dst_key").alias("related_key"), "predicate", "fact")
    into = edges.where(F.col("dst_key") == key).select(F.lit("in").alias("direction"), F.col("src_key").alias("related_key"), "predicate", "fact")
    return out.distinct().unionByName(into.distinct())


def related_facts(entities: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(central_entity, direction, related_key, predicate, fact), a row for each different fact one hop away; none if there is no such entity."""
    own = entities.where(F.col("name_key") == normal_name(F.lit(name))).select(F.col("name").alias("central_entity"))
    return own.join(entity_relationships(edges, name)).select("central_entity", "direction", "related_key", "predicate", "fact")


def related_entities(entities: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """One row: central_entity, related_entities (sorted set) and related_facts, outgoing first; no row if there is no such entity.

    An entity of very many facts is better asked for as rows (:func:`related_facts`).
    """
    own = entities.where(F.col("name_key") == normal_name(F.lit(name))).select("name_key", F.col("name").alias("central_entity"))
    links = entity_relationships(edges, name)
    packed = links.agg(F.sort_array(F.collect_set("related_key")).alias("related_entities"), F.sort_array(F.collect_list(F.struct(F.when(F.col("direction") == "out", 0).otherwise(1).alias("o"), "related_key", "predicate", "fact"))).alias("related_facts"))
    return own.join(packed).select("central_entity", "related_entities", "related_facts")


def entity_timeline(edges: DataFrame, name: str, start=None, end=None) -> DataFrame:
    """(fact, related_key, valid_at) of the edges that leave an entity; optionally those from ``start`` to ``end`` only."""
    rows = edges.where(F.col("src_key") == normal_name(F.lit(name)))
    if start is not None:
        rows = rows.where(F.col("created_at") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("created_at") <= F.lit(end))
    return rows.select("fact", F.col("dst_key").alias("related_key"), F.col("created_at").alias("valid_at"))


def graph_statistics(entities: DataFrame, edges: DataFrame) -> DataFrame:
    return entities.agg(F.count("*").alias("entities")).join(edges.agg(F.count("*").alias("relationships")))


def reachable(edges: DataFrame, name: str, depth: int = 2) -> DataFrame:
    """(key, depth): entities within ``depth`` hops in either direction, at their least distance. An extra: one join a hop."""
    if depth < 0:
        raise ValueError("depth must not be negative")
    both = edges.select(F.col("src_key").alias("a"), F.col("dst_key").alias("b")).unionByName(edges.select(F.col("dst_key").alias("a"), F.col("src_key").alias("b"))).distinct()
    found = edges.sparkSession.range(1).select(normal_name(F.lit(name)).alias("key"), F.lit(0).alias("depth"))
    front = found
    for hop in range(1, depth + 1):
        front = front.join(both, F.col("key") == F.col("a")).select(F.col("b").alias("key")).distinct().join(found, "key", "left_anti").withColumn("depth", F.lit(hop))
        found = found.unionByName(front)
    return found


def entities_with_vectors(entities: DataFrame) -> DataFrame:
    """Entities with a vector that is all numbers, in the order that scans follow."""
    good = F.col("name_embedding").isNotNull() & F.forall(F.col("name_embedding"), lambda x: x.isNotNull() & ~F.isnan(x))
    return entities.where(good)

