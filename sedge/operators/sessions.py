"""Sessions and their messages. ``now`` is a parameter of everything that depends on time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sedge.functions.text import json_merge

ROLES = ("user", "assistant", "system")


def active(expires_at: Column, now: Column) -> Column:
    """A session without an expiry never ends."""
    return expires_at.isNull() | (expires_at > now)


def active_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(active(F.col("expires_at"), now))


def new_sessions(requests: DataFrame, now: Column, minutes: int = 60) -> DataFrame:
    """Session rows for requests(id, user_id, metadata); null metadata is an empty object."""
    return requests.select("id", "user_id", F.coalesce("metadata", F.lit("{}")).alias("metadata"), now.alias("created_at"), now.alias("updated_at"), (now + F.make_interval(mins=F.lit(minutes))).alias("expires_at"))


def get_or_create(sessions: DataFrame, requests: DataFrame, now: Column, minutes: int = 60) -> DataFrame:
    """The active session of each request's id, or a new one; ``found`` tells them, as a session that was there can have been created at ``now`` too."""
    live = active_sessions(sessions, now)
    fresh = new_sessions(requests.join(live, "id", "left_anti"), now, minutes)
    return live.join(requests.select("id"), "id", "left_semi").withColumn("found", F.lit(True)).unionByName(fresh.withColumn("found", F.lit(False)))


def merge_metadata(sessions: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """All sessions, those that are active and in changes(id, change) with shallowly merged metadata; ``changed`` tells them."""
    given = sessions.join(changes.select(F.col("id").alias("_id"), "change"), F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull() & active(F.col("expires_at"), now)
    merged = given.withColumn("changed", hit).withColumn("metadata", F.when(hit, json_merge(F.col("metadata"), F.col("change"))).otherwise(F.col("metadata"))).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))
    return merged.drop("_id", "change")


def valid_messages(messages: DataFrame) -> DataFrame:
    """Messages of the roles that a store takes."""
    return messages.where(F.col("role").isin(*ROLES))


def history(messages: DataFrame, session_id, limit: int | None = None) -> DataFrame:
    """A session's messages from the oldest; the first ``limit``, all for None or 0."""
    rows = messages.where(F.col("session_id") == session_id).orderBy("created_at", "id")
    return rows.limit(limit) if limit else rows


def context(messages: DataFrame, oldest: int = 10, last: int = 6, mode: str = "reference") -> DataFrame:
    """The messages that each session's next prompt holds, numbered from 1.

    ``reference`` takes the last six of the oldest ten; ``recent`` the last six of all.
    """
    by = Window.partitionBy("session_id")
    ranked = messages.withColumn("_up", F.row_number().over(by.orderBy("created_at", "id")))
    if mode == "reference":
        ranked = ranked.where(F.col("_up") <= oldest)
    elif mode != "recent":
        raise ValueError("mode is reference or recent")
    ranked = ranked.withColumn("_down", F.row_number().over(by.orderBy(F.desc("_up")))).where(F.col("_down") <= last)
    return ranked.withColumn("position", F.row_number().over(by.orderBy("_up"))).drop("_up", "_down")


def prompt_context(messages: DataFrame, **how) -> DataFrame:
    """One text per session: ``role: content`` lines of its context. At most ``last`` messages meet in a row."""
    rows = context(messages, **how).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("position", "role", "content"))).alias("m"))
    return rows.select("session_id", F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("prompt"))


def turn_rows(turns: DataFrame, now: Column) -> DataFrame:
    """Two message rows for each of turns(session_id, question, answer), the question first."""
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(0).alias("n")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.lit(1).alias("n")))
    rows = turns.select("session_id", F.explode(pair).alias("m"))
    return rows.select(F.sha2(F.concat_ws("|", F.col("session_id").cast("string"), "m.role", "m.content", now.cast("string")), 256).alias("id"), "session_id", "m.role", "m.content", F.lit("{}").alias("metadata"), (now + F.make_interval(secs=F.col("m.n") / 1_000_000)).alias("created_at"))


def tool_calls(runs: DataFrame) -> DataFrame:
    """Tool calls of runs(run_id, messages): messages is JSON, an array of objects with ``parts``.

    A part counts if its ``part_kind`` is tool-call. Arguments are an object, or the text of one; anything else is an empty object.
    """
    part = "struct<part_kind:string,tool_name:string,args:string,tool_call_id:string>"
    parts = F.from_json("messages", f"array<struct<parts:array<{part}>>>")
    rows = runs.select("run_id", F.posexplode(F.flatten(F.transform(F.coalesce(parts, F.array().cast(f"array<struct<parts:array<{part}>>>")), lambda m: F.coalesce(m["parts"], F.array().cast(f"array<{part}>"))))).alias("position", "p"))
    args = F.when(F.json_object_keys("p.args").isNotNull(), F.col("p.args")).otherwise("{}")
    return rows.where("p.part_kind = 'tool-call'").select("run_id", "position", F.coalesce("p.tool_name", F.lit("unknown")).alias("tool_name"), args.alias("args"), F.nullif("p.tool_call_id", F.lit("")).alias("tool_call_id"))
