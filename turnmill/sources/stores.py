"""Sessions kept in relational stores, re-emitted as transcript lines.  The tables come from any reader, for example spark.read.jdbc."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.operators.windows import ordinal

PREFIX = "store:"


def virtual_path(db, session):
    """One name for a session inside a store, and its two parts again: the last # parts them."""
    return F.concat(F.lit(PREFIX), F.url_encode(db), F.lit("#"), F.url_encode(session))


def virtual_parts(path):
    return F.url_decode(F.substring_index(F.expr(f"substring({path}, {len(PREFIX) + 1})"), "#", 1)).alias("db"), F.url_decode(F.substring_index(path, "#", -1)).alias("session")


def message_lines(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Messages (id, session_id, time_created, data) with their parts (id, message_id, session_id, time_created, data): session, line_no, value.

    A message comes before its parts, which follow by time and id; a message without parts stands alone.
    """
    m = messages.select(F.col("session_id").alias("session"), F.col("id").alias("message"), F.col("time_created").alias("at"), F.col("data").alias("head"))
    p = parts.select(F.col("session_id").alias("session"), F.col("message_id").alias("message"), F.col("time_created").alias("part_at"), F.col("id").alias("part"), F.col("data").alias("body"))
    heads = m.select("session", "at", "message", F.lit(None).cast(p.schema["part_at"].dataType).alias("part_at"), F.lit("").alias("part"), F.col("head").alias("value"))
    bodies = m.join(p, ["session", "message"]).select("session", "at", "message", "part_at", "part", F.col("body").alias("value"))
    return ordinal(heads.unionByName(bodies), ["session"], ["at", "message", F.col("part_at").asc_nulls_first(), "part"], "line_no").select("session", (F.col("line_no") + 1).cast("int").alias("line_no"), "value")


def replay_lines(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Replayed sessions (session_id, session_key, cwd) with their events (session_id, seq, at, run_id, update_json): a header line, then the updates by seq.

    Events whose JSON names no sessionUpdate are dropped.
    """
    head = sessions.select(F.col("session_id").alias("session"), F.lit(-1).cast("long").alias("seq"), F.to_json(F.struct(F.lit("openclaw_session").alias("type"), F.col("session_id").alias("sessionId"), F.col("session_key").alias("sessionKey"), "cwd")).alias("value"))
    update = F.try_parse_json("update_json")
    kept = events.where(F.try_variant_get(update, "$.sessionUpdate", "string").isNotNull())
    wrapped = F.concat(F.lit('{"type":"session_update","sessionId":"'), "session_id", F.lit('","runId":"'), F.coalesce("run_id", F.lit("")), F.lit('","at":'), F.col("at").cast("string"), F.lit(',"update":'), F.to_json(update), F.lit("}"))
    body = kept.select(F.col("session_id").alias("session"), F.col("seq").cast("long").alias("seq"), wrapped.alias("value"))
    return ordinal(head.unionByName(body), ["session"], ["seq"], "line_no").select("session", (F.col("line_no") + 1).cast("int").alias("line_no"), "value")
