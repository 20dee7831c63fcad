"""Relational stores and capture logs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from turnmill.sources import captures, stores, transcripts

from test_transcripts import lines_of


def test_messages_and_parts(spark):
    messages = spark.createDataFrame([("m2", "s", 20, '{"n":2}'), ("m1", "s", 10, '{"n":1}')], "id string, session_id string, time_created long, data string")
    parts = spark.createDataFrame([("p2", "m1", "s", 12, '{"p":2}'), ("p1", "m1", "s", 11, '{"p":1}'), ("p9", "m1", "other", 11, "{}")], "id string, message_id string, session_id string, time_created long, data string")
    assert [(r["line_no"], r["value"]) for r in stores.message_lines(messages, parts).orderBy("line_no").collect()] == [(1, '{"n":1}'), (2, '{"p":1}'), (3, '{"p":2}'), (4, '{"n":2}')]


def test_replayed_sessions(spark):
    sessions = spark.createDataFrame([("s", "key", "/tmp")], "session_id string, session_key string, cwd string")
    events = spark.createDataFrame([("s", 2, 5, "r", '{"sessionUpdate": "tool_call"}'), ("s", 1, 4, None, '{"sessionUpdate": "usage_update", "used": 3}'), ("s", 3, 6, "r", "{}")], "session_id string, seq int, at long, run_id string, update_json string")
    lines = stores.replay_lines(sessions, events)
    got = transcripts.openclaw_lines(lines).orderBy("seq").collect()
    assert [(r["session_id"], r["run_id"], r["update"], r["error"]) for r in got] == [("s", "", None, None), ("s", "", "usage_update", None), ("s", "r", "tool_call", None)]
    assert transcripts.formats(lines).first()["format"] == "openclaw"


def test_virtual_paths(spark):
    row = spark.createDataFrame([("/a b#c.db", "x/y#z")], "db string, s string").select(stores.virtual_path(F.col("db"), F.col("s")).alias("p")).select(*stores.virtual_parts("p")).first()
    assert tuple(row) == ("/a b#c.db", "x/y#z")


def test_captures(spark):
    body = {"system": [{"type": "text", "text": "abc"}, {"type": "text", "text": "de"}], "tools": [{"name": "t"}], "messages": [{"role": "user", "content": "x"}]}
    rows = [{"request": {"method": "GET", "body": body}}, {"request": {"method": "POST", "body": {"a": 1}}}, {"request": {"method": "POST", "body": body}}]
    got = captures.core_sizes(lines_of(spark, "s", rows)).first()
    assert (got["sysPrompt"], got["tool_defs"], got["n_tools"]) == (5, len(json.dumps(body["tools"], separators=(",", ":"))), 1)
    other = captures.core_sizes(lines_of(spark, "s", [{"request": {"method": "POST", "body": {"instructions": "four", "input": []}}}]))
    assert captures.filled(other, {"sysPrompt": 1, "tool_defs": 99}).first().asDict() == {"session": "s", "sysPrompt": 4, "tool_defs": 99}


def test_shards_are_written_once(spark, tmp_path):
    from turnmill.sources.tables import MANIFEST, write_shards

    rows = lambda mark, sessions: spark.createDataFrame([(s, i // 2, i, f"{mark}{i}") for s in sessions for i in range(3)], "session string, shard int, turn_i long, content string")
    root = str(tmp_path)
    found = lambda: {(r["session"], r["shard"], r["value"]) for r in spark.read.schema("shard int, value string, session string").json(f"{root}/shards").collect()}
    write_shards(rows("a", ["1", "x"]), root)
    first = {(s, k, t) for s in ("1", "x") for k, t in ((0, "a0\na1"), (1, "a2"))}
    assert found() == first
    write_shards(rows("b", ["x", "y"]), root)
    assert found() == first | {("y", 0, "b0\nb1"), ("y", 1, "b2")}
    write_shards(rows("c", ["x"]), root, force=True)
    assert ("x", 0, "c0\nc1") in found() and ("1", 0, "a0\na1") in found()
    write_shards(rows("d", ["x"]).where("shard = 0"), root, force=True)
    assert {k for s, k, _ in found() if s == "x"} == {0}
    write_shards(rows("c", ["x"]), root, force=True)
    listed = spark.read.schema(MANIFEST).json(f"{root}/manifests").orderBy("session", "shard").collect()
    assert [(r["session"], r["shard"], r["first_turn"], r["last_turn"], r["turns"]) for r in listed][:2] == [("1", 0, 0, 1, 2), ("1", 1, 2, 2, 1)] and len(listed) == 6
