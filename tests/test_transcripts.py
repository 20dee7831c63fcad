"""Readers on small hand-made logs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from turnmill.sources import transcripts as S


def lines_of(spark, session, rows):
    return spark.createDataFrame([(session, i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows, 1)], "session string, line_no int, value string")


def user(text, **more):
    return {"type": "user", "uuid": "u", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": text}, **more}


def assistant(blocks, usage=None):
    return {"type": "assistant", "uuid": "a", "timestamp": "2024-01-01T00:00:05Z", "message": {"content": blocks, "model": "m", **({"usage": usage} if usage else {})}}


@pytest.mark.parametrize(
    ("line", "label"),
    [
        (user("x"), "claude"), ({"type": "session_meta", "payload": {}}, "codex"), ({"type": "event_msg", "payload": {"type": "x"}}, "codex"), ({"type": "text", "sessionID": "s"}, "opencode"),
        ({"type": "header", "version": 1}, "pi-session"), ({"type": "message", "id": "1", "message": {}}, "pi-session"), ({"type": "turn_start"}, "pi-event-stream"),
        ({"type": "session_update", "update": {"sessionUpdate": "tool_call"}}, "openclaw"), ({"a": 1}, "unknown"), ("{", "unknown"), ("[1]", "unknown"),
    ],
)
def test_formats(spark, line, label):
    assert S.formats(lines_of(spark, "s", ["", line])).collect()[0]["format"] == label


def test_a_bad_line_before_the_decisive_one(spark):
    assert S.formats(lines_of(spark, "s", ["nonsense", user("x")])).first()["format"] == "unknown"
    assert S.formats(lines_of(spark, "s", [{"a": 1}, user("x")])).first()["format"] == "claude"
    assert S.formats(lines_of(spark, "s", [{"a": 1}] * 25 + [user("x")])).first()["format"] == "unknown"


def test_faulty_lines(spark):
    rows = ["{bad", "[]", {"type": "user"}, {**user("x"), "type": "other"}, {**user("x"), "message": 3}, "", user("ok")]
    got = {r["line_no"]: r["error"] for r in S.claude_lines(lines_of(spark, "s", rows)).collect()}
    assert got == {1: "Invalid JSON: could not parse line", 2: "Line is not a JSON object", 3: "Missing required fields", 4: "Unknown line type", 5: 'User line missing or invalid "message" field', 7: None}


def test_turns_and_usage(spark):
    rows = [
        assistant([{"type": "text", "text": "before any turn"}]),
        user("first", promptId="p1"),
        user("more", promptId="p1", isMeta=True),
        assistant([{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"a": 1}}], {"input_tokens": 10, "output_tokens": 5, "cache_read_input_tokens": 90}),
        user([{"type": "tool_result", "tool_use_id": "t1", "content": "data"}]),
        user("<task-notification> x"),
        assistant([{"type": "text", "text": "done"}], {"input_tokens": 7}),
        user([{"type": "text", "text": "second"}]),
    ]
    turns = S.claude_turns(lines_of(spark, "s", rows))
    assert [(r["line_no"], r["turn_i"]) for r in turns.orderBy("line_no").collect()] == [(2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (7, 0), (8, 1)]
    assert [tuple(r) for r in S.claude_requests(turns).collect()] == [("s", 0, 4, "m", 100, 90, 5)]
    blocks = S.claude_blocks(turns)
    assert [(r["type"], r["name"], r["input"]) for r in blocks.where("line_no = 4").orderBy("block_i").collect()] == [("thinking", None, None), ("tool_use", "Read", '{"a":1}')]


def test_other_formats(spark):
    codex = S.codex_usage(lines_of(spark, "s", [{"type": "event_msg", "timestamp": "2024-01-01T00:00:00Z", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 12, "cached_input_tokens": 3, "output_tokens": 5}, "model_context_window": 258400}}}]))
    assert tuple(codex.first()) == ("s", 0, 12, 3, 5, None, 258400)
    assert S.codex_lines(lines_of(spark, "s", [{"payload": {}}])).first()["error"] == "Codex line missing type"
    opencode = S.opencode_lines(lines_of(spark, "s", [{"type": "text", "timestamp": 1700000000, "part": {"sessionID": "q"}}, {"type": "text", "timestamp": 1700000000123}])).orderBy("seq").collect()
    assert [(r["session_id"], r["ms"]) for r in opencode] == [("q", 1700000000000), ("", 1700000000123)]
    claw = S.openclaw_lines(lines_of(spark, "s", [{"type": "openclaw_session", "session_id": "k"}, {"sessionUpdate": "tool_call", "runId": "r", "at": 5}, {"type": "x"}])).orderBy("seq").collect()
    assert [(r["session_id"], r["run_id"], r["update"], r["error"]) for r in claw] == [("k", "", None, None), ("", "r", "tool_call", None), ("", "", None, "OpenClaw line missing sessionUpdate")]


def test_longest_branch(spark):
    tree = [("a", None), ("b", "a"), ("c", "b"), ("x", "a"), ("d", "c"), ("e", "c"), ("p", "q"), ("q", "p")]
    rows = [{"type": "message", "id": i, **({"parentId": p} if p else {}), "message": {}} for i, p in tree]
    assert [r["id"] for r in S.longest_branch(lines_of(spark, "s", rows)).orderBy("seq").collect()] == ["a", "b", "c", "e"]


def test_longest_branch_of_deep_and_random_trees(spark):
    import random

    draw = random.Random(4)
    deep = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(400)] + [(f"m{i}", f"n{draw.randrange(300)}") for i in range(60)]
    wide = [(f"r{i}", f"r{draw.randrange(i)}" if i and draw.random() < 0.95 else None) for i in range(120)]
    entry = lambda i, p: {"type": "message", "id": i, **({"parentId": p} if p else {}), "message": {}}
    lines = lines_of(spark, "deep", [entry(*x) for x in deep]).union(lines_of(spark, "wide", [entry(*x) for x in wide]))
    got = S.longest_branch(lines).orderBy("session", "depth").collect()
    for session, tree in (("deep", deep), ("wide", wide)):
        up, best = dict(tree), []
        for i, _ in tree:
            path = [i]
            while up[path[-1]]:
                path.append(up[path[-1]])
            if len(path) >= len(best):
                best = path
        assert [r["id"] for r in got if r["session"] == session] == best[::-1]
    assert S.longest_branch(lines.limit(0)).collect() == []


def test_attachments(spark):
    rows = [{"type": "attachment", "attachment": {"type": "skill_listing", "content": "x"}}, {"type": "attachment", "attachment": {"type": "other", "content": "y"}}, {"type": "attachment", "attachment": {"type": "task_reminder", "n": 1}}, {"type": "user"}]
    got = S.claude_attachments(lines_of(spark, "s", rows)).orderBy("line_no").collect()
    assert [(r["line_no"], r["attachment"], json.loads(r["content"])) for r in got] == [(1, "skill_listing", "x"), (3, "task_reminder", {"type": "task_reminder", "n": 1})]


def test_collected_items(spark):
    from turnmill.functions.json_text import collected_items

    texts = {1: '[{"a": 1}, [{"a": 2}], 3]', 2: '{"results": [{"text": "{\\"a\\": 4}"}, {"text": "no"}]}', 3: "none", 4: None, 5: '[[[[{"a": 5}]]]]', 6: '[[[[[{"a": 6}]]]]]', 7: ""}
    got = collected_items(spark.createDataFrame(list(texts.items()), "id int, t string"), "t").selectExpr("id", "place", "to_json(item) AS item").orderBy("id", "place").collect()
    assert [(r["id"], json.loads(r["item"])["a"]) for r in got] == [(1, 1), (1, 2), (2, 4), (5, 5)]


def test_files(spark, tmp_path):
    for name in ("p/one.jsonl", "p/agent-x.jsonl", "p/subagents/two.jsonl", "p/.hidden/three.jsonl"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps(user("x")) + "\n\n" + json.dumps(user("y")))
    got = S.raw_lines(spark, str(tmp_path)).where(F.col("value") != "").orderBy("line_no").collect()
    assert [r["line_no"] for r in got] == [1, 3] and got[0]["session"].endswith("/p/one.jsonl")
