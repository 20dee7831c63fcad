"""Headers of sessions, format by format."""

from __future__ import annotations

from test_builders import at, event, item, lines_of, say, usage

from turnmill.operators import codex, headers, openclaw, opencode, pi
from turnmill.sources import transcripts as S


def told(df):
    (row,) = df.collect()
    return [row[c] for c in headers.HEADER[1:]]


def test_codex(spark):
    rows = [
        {"timestamp": at(0), "type": "session_meta", "payload": {"cli_version": "0.4"}}, {"timestamp": at(0), "type": "turn_context", "payload": {"model": "gpt-a", "cwd": "/work"}}, event(1, "task_started"), event(1, "user_message", message="first"), usage(2, input_tokens=100, output_tokens=5),
        event(2, "task_complete"), event(3, "task_started"), usage(4, input_tokens=300, output_tokens=6), usage(5, input_tokens=300, output_tokens=7), item(6, "reasoning", summary=[]), event(6, "task_complete"),
    ]
    lines = lines_of(spark, rows)
    events = codex.turn_events(lines)
    assert told(headers.codex_headers(lines, events, codex.codex_turns(lines, events), "file")) == ["gpt-a", "0.4", "/work", "first", 3, 18, 1, 300, 1, 1000]


def test_opencode(spark):
    line = lambda kind, part=None: {"type": kind, "timestamp": at(1), "sessionID": "ses", "part": part or {}}
    for finish, want in (([{"tokens": {"input": 9, "output": 2}}, {"tokens": {"input": 9, "output": 1}}], [2, 3, 0, 9, 0]), ([], [1, 0, 0, None, 1])):
        rows = [line("text", {"text": "x"}), *[line("step_finish", f) for f in finish], line("step_start", {"prompt": "ask " * 30})]
        lines = lines_of(spark, rows)
        events = opencode.step_events(lines)
        turns = opencode.opencode_turns(events, "f")
        got = told(headers.opencode_headers(lines, turns, opencode.opencode_steps(events, turns), "f"))
        assert got[:4] == ["opencode", "ses", "", "OpenCode stream: f"] and got[9] == 200_000
        assert [got[4] - (1 if finish else 0), *got[5:7], got[7] if finish else None, got[8]] == want and (finish or got[7] > 30)


def test_openclaw(spark):
    up = lambda kind, **more: {"sessionId": "claw", "runId": "r", "timestamp": at(1), "update": {"sessionUpdate": kind, **more}}
    rows = [{"type": "openclaw_session", "sessionId": "claw", "cwd": "/c"}, up("user_message_chunk", text="hi"), up("usage_update", used=50, size=1000), up("agent_message_chunk", content="abcdef"), up("user_message_chunk", text="on"), up("usage_update", used=70, size=0), up("user_message_chunk", text="x")]
    lines = lines_of(spark, rows)
    events = openclaw.update_events(lines)
    turns = openclaw.openclaw_turns(events, "f")
    assert told(headers.openclaw_headers(lines, turns, openclaw.openclaw_steps(events, turns), "f")) == ["openclaw", "claw", "/c", "hi", 2, 2, 1, 70, 1, 1000]


def test_pi(spark):
    rows = [{"type": "session", "id": "pi_stream", "version": 3, "timestamp": at(0), "cwd": "/repo"}, {"type": "turn_start", "timestamp": at(1), "prompt": "p"}, say("message_end", 2, "assistant", "nine char"), {"type": "turn_end", "timestamp": at(3)}]
    lines = lines_of(spark, rows)
    turns, steps = pi.event_turns(lines, "f")
    got = told(headers.pi_headers(lines, turns, steps, "f"))
    assert got[:6] == ["pi", "pi_stream", "/repo", "p", 1, 3] and got[6] == 0 and got[7] == 3 and got[8:] == [0, 200_000]
    bare = lines_of(spark, [{"type": "header", "version": 2, "workingDirectory": "/w"}, {"type": "message", "id": "1", "message": {"role": "user", "content": "q"}}])
    turns, steps = pi.session_turns(bare, "f")
    assert told(headers.pi_headers(bare, turns, steps, "f"))[:4] == ["pi", "2", "/w", "q"]


def test_claude(spark):
    head = lambda **more: {"uuid": "u", "timestamp": at(1), **more}
    rows = [head(type="user", cwd="", message={"content": "a"}), head(type="assistant", message={"content": []}), head(type="user", cwd="/second", message={"content": "b"}), head(type="assistant", message={"content": [], "model": "claude-opus-4"}), head(type="user", cwd="/third", message={"content": "c"})]
    lines = lines_of(spark, rows)
    assert [tuple(r) for r in headers.claude_meta(lines, S.claude_turns(lines)).collect()] == [("s", "claude-opus-4", "4", "/second")]
