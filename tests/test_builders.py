"""Turns and steps of raw logs of several formats."""

from __future__ import annotations

import json

from turnmill.operators import codex, openclaw, opencode, pi, steps


def lines_of(spark, rows, session="s"):
    return spark.createDataFrame([(session, i, json.dumps(r)) for i, r in enumerate(rows, 1)], "session string, line_no int, value string")


def collected(pair):
    turns, made = pair
    return turns.orderBy("turn_i").collect(), made.orderBy("turn_i", "step_i").collect()


def test_pi_session_takes_the_longest_branch(spark):
    message = lambda id_, parent, role, text, ts, **more: {"type": "message", "id": id_, "parentId": parent, "message": {"role": role, "content": [{"type": "text", "text": text}], "timestamp": ts, **more}}
    rows = [
        {"type": "header", "version": 3, "workingDirectory": "/repo/pi"}, message("u1", None, "user", "Pi main prompt", 1709136000000), message("a1", "u1", "assistant", "Main answer", 1709136001000),
        message("branch_a", "u1", "assistant", "Discarded branch answer", 1709136001500), message("tool1", "a1", "toolResult", "tool ok", 1709136002000, toolName="bash", toolCallId="tool_1"),
        {"type": "compaction", "id": "cmp1", "parentId": "tool1", "summary": "Compressed context summary"},
    ]
    turns, made = collected(pi.session_turns(lines_of(spark, rows), "f"))
    assert [(t.prompt, t.start_ms, t.compaction) for t in turns] == [("Pi main prompt", 1709136000000, True)]
    assert [(s.kind, s.name, s.text, s.result, s.ms) for s in made] == [("m", pi.MODEL_STEP, "Main answer", "", 1000), ("t", "bash", "", "tool ok", 0), ("i", pi.COMPACTION_STEP, "Compressed context summary", "", 2000)]


def test_pi_lines_without_ids(spark):
    rows = [{"type": "header", "version": 1}, {"type": "message", "message": {"role": "assistant", "content": "first"}}, {"type": "message", "message": {"role": "user", "content": "ask"}}, {"type": "message", "message": {"role": "system", "content": "x"}}]
    turns, made = collected(pi.session_turns(lines_of(spark, rows), "f"))
    assert [t.prompt for t in turns] == ["Pi session: f", "ask"]
    assert [(s.turn_i, s.text) for s in made] == [(0, "first")]


def at(second):
    return f"2026-07-06T00:00:0{second}Z"


def say(kind, second, role, text):
    return {"type": kind, "timestamp": at(second), "message": {"role": role, "content": [{"type": "text", "text": text}] if text else []}}


def test_pi_stream(spark):
    rows = [
        {"type": "session", "id": "pi_stream", "version": 3, "timestamp": at(0), "cwd": "/repo/pi"}, {"type": "turn_start", "timestamp": at(1)}, say("message_end", 2, "assistant", "Stream answer"),
        {"type": "tool_execution_start", "timestamp": at(3), "toolCallId": "tool_1", "toolName": "bash", "args": {"command": "pwd"}},
        {"type": "tool_execution_end", "timestamp": at(4), "toolCallId": "tool_1", "result": {"content": [{"type": "text", "text": "/repo/pi"}]}, "isError": False}, {"type": "turn_end", "timestamp": at(5)},
    ]
    turns, made = collected(pi.event_turns(lines_of(spark, rows), "f"))
    assert [t.prompt for t in turns] == ["Pi stream: f"]
    assert [(s.kind, s.name, s.text or s.result, s.input, s.ms) for s in made] == [("m", pi.MODEL_STEP, "Stream answer", "", 2000), ("t", "bash", "/repo/pi", '{"command":"pwd"}', 1000)]


def test_pi_tentative_messages(spark):
    rows = [
        {"type": "turn_start", "timestamp": at(1)}, say("message_update", 2, "assistant", "partial"), say("message_end", 3, "assistant", "final answer"), say("message_update", 3, "assistant", "kept by an empty end"),
        say("message_end", 4, "assistant", ""), say("message_end", 4, "assistant", ""), say("message_update", 4, "user", "the prompt"), say("message_update", 4, "user", "too late"), say("message_update", 5, "assistant", "left open"), {"type": "auto_compaction_start", "timestamp": at(6)},
        {"type": "turn_start", "timestamp": at(7), "prompt": "asked"}, say("message_update", 8, "assistant", "cut off"), {"type": "turn_end", "timestamp": at(8)}, {"type": "turn_end", "timestamp": at(8)},
        say("message_update", 9, "assistant", "opens by itself"), say("message_update", 9, "assistant", ""),
    ]
    turns, made = collected(pi.event_turns(lines_of(spark, rows), "f"))
    assert [(t.prompt, t.compaction) for t in turns] == [("the prompt", True), ("asked", False), ("Pi stream: f", False)]
    assert [(s.turn_i, s.kind, s.text) for s in made] == [(0, "m", "final answer"), (0, "m", "kept by an empty end"), (0, "i", pi.COMPACTED), (0, "m", "left open"), (1, "m", "cut off"), (2, "m", "opens by itself")]


def event(second, kind, **payload):
    return {"timestamp": at(second), "type": "event_msg", "payload": {"type": kind, **payload}}


def item(second, kind, **payload):
    return {"timestamp": at(second), "type": "response_item", "payload": {"type": kind, **payload}}


def usage(second, **tokens):
    return event(second, "token_count", info={"last_token_usage": tokens, "model_context_window": 1000})


def codex_of(spark, rows):
    lines = lines_of(spark, rows)
    events = codex.turn_events(lines)
    turns = codex.codex_turns(lines, events)
    return collected((turns, codex.codex_steps(events, turns))), turns


def test_codex_turns(spark):
    rows = [
        {"timestamp": at(0), "type": "turn_context", "payload": {"model": "gpt-a", "model_context_window": 50}}, event(0, "agent_message", message="before any turn"),
        event(1, "task_started", turn_id="t1"), item(1, "message", role="user", content=[{"type": "input_text", "text": "<environment_context> x"}]), event(1, "user_message", message=""), item(1, "message", role="user", content=[{"type": "input_text", "text": " ask "}]),
        event(2, "agent_message", message="hello"), item(2, "message", role="assistant", content=[{"type": "output_text", "text": "hello "}]), item(3, "reasoning", summary=[{"text": "why"}]), usage(3, input_tokens=100, cached_input_tokens=5, output_tokens=7, reasoning_output_tokens=3),
        {"timestamp": at(4), "type": "compacted", "payload": {}}, event(4, "context_compacted"), event(4, "context_compacted"), event(5, "task_complete", duration_ms=4000), event(5, "agent_message", message="between turns"),
        event(6, "task_started"), event(7, "task_started"), usage(8, input_tokens=20, output_tokens=60), event(9, "turn_aborted"),
    ]
    (turns, made), _ = codex_of(spark, rows)
    assert [(t.turn_id, t.prompt, t.model, t.window, t.duration_ms, t.aborted, t.compacted, t.requests, t.out_tok, t.last_input) for t in turns] == [
        ("t1", "ask", "gpt-a", 1000, 4000, False, True, 1, 7, 0), ("turn_2", codex.NO_PROMPT, "gpt-a", 1000, None, False, False, 0, 0, 0), ("turn_3", codex.NO_PROMPT, "gpt-a", 1000, None, True, False, 1, 60, 20),
    ]
    assert [(s.turn_i, s.kind, s.text, s.think_tok, s.in_tok) for s in made] == [
        (0, "m", "hello", 0, 100), (0, "m", "why", 3, 100), (0, "i", codex.COMPACTED, 0, 100), (0, "i", codex.COMPACTED, 0, 100), (1, "m", codex.NOTHING, 0, 0), (2, "m", codex.ONLY_COUNTS, 0, 20),
    ]
    assert [s.ms for s in made] == [1000, 1000, 0, 1000, 0, 1000]


def test_codex_calls_and_late_results(spark):
    rows = [
        event(1, "task_started"), item(1, "function_call", name="shell", call_id="a", arguments='{"x":1}'), item(2, "custom_tool_call", name="patch", call_id="b", input="p"), event(3, "patch_apply_end", call_id="b", stdout="done", stderr="", success=True),
        item(4, "custom_tool_call_output", call_id="b", output="over"), event(5, "patch_apply_end", call_id="b", stdout="later", success=False), item(6, "web_search_call", call_id="w", action={"query": "q"}), item(7, "function_call", name="Agent", call_id="g", arguments="{}"),
        event(8, "mcp_tool_call_end", call_id="g", result={"Err": "bad"}, duration={"secs": 1, "nanos": 500_000_000}), item(9, "function_call_output", call_id="a", output=[{"text": "row"}, "two"]), event(9, "patch_apply_end", call_id="zzz", stdout="x"),
    ]
    (_, made), turns = codex_of(spark, rows)
    tools = [(s.kind, s.name, s.input, s.result, s.is_error, s.ms) for s in made if s.kind != "m"]
    assert tools == [("t", "shell", '{"x":1}', "row\ntwo", False, 0), ("t", "patch", "p", "over", False, 2000), ("t", "web_search", '{"query":"q"}', codex.NO_RESULT, True, 1000), ("s", "Agent", "{}", "bad", True, 1500)]
    assert [s.call_tok for s in made if s.kind == "m"] == [round(len('shell{"x":1}') / 3), 2, round(len('web_search{"query":"q"}') / 3), round(len("Agent{}") / 3)]
    assert steps.turn_facts(turns, codex.codex_steps(codex.turn_events(lines_of(spark, rows)), turns).drop("out_tok")).first()["sub_ms"] == 1500


def test_opencode(spark):
    line = lambda second, kind, part=None, **more: {"type": kind, "timestamp": at(second), "sessionID": "x", "part": part or {}, **more}
    rows = [
        line(1, "text", {"text": "before any step"}), line(2, "step_start", {"prompt": " ask "}), line(3, "text", {"content": "answer"}), line(3, "text", {"text": ""}),
        line(4, "tool_use", {"tool": "bash", "state": {"input": {"c": 1}, "output": "ok", "status": "completed", "time": {"start": 1000, "end": 1250}}}), line(5, "tool_use", {"tool": "task", "state": {"input": {}, "output": "sub", "status": "error"}}),
        line(6, "step_finish", {"tokens": {"input": 50, "output": 5, "cache": {"read": 7}}}), line(7, "step_finish", {"tokens": {"input": 20, "output": 1}}), line(7, "error", error={"data": {"message": "broke"}}), line(8, "step_start"), line(9, "step_finish", {}),
    ]
    events = opencode.step_events(lines_of(spark, rows))
    turns = opencode.opencode_turns(events, "f")
    got, made = collected((turns, opencode.opencode_steps(events, turns)))
    assert [(t.prompt, t.requests, t.out_tok, t.max_input, t.last_input) for t in got] == [("OpenCode stream: f", 0, 0, 0, 0), ("ask", 2, 6, 50, 20), ("OpenCode stream: f", 1, 0, 0, 0)]
    assert [(s.turn_i, s.kind, s.name if s.kind in "ts" else s.text, s.result, s.ms, s.in_tok) for s in made] == [
        (0, "m", "before any step", "", 0, 0), (1, "m", "answer", "", 1000, 50), (1, "m", "", "", 0, 50), (1, "t", "bash", "ok", 250, 50), (1, "m", "", "", 0, 50), (1, "s", "task", "sub", 2000, 50), (1, "i", "broke", "", 0, 20), (2, "m", opencode.NOTHING, "", 1000, 0),
    ]


def test_openclaw(spark):
    up = lambda second, kind, run="", **more: {"sessionId": "x", "runId": run, "timestamp": at(second), "update": {"sessionUpdate": kind, **more}}
    words = lambda t: {"type": "text", "text": t}
    rows = [
        {"type": "openclaw_session", "cwd": "/x"}, up(1, "user_message_chunk", "r1", content=words("hello")), up(1, "user_message_chunk", "", content=words("there")), up(2, "agent_thought_chunk", "r1", content=words("hm")), up(2, "agent_thought_chunk", "r1", content=words("m")),
        up(3, "agent_message_chunk", "r1", content=words("An")), up(3, "usage_update", "r1", used=500, size=1000), up(3, "agent_message_chunk", "r2", content=words("swer")), up(4, "tool_call", "r1", toolCallId="c", title="bash", rawInput={"x": 1}), up(4, "tool_call", "r1"),
        up(5, "tool_call_update", "r1", toolCallId="c", status="in_progress"), up(6, "tool_call_update", "r1", toolCallId="c", status="failed", content=[words("out")]), up(6, "tool_call_update", toolCallId="tool_3", status="completed", rawOutput={"a": 1}),
        up(7, "user_message_chunk", "r3", text="next"), up(7, "user_message_chunk", "r4", text="other run"), up(8, "user_message_chunk", "r4", text=""), up(8, "session_info_update", "r9"), up(9, "usage_update", "", used=0, size=10),
    ]
    events = openclaw.update_events(lines_of(spark, rows))
    turns = openclaw.openclaw_turns(events, "f")
    got, made = collected((turns, openclaw.openclaw_steps(events, turns)))
    assert [(t.prompt, t.requests, t.max_input, t.last_input) for t in got] == [("hello\nthere", 3, 500, 500), ("next", 0, 0, 0), ("other run", 1, 0, 0)]
    assert [(s.kind, s.name if s.kind == "t" else s.text, s.input, s.result, s.is_error, s.think_tok) for s in made] == [
        ("m", "hmm", "", "", False, 1), ("m", "Answer", "", "", False, 0), ("m", "", '{"x":1}', "", False, 0), ("m", "", "{}", "", False, 0), ("t", "bash", '{"x":1}', "out", True, 0), ("t", "tool_3", "{}", '{"a":1}', False, 0),
    ]
    only = [up(1, "session_info_update", "r0"), up(2, "user_message_chunk", "r0", text="a"), up(3, "user_message_chunk", "r1", text="b"), up(4, "agent_message_chunk", "r1", content="x"), up(5, "user_message_chunk", "r1", text="c")]
    turns = openclaw.openclaw_turns(openclaw.update_events(lines_of(spark, only)), "f")
    assert [t.prompt for t in turns.orderBy("turn_i").collect()] == ["a", "b", "c"]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "session string, line_no int, value string")
    events = codex.turn_events(empty)
    turns = codex.codex_turns(empty, events)
    steps_ = opencode.step_events(empty)
    claws = openclaw.update_events(empty)
    others = (opencode.opencode_turns(steps_), opencode.opencode_steps(steps_, opencode.opencode_turns(steps_)), openclaw.openclaw_turns(claws), openclaw.openclaw_steps(claws, openclaw.openclaw_turns(claws)))
    for df in (*pi.event_turns(empty), *pi.session_turns(empty), turns, codex.codex_steps(events, turns), *others):
        assert df.collect() == []
