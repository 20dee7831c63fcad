"""What keeps a task's share from growing with the input: lines parsed once, parts that grow in number."""

from __future__ import annotations

import json

from turnmill.operators import lineage, openclaw


def log(spark, *lines):
    return spark.createDataFrame([("s", i, json.dumps(x)) for i, x in enumerate(lines, 1)], "session string, line_no int, value string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_parts_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(lineage, "TASK_ROWS", 100)
    parts = [lineage.dealt(spark.range(n), "id").rdd.getNumPartitions() for n in (0, 100, 1001)]
    assert parts == [1, 1, 11]


def test_openclaw_lines_are_parsed_once(spark):
    lines = log(spark, {"update": {"sessionUpdate": "user_message_chunk", "text": "go"}}, {"update": {"sessionUpdate": "agent_message_chunk", "text": "a"}}, {"update": {"sessionUpdate": "agent_message_chunk", "text": "b"}})
    events = openclaw.update_events(lines)
    steps = openclaw.openclaw_steps(events, openclaw.openclaw_turns(events))
    assert "parse_json" not in plan(steps) and "parsejson" not in plan(steps)
    assert [(r["step_i"], r["text"]) for r in steps.collect()] == [(0, "ab")]


def test_a_line_is_parsed_once_under_filters(spark):
    """A filter on the parsed line, that names it several times, stays above the parsing."""
    from turnmill.sources.transcripts import codex_lines

    good = codex_lines(log(spark, {"type": "a"}, {"x": 1}, ["type"])).where("error is null")
    assert plan(good).count("parsejson") + plan(good).count("parse_json") == 1
    assert [r["seq"] for r in good.collect()] == [0]


def test_turns_and_steps_share_parsed_lines(spark):
    """Of opencode, codex and pi: plans of steps hold no parsing of their own."""
    from turnmill.operators import codex, opencode, pi

    lines = log(spark, {"type": "step_start"}, {"type": "text", "part": {"text": "a"}})
    events = opencode.step_events(lines)
    parses = lambda df: plan(df).count("parsejson") + plan(df).count("parse_json(value")
    assert parses(opencode.opencode_steps(events, opencode.opencode_turns(events))) == 0
    assert parses(pi.event_turns(log(spark, {"type": "turn_start"}))[1]) == 0
    lines = log(spark, {"type": "event_msg", "payload": {"type": "task_started", "turn_id": "t"}})
    events = codex.turn_events(lines)
    assert parses(codex.codex_steps(events, codex.codex_turns(lines, events))) <= 1


def test_claude_meta_parses_a_line_once(spark):
    """One aggregate over the turns finds model and folder; a list of unlike blocks still tells that it is written."""
    from turnmill.operators import headers
    from turnmill.sources.transcripts import claude_turns

    head = lambda **more: {"uuid": "u", "timestamp": "2024-01-01T00:00:00Z", **more}
    lines = log(spark, head(type="user", cwd="/a", message={"content": [{"type": "text", "text": "go"}, "plain"]}), head(type="assistant", message={"content": [], "model": "x-7"}), head(type="user", cwd="/b", message={"content": "on"}))
    meta = headers.claude_meta(lines, claude_turns(lines))
    assert plan(meta).count("parsejson") + plan(meta).count("parse_json(value") == 1
    assert [tuple(r) for r in meta.collect()] == [("s", "x-7", "7", "/a")]


def test_diffs_run_in_parts_that_grow_with_the_lines(spark, monkeypatch):
    from turnmill.operators import diff

    monkeypatch.setattr(lineage, "TASK_ROWS", 10)
    texts = spark.createDataFrame([(i, "diff --git a/x b/x\n-a\n+b") for i in range(40)] + [(40, "-a\n+b diff --git "), (None, "diff --git ")], "id int, text string")
    lines = diff.diff_lines(texts)
    assert "join" not in plan(lines)
    rows = diff.side_by_side(lines)
    assert rows.rdd.getNumPartitions() == 12
    assert [(r["row"], r["type"]) for r in rows.where("id = 3").orderBy("row").collect()] == [(0, "meta"), (1, "change")] and rows.select("id").distinct().count() == 40


def test_short_sessions_are_walked_and_long_ones_jumped(spark, monkeypatch):
    """Both ways agree: cycles, repeated ids, unknown and empty parents, sessions without a root; and a walk takes no joins."""
    import random

    from turnmill.sources import transcripts

    draw = random.Random(9)
    rows = []
    for session, n in ((2**53, 5), (2**53 + 1, 90), (3, 40), (4, 2), (5, 70)):
        ids = [f"i{draw.randrange(n)}" for _ in range(n)]
        parents = [draw.choice([None, "", "gone", *ids, *ids[:i], *ids[:i]]) if session != 4 else ids[0] for i in range(n)]
        rows += [(session, i, json.dumps({"type": "message", "id": own, "parentId": up})) for i, (own, up) in enumerate(zip(ids, parents, strict=True), 1)]
    lines = spark.createDataFrame([*rows, (None, 1, json.dumps({"type": "message", "id": "a"}))], "session long, line_no int, value string")
    told = lambda: sorted(map(tuple, transcripts.longest_branch(lines).collect()))
    assert "join" not in plan(transcripts.longest_branch(lines))
    walked = told()
    monkeypatch.setattr(transcripts, "WALKED", 50)
    mixed = told()
    monkeypatch.setattr(transcripts, "WALKED", 0)
    assert walked == mixed == told() and {r[0] for r in walked} >= {2**53, 2**53 + 1}


def test_turns_alone_settle_no_events(spark, monkeypatch):
    from turnmill.operators import opencode
    from turnmill.plans import raw_more

    lines = log(spark, {"type": "step_start", "part": {"prompt": "go"}}, {"type": "step_finish", "part": {"tokens": {"input": 3, "output": 2}}}, {"type": "step_start"})
    want = opencode.opencode_turns(opencode.step_events(lines)).orderBy("turn_i").collect()
    monkeypatch.setattr(opencode, "settled", lambda df: 1 / 0)
    monkeypatch.setattr(raw_more, "opencode_log", lambda events: events)
    turns = raw_more.opencode_turns(lambda table: lines)
    assert turns.orderBy("turn_i").collect() == want and [r["max_input"] for r in want] == [3, 0]
    assert plan(turns).count("parsejson") + plan(turns).count("parse_json(value") == 1


def test_only_a_sessions_first_capture_is_opened(spark):
    from turnmill.sources import wire

    sent = lambda **body: {"request": {"method": "POST", "url": "/responses", "body": body}}
    lines = log(spark, sent(input=[]), sent(input={"a": 1}), sent(input=[None]), sent(instructions="do", input=[]))
    for found in (wire.codex_captures(lines), wire.claude_captures(lines)):
        above, below = plan(found).split("aggregate [", 1)
        assert "length(" in above
        assert "length(" not in below and "sha2" not in below
    assert [(r["wire_api"], r["sys_prompt"]) for r in wire.codex_captures(lines).collect()] == [("chat_completions", 0)]


def test_composition_reads_lines_once(spark, monkeypatch):
    """Totals and parts come from one read, settled as one row a turn and one a part that fills."""
    from turnmill.operators import composition
    from turnmill.sources.transcripts import claude_turns

    head = lambda **more: {"uuid": "u", "timestamp": "2024-01-01T00:00:00Z", **more}
    listed = lambda *texts: head(type="attachment", attachment={"type": "task_reminder", "content": list(texts)})
    said = head(type="assistant", message={"content": [{"type": "text", "text": "yes"}, {"type": "text", "text": "no"}], "usage": {"input_tokens": 5, "output_tokens": 1}})
    turns = claude_turns(log(spark, head(type="user", message={"content": "go"}), said, listed("ab", "c"), head(type="user", message={"content": ""})))
    kept = []
    monkeypatch.setattr(composition, "settled", lambda df: kept.append(lineage.settled(df)) or kept[-1])
    found = composition.claude_composition(turns)
    assert len(kept) == 1 and kept[0].count() == 3 and "parse_json" not in plan(found) and "parsejson" not in plan(found)
    assert [(r["turn_i"], r["asstText"]) for r in found.collect()] == [(0, 2)]
