"""Composition of a session's context, against a plain fold and on lines as they are written."""

from __future__ import annotations

import json
import math
import random

import pytest

from turnmill.functions.text import units
from turnmill.operators import composition as C
from turnmill.sources import transcripts as S


def length(text):
    return units(text).cast("double")


def folded(turns, parts, seeds):
    """One pass over a session's turns with the state in variables."""
    have = {c: (n, float(n)) for c, n in seeds.items()} | {c: (0, 0.0) for c in C.ADDED}
    last, out = 0, []
    for turn_i, total in turns:
        if total > 0:
            if last > 0 and total < last * 0.5:
                kept = {c: have[c] for c in (*C.REPLACED, *C.FILLED) if have[c][1] > 0}
                have = {c: (n, float(n)) for c, n in seeds.items()} | {c: (0, 0.0) for c in C.ADDED} | kept
            last = total
        for category, how, text in parts.get(turn_i, []):
            size, tok = have[category]
            if how == "replace" or how in ("refill", "once") and size == seeds[category]:
                size, tok = 0, 0.0
            elif how == "once":
                continue
            have[category] = (size + len(text), tok + len(text))
        out.append((turn_i, {c: math.floor(have[c][1] + 0.5) for c in C.CATEGORIES}))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_a_fold(spark, seed):
    rng = random.Random(seed)
    seeds = {"sysPrompt": 50, "tool_defs": 60, "skills": 4, "memory": 6, "mcp": 5, "reminders": 6, "userWrapper": 3}
    turns, parts, want = [], [], {}
    for session in ("a", "b"):
        own, held = [], {}
        for t in range(40):
            own.append((t, rng.choice([0, 0, 100, 300, 120, 40])))
            for line in range(rng.randint(0, 4)):
                category = rng.choice([*C.ADDED, "skills", "mcp", "memory", "reminders", "reminders"])
                how = {"skills": "replace", "mcp": "replace", "memory": "once", "reminders": "refill"}.get(category, "add")
                text = "x" * rng.randint(0 if category == "skills" else 1, 3)
                held.setdefault(t, []).append((category, how, text))
                parts.append((session, t, line, 0, category, how, len(text), float(len(text))))
        turns += [(session, *x, "clash") for x in own]
        want |= {(session, t): c for t, c in folded(own, held, seeds)}
    rng.shuffle(parts)
    df = C.compositions(spark.createDataFrame([(a, b, float(c), d) for a, b, c, d in turns], "session string, turn_i long, total double, note string"), spark.createDataFrame(parts, "session string, turn_i long, line_no int, pos int, category string, how string, raw long, tok double"), seeds, length)
    got = {(r["session"], r["turn_i"]): {c: r[c] for c in C.CATEGORIES} for r in df.collect()}
    assert got == want


def lines_of(spark, rows):
    return spark.createDataFrame([("s", i, json.dumps({"uuid": f"u{i}", "timestamp": "2024-01-01T00:00:00Z", **r})) for i, r in enumerate(rows, 1)], "session string, line_no int, value string")


def composed(spark, rows, seeds=C.SEEDS):
    df = C.claude_composition(S.claude_turns(lines_of(spark, rows)), seeds, length)
    return [{c: r[c] for c in C.CATEGORIES} for r in df.orderBy("turn_i").collect()]


HI = {"type": "user", "message": {"content": "hi"}}


@pytest.mark.parametrize(
    ("constants", "own"),
    [
        ({"categories": {"sysPrompt": {"chars": 111}, "tool_defs": {"chars": 222}, "userMsgs": {"chars": 333}}}, {"sysPrompt": 111, "tool_defs": 222, "userWrapper": 333}),
        ({"SYS_PROMPT_FALLBACK_CHARS": 10, "TOOL_DEFS_FALLBACK_CHARS": 20, "SYSTEM_REMINDER_CHROME_CHARS": 30}, {"sysPrompt": 10, "tool_defs": 20, "userWrapper": 30}),
        ({"categories": {"memoryGlobal": {"chars": 40}, "memoryProject": {"chars": 50}, "memory": {"chars": 7}}}, {"memory": 90}),
        ({"categories": {"memory": {"chars": 7}, "sysPrompt": None}}, {"memory": 7}),
        (None, {}),
    ],
)
def test_seeds_of_a_project(constants, own):
    assert C.calibrated(constants) == C.SEEDS | own


def test_one_prompt(spark):
    assert composed(spark, [HI]) == [C.SEEDS | dict.fromkeys(C.ADDED, 0) | {"userMsgs": 2}]


def test_lines(spark):
    block = lambda **b: b
    rows = [
        {"type": "attachment", "attachment": {"type": "skill_listing", "content": "before any turn"}},
        {"type": "user", "promptId": "p", "message": {"content": [block(type="text", text="ask"), block(type="image")]}},
        {"type": "user", "promptId": "p", "isMeta": True, "message": {"content": "go on"}},
        {"type": "assistant", "message": {"content": [block(type="thinking", thinking="hmm"), block(type="text", text="😀"), block(type="tool_use", id="1", name="Agent", input={"a": 1}), block(type="tool_use", id="2", name="Read", input=3)], "usage": {"input_tokens": 100, "output_tokens": 1, "cache_read_input_tokens": 900}}},
        {"type": "user", "message": {"content": [block(type="tool_result", tool_use_id="1", content="found"), block(type="tool_result", tool_use_id="2", content=[block(type="text", text="row"), block(type="tool_result", content="in")]), block(type="tool_result", tool_use_id="9", content="?")]}},
        {"type": "attachment", "attachment": {"type": "skill_listing", "content": "skills!"}},
        {"type": "attachment", "attachment": {"type": "task_reminder", "content": [{"title": "t"}, "plain", "  ", {"description": "d"}]}},
        {"type": "attachment", "attachment": {"type": "mcp_instructions_delta", "addedBlocks": ["a", "bc"]}},
        {"type": "attachment", "attachment": {"type": "other", "content": "x"}},
        {"type": "user", "message": {"content": "again"}},
        {"type": "assistant", "message": {"content": [], "usage": {"input_tokens": 10, "output_tokens": 1}}},
        {"type": "attachment", "attachment": {"type": "ultra_effort_enter"}},
    ]
    first, second = composed(spark, rows)
    kept = {"skills": 7, "mcp": 4}
    assert first == C.SEEDS | kept | {"reminders": 2 + 5 + 2, "toolResults": 3 + 23 + 2 + 1, "subagent": 5, "thinking": 3, "asstText": 2, "toolCalls": len('Agent{"a":1}') + len("Read{}"), "userMsgs": 3 + 23 + 5}
    assert second == C.SEEDS | kept | dict.fromkeys(C.ADDED, 0) | {"reminders": 9 + len(C.EFFORT), "userMsgs": 5}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "session string, line_no int, value string")
    assert C.claude_composition(S.claude_turns(empty)).collect() == []
