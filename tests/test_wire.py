"""Capture logs against a plain walk over their messages."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from turnmill.sources import wire


def lines_of(spark, rows, session="s"):
    return [(session, i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows, 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "session string, line_no int, value string")


def sections(text):
    """Sizes by index searches, section by section."""
    g = text.find(wire.GLOBAL)
    p = text.find(wire.PROJECT, g + 20) if g >= 0 else -1
    m, s, d, c = (text.find(x) for x in (wire.SERVERS, wire.SKILLS, wire.DATE, wire.CLOSING))
    end = c if c >= 0 else len(text)

    def content(start, following):
        until = next((x for x in following if x > start), end)
        gap = text.find("\n\n", start)
        q = until - 1
        while q > 0 and text[q] == "\n":
            q -= 1
        begin, stop = gap + 2 if gap >= 0 else start, q + 1
        return (begin, stop) if stop > begin else None

    found = [content(g, (p, m, s, d)) if g >= 0 else None, content(p, (m, s, d)) if p > 0 else None, content(m, (s, d)) if m >= 0 else None, content(s, (d,)) if s >= 0 else None]
    sizes = [x[1] - x[0] if x else 0 for x in found]
    ranges, out, at = sorted(x for x in found if x), "", 0
    head = text[:end]
    for a, b in ranges:
        out += head[at : max(at, a)]
        at = max(at, b)
    return [len(text), *sizes, end - d if d >= 0 else 0, max(0, end - sum(sizes)), (out + head[at:]).strip() if ranges else head]


def test_sections(spark):
    rng = random.Random(6)
    parts = [wire.GLOBAL + "me/CLAUDE.md:\n\n", wire.PROJECT + " /repo/CLAUDE.md:\n\n", wire.SERVERS + "\n\n", wire.SKILLS + ":\n\n", wire.DATE + "\n", wire.CLOSING, "text\n", "more text\n\n", "\n\n\n", "<system-reminder>\n"]
    texts = ["", "plain", "<system-reminder>\nintro\n# claudeMd\n" + parts[0] + "global rules\n\n" + parts[1] + "project rules\n\n" + parts[2] + "servers\n\n" + parts[3] + "- skill\n\n" + parts[4] + "today\n" + parts[5] + "tail"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = df.select("i", *[c.alias(n) for n, c in wire.message_sections(F.col("text")).items()]).orderBy("i").collect()
    assert [list(r)[1:] for r in got] == [sections(t) for t in texts]


def test_claude_capture(spark):
    body = {"model": "m", "system": [{"text": "x cc_version"}, {"text": "You are a Claude agent."}, {"text": "rest"}, {}], "tools": [{"b": 1, "a": "ü"}], "messages": [{"role": "user", "content": [{"type": "text", "text": "hello"}]}]}
    rows = ["{broken", {"request": {"method": "GET", "body": body}}, {"request": {"method": "POST", "body": {"input": []}}}, {"request": {"method": "POST", "body": body, "headers": {"user-agent": "claude-cli/1.2.3 (x)"}}, "response": {"body": 'data: {"usage":{"input_tokens":77}}'}}, {"request": {"method": "POST", "body": {"messages": []}}}]
    other = [{"request": {"method": "POST", "body": {"messages": []}}}]
    got = {r["session"]: r for r in wire.claude_captures(frame(spark, lines_of(spark, rows) + lines_of(spark, other, "t"))).collect()}
    s = got["s"]
    assert (s["model"], s["version"], s["sys_prompt"], s["billing"], s["identity"], s["harness"], s["tools"], s["input"], s["section_total"], s["section_wrapper"]) == ("m", "1.2.3", 12 + 23 + 4, 12, 23, 4, len('[{"a":"ü","b":1}]'), 77, 5, 5)
    assert (got["t"]["model"], got["t"]["tools"], got["t"]["input"], got["t"]["section_total"]) == ("unknown", 2, 0, 0)


def test_codex_capture(spark):
    developer = lambda *texts: {"role": "developer", "content": [{"type": "input_text", "text": t} for t in texts]}
    sse = "event: x\r\ndata: {\"response\":{\"usage\":{\"input_tokens\":1}}}\n\ndata: not json\ndata: [DONE]\ndata: {\"usage\":{\"input_tokens\":90,\"input_tokens_details\":{\"cached_tokens\":30},\"output_tokens\":7,\"reasoning_output_tokens\":2}}\ndata: {\"type\":\"other\"}\n: data: {\"usage\":{\"input_tokens\":5}}"
    old = {"instructions": "be good", "tools": [{"name": "shell"}, {"function": {"name": "apply"}}, {"type": "x"}], "model": "gpt", "input": [developer("a <skills_instructions> b", "plain"), developer("<plugins_instructions>", "also"), {"role": "user", "content": "no"}]}
    new = {"input": [{"type": "additional_tools", "tools": [{"name": "t2"}]}, {"role": "developer", "content": "one"}, developer("two", "")], "tools": [{"name": "ignored"}]}
    post = lambda body, url="https://x/responses", **more: {"request": {"method": "POST", "url": url, "body": body, "headers": {"user-agent": "codex-cli/0.9 z"}}, **more}
    rows = lines_of(spark, [post(old, "https://x/other"), post({"input": []}), post(old, response={"body": sse}), post(new)]) + lines_of(spark, [post(new)], "t") + lines_of(spark, [post({"tools": []})], "u")
    got = {r["session"]: r for r in wire.codex_captures(frame(spark, rows)).collect()}
    s, t = got["s"], got["t"]
    assert set(got) == {"s", "t"}
    assert (s["wire_api"], s["model"], s["version"], s["sys_prompt"], s["runtime"], s["skills"], s["plugins"], s["tool_names"]) == ("responses", "gpt", "0.9", 7, len("plain\n\nalso"), len("a <skills_instructions> b"), len("<plugins_instructions>"), "apply,shell")
    assert (s["input"], s["cached"], s["output"], s["reasoning"]) == (90, 30, 7, 2)
    assert (t["wire_api"], t["model"], t["sys_prompt"], t["tool_names"], t["tools"], t["input"], t["runtime"]) == ("chat_completions", "unknown", len("one\n\ntwo"), "t2", len('[{"name":"t2"}]'), None, 0)
