"""Functions and operators that the driver tables don't exercise."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from turnmill.functions import json_text, redact
from turnmill.functions import text as X
from turnmill.operators import graph, layout, segments
from turnmill.sources import tables, transcripts

from test_transcripts import assistant, lines_of, user


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, X.units(F.lit("a😀b"))) == 4
    modes = [one(spark, X.mode(F.lit(t))) for t in ("", "plain words here", "中文为主的一段文字", "if (a) { b[0] = c(d); }", "mixed words 中文混合 and more")]
    assert modes == ["mixed", "en", "zh", "code", "mixed"]
    assert one(spark, X.knowledge_score(F.lit("结论：需要先验证输入再修复这个问题，不要跳过检查步骤。"))) == 3 * 7 + 6 + 1

    def fnv(text):
        h = 2_166_136_261
        raw = text.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i : i + 2], "big")) * 16_777_619) % 2**32
        return h % 100_000 + 930_000_000

    for text in ("", "abc", "a😀é"):
        assert one(spark, X.fnv_slot(F.lit(text))) == fnv(text)


def test_headers(spark):
    got = one(spark, redact.headers(F.create_map(F.lit("Authorization"), F.lit("secret"), F.lit("accept"), F.lit("x"))))
    assert got == {"Authorization": "[REDACTED]", "accept": "x"}


def test_json_in_prose(spark):
    for text in ('{"a": 1}', 'see\n```json\n{"a": 1}\n```\nend', 'see\n```\n{"a": 1}\n```', 'so {"a": 1} it is'):
        assert one(spark, F.to_json(json_text.json_in(F.lit(text)))) == '{"a":1}'
    assert one(spark, json_text.json_in(F.lit("nothing")).isNull())


def test_steps(spark):
    rows = [
        user("go"),
        assistant([{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}, {"type": "tool_use", "id": "1", "name": "Read", "input": {}}, {"type": "tool_use", "id": "2", "name": "Agent", "input": {}}], {"input_tokens": 1, "output_tokens": 9}),
        user([{"type": "tool_result", "tool_use_id": "1", "content": "123456789"}]),
        assistant([]),
    ]
    got = segments.steps(transcripts.claude_turns(lines_of(spark, "s", rows))).orderBy("step_i").collect()
    assert [(r["kind"], r["name"], r["tokens"]) for r in got] == [("m", "thinking", 9), ("m", "text", 9), ("m", "calls", 9), ("t", "Read", 3), ("s", "Agent", 0), ("m", "diagnostic", 0)]


def test_treemap(spark):
    rows = spark.createDataFrame([(1, c, t) for c, t in (("a", 60), ("b", 25), ("c", 10), ("d", 5), ("e", 0))] + [(2, "a", 7)], "session long, category string, tokens long")
    got = [r.asDict() for r in layout.treemap(rows).collect()]
    first = [r for r in got if r["session"] == 1]
    assert abs(sum(r["w"] * r["h"] for r in first) - 10_000) < 1e-6 and all(abs(r["w"] * r["h"] - 100 * r["tokens"]) < 1e-6 for r in first)
    for a, b in itertools.combinations(first, 2):
        assert min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"]) < 1e-6 or min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]) < 1e-6


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "turns")
    rows = lambda *r: spark.createDataFrame(r, "session string, turn_i long, n long")
    tables.append_sessions(rows(("a", 0, 1), ("b", 0, 1)), path)
    tables.refresh_sessions(rows(("a", 0, 5), ("a", 1, 6)), path)
    assert sorted((r["session"], r["turn_i"], r["n"]) for r in spark.read.parquet(path).collect()) == [("a", 0, 5), ("a", 1, 6), ("b", 0, 1)]


def test_greedy_leaders(spark):
    labels = ["abcdef", "xyz", "abcdeg", "abcdhg", "zyx", "abcdef1"]
    rows = spark.createDataFrame([("s", i, x) for i, x in enumerate(labels)], "session string, seq long, label string")
    alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) > 0.7
    leaders, want = [], {}
    for i, x in enumerate(labels):
        want[i] = next((k for k in leaders if alike(labels[k], x)), i)
        leaders += [i] * (want[i] == i)
    assert {r["seq"]: r["leader"] for r in graph.greedy_leaders(rows).collect()} == want


def test_merged_themes(spark):
    rows = [("s", 1, "login flow", 0, 3), ("s", 2, "login flows", 4, 5), ("s", 3, "xyz", 6, 6), ("s", 4, "login flow", 7, 8)]
    got = graph.merged_themes(spark.createDataFrame(rows, "session string, run long, theme string, first_turn long, last_turn long")).orderBy("place").collect()
    assert [(r["theme"], r["first_turn"], r["last_turn"]) for r in got] == [("login flow", 0, 5), ("xyz", 6, 6), ("login flow", 7, 8)]
