"""Diffs against a queue that is walked line by line, and edits against what they must give back."""

from __future__ import annotations

import random
import re

from turnmill.operators import diff as D


def walked(text):
    lines = [x for x in text.replace("\r\n", "\n").split("\n") if not x.startswith("```")]
    rows, waiting, old, new = [], [], 0, 0
    blank = (None, "", "", "blank")

    def flush():
        rows.extend(("change", None, x, blank) for x in waiting)
        waiting.clear()

    for line in lines:
        hunk = re.match(D.HUNK, line)
        if hunk or line.startswith(D.META):
            flush()
            if hunk:
                old, new = int(hunk[1]), int(hunk[2])
            rows.append(("hunk" if hunk else "meta", line, None, None))
        elif line.startswith("-"):
            waiting.append((old, "-", line[1:], "delete"))
            old += 1
        elif line.startswith("+"):
            rows.append(("change", None, waiting.pop(0) if waiting else blank, (new, "+", line[1:], "add")))
            new += 1
        else:
            flush()
            text = line[1:] if line.startswith(" ") else line
            rows.append(("change", None, (old or None, "", text, "context"), (new or None, "", text, "context")))
            old, new = old + bool(old), new + bool(new)
    flush()
    return rows


def test_side_by_side(spark):
    rng = random.Random(1)
    texts = ["diff --git a/x b/x\nindex 1..2\n--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n one\n-two\n-three\n+zwei\n+drei\n+vier\n five\n```\n-last", "no diff\n-a\n+b", "-a\n+b\n+c\n d\ndiff --git a/y b/y\r\n@@ -0,0 +1 @@\n d\n+x\n-y", ""]
    for _ in range(60):
        body = [rng.choice(["-", "-", "+", "+", " ", "", "@@ -3 +9 @@ f", "@@ -0,0 +0,0 @@", "--- a/b", "\\ No newline"]) + rng.choice("abc") for _ in range(rng.randint(0, 40))]
        body.insert(rng.randint(0, len(body)), "diff --git a/q b/q")
        texts.append("\n".join(body))
    lines = D.diff_lines(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))
    got = {}
    for r in D.side_by_side(lines).orderBy("id", "row").collect():
        got.setdefault(r["id"], []).append((r["type"], r["text"], r["left"] and tuple(r["left"]), r["right"] and tuple(r["right"])))
    assert got == {i: walked(t) for i, t in enumerate(texts) if "diff --git " in t}
    paths = {r["id"]: tuple(r)[1:] for r in D.diff_paths(lines).collect()}
    assert paths[0] == ("diff --git a/x b/x", "x", "x") and paths[2] == ("diff --git a/y b/y", "old", "new")


def test_edit_lines(spark):
    rng = random.Random(2)
    edits = [(0, None, None), (1, "", "a\nb"), (2, "a\nb\n", ""), (3, "a\nb\nc", "a\nx\nc"), (4, "same\n", "same"), (5, "x\na\nb\nc", "a\nb\nc\nx")]
    for i in range(6, 80):
        old = [rng.choice("abcdefghij") + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 30))]
        new = [x for x in old if rng.random() < 0.8]
        for _ in range(rng.randint(0, 4)):
            new.insert(rng.randint(0, len(new)), rng.choice("xyz"))
        edits.append((i, "\n".join(old), "\n".join(new)))
    got = {}
    for r in D.edit_lines(spark.createDataFrame(edits, "id int, old string, new string")).orderBy("id", "row").collect():
        got.setdefault(r["id"], []).append((r["mark"], r["num"], r["text"]))
    assert 0 not in got
    assert got[3] == [("", 1, "a"), ("-", 2, "b"), ("+", None, "x"), ("", 3, "c")]
    assert [m for m, _, _ in got[5]] == ["-", "", "", "", "+"] and [m for m, _, _ in got[4]] == [""]
    for i, old, new in edits[1:]:
        before, after = [x for x in (old or "").removesuffix("\n").split("\n") if old], [x for x in (new or "").removesuffix("\n").split("\n") if new]
        rows = got.get(i, [])
        assert [t for m, _, t in rows if m != "+"] == before and [t for m, _, t in rows if m != "-"] == after
        assert [n for m, n, _ in rows if m == "-"] == [n for n, m in enumerate((m for m, _, _ in rows if m != "+"), 1) if m == "-"]
        assert [n for m, n, _ in rows if m == ""] == [n for n, m in enumerate((m for m, _, _ in rows if m != "-"), 1) if m == ""]
