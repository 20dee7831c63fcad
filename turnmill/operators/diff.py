"""Diffs as rows: unified diffs side by side, and the lines of an edit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.operators.lineage import dealt
from turnmill.operators.windows import before, islands, ordinal, up_to

# How lines of a unified diff begin.
FILE_LINE = "diff --git "
META = (FILE_LINE, "index ", "--- ", "+++ ")
HUNK = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
FENCE = "```"
CELL = "struct<line:bigint,marker:string,text:string,kind:string>"


def diff_lines(texts: DataFrame) -> DataFrame:
    """(id, text) -> id, pos, line of the texts that hold a file's line; lines that fence code go."""
    held = F.concat(F.lit("\n"), F.col("text")).contains("\n" + FILE_LINE)
    # A generator's row: a text that is made by an expression is made once.
    once = texts.where("id is not null").select("id", F.explode(F.array("text")).alias("text"))
    return once.where(held).select("id", F.posexplode(F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n")).alias("pos", "line")).where(~F.col("line").startswith(FENCE))


def diff_paths(lines: DataFrame) -> DataFrame:
    """id, title, old_path, new_path: from the first line of each kind."""
    first = lambda mark: F.min_by("line", F.when(F.col("line").startswith(mark), F.col("pos")))
    path = lambda mark, side, other: F.coalesce(F.regexp_replace(first(mark), rf"^{mark.strip().replace('+', chr(92) + '+')}\s+(?:{side}/)?", ""), F.lit(other))
    return lines.groupBy("id").agg(F.coalesce(first(FILE_LINE), F.lit("diff")).alias("title"), path("--- ", "a", "old").alias("old_path"), path("+++ ", "b", "new").alias("new_path"))


def side_by_side(lines: DataFrame) -> DataFrame:
    """Of diff_lines(): id, row (from 0), type (meta, hunk, change), text, left, right (CELL; null but for changes).

    Deleted lines wait, in their order, for the next added lines; whatever waits when anything else follows stands alone.  As a queue: of a
    run's adds, as many stay without a partner as adds have at most been ahead of deletions so far, and the others take deletions one by one.
    Counters begin anew with each hunk; one at 0 stays there until a deletion (or an addition) moves it.
    Texts are dealt into parts that grow in number with the lines: every window and the grouping run within a part.
    """
    lines = dealt(lines, "id")
    line, kind = F.col("line"), F.col("kind")
    hunk = line.rlike(HUNK)
    named = lines.withColumn("kind", F.when(hunk, "hunk").when(_begins(line, META), "meta").when(line.startswith("-"), "delete").when(line.startswith("+"), "add").otherwise("context"))
    start = lambda k: F.when(kind == "hunk", F.regexp_extract("line", HUNK, k).cast("long"))
    w = up_to(["id"], ["pos"])
    runs = islands(named, ["id"], ["pos"], ~kind.isin("delete", "add"), "run").withColumn("part", F.count_if(kind == "hunk").over(w))
    for k, (side, moves) in enumerate((("old", "delete"), ("new", "add")), 1):
        at = F.coalesce(F.last(start(k), ignorenulls=True).over(w), F.lit(0))
        runs = runs.withColumn(f"_{side}0", at)
        moved = F.coalesce(F.max((kind == moves).cast("int")).over(before(["id", "part"], ["pos"])), F.lit(0)) == 1
        step = (kind == moves) | (kind == "context") & ((F.col(f"_{side}0") > 0) | moved)
        runs = runs.withColumn("_step", step.cast("int"))
        runs = runs.withColumn(side, F.col(f"_{side}0") + F.coalesce(F.sum("_step").over(before(["id", "part"], ["pos"])), F.lit(0)))
    keys = ["id", "run"]
    queue = runs.withColumn("_a", F.count_if(kind == "add").over(up_to(keys, ["pos"]))).withColumn("_d", F.count_if(kind == "delete").over(up_to(keys, ["pos"])))
    ahead = F.when(kind == "add", F.col("_a") - F.col("_d"))
    queue = queue.withColumn("_u", F.greatest(F.lit(0), F.coalesce(F.max(ahead).over(up_to(keys, ["pos"])), F.lit(0)))).withColumn("_u0", F.greatest(F.lit(0), F.coalesce(F.max(ahead).over(before(keys, ["pos"])), F.lit(0))))
    alone = (kind == "add") & (F.col("_u") > F.col("_u0"))
    slot = F.when(kind == "delete", F.col("_d")).when((kind == "add") & ~alone, F.col("_a") - F.col("_u")).when(alone, -F.col("_a")).otherwise(0)
    cell = lambda n, mark, text, kind_: F.struct(n.alias("line"), F.lit(mark).alias("marker"), text.alias("text"), F.lit(kind_).alias("kind")).cast(CELL)
    rest, none = F.expr("substring(line, 2)"), F.lit(None).cast(CELL)
    blank = cell(F.lit(None).cast("long"), "", F.lit(""), "blank")
    plain = F.when(line.startswith(" "), rest).otherwise(line)
    left = F.when(kind == "delete", cell(F.col("old"), "-", rest, "delete")).when(kind == "context", cell(F.nullif("old", F.lit(0)), "", plain, "context")).otherwise(none)
    right = F.when(kind == "add", cell(F.col("new"), "+", rest, "add")).when(kind == "context", cell(F.nullif("new", F.lit(0)), "", plain, "context")).otherwise(none)
    halves = queue.select("id", "run", slot.alias("slot"), "pos", "kind", "line", left.alias("left"), right.alias("right"))
    is_change = ~F.col("kind").isin("meta", "hunk")
    rows = halves.groupBy("id", "run", "slot").agg(F.max_by("kind", "pos").alias("kind"), F.max_by("line", "pos").alias("line"), F.max(F.when(kind != "delete", F.col("pos"))).alias("at"), F.max("pos").alias("pos"), F.max("left").alias("left"), F.max("right").alias("right"))
    # What waits in vain comes at the end of its run.
    placed = ordinal(rows.withColumn("late", F.col("at").isNull().cast("int")), ["id"], ["run", "late", "pos"], "row")
    half = lambda side: F.when(is_change, F.coalesce(side, blank))
    return placed.select("id", "row", F.when(is_change, "change").otherwise(F.col("kind")).alias("type"), F.when(~is_change, F.col("line")).alias("text"), half("left").alias("left"), half("right").alias("right"))


def _begins(line: Column, marks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | line.startswith(mark)
    return found


def edit_lines(edits: DataFrame) -> DataFrame:
    """(id, old, new) -> id, row (from 0), mark (+, - or blank), num, text: the lines of an edit, one row each.

    Lines that occur once on either side and the longest run of them in one order on both hold the sides together; between them the same again, after
    equal lines at either end; the rest was removed, then added.  num: of a removed line its number before, of one that stays that
    after the edit, none for an added one.  Edits without any text have no rows.  A pair of texts is read by one task, pairs are spread.
    """

    def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The longest subsequence whose second numbers rise."""
        import bisect

        ends, tops, back = [], [], []
        for k, (_, b) in enumerate(pairs):
            at = bisect.bisect_left(tops, b)
            tops[at : at + 1], ends[at : at + 1] = [b], [k]
            back.append(ends[at - 1] if at else -1)
        out, k = [], ends[-1] if ends else -1
        while k >= 0:
            out.append(pairs[k])
            k = back[k]
        return out[::-1]

    def anchors(a: list[str], b: list[str], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
        from collections import Counter

        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        return rising([(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in place])

    def kept(a: list[str], b: list[str]) -> list[tuple[int, int]]:
        """Pairs of lines that stay, in order; ranges still to be compared wait on a stack."""
        out, stack = [], [(0, len(a), 0, len(b))]
        while stack:
            a0, a1, b0, b1 = stack.pop()
            while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
                out.append((a0, b0))
                a0, b0 = a0 + 1, b0 + 1
            while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
                a1, b1 = a1 - 1, b1 - 1
                out.append((a1, b1))
            if a0 == a1 or b0 == b1:
                continue
            found = anchors(a, b, a0, a1, b0, b1)
            out += found
            if found:
                ends = [(a0 - 1, b0 - 1), *found, (a1, b1)]
                stack += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(ends, ends[1:], strict=False)]
        return sorted(out)

    def lines(old: str, new: str) -> list[tuple[str, int | None, str]]:
        cut = lambda t: t.removesuffix("\n").split("\n") if t else []
        a, b = cut(old or ""), cut(new or "")
        out, i, j = [], 0, 0
        for x, y in [*kept(a, b), (len(a), len(b))]:
            out += [("-", k + 1, a[k]) for k in range(i, x)] + [("+", None, b[k]) for k in range(j, y)]
            if x < len(a) and y < len(b):
                out.append(("", y + 1, b[y]))
            i, j = x + 1, y + 1
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, old, new in zip(batch["id"], batch["old"], batch["new"], strict=True):
                found = lines(old, new)
                if found:
                    told = [pd.Series(x, dtype=object) for x in zip(*found, strict=True)]
                    yield pd.DataFrame({"id": pd.Series([key] * len(found), dtype=batch["id"].dtype), "row": range(len(found)), "mark": told[0], "num": told[1].astype("Int64"), "text": told[2]})

    kind = dict(edits.dtypes)["id"]
    return edits.select("id", "old", "new").mapInPandas(run, f"id {kind}, row long, mark string, num long, text string")
