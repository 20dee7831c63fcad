"""Queries over texts as diffs and edits, and over two states of one log."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.operators import diff as D
from turnmill.operators import turns as T
from turnmill.operators.windows import over
from turnmill.plans.base import EVENT_LINES, event_lines, query
from turnmill.streaming.live import changed_turns as changed
from turnmill.streaming.live import turn_prints

#: Sentences of a document as the lines of a diff: by their length a line stays, goes, comes, or begins a hunk.
DIFFS = r"""lines AS (
        SELECT doc_id AS id, list_prepend('diff --git a/' || source || ' b/' || source, list_prepend('--- a/' || source, list_prepend('+++ b/' || source, list_transform(string_split(replace(text, chr(10), '. '), '. '),
            lambda s: CASE length(s) % 5 WHEN 0 THEN '-' || s WHEN 1 THEN '+' || s WHEN 2 THEN '-' || s WHEN 3 THEN ' ' || s ELSE '@@ -' || length(s) || ' +' || length(s) % 7 || ' @@ ' || s END)))) AS l
        FROM documents WHERE text IS NOT NULL AND source IS NOT NULL
    ), flat AS (SELECT id, i, l[i] AS line FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM lines))"""


def diffs(read):
    size = lambda s: F.char_length(s)
    head = lambda s: F.concat(F.lit("@@ -"), size(s), F.lit(" +"), size(s) % 7, F.lit(" @@ "), s)
    line = lambda s: F.when(size(s) % 5 == 1, F.concat(F.lit("+"), s)).when(size(s) % 5 == 3, F.concat(F.lit(" "), s)).when(size(s) % 5 == 4, head(s)).otherwise(F.concat(F.lit("-"), s))
    body = F.transform(F.split(F.replace("text", F.lit("\n"), F.lit(". ")), r"\. "), line)
    title = F.concat(F.lit("diff --git a/"), "source", F.lit(" b/"), "source")
    text = F.concat_ws("\n", title, F.concat(F.lit("--- a/"), "source"), F.concat(F.lit("+++ b/"), "source"), body)
    return read("documents").where("text is not null and source is not null").select(F.col("doc_id").alias("id"), text.alias("text"))


@query("x18_side_by_side", f"""WITH RECURSIVE {DIFFS},
    marked AS (SELECT *, regexp_matches(line, '^@@ -(\\d+)(?:,\\d+)? \\+(\\d+)(?:,\\d+)? @@') AS hunk FROM flat),
    kinds AS (SELECT *, CASE WHEN hunk THEN 'hunk' WHEN starts_with(line, 'diff --git ') OR starts_with(line, 'index ') OR starts_with(line, '--- ') OR starts_with(line, '+++ ') THEN 'meta' WHEN starts_with(line, '-') THEN 'delete' WHEN starts_with(line, '+') THEN 'add' ELSE 'context' END AS kind FROM marked),
    walk(id, i, o, n, waiting, told) AS (
        SELECT DISTINCT id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS STRUCT(type VARCHAR, l BIGINT, r BIGINT)[]) FROM kinds
        UNION ALL
        SELECT k.id, k.i,
            CASE k.kind WHEN 'hunk' THEN CAST(regexp_extract(line, '^@@ -(\\d+)', 1) AS BIGINT) WHEN 'delete' THEN o + 1 WHEN 'context' THEN CASE WHEN o > 0 THEN o + 1 ELSE 0 END ELSE o END,
            CASE k.kind WHEN 'hunk' THEN CAST(regexp_extract(line, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)', 1) AS BIGINT) WHEN 'add' THEN n + 1 WHEN 'context' THEN CASE WHEN n > 0 THEN n + 1 ELSE 0 END ELSE n END,
            CASE k.kind WHEN 'delete' THEN list_append(waiting, o) WHEN 'add' THEN waiting[2:] ELSE [] END,
            CASE k.kind WHEN 'delete' THEN [] WHEN 'add' THEN [{{'type': 'change', 'l': waiting[1], 'r': n}}]
                ELSE list_transform(waiting, lambda x: {{'type': 'change', 'l': x, 'r': CAST(NULL AS BIGINT)}}) || [{{'type': CASE WHEN k.kind = 'context' THEN 'change' ELSE k.kind END, 'l': CASE WHEN k.kind = 'context' THEN nullif(o, 0) END, 'r': CASE WHEN k.kind = 'context' THEN nullif(n, 0) END}}] END
        FROM walk JOIN kinds AS k ON k.id = walk.id AND k.i = walk.i + 1
    ), every AS (
        SELECT id, i, told FROM walk
        UNION ALL SELECT id, max(i) + 1, list_transform(max_by(waiting, i), lambda x: {{'type': 'change', 'l': x, 'r': CAST(NULL AS BIGINT)}}) FROM walk GROUP BY id
    ), out AS (SELECT id, i, unnest(range(1, len(told) + 1)) AS j, told FROM every)
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY i, j) - 1 AS "row", told[j].type AS type, told[j].l AS left_line, told[j].r AS right_line FROM out""")
def side_by_side(read):
    return D.side_by_side(D.diff_lines(diffs(read))).select("id", "row", "type", F.col("left.line").alias("left_line"), F.col("right.line").alias("right_line"))


@query("x33_edit_lines")
def edit_lines(read):
    """Each document against the one before it that begins alike (same source, same first 24 characters): near copies, as edits by line."""
    begin = over(["source", "_head"], ["doc_id"])
    docs = read("documents").where("text <> ''").withColumn("_head", F.substring("text", 1, 24))
    pairs = docs.withColumn("old", F.lag("text").over(begin)).where("old is not null").select(F.col("doc_id").alias("id"), F.replace("old", F.lit(". "), F.lit(".\n")).alias("old"), F.replace("text", F.lit(". "), F.lit(".\n")).alias("new"))
    return D.edit_lines(pairs)


THEN = "2024-01-16 12:00:00"


@query("r2_changed_turns", f"""WITH {EVENT_LINES}, t AS (SELECT *, CAST(sum(CASE WHEN kind = 'purchase' OR seq = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS BIGINT) - 1 AS turn_i FROM lines),
    a AS (SELECT session, turn_i, count(*) AS steps, count(*) FILTER (kind = 'view') AS requests, coalesce(max(value) FILTER (kind = 'view'), 0) AS m FROM t GROUP BY ALL),
    b AS (SELECT session, turn_i, count(*) AS steps, count(*) FILTER (kind = 'view') AS requests, coalesce(max(value) FILTER (kind = 'view'), 0) AS m FROM t WHERE ts < TIMESTAMP '{THEN}' GROUP BY ALL)
    SELECT session, turn_i, CASE WHEN b.steps IS NULL THEN 'new' WHEN a.requests <> b.requests OR a.m <> b.m THEN 'listed' ELSE 'longer' END AS change FROM a LEFT JOIN b USING (session, turn_i) WHERE b.steps IS NULL OR a.steps <> b.steps""")
def changed_turns(read):
    """The log as it was at a moment against the whole of it."""

    def prints(lines):
        per = T.opened_turns(lines, F.col("kind") == "purchase").groupBy("session", "turn_i").agg(
            F.count("*").alias("steps"), F.count_if(F.col("kind") == "view").alias("requests"), F.coalesce(F.max(F.when(F.col("kind") == "view", F.col("value"))), F.lit(0.0)).alias("max_input")
        )
        return turn_prints(per)

    lines = event_lines(read("events"))
    return changed(prints(lines.where(F.col("ts") < F.lit(THEN).cast("timestamp_ntz"))), prints(lines))
