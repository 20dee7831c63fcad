"""Queries over raw transcript lines: each row of ``events`` as one line of JSON in an agent's format, read back by the library's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.operators import codex, headers, pi
from turnmill.operators.composition import ADDED, CATEGORIES, EFFORT, SEEDS, claude_composition
from turnmill.operators.headers import claude_meta
from turnmill.operators.lineage import dealt
from turnmill.operators.windows import before, over
from turnmill.plans.base import EVENT_LINES, event_lines, query
from turnmill.sources import wire
from turnmill.sources.transcripts import claude_turns, longest_branch

S = ["session"]
W = "WITH RECURSIVE " + EVENT_LINES
WHEN = "2024-01-01T00:00:00Z"


def said(word: str, times: Column) -> Column:
    return F.repeat(F.lit(word + " "), times.cast("int"))


def listed(*structs: Column) -> Column:
    """Objects of different shapes as one JSON list."""
    return F.concat(F.lit("["), F.concat_ws(",", *[F.to_json(s) for s in structs]), F.lit("]"))


def of(**fields) -> Column:
    return F.struct(*[(f if isinstance(f, Column) else F.lit(f)).alias(n) for n, f in fields.items()])


def quoted(text: Column) -> Column:
    """A string as JSON."""
    return F.regexp_replace(F.to_json(F.struct(text.alias("x"))), r'^\{"x":|\}$', "")


def as_read(lines: DataFrame) -> DataFrame:
    """Lines as a reader of files would hand them over: what writes them and what reads them would make one stage too large to compile."""
    return dealt(lines, "session")


def claude_log(events: DataFrame) -> DataFrame:
    """session, line_no, value.  A purchase asks, a view answers with a call, a click returns a result, a signup attaches, an error goes on with the prompt of the last purchase."""
    k, e = F.col("tokens"), event_lines(events)
    asked, called = (F.last(F.when(F.col("kind") == kind, F.col("event_id")), ignorenulls=True).over(before(S, ["seq"])) for kind in ("purchase", "view"))
    e = e.withColumn("asked", asked).withColumn("called", called)
    head = lambda kind: F.concat(F.lit(f'{{"type":"{kind}","uuid":"u'), F.col("event_id"), F.lit(f'","timestamp":"{WHEN}",'))
    message = lambda kind, body: F.concat(head(kind), F.lit('"message":{"content":'), body, F.lit("}}"))
    result = of(type="tool_result", tool_use_id=F.concat(F.lit("c"), F.coalesce(F.col("called").cast("string"), F.lit("none"))))
    output = F.when(k % 2 == 0, quoted(said("out", k))).otherwise(listed(of(type="text", text=said("row", k)), of(type="image")))
    answer = listed(
        of(type="thinking", thinking=said("hm", k)), of(type="text", text=said("seen", k / 7)),
        of(type="tool_use", id=F.concat(F.lit("c"), F.col("event_id")), name=F.element_at(F.array(F.lit("Read"), F.lit("Agent"), F.lit("Bash")), (k % 3 + 1).cast("int")), input=of(n=k)),
    )
    usage = F.to_json(of(input_tokens=F.floor(F.col("value") * 100), output_tokens=k, cache_read_input_tokens=k * 10))
    attached = (
        F.when(k % 4 == 0, F.to_json(of(type="skill_listing", content=said("skill", k))))
        .when(k % 4 == 1, F.concat(F.lit('{"type":"task_reminder","content":'), F.regexp_replace(listed(of(title=F.concat(F.lit("t"), k), description=said("todo", k))), r"\]$", ',"plain"]'), F.lit("}")))
        .when(k % 4 == 2, F.to_json(of(type="mcp_instructions_delta", addedBlocks=F.array(F.lit("a"), said("mcp", k)))))
        .otherwise(F.to_json(of(type="ultra_effort_enter")))
    )
    value = (
        F.when(F.col("kind") == "purchase", F.concat(head("user"), F.lit('"cwd":"'), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("/w"), k % 5)), F.lit('","promptId":"p'), F.col("event_id"), F.lit('","message":{"content":'), quoted(F.concat(F.lit("order "), F.col("event_id"), said(" item", k))), F.lit("}}")))
        .when(F.col("kind") == "error", F.concat(head("user"), F.lit('"isMeta":true,'), F.coalesce(F.concat(F.lit('"promptId":"p'), F.col("asked"), F.lit('",')), F.lit("")), F.lit('"message":{"content":'), quoted(F.concat(F.lit("meta "), k)), F.lit("}}")))
        .when(F.col("kind") == "click", message("user", F.concat(F.lit("["), F.regexp_replace(F.to_json(result), r"\}$", ""), F.lit(',"content":'), output, F.lit("}]"))))
        .when(F.col("kind") == "view", F.concat(head("assistant"), F.lit('"message":{'), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit('"model":"agent-'), k % 3, F.lit('",'))), F.lit('"content":'), answer, F.lit(',"usage":'), usage, F.lit("}}")))
        .otherwise(F.concat(head("attachment"), F.lit('"attachment":'), attached, F.lit("}")))
    )
    return as_read(e.select("session", (F.col("seq") + 1).alias("line_no"), value.alias("value")))


#: Turns, then sizes of every part by the rule, from the columns alone.
_CLAUDE = f"""{W}, a AS (
        SELECT *, last_value(CASE WHEN kind = 'purchase' THEN event_id END IGNORE NULLS) OVER b AS asked, last_value(CASE WHEN kind = 'view' THEN event_id END IGNORE NULLS) OVER b AS called,
               coalesce(sum(CASE WHEN kind IN ('purchase', 'click', 'error') THEN 1 ELSE 0 END) OVER b, 0) AS users
        FROM lines WINDOW b AS (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), o AS (SELECT *, kind = 'purchase' OR (kind = 'error' AND asked IS NULL) OR (kind = 'click' AND users = 0) AS opens FROM a),
    t AS (SELECT * FROM (SELECT *, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS BIGINT) - 1 AS turn_i FROM o) WHERE turn_i >= 0),
    u AS (SELECT session, turn_i, coalesce(max(floor(value * 100) + tokens * 10) FILTER (kind = 'view'), 0) AS total FROM t GROUP BY session, turn_i),
    ep AS (SELECT *, sum(CASE WHEN total > 0 AND total < 0.5 * prev THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY turn_i) AS epoch FROM (
        SELECT *, last_value(nullif(total, 0) IGNORE NULLS) OVER (PARTITION BY session ORDER BY turn_i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM u)),
    out AS (SELECT *, CASE WHEN tokens % 2 = 0 THEN tokens * 4 ELSE tokens * 4 + 23 END AS returned,
        (SELECT c.tokens % 3 = 1 FROM t AS c WHERE c.session = t.session AND c.turn_i = t.turn_i AND c.event_id = t.called) AS by_agent FROM t),
    per AS (
        SELECT session, turn_i,
            sum(CASE WHEN kind = 'click' AND NOT coalesce(by_agent, false) THEN returned ELSE 0 END) / 3.0 AS toolResults,
            sum(CASE WHEN kind = 'view' THEN tokens * 3 ELSE 0 END) / 3.0 AS thinking,
            sum(CASE WHEN kind = 'view' THEN CASE tokens % 3 WHEN 1 THEN 5 ELSE 4 END + length('{{"n":' || tokens || '}}') ELSE 0 END) / 3.0 AS toolCalls,
            sum(CASE WHEN kind = 'purchase' THEN length('order ' || event_id) + tokens * 6 WHEN kind = 'error' THEN length('meta ' || tokens) WHEN opens THEN returned ELSE 0 END) / 3.0 AS userMsgs,
            sum(CASE WHEN kind = 'view' THEN (tokens // 7) * 5 ELSE 0 END) / 3.0 AS asstText,
            sum(CASE WHEN kind = 'click' AND by_agent THEN returned ELSE 0 END) / 3.0 AS subagent,
            max_by(tokens * 6, seq) FILTER (kind = 'signup' AND tokens % 4 = 0) AS skills, max_by(2 + tokens * 4, seq) FILTER (kind = 'signup' AND tokens % 4 = 2) AS mcp
        FROM out GROUP BY session, turn_i
    ), r AS (
        SELECT session, turn_i, seq, unnest(CASE WHEN tokens % 4 = 1 THEN [length('t' || tokens) + 1 + tokens * 5, 5] ELSE [{len(EFFORT)}] END) AS raw, unnest(CASE WHEN tokens % 4 = 1 THEN [0, 1] ELSE [0] END) AS pos
        FROM t WHERE kind = 'signup' AND tokens % 4 IN (1, 3)
    ), rn AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq, pos) AS n FROM r),
    fold(session, n, turn_i, have) AS (
        SELECT session, n, turn_i, CAST(raw AS BIGINT) FROM rn WHERE n = 1
        UNION ALL SELECT rn.session, rn.n, rn.turn_i, CASE WHEN have = {SEEDS["reminders"]} THEN 0 ELSE have END + raw FROM fold JOIN rn ON rn.session = fold.session AND rn.n = fold.n + 1
    ), rem AS (SELECT session, turn_i, max_by(have, n) AS reminders FROM fold GROUP BY session, turn_i),
    j AS (SELECT ep.*, per.* EXCLUDE (session, turn_i), rem.reminders FROM ep JOIN per USING (session, turn_i) LEFT JOIN rem USING (session, turn_i)),
    k AS (SELECT session, turn_i, epoch, {", ".join(f"sum({c}) OVER e AS {c}" for c in ADDED)},
        last_value(CASE WHEN skills IS NOT NULL THEN {{'n': skills, 'epoch': epoch}} END IGNORE NULLS) OVER s AS skills, last_value(mcp IGNORE NULLS) OVER s AS mcp, last_value(reminders IGNORE NULLS) OVER s AS reminders
        FROM j WINDOW e AS (PARTITION BY session, epoch ORDER BY turn_i), s AS (PARTITION BY session ORDER BY turn_i ROWS UNBOUNDED PRECEDING))
    SELECT session, turn_i, {", ".join(f"CAST(floor(round({c}, 6) + 0.5) AS BIGINT) AS {c}" for c in ADDED)},
        {", ".join(f"CAST(floor(round({SEEDS[c]} / 3.0, 6) + 0.5) AS BIGINT) AS {c}" for c in ("sysPrompt", "tool_defs", "memory", "userWrapper"))},
        CAST(floor(round(CASE WHEN skills IS NULL OR (skills.n = 0 AND skills.epoch < epoch) THEN {SEEDS["skills"]} ELSE skills.n END / 3.0, 6) + 0.5) AS BIGINT) AS skills,
        CAST(floor(round(coalesce(mcp, {SEEDS["mcp"]}) / 3.0, 6) + 0.5) AS BIGINT) AS mcp, CAST(floor(round(coalesce(reminders, {SEEDS["reminders"]}) / 3.0, 6) + 0.5) AS BIGINT) AS reminders
    FROM k"""


@query("t7_full_composition", _CLAUDE)
def full_composition(read):
    return claude_composition(claude_turns(claude_log(read("events")))).select("session", "turn_i", *CATEGORIES)


ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


@query("a13_session_meta", f"""{_CLAUDE[: _CLAUDE.index("    u AS (")].rstrip().rstrip(",")}
    SELECT session, coalesce(min_by('agent-' || tokens % 3, seq) FILTER (kind = 'view' AND tokens % 3 > 0), 'unknown') AS model, coalesce(CAST(min_by(tokens % 3, seq) FILTER (kind = 'view' AND tokens % 3 > 0) AS VARCHAR), 'unknown') AS version,
        coalesce(min_by('/w' || tokens % 5, seq) FILTER (kind = 'purchase' AND tokens % 5 > 0), '') AS cwd FROM t GROUP BY session""")
def session_meta(read):
    lines = claude_log(read("events"))
    return claude_meta(lines, claude_turns(lines))


def stamped(events: DataFrame) -> tuple[DataFrame, Column, Column]:
    """The events with the start of a JSON object that holds their time, and k."""
    return event_lines(events), F.concat(F.lit('{"timestamp":"'), F.date_format("ts", ISO), F.lit('",')), F.col("tokens")


def body(**fields: Column | str) -> Column:
    """The rest of that object; fields that are null are left out."""
    return F.regexp_replace(F.to_json(of(**fields)), r"^\{", "")


def worded(word: str, n: Column) -> Column:
    return F.concat(F.lit(word), n.cast("string"))


def pi_log(events: DataFrame) -> DataFrame:
    """A purchase starts a turn, a signup ends one, a view updates a message, a click ends one or starts a tool, an error ends a tool or tells of a compaction."""
    e, head, k = stamped(events)
    kind, tool = F.col("kind"), worded("t", k % 7)
    spoken = lambda role, word, empty: of(role=role, content=F.when(empty, F.array().cast("array<string>")).otherwise(F.array(worded(word, k))))
    rest = (
        F.when(kind == "purchase", body(type="turn_start", prompt=F.when(k % 2 == 0, worded("ask ", k))))
        .when(kind == "signup", body(type="turn_end"))
        .when(kind == "view", body(type="message_update", message=spoken(F.when(k % 5 == 0, "user").otherwise("assistant"), "say ", k % 7 == 0)))
        .when((kind == "click") & (k % 2 == 1), body(type="message_end", message=spoken("assistant", "end ", k % 3 == 0)))
        .when(kind == "click", body(type="tool_execution_start", toolCallId=tool, toolName=worded("tool", k % 3), args=of(n=k)))
        .when(k % 2 == 1, body(type="tool_execution_end", toolCallId=tool, result=worded("res ", k)))
        .otherwise(body(type="auto_compaction_start", summary=F.when(k % 4 == 0, worded("sum ", k))))
    )
    return as_read(e.select("session", (F.col("seq") + 1).alias("line_no"), F.concat(head, rest).alias("value")))


_PI = f"""{W}, p AS (
        SELECT *, CASE kind WHEN 'purchase' THEN 'turn_start' WHEN 'signup' THEN 'turn_end' WHEN 'view' THEN 'update' WHEN 'click' THEN CASE WHEN tokens % 2 = 1 THEN 'end' ELSE 'tool_start' END ELSE CASE WHEN tokens % 2 = 1 THEN 'tool_end' ELSE 'compaction' END END AS t,
            CASE WHEN kind = 'view' AND tokens % 7 <> 0 THEN 'say ' || tokens WHEN kind = 'click' AND tokens % 3 <> 0 THEN 'end ' || tokens ELSE '' END AS text, kind = 'view' AND tokens % 5 = 0 AS by_user FROM lines
    ), st AS (SELECT *, last_value(CASE WHEN t = 'tool_start' THEN {{'ms': ms, 'name': 'tool' || tokens % 3, 'input': '{{"n":' || tokens || '}}'}} END IGNORE NULLS) OVER (PARTITION BY session, tokens % 7, t IN ('tool_start', 'tool_end') ORDER BY seq) AS start FROM p),
    f AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY session ORDER BY seq) = 'turn_end', true) AS closed FROM st WHERE t <> 'tool_start'),
    o AS (SELECT *, t = 'turn_start' OR (t <> 'turn_end' AND closed) AS opens FROM f),
    i AS (SELECT *, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS BIGINT) - 1 AS turn_i FROM o),
    inside AS (SELECT * FROM i WHERE t <> 'turn_end' OR NOT closed),
    turns AS (
        SELECT session, turn_i, CASE WHEN bool_or(t = 'turn_start' AND tokens % 2 = 0) THEN 'ask ' || max(tokens) FILTER (t = 'turn_start') ELSE coalesce(min_by(text, seq) FILTER (by_user AND text <> ''), 'Pi stream: ') END AS prompt,
            min(ms) AS start_ms, max_by(ms, seq) AS end_ms, bool_or(t = 'compaction') AS compaction FROM inside GROUP BY session, turn_i
    )"""


@query("t6_pi_turns", _PI + " SELECT * FROM turns")
def pi_turns(read):
    return pi.event_turns(pi_log(read("events")))[0]


@query("t6_pi_steps", _PI + f""", a AS (SELECT *, coalesce(sum(CASE WHEN t = 'end' THEN 1 ELSE 0 END) OVER (PARTITION BY session, turn_i ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m
            FROM inside WHERE t = 'end' OR (t = 'update' AND NOT by_user AND text <> '')),
    msg AS (SELECT session, turn_i, max(seq) FILTER (t = 'end') AS e_seq, max(ms) FILTER (t = 'end') AS e_ms, max(text) FILTER (t = 'end') AS e_text,
            max(seq) FILTER (t = 'update') AS u_seq, max_by(ms, seq) FILTER (t = 'update') AS u_ms, max_by(text, seq) FILTER (t = 'update') AS u_text FROM a GROUP BY session, turn_i, m),
    s AS (
        SELECT session, turn_i, CASE WHEN e_seq IS NULL THEN 1 ELSE 0 END AS late, coalesce(e_seq, u_seq) AS seq, coalesce(e_ms, u_ms) AS at_ms, CAST(0 AS BIGINT) AS ms, 'm' AS kind, '{pi.MODEL_STEP}' AS name, coalesce(nullif(e_text, ''), u_text) AS text, '' AS input, '' AS result FROM msg WHERE coalesce(nullif(e_text, ''), u_text, '') <> ''
        UNION ALL SELECT session, turn_i, 0, seq, ms, 0, 'i', '{pi.COMPACTION_STEP}', CASE WHEN tokens % 4 = 0 THEN 'sum ' || tokens ELSE '{pi.COMPACTED}' END, '', '' FROM inside WHERE t = 'compaction'
        UNION ALL SELECT session, turn_i, 0, seq, ms, greatest(coalesce(ms - start.ms, 0), 0), 't', coalesce(start.name, 'tool'), '', coalesce(start.input, ''), 'res ' || tokens FROM inside WHERE t = 'tool_end'
    ), n AS (SELECT *, row_number() OVER w - 1 AS step_i, lead(at_ms) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY session, turn_i ORDER BY late, seq))
    SELECT n.session, n.turn_i, step_i, kind, name, text, input, result, CASE WHEN ms > 0 THEN ms ELSE greatest(coalesce(nxt, end_ms) - at_ms, 0) END AS ms, CASE WHEN kind = 't' THEN CAST(floor(length(result) / 3.0 + 0.5) AS BIGINT) ELSE 0 END AS result_tok
    FROM n JOIN turns USING (session, turn_i)""")
def pi_steps(read):
    return pi.event_turns(pi_log(read("events")))[1].select("session", "turn_i", "step_i", "kind", "name", "text", "input", "result", "ms", "result_tok")


def codex_log(events: DataFrame) -> DataFrame:
    """A purchase starts a task, a signup ends one, a view says, thinks or counts, a click calls, an error returns a result or marks a compaction."""
    e, head, k = stamped(events)
    kind = F.col("kind")
    call, message = worded("c", k % 5), worded("m", k % 10)
    line = lambda type_, **payload: body(type=type_, payload=of(**payload))
    said = F.concat(F.lit(" "), message, F.lit("\n"))
    rest = (
        F.when(kind == "purchase", line("event_msg", type="task_started", turn_id=worded("t", F.col("event_id"))))
        .when((kind == "signup") & (k % 3 == 0), line("event_msg", type="turn_aborted")).when(kind == "signup", line("event_msg", type="task_complete", duration_ms=k * 10))
        .when((kind == "view") & (k % 4 == 0), line("event_msg", type="agent_message", message=message))
        .when((kind == "view") & (k % 4 == 1), line("response_item", type="message", role="assistant", content=F.array(of(type="output_text", text=said))))
        .when((kind == "view") & (k % 4 == 2), line("response_item", type="reasoning", summary=F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(worded("why ", k)))))
        .when(kind == "view", line("event_msg", type="token_count", info=of(last_token_usage=of(input_tokens=F.floor(F.col("value") * 10), cached_input_tokens=k, output_tokens=k, reasoning_output_tokens=k % 5))))
        .when(kind == "click", line("response_item", type="function_call", call_id=call, name=F.when(k % 11 == 0, "Agent").otherwise(worded("f", k % 3)), arguments=F.concat(F.lit('{"k":'), k, F.lit("}"))))
        .when(k % 4 == 0, line("response_item", type="function_call_output", call_id=call, output=worded("out ", k)))
        .when(k % 4 == 1, line("event_msg", type="patch_apply_end", call_id=call, stdout=worded("patched ", k), success=F.lit(False)))
        .when(k % 4 == 2, line("compacted", type="x")).otherwise(line("event_msg", type="context_compacted"))
    )
    return as_read(e.select("session", (F.col("seq") + 1).alias("line_no"), F.concat(head, rest).alias("value")))


_CODEX = f"""{W}, c AS (
        SELECT *, last_value(CASE kind WHEN 'purchase' THEN 1 WHEN 'signup' THEN 0 END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was, sum(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS o FROM lines
    ), inside AS (
        SELECT *, CAST(o - 1 AS BIGINT) AS turn_i, CASE WHEN kind = 'view' THEN CASE tokens % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'text' WHEN 2 THEN 'thought' ELSE 'usage' END WHEN kind = 'click' THEN 'call' WHEN kind = 'error' THEN CASE tokens % 4 WHEN 0 THEN 'result' WHEN 1 THEN 'patch' WHEN 2 THEN 'mark' ELSE 'echo' END END AS t
        FROM c WHERE kind = 'purchase' OR was = 1
    ), marked AS (SELECT *, max(seq) FILTER (t IN ('mark', 'echo')) OVER (PARTITION BY session, turn_i) AS compacted_at FROM inside),
    turns AS (
        SELECT session, turn_i, 't' || min_by(event_id, seq) AS turn_id, min(ms) AS start_ms, max_by(ms, seq) AS end_ms, max(tokens * 10) FILTER (kind = 'signup' AND tokens % 3 <> 0) AS duration_ms, coalesce(bool_or(kind = 'signup' AND tokens % 3 = 0), false) AS aborted,
            coalesce(bool_or(t IN ('mark', 'echo')), false) AS compacted, count(*) FILTER (t = 'usage') AS requests, CAST(coalesce(sum(tokens) FILTER (t = 'usage'), 0) AS BIGINT) AS out_tok, CAST(coalesce(max(floor(value * 10)) FILTER (t = 'usage'), 0) AS BIGINT) AS max_input,
            CAST(coalesce(max_by(floor(value * 10), seq) FILTER (t = 'usage' AND (value >= 0.1 OR tokens > 0) AND seq > coalesce(compacted_at, -1)), 0) AS BIGINT) AS last_input
        FROM marked GROUP BY session, turn_i
    )"""


@query("t2_codex_turns", _CODEX + f" SELECT *, '{codex.NO_PROMPT}' AS prompt, 'codex' AS model, CAST(200000 AS BIGINT) AS \"window\" FROM turns")
def codex_turns(read):
    return codex.codex_turns(codex_log(read("events")))


@query("a12_codex_headers", _CODEX + """, u AS (SELECT session, turn_i, CAST(floor(value * 10) AS BIGINT) AS input, row_number() OVER (PARTITION BY session ORDER BY turn_i, seq) - 1 AS i FROM inside WHERE t = 'usage'),
    b AS (SELECT * FROM u WHERE input > 0 QUALIFY row_number() OVER (PARTITION BY session ORDER BY input DESC, i) = 1), s AS (SELECT session, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(out_tok) AS BIGINT) AS total_output FROM turns GROUP BY session)
    SELECT session, 'codex' AS model, 'log' AS version, '' AS cwd, '""" + codex.NO_PROMPT + """' AS title, requests, total_output, coalesce(b.i, 0) AS peak_index, coalesce(b.input, 0) AS peak_tokens, coalesce(b.turn_i, 0) AS peak_turn, CAST(200000 AS BIGINT) AS context_limit FROM s LEFT JOIN b USING (session)""")
def codex_headers(read):
    lines = codex_log(read("events"))
    events = codex.turn_events(lines)
    return headers.codex_headers(lines, events, codex.codex_turns(lines, events), "log")


@query("t18_codex_steps", _CODEX + f""", u AS (SELECT session, turn_i, seq, CAST(floor(value * 10) AS BIGINT) AS input, tokens AS output, tokens % 5 AS reasoning, ms FROM inside WHERE t = 'usage'),
    near AS (
        SELECT i.*, u.input AS in_tok, u.output AS used_out, u.reasoning FROM inside AS i LEFT JOIN u USING (session, turn_i) WHERE i.t IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY i.session, i.turn_i, i.seq ORDER BY abs(u.seq - i.seq), u.seq) = 1
    ), said AS (SELECT *, 'm' || tokens % 10 AS words FROM near WHERE t = 'text' QUALIFY row_number() OVER (PARTITION BY session, turn_i, tokens % 10 ORDER BY seq) = 1),
    echoes AS (SELECT *, lag(t) OVER (PARTITION BY session, turn_i ORDER BY seq) AS before FROM near WHERE t IN ('mark', 'echo')),
    called AS (SELECT session, turn_i, tokens % 5 AS id, max_by({{'name': CASE WHEN tokens % 11 = 0 THEN 'Agent' ELSE 'f' || tokens % 3 END, 'input': '{{"k":' || tokens || '}}', 'ms': ms}}, seq) AS c FROM inside WHERE t = 'call' GROUP BY ALL),
    answered AS (SELECT session, turn_i, tokens % 5 AS id, coalesce(max_by({{'output': 'out ' || tokens, 'bad': false, 'ms': ms}}, seq) FILTER (t = 'result'), min_by({{'output': 'patched ' || tokens, 'bad': true, 'ms': ms}}, seq) FILTER (t = 'patch')) AS r FROM inside WHERE t IN ('result', 'patch') GROUP BY ALL),
    calls AS (SELECT n.*, c, r FROM near AS n JOIN called ON called.session = n.session AND called.turn_i = n.turn_i AND called.id = n.tokens % 5 LEFT JOIN answered ON answered.session = n.session AND answered.turn_i = n.turn_i AND answered.id = n.tokens % 5 WHERE t = 'call'),
    made AS (
        SELECT session, turn_i, seq, 0 AS part, ms AS at_ms, 'i' AS kind, '{pi.COMPACTION_STEP}' AS name, '{codex.COMPACTED}' AS text, '' AS input, '' AS result, false AS is_error, 0 AS think_tok, in_tok, used_out FROM echoes WHERE t = 'mark' OR before IS DISTINCT FROM 'mark'
        UNION ALL SELECT session, turn_i, seq, 0, ms, 'm', '{pi.MODEL_STEP}', CASE WHEN tokens % 3 = 0 THEN '{codex.HIDDEN_THOUGHT}' ELSE 'why ' || tokens END, '', '', false, coalesce(reasoning, 0), in_tok, used_out FROM near WHERE t = 'thought'
        UNION ALL SELECT session, turn_i, seq, 0, ms, 'm', '{pi.MODEL_STEP}', words, '', '', false, 0, in_tok, used_out FROM said
        UNION ALL SELECT session, turn_i, seq, 0, ms, 'm', '{pi.MODEL_STEP}', '', c.input, '', false, 0, in_tok, used_out FROM calls
        UNION ALL SELECT session, turn_i, seq, 1, coalesce(r.ms, c.ms), CASE WHEN c.name = 'Agent' THEN 's' ELSE 't' END, c.name, '', c.input, coalesce(r.output, '{codex.NO_RESULT}'), coalesce(r.bad, true), 0, in_tok, used_out FROM calls
    ), bare AS (
        SELECT t.session, t.turn_i, 0 AS seq, 0 AS part, coalesce(max_by(u.ms, u.seq), any_value(t.start_ms)) AS at_ms, 'm' AS kind, '{pi.MODEL_STEP}' AS name, CASE WHEN count(u.seq) > 0 THEN '{codex.ONLY_COUNTS}' ELSE '{codex.NOTHING}' END AS text, '' AS input, '' AS result, false AS is_error, 0 AS think_tok, max_by(u.input, u.seq) AS in_tok, max_by(u.output, u.seq) AS used_out
        FROM turns AS t ANTI JOIN made USING (session, turn_i) LEFT JOIN u USING (session, turn_i) GROUP BY t.session, t.turn_i
    ), every AS (SELECT * FROM made UNION ALL SELECT * FROM bare),
    n AS (SELECT *, row_number() OVER w - 1 AS step_i, lead(at_ms) OVER w AS nxt, CASE WHEN kind = 'm' AND think_tok = 0 AND text LIKE 'm_' THEN CAST(floor(length(text) / 3.0 + 0.5) AS BIGINT) ELSE 0 END AS text_tok FROM every WINDOW w AS (PARTITION BY session, turn_i ORDER BY seq, part)),
    d AS (SELECT n.*, greatest(coalesce(nxt, end_ms) - at_ms, 0) AS wait FROM n JOIN turns USING (session, turn_i))
    SELECT session, turn_i, step_i, kind, name, text, input, result, is_error, CAST(think_tok AS BIGINT) AS think_tok, text_tok, coalesce(in_tok, 0) AS in_tok, coalesce(used_out, 0) AS out_tok,
        CAST(CASE WHEN wait = 0 AND kind = 'm' AND coalesce(used_out, 0) + think_tok + text_tok > 0 THEN greatest(1, floor((coalesce(used_out, 0) + think_tok + text_tok) / 30.0 + 0.5) * 1000) ELSE wait END AS BIGINT) AS ms
    FROM d""")
def codex_steps(read):
    lines = codex_log(read("events"))
    events = codex.turn_events(lines)
    steps = codex.codex_steps(events, codex.codex_turns(lines, events))
    return steps.select("session", "turn_i", "step_i", "kind", "name", "text", "input", "result", "is_error", "think_tok", "text_tok", "in_tok", "out_tok", "ms")


def tree_log(events: DataFrame) -> DataFrame:
    """Every event as an entry whose parent is one to four entries before it, by k."""
    e, head, k = stamped(events)
    parent = F.lag("event_id", 1).over(over(S, ["seq"])), F.lag("event_id", 2).over(over(S, ["seq"])), F.lag("event_id", 3).over(over(S, ["seq"])), F.lag("event_id", 4).over(over(S, ["seq"]))
    e = e.withColumn("parent", F.when(k % 4 == 0, parent[0]).when(k % 4 == 1, parent[1]).when(k % 4 == 2, parent[2]).otherwise(parent[3]))
    entry = body(type="message", id=F.col("event_id").cast("string"), parentId=F.col("parent").cast("string"), message=of(role="user", content=worded("m", k)))
    return as_read(e.select("session", (F.col("seq") + 1).alias("line_no"), F.concat(head, entry).alias("value")))


@query("j19_longest_branch", W + """, p AS (SELECT session, event_id AS id, seq, CASE tokens % 4 WHEN 0 THEN lag(event_id, 1) OVER w WHEN 1 THEN lag(event_id, 2) OVER w WHEN 2 THEN lag(event_id, 3) OVER w ELSE lag(event_id, 4) OVER w END AS parent FROM lines WINDOW w AS (PARTITION BY session ORDER BY seq)),
    d(session, id, seq, depth) AS (SELECT session, id, seq, 0 FROM p WHERE parent IS NULL UNION ALL SELECT p.session, p.id, p.seq, d.depth + 1 FROM d JOIN p ON p.session = d.session AND p.parent = d.id),
    leaf AS (SELECT session, id FROM d QUALIFY row_number() OVER (PARTITION BY session ORDER BY depth DESC, seq DESC) = 1),
    path(session, id) AS (SELECT session, id FROM leaf UNION ALL SELECT p.session, p.parent FROM path JOIN p USING (session, id) WHERE p.parent IS NOT NULL)
    SELECT d.session, d.seq, CAST(d.id AS VARCHAR) AS id, CAST(depth AS BIGINT) AS depth FROM d JOIN path USING (session, id)""")
def longest_branches(read):
    return longest_branch(tree_log(read("events")))


def message_text() -> Column:
    """A first message whose sections hold stretches of a document, some left out by its length."""
    n, cut = F.col("n_chars"), lambda k: F.substring("text", 1 + 60 * k, 60)
    some = lambda yes, *parts: F.when(yes, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])).otherwise("")
    return F.concat(
        F.lit("<system-reminder>\nintro "), some(n % 2 == 0, wire.GLOBAL, "me:\n\n", cut(0), "\n\n"), some(n % 3 == 0, wire.PROJECT, " /repo:\n\n", cut(1), "\n"), some(n % 5 < 3, wire.SERVERS, "\n\n", cut(2), "\n\n"),
        some(n % 7 < 4, wire.SKILLS, ":\n\n", cut(3), "\n"), some(n % 4 < 2, wire.DATE, "\n2024\n"), some(n % 11 > 0, wire.CLOSING), F.lit(" tail"),
    )


_MESSAGE = f"""concat('<system-reminder>\n' || 'intro ', CASE WHEN n_chars % 2 = 0 THEN '{wire.GLOBAL}me:\n\n' || substr(text, 1, 60) || '\n\n' ELSE '' END, CASE WHEN n_chars % 3 = 0 THEN '{wire.PROJECT} /repo:\n\n' || substr(text, 61, 60) || '\n' ELSE '' END,
    CASE WHEN n_chars % 5 < 3 THEN '{wire.SERVERS}\n\n' || substr(text, 121, 60) || '\n\n' ELSE '' END, CASE WHEN n_chars % 7 < 4 THEN '{wire.SKILLS}:\n\n' || substr(text, 181, 60) || '\n' ELSE '' END,
    CASE WHEN n_chars % 4 < 2 THEN '{wire.DATE}\n2024\n' ELSE '' END, CASE WHEN n_chars % 11 > 0 THEN '{wire.CLOSING}' ELSE '' END, ' tail')"""


def _section(own: str, following: tuple[str, ...]) -> str:
    until = "stop"
    for x in reversed(following):
        until = f"CASE WHEN {x} > {own} THEN {x} ELSE {until} END"
    begin = f"CASE WHEN strpos(substr(t, {own} + 1), '\n\n') > 0 THEN {own} + strpos(substr(t, {own} + 1), '\n\n') + 1 ELSE {own} END"
    end = f"greatest(length(rtrim(substr(t, 1, {until}), '\n')), least({until}, 1))"
    return f"CASE WHEN {own} >= 0 THEN greatest(0, {end} - ({begin})) ELSE 0 END"


@query("s14_claude_capture", f"""WITH m AS (SELECT doc_id, lang, source, {_MESSAGE} AS t FROM documents WHERE text IS NOT NULL),
    g AS (SELECT *, strpos(t, '{wire.GLOBAL}') - 1 AS g, strpos(t, '{wire.SERVERS}') - 1 AS m, strpos(t, '{wire.SKILLS}') - 1 AS s, strpos(t, '{wire.DATE}') - 1 AS d, CASE WHEN strpos(t, '{wire.CLOSING}') > 0 THEN strpos(t, '{wire.CLOSING}') - 1 ELSE length(t) END AS stop FROM m),
    p AS (SELECT *, CASE WHEN g >= 0 AND strpos(substr(t, g + 21), '{wire.PROJECT}') > 0 THEN g + 19 + strpos(substr(t, g + 21), '{wire.PROJECT}') ELSE -1 END AS p FROM g),
    z AS (SELECT *, {_section("g", ("p", "m", "s", "d"))} AS section_global, {_section("p", ("m", "s", "d"))} AS section_project, {_section("m", ("s", "d"))} AS section_servers, {_section("s", ("d",))} AS section_skills FROM p)
    SELECT doc_id AS session, coalesce(lang, 'unknown') AS model, length(coalesce(source, '')) + 22 AS sys_prompt, length(t) AS section_total, section_global, section_project, section_servers, section_skills, CASE WHEN d >= 0 THEN stop - d ELSE 0 END AS section_date,
        greatest(0, stop - section_global - section_project - section_servers - section_skills) AS section_wrapper FROM z""")
def claude_capture(read):
    request = of(method="POST", body=of(model=F.col("lang"), system=F.array(of(text=F.col("source")), of(text=wire.IDENTITY)), messages=F.array(of(role="user", content=F.array(of(type="text", text=message_text()))))))
    lines = read("documents").where("text is not null").select(F.col("doc_id").alias("session"), F.lit(1).alias("line_no"), F.to_json(of(request=request)).alias("value"))
    return wire.claude_captures(as_read(lines)).select("session", "model", "sys_prompt", *[f"section_{n}" for n in ("total", "global", "project", "servers", "skills", "date", "wrapper")])


@query("s15_codex_capture", f"""WITH {EVENT_LINES}, f AS (SELECT * FROM lines WHERE kind IN ('purchase', 'view') QUALIFY row_number() OVER (PARTITION BY session ORDER BY seq) = 1)
    SELECT session, CASE WHEN kind = 'purchase' THEN 'responses' ELSE 'chat_completions' END AS wire_api, CASE WHEN kind = 'purchase' THEN length('do ' || tokens) ELSE length('dev ' || tokens) END AS sys_prompt, CASE WHEN kind = 'purchase' THEN 't' || tokens ELSE 'a,b' END AS tool_names,
        CASE WHEN kind = 'purchase' THEN length('dev ' || tokens) ELSE 0 END AS runtime, CASE WHEN tokens % 3 = 0 THEN event_id ELSE tokens END AS input, CASE WHEN tokens % 3 <> 0 THEN tokens // 2 END AS cached FROM f""")
def codex_capture(read):
    e, _, k = stamped(read("events"))
    developer = of(role="developer", content=F.array(of(type="input_text", text=worded("dev ", k))))
    old = F.to_json(of(instructions=worded("do ", k), tools=F.array(of(name=worded("t", k))), input=F.array(developer)))
    new = F.concat(F.lit('{"input":[{"type":"additional_tools","tools":[{"name":"b"},{"function":{"name":"a"}}]},'), F.to_json(developer), F.lit("]}"))
    first = F.concat(F.lit('data: {"usage":{"input_tokens":'), k, F.lit(',"cached_input_tokens":'), F.floor(k / 2), F.lit("}}\ndata: [DONE]\n"))
    second = F.when(k % 3 == 0, F.concat(F.lit('data: {"response":{"usage":{"input_tokens":'), F.col("event_id"), F.lit("}}}\n"))).otherwise("data: {broken\n")
    request = F.concat(F.lit('{"request":{"method":"'), F.when(F.col("kind") == "error", "GET").otherwise("POST"), F.lit('","url":"'), F.when(F.col("kind") == "click", "/other").otherwise("/responses"), F.lit('","body":'))
    payload = F.when(F.col("kind") == "purchase", old).when(F.col("kind") == "signup", F.lit('{"input":[]}')).otherwise(new)
    value = F.concat(request, payload, F.lit('},"response":'), F.to_json(of(body=F.concat(first, second))), F.lit("}"))
    found = wire.codex_captures(as_read(e.select("session", (F.col("seq") + 1).alias("line_no"), value.alias("value"))))
    return found.select("session", "wire_api", "sys_prompt", "tool_names", "runtime", "input", "cached")
