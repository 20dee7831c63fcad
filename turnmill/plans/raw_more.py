"""Queries over raw opencode and openclaw lines made of ``events``, as raw.py does for the other formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.operators import headers, openclaw, opencode, pi
from turnmill.plans.base import query
from turnmill.plans.raw import W, as_read, body, of, stamped, worded


def opencode_log(events: DataFrame) -> DataFrame:
    """A purchase starts a step, a signup finishes one with its usage, a view says something, a click calls, an error is one."""
    e, head, k = stamped(events)
    kind = F.col("kind")
    line = lambda type_, **part: body(type=type_, sessionID="x", part=of(**part))
    state = of(input=of(n=k), output=worded("out ", k), status=F.when(k % 5 == 0, "error").otherwise("completed"), time=of(start=F.lit(1000), end=1000 + k % 4 * 100))
    rest = (
        F.when(kind == "purchase", line("step_start", prompt=F.when(k % 2 == 0, worded(" ask ", k))))
        .when(kind == "view", line("text", text=F.when(k % 7 == 0, "").otherwise(worded("say ", k))))
        .when(kind == "click", line("tool_use", tool=F.when(k % 11 == 0, "task").otherwise(worded("f", k % 3)), state=state))
        .when(kind == "signup", line("step_finish", tokens=of(input=F.floor(F.col("value") * 10), output=k, cache=of(read=k % 5))))
        .otherwise(body(type="error", sessionID="x", error=of(message=worded("bad ", k))))
    )
    return as_read(e.select("session", (F.col("seq") + 1).alias("line_no"), F.concat(head, rest).alias("value")))


_OPENCODE = f"""{W}, i AS (SELECT *, CAST(sum(CASE WHEN kind = 'purchase' OR seq = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS BIGINT) - 1 AS turn_i FROM lines),
    u AS (SELECT session, turn_i, seq, CAST(floor(value * 10) AS BIGINT) AS input, tokens AS output, tokens % 5 AS cached FROM i WHERE kind = 'signup'),
    turns AS (SELECT i.session, i.turn_i, coalesce('ask ' || max(tokens) FILTER (kind = 'purchase' AND tokens % 2 = 0), 'OpenCode stream: ') AS prompt, min_by(ms, i.seq) AS start_ms, max_by(ms, i.seq) AS end_ms, greatest(count(*) FILTER (kind = 'signup'), max(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END)) AS requests,
        CAST(coalesce(sum(tokens) FILTER (kind = 'signup'), 0) AS BIGINT) AS out_tok, coalesce(max(u.input), 0) AS max_input, coalesce(max_by(u.input, u.seq) FILTER (u.input > 0 OR u.output > 0 OR u.cached > 0), 0) AS last_input
        FROM i LEFT JOIN u USING (session, turn_i, seq) GROUP BY i.session, i.turn_i)"""


@query("t3_opencode_turns", _OPENCODE + " SELECT * FROM turns")
def opencode_turns(read):
    return opencode.opencode_turns(opencode.step_events(opencode_log(read("events")), keep=False))


@query("t3_opencode_steps", _OPENCODE + f""", near AS (SELECT i.*, u.input AS in_tok, u.output AS used_tok FROM i LEFT JOIN u USING (session, turn_i) QUALIFY row_number() OVER (PARTITION BY i.session, i.turn_i, i.seq ORDER BY abs(u.seq - i.seq), u.seq) = 1),
    c AS (SELECT *, CASE WHEN tokens % 11 = 0 THEN 'task' ELSE 'f' || tokens % 3 END AS tool, '{{"n":' || tokens || '}}' AS arg FROM near WHERE kind = 'click'),
    made AS (
        SELECT session, turn_i, seq, 0 AS part, ms AS at_ms, CAST(0 AS BIGINT) AS ms, 'm' AS kind, '{pi.MODEL_STEP}' AS name, 'say ' || tokens AS text, '' AS input, '' AS result, false AS is_error, in_tok, used_tok FROM near WHERE kind = 'view' AND tokens % 7 <> 0
        UNION ALL SELECT session, turn_i, seq, 0, ms, 0, 'm', '{pi.MODEL_STEP}', '', arg, '', false, in_tok, used_tok FROM c
        UNION ALL SELECT session, turn_i, seq, 1, ms, tokens % 4 * 100, CASE WHEN tool = 'task' THEN 's' ELSE 't' END, tool, '', arg, 'out ' || tokens, tokens % 5 = 0, in_tok, used_tok FROM c
        UNION ALL SELECT session, turn_i, seq, 0, ms, 0, 'i', '{opencode.ERROR_STEP}', 'bad ' || tokens, '', '', false, in_tok, used_tok FROM near WHERE kind = 'error'
    ), every AS (SELECT * FROM made UNION ALL SELECT session, turn_i, 0, 0, start_ms, 0, 'm', '{pi.MODEL_STEP}', '{opencode.NOTHING}', '', '', false, NULL, NULL FROM turns ANTI JOIN made USING (session, turn_i)),
    n AS (SELECT *, row_number() OVER w - 1 AS step_i, lead(at_ms) OVER w AS nxt FROM every WINDOW w AS (PARTITION BY session, turn_i ORDER BY seq, part))
    SELECT n.session, n.turn_i, step_i, kind, name, text, input, result, is_error, coalesce(in_tok, 0) AS in_tok, coalesce(used_tok, 0) AS used_tok, CASE WHEN ms > 0 THEN ms ELSE greatest(coalesce(nxt, end_ms) - at_ms, 0) END AS ms FROM n JOIN turns USING (session, turn_i)""")
def opencode_steps(read):
    events = opencode.step_events(opencode_log(read("events")))
    return opencode.opencode_steps(events, opencode.opencode_turns(events)).select("session", "turn_i", "step_i", "kind", "name", "text", "input", "result", "is_error", "in_tok", "used_tok", "ms")


@query("a12_opencode_headers", _OPENCODE + """, n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn_i, seq) - 1 AS i FROM u), b AS (SELECT * FROM n WHERE input > 0 QUALIFY row_number() OVER (PARTITION BY session ORDER BY input DESC, i) = 1),
    s AS (SELECT session, min_by(prompt, turn_i) AS title, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(out_tok) AS BIGINT) AS total_output FROM turns GROUP BY session)
    SELECT session, 'opencode' AS model, 'x' AS version, '' AS cwd, title, requests, total_output, b.i AS peak_index, b.input AS peak_tokens, b.turn_i AS peak_turn, CAST(200000 AS BIGINT) AS context_limit FROM s JOIN b USING (session)""")
def opencode_headers(read):
    lines = opencode_log(read("events"))
    events = opencode.step_events(lines)
    turns = opencode.opencode_turns(events)
    return headers.opencode_headers(lines, turns, opencode.opencode_steps(events, turns), events=events)


def openclaw_log(events: DataFrame) -> DataFrame:
    """A purchase and every second signup are a user's chunk, a view is a text or a thought, a click a call, an error an update of one, the other signups tell of usage."""
    e, head, k = stamped(events)
    kind = F.col("kind")
    call, run = worded("c", k % 5), worded("r", k % 4)
    line = lambda run_, **update: body(sessionId="x", runId=run_, update=of(**update))
    words = lambda text: of(type="text", text=text)
    rest = (
        F.when(kind == "purchase", line(worded("r", k % 3), sessionUpdate=openclaw.USER, content=words(F.when(k % 7 == 0, "").otherwise(worded("ask ", k)))))
        .when((kind == "signup") & (k % 2 == 1), line("", sessionUpdate=openclaw.USER, text=worded("more ", k)))
        .when(kind == "signup", line(run, sessionUpdate=openclaw.USAGE, used=F.floor(F.col("value") * 10), size=F.lit(1000)))
        .when(kind == "view", line(run, sessionUpdate=F.when(k % 2 == 0, openclaw.TEXT).otherwise(openclaw.THOUGHT), content=words(worded("say ", k))))
        .when(kind == "click", line(run, sessionUpdate=openclaw.CALL, toolCallId=call, title=F.when(k % 11 == 0, "task").otherwise(worded("f", k % 3)), rawInput=of(n=k)))
        .when(k % 3 == 0, line("", sessionUpdate=openclaw.RESULT, toolCallId=call, status="in_progress"))
        .otherwise(line("", sessionUpdate=openclaw.RESULT, toolCallId=call, status=F.when(k % 3 == 1, "failed").otherwise("completed"), content=F.array(words(worded("out ", k)))))
    )
    return as_read(e.select("session", (F.col("seq") + 1).alias("line_no"), F.concat(head, rest).alias("value")))


#: One line after the other, with the open turn's run, whether the assistant has done anything in it, and its prompt.
_OPENCLAW = f"""{W}, p AS (
        SELECT *, CASE WHEN kind = 'purchase' OR (kind = 'signup' AND tokens % 2 = 1) THEN 'user' WHEN kind = 'signup' THEN 'usage' WHEN kind = 'view' THEN CASE WHEN tokens % 2 = 0 THEN 'text' ELSE 'thought' END WHEN kind = 'click' THEN 'call' ELSE 'result' END AS t,
            CASE WHEN kind = 'purchase' THEN 'r' || tokens % 3 WHEN kind = 'error' OR (kind = 'signup' AND tokens % 2 = 1) THEN '' ELSE 'r' || tokens % 4 END AS run, CASE WHEN kind = 'purchase' THEN CASE WHEN tokens % 7 = 0 THEN '' ELSE 'ask ' || tokens END ELSE 'more ' || tokens END AS said FROM lines
    ), walk(session, seq, turn_i, run, active, prompt) AS (
        SELECT session, seq, CAST(0 AS BIGINT), run, t <> 'user', CASE WHEN t = 'user' AND said <> '' THEN said ELSE 'OpenClaw stream: ' END FROM p WHERE seq = 0
        UNION ALL
        SELECT p.session, p.seq, CASE WHEN new THEN turn_i + 1 ELSE turn_i END, CASE WHEN new THEN p.run ELSE p.open_run END, CASE WHEN p.t = 'user' THEN CASE WHEN new THEN false ELSE p.active END ELSE true END,
            CASE WHEN new THEN CASE WHEN said = '' THEN 'OpenClaw stream: ' ELSE said END WHEN p.t = 'user' AND said <> '' THEN CASE WHEN starts_with(prompt, 'OpenClaw stream:') THEN said ELSE prompt || chr(10) || said END ELSE prompt END
        FROM (SELECT p.*, walk.turn_i, walk.run AS open_run, walk.active, walk.prompt, p.t = 'user' AND (walk.active OR (p.run <> '' AND walk.run <> '' AND p.run <> walk.run)) AS new FROM walk JOIN p ON p.session = walk.session AND p.seq = walk.seq + 1) AS p
    ), i AS (SELECT p.*, walk.turn_i, walk.prompt FROM p JOIN walk USING (session, seq)),
    turns AS (SELECT session, turn_i, max_by(prompt, seq) AS prompt, min_by(ms, seq) AS start_ms, max_by(ms, seq) AS end_ms, count(DISTINCT CASE WHEN t <> 'user' THEN coalesce(nullif(run, ''), '-') END) AS requests,
        CAST(coalesce(max(floor(value * 10)) FILTER (t = 'usage'), 0) AS BIGINT) AS max_input, CAST(coalesce(max_by(floor(value * 10), seq) FILTER (t = 'usage' AND floor(value * 10) > 0), 0) AS BIGINT) AS last_input FROM i GROUP BY session, turn_i)"""


@query("t4_openclaw_turns", _OPENCLAW + " SELECT * FROM turns")
def openclaw_turns(read):
    return openclaw.openclaw_turns(openclaw.update_events(openclaw_log(read("events"))))


@query("t4_openclaw_steps", _OPENCLAW + f""", k AS (SELECT * FROM i WHERE t IN ('text', 'thought', 'call') OR (t = 'result' AND tokens % 3 <> 0)),
    r AS (SELECT *, sum(CASE WHEN prev = t AND t IN ('text', 'thought') THEN 0 ELSE 1 END) OVER (PARTITION BY session, turn_i ORDER BY seq) AS r FROM (SELECT *, lag(t) OVER (PARTITION BY session, turn_i ORDER BY seq) AS prev FROM k)),
    called AS (SELECT *, last_value(CASE WHEN t = 'call' THEN {{'name': CASE WHEN tokens % 11 = 0 THEN 'task' ELSE 'f' || tokens % 3 END, 'arg': '{{"n":' || tokens || '}}'}} END IGNORE NULLS) OVER (PARTITION BY session, turn_i, tokens % 5 ORDER BY seq) AS c FROM r WHERE t IN ('call', 'result')),
    s AS (
        SELECT session, turn_i, r, min(ms) AS at_ms, 'm' AS kind, '{pi.MODEL_STEP}' AS name, string_agg('say ' || tokens, '' ORDER BY seq) AS text, '' AS input, '' AS result, false AS is_error FROM r WHERE t IN ('text', 'thought') GROUP BY session, turn_i, r
        UNION ALL SELECT session, turn_i, r, ms, 'm', '{pi.MODEL_STEP}', '', c.arg, '', false FROM called WHERE t = 'call'
        UNION ALL SELECT session, turn_i, r, ms, CASE WHEN coalesce(c.name, '') = 'task' THEN 's' ELSE 't' END, coalesce(c.name, 'c' || tokens % 5), '', coalesce(c.arg, ''), 'out ' || tokens, tokens % 3 = 1 FROM called WHERE t = 'result'
    ), n AS (SELECT *, row_number() OVER w - 1 AS step_i, lead(at_ms) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY session, turn_i ORDER BY r))
    SELECT n.session, n.turn_i, step_i, kind, name, text, input, result, is_error, greatest(coalesce(nxt, end_ms) - at_ms, 0) AS ms FROM n JOIN turns USING (session, turn_i)""")
def openclaw_steps(read):
    events = openclaw.update_events(openclaw_log(read("events")))
    return openclaw.openclaw_steps(events, openclaw.openclaw_turns(events)).select("session", "turn_i", "step_i", "kind", "name", "text", "input", "result", "is_error", "ms")
