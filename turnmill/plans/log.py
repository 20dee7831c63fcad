"""Queries over ``events`` as an agent's log: purchase opens a turn, error is a compaction, value is token usage, event_type names the tool."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.operators import timeline as L
from turnmill.operators import turns as T
from turnmill.operators.windows import carried, first_of, islands, ordinal, over, running, top_of, up_to
from turnmill.plans.base import EVENT_LINES, event_lines, query

S = ["session"]
OPEN, CLOSE = "purchase", "signup"
W = "WITH " + EVENT_LINES
RUN = "(PARTITION BY session ORDER BY seq)"
TURNED = f"""{W}, turns AS (SELECT *, CAST(sum(CASE WHEN kind = 'purchase' OR seq = 0 THEN 1 ELSE 0 END) OVER {RUN} AS BIGINT) - 1 AS turn_i FROM lines)"""
PER_TURN = TURNED + """, per AS (SELECT session, turn_i, count(*) AS lines, min(ms) AS start_ms, max(ms) AS end_ms, coalesce(max(value) FILTER (kind = 'view'), 0) AS total, CAST(sum(tokens) AS BIGINT) AS tokens, bool_or(kind = 'error') AS failed FROM turns GROUP BY session, turn_i)"""


def turned(read):
    return T.opened_turns(event_lines(read("events")), F.col("kind") == OPEN)


def per_turn(read):
    return turned(read).groupBy("session", "turn_i").agg(
        F.count("*").alias("lines"), F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.coalesce(F.max(F.when(F.col("kind") == "view", F.col("value"))), F.lit(0.0)).alias("total"), F.sum("tokens").alias("tokens"), F.max(F.col("kind") == "error").alias("failed")
    )


@query("t3_opened_turns", TURNED + " SELECT session, seq, turn_i FROM turns")
def opened_turns(read):
    return turned(read).select("session", "seq", "turn_i")


@query("t2_closed_turns", f"""{W}, s AS (SELECT *, sum(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER {RUN} AS o,
        last_value(CASE WHEN kind = 'purchase' THEN 1 WHEN kind = 'signup' THEN 0 END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS st,
        last_value(CASE WHEN kind = 'purchase' THEN 1 WHEN kind = 'signup' THEN 0 END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM lines)
    SELECT session, seq, CAST(o - 1 AS BIGINT) AS turn_i FROM s WHERE st = 1 OR (kind = 'signup' AND b = 1)""")
def closed_turns(read):
    return T.closed_turns(event_lines(read("events")), F.col("kind") == OPEN, F.col("kind") == CLOSE).select("session", "seq", "turn_i")


@query("t8_compaction_epochs", PER_TURN + """, l AS (SELECT *, last_value(nullif(total, 0) IGNORE NULLS) OVER (PARTITION BY session ORDER BY turn_i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM per),
    r AS (SELECT session, turn_i, total, coalesce(total > 0 AND total < 0.5 * prev, false) AS reset FROM l)
    SELECT *, CAST(sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY turn_i) AS BIGINT) AS epoch FROM r""")
def compaction_epochs(read):
    return T.epochs(per_turn(read)).select("session", "turn_i", "total", "reset", "epoch")


@query("t11_carried_totals", PER_TURN + """, c AS (SELECT session, turn_i, coalesce(last_value(nullif(total, 0) IGNORE NULLS) OVER (PARTITION BY session ORDER BY turn_i ROWS UNBOUNDED PRECEDING), 0) AS cum_total FROM per)
    SELECT *, coalesce(cum_total < lag(cum_total) OVER (PARTITION BY session ORDER BY turn_i), false) AS dropped FROM c""")
def carried_totals(read):
    return T.totals_carried(per_turn(read)).select("session", "turn_i", "cum_total", "dropped")


@query("t12_running_peak", PER_TURN + " SELECT session, turn_i, max(total) OVER (PARTITION BY session ORDER BY turn_i) AS peak FROM per")
def running_peak(read):
    return per_turn(read).select("session", "turn_i", F.max("total").over(up_to(S, ["turn_i"])).alias("peak"))


@query("t13_tool_totals", f"""{W}, e AS (SELECT *, sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER {RUN} AS epoch FROM lines)
    SELECT session, seq, kind, CAST(epoch AS BIGINT) AS epoch, count(*) OVER w AS calls, CAST(sum(tokens) OVER w AS BIGINT) AS result_tokens FROM e WINDOW w AS (PARTITION BY session, epoch, kind ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def tool_totals(read):
    return L.tool_totals(event_lines(read("events")), F.col("kind") == "error").select("session", "seq", "kind", "epoch", "calls", "result_tokens")


@query("t14_shared_durations", f"""{W}, t AS (SELECT *, (ms // 20000000) * 20000000 AS m FROM lines), k AS (SELECT *, sum(CASE WHEN m IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER {RUN} AS moment FROM (SELECT *, lag(m) OVER {RUN} AS p FROM t)),
    g AS (SELECT session, moment, max(m) AS m0, sum(tokens + 1) AS ws, sum(tokens) AS o, max(m) + 40000 AS until, max(seq) AS last_seq FROM k GROUP BY session, moment),
    s AS (SELECT *, coalesce(lead(m0) OVER (PARTITION BY session ORDER BY moment) - m0, CASE WHEN until - m0 > 30000 THEN floor(o / 30 + 0.5) * 1000 ELSE until - m0 END) AS span FROM g),
    j AS (SELECT k.session, k.seq, s.span, s.last_seq, k.moment, greatest(1, floor(s.span * (k.tokens + 1) / s.ws)) AS share FROM k JOIN s USING (session, moment))
    SELECT session, seq, CAST(CASE WHEN seq = last_seq THEN greatest(1, span - coalesce(sum(share) OVER (PARTITION BY session, moment ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) ELSE share END AS BIGINT) AS lasts FROM j""")
def shared_durations(read):
    lines = event_lines(read("events")).withColumn("ms", F.floor(F.col("ms") / 20_000_000) * 20_000_000)
    return L.shared_gaps(lines, F.col("tokens"), F.col("ms") + 40_000).select("session", "seq", "lasts")


@query("t15_next_step_durations", f"{W} SELECT session, seq, CAST(greatest(0, coalesce(lead(ms) OVER {RUN} - ms, 0)) AS BIGINT) AS lasts FROM lines")
def next_step_durations(read):
    return L.gaps(event_lines(read("events")), S, ["seq"]).select("session", "seq", "lasts")


@query("t16_idle_gaps", PER_TURN + ", g AS (SELECT session, turn_i, start_ms - lag(end_ms) OVER (PARTITION BY session ORDER BY turn_i) AS idle FROM per) SELECT * FROM g WHERE idle > 1000")
def idle_gaps(read):
    return L.idle(per_turn(read))


@query("t18_text_once_per_turn", TURNED + " SELECT session, turn_i, kind, min(seq) AS seq FROM turns GROUP BY session, turn_i, kind")
def text_once_per_turn(read):
    return first_of(turned(read), ["session", "turn_i", "kind"], ["seq"]).select("session", "turn_i", "kind", "seq")


@query("t19_step_groups", f"""{W}, g AS (SELECT *, sum(CASE WHEN kind = 'view' AND p IS DISTINCT FROM 'view' OR p IS NULL THEN 1 ELSE 0 END) OVER {RUN} AS step FROM (SELECT *, lag(kind) OVER {RUN} AS p FROM lines))
    SELECT session, seq, CAST(step AS BIGINT) AS step, count(*) OVER w AS size, seq = max(seq) OVER w AS is_end FROM g WINDOW w AS (PARTITION BY session, step)""")
def step_groups(read):
    return L.step_groups(event_lines(read("events")), F.col("kind") == "view").select("session", "seq", "step", "size", "is_end")


@query("a1_request_totals", f"{W} SELECT session, count(*) FILTER (kind = 'view') AS requests, round(coalesce(sum(value) FILTER (kind = 'view'), 0), 4) AS total_output FROM lines GROUP BY session")
def request_totals(read):
    view = F.col("kind") == "view"
    return event_lines(read("events")).groupBy("session").agg(F.count_if(view).alias("requests"), F.round(F.coalesce(F.sum(F.when(view, F.col("value"))), F.lit(0.0)), 4).alias("total_output"))


@query("a2_peak_request", TURNED + """ SELECT session, seq, turn_i, value FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY value DESC, seq) AS n FROM turns WHERE kind = 'view') WHERE n = 1""")
def peak_request(read):
    best = turned(read).where("kind = 'view'").groupBy("session").agg(F.max_by(F.struct("seq", "turn_i", "value"), F.struct("value", -F.col("seq"))).alias("x"))
    return best.select("session", "x.*")


@query("a4_request_series", TURNED + """, t AS (SELECT session, turn_i, sum(tokens) AS assembled FROM turns GROUP BY session, turn_i)
    SELECT session, row_number() OVER (PARTITION BY session ORDER BY seq) - 1 AS i, CAST(assembled AS BIGINT) AS assembled, value AS input, tokens AS output FROM turns JOIN t USING (session, turn_i) WHERE kind = 'view'""")
def request_series(read):
    lines = turned(read)
    total = lines.groupBy("session", "turn_i").agg(F.sum("tokens").alias("assembled"))
    return ordinal(lines.where("kind = 'view'").join(total, ["session", "turn_i"]), S, ["seq"], "i").select("session", "i", "assembled", F.col("value").alias("input"), F.col("tokens").alias("output"))


@query("a5_tool_totals", f"{W} SELECT session, kind AS tool, count(*) AS calls, CAST(sum(CAST(floor(tokens / 4.0 + 0.5) AS BIGINT)) AS BIGINT) AS result_tokens FROM lines GROUP BY session, kind")
def tool_sums(read):
    return event_lines(read("events")).groupBy("session", F.col("kind").alias("tool")).agg(F.count("*").alias("calls"), F.sum(F.floor(F.col("tokens") / 4.0 + 0.5).cast("long")).alias("result_tokens"))


@query("a6_tool_maxima", PER_TURN + f""", t AS (SELECT session, turn_i, kind AS tool, count(*) AS calls, sum(tokens) AS tok FROM turns GROUP BY session, turn_i, kind), c AS (SELECT *, sum(tok) OVER (PARTITION BY session, tool ORDER BY turn_i) AS cum FROM t)
    SELECT session, tool, CAST(sum(calls) AS BIGINT) AS calls, CAST(max(cum) AS BIGINT) AS result_tokens, bool_or(tool = 'signup') AS task FROM c GROUP BY session, tool""")
def tool_maxima(read):
    each = turned(read).groupBy("session", "turn_i", F.col("kind").alias("tool")).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tok"))
    total = running(each, ["session", "tool"], ["turn_i"], F.col("tok"), "cum")
    return total.groupBy("session", "tool").agg(F.sum("calls").alias("calls"), F.max("cum").alias("result_tokens"), F.max(F.col("tool") == "signup").alias("task"))


@query("a7_tool_histogram", TURNED + " SELECT session, turn_i, kind AS tool, count(*) AS n FROM turns GROUP BY session, turn_i, kind")
def tool_histogram(read):
    return turned(read).groupBy("session", "turn_i", F.col("kind").alias("tool")).agg(F.count("*").alias("n"))


@query("a8_turn_peaks", TURNED + " SELECT session, turn_i, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY session, turn_i ORDER BY value DESC, seq) AS n FROM turns) WHERE n = 1")
def turn_peaks(read):
    return first_of(turned(read), ["session", "turn_i"], ["-value", "seq"]).select("session", "turn_i", "seq", "value")


@query("a9_turn_metrics", TURNED + """, d AS (SELECT *, greatest(0, coalesce(lead(ms) OVER (PARTITION BY session, turn_i ORDER BY seq) - ms, 0)) AS lasts FROM turns)
    SELECT session, turn_i, CAST(coalesce(sum(lasts) FILTER (kind = 'view'), 0) AS BIGINT) AS model_ms, CAST(coalesce(sum(lasts) FILTER (kind IN ('click', 'error')), 0) AS BIGINT) AS tool_ms, CAST(coalesce(sum(lasts) FILTER (kind = 'signup'), 0) AS BIGINT) AS sub_ms,
           count(*) AS steps, arg_max(seq, lasts * 100000 - seq) AS longest FROM d GROUP BY session, turn_i""")
def turn_metrics(read):
    d = L.gaps(turned(read), ["session", "turn_i"], ["seq"])
    part = lambda *k: F.coalesce(F.sum(F.when(F.col("kind").isin(*k), F.col("lasts"))), F.lit(0)).cast("long")
    return d.groupBy("session", "turn_i").agg(part("view").alias("model_ms"), part("click", "error").alias("tool_ms"), part("signup").alias("sub_ms"), F.count("*").alias("steps"), F.max_by("seq", F.struct("lasts", -F.col("seq"))).alias("longest"))


@query("a10_usage_after_compaction", f"""{W}, c AS (SELECT *, max(CASE WHEN kind = 'error' THEN seq ELSE -1 END) OVER (PARTITION BY session) AS cut FROM lines)
    SELECT session, count(*) FILTER (kind = 'view') AS n, max(value) FILTER (kind = 'view') AS most, arg_max(value, seq) FILTER (kind = 'view' AND seq > cut) AS last_after, round(sum(value) FILTER (kind = 'view'), 4) AS total FROM c GROUP BY session""")
def usage_after_compaction(read):
    lines = event_lines(read("events"))
    cut = lines.groupBy("session").agg(F.max(F.when(F.col("kind") == "error", F.col("seq")).otherwise(-1)).alias("cut"))
    view, after = F.col("kind") == "view", (F.col("kind") == "view") & (F.col("seq") > F.col("cut"))
    return lines.join(cut, "session").groupBy("session").agg(F.count_if(view).alias("n"), F.max(F.when(view, F.col("value"))).alias("most"), F.max_by(F.when(after, F.col("value")), F.when(after, F.col("seq"))).alias("last_after"), F.round(F.sum(F.when(view, F.col("value"))), 4).alias("total"))


@query("a11_request_counts", PER_TURN + ", n AS (SELECT session, turn_i, count(*) FILTER (kind = 'view') AS v, bool_or(kind = 'purchase') AS opened FROM turns GROUP BY session, turn_i) SELECT session, CAST(sum(greatest(v, CASE WHEN opened THEN 1 ELSE 0 END)) AS BIGINT) AS requests FROM n GROUP BY session")
def request_counts(read):
    n = turned(read).groupBy("session", "turn_i").agg(F.count_if(F.col("kind") == "view").alias("v"), F.max((F.col("kind") == OPEN).cast("int")).alias("opened"))
    return n.groupBy("session").agg(F.sum(F.greatest("v", "opened")).cast("long").alias("requests"))


@query("a18_monitor_snapshot", PER_TURN + """, l AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn_i DESC) AS back, total - lag(total) OVER (PARTITION BY session ORDER BY turn_i) AS delta FROM per)
    SELECT session, max(turn_i) AS last_turn, arg_max(total, turn_i) AS last_total, round(coalesce(arg_max(delta, turn_i) FILTER (delta IS NOT NULL), 0), 6) AS last_delta, CAST(sum(lines) AS BIGINT) AS lines5, round(avg(tokens), 6) AS mean_tokens, round(100 * arg_max(total, turn_i) / 200, 6) AS pct FROM l WHERE back <= 5 GROUP BY session""")
def monitor_snapshot(read):
    from turnmill.operators.monitor import snapshot

    return snapshot(per_turn(read), 200)


@query("a19_alerts", PER_TURN + """, l AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn_i DESC) AS back FROM per), s AS (
        SELECT session, arg_max(total, turn_i) / 2 AS pct, arg_max(failed, turn_i) AS last_reset, avg(lines) AS mean_calls, count(*) AS n, avg(tokens) FILTER (back <= 3) AS late, avg(tokens) FILTER (back > least(5, k) - 3) AS early
        FROM (SELECT *, count(*) OVER (PARTITION BY session) AS k FROM l WHERE back <= 5) GROUP BY session)
    SELECT session, CASE WHEN pct > 90 THEN 'critical' WHEN pct > 75 THEN 'high' ELSE 'none' END AS fill, coalesce(last_reset, false) AS reset, mean_calls > 15 AS busy, coalesce(n >= 3 AND late < 0.5 * early, false) AS cold FROM s""")
def alerts(read):
    from turnmill.operators.monitor import alerts as rules

    return rules(per_turn(read), 200)


@query("j5_nearest_usage", f"""{W}, x AS (SELECT l.session, l.seq, u.value AS usage, row_number() OVER (PARTITION BY l.session, l.seq ORDER BY abs(l.seq - u.seq), u.seq) AS n FROM lines AS l LEFT JOIN (SELECT * FROM lines WHERE kind = 'view') AS u ON l.session = u.session)
    SELECT session, seq, usage FROM x WHERE n = 1""")
def nearest_usage(read):
    return L.nearest(event_lines(read("events")), F.col("kind") == "view", "value", "usage").select("session", "seq", "usage")


@query("j6_step_nearest_peak", f"""{W}, p AS (SELECT session, arg_max(ms, tokens * 100000 - seq) AS peak_ms FROM lines GROUP BY session) SELECT session, seq FROM (SELECT l.session, l.seq, row_number() OVER (PARTITION BY l.session ORDER BY abs(l.ms - p.peak_ms), l.seq) AS n FROM lines AS l JOIN p USING (session) WHERE l.kind = 'click') WHERE n = 1""")
def step_nearest_peak(read):
    lines = event_lines(read("events"))
    peak = lines.groupBy("session").agg(F.max_by("ms", F.struct("tokens", -F.col("seq"))).alias("peak_ms"))
    return lines.where("kind = 'click'").join(peak, "session").groupBy("session").agg(F.min_by("seq", F.struct(F.abs(F.col("ms") - F.col("peak_ms")), F.col("seq"))).alias("seq"))


@query("j7_as_of_call", f"""{W}, a AS (SELECT l.session, l.seq, c.seq AS call_seq, row_number() OVER (PARTITION BY l.session, l.seq ORDER BY c.ms DESC, c.seq) AS n FROM lines AS l LEFT JOIN (SELECT * FROM lines WHERE kind = 'signup') AS c ON l.session = c.session AND c.ms <= l.ms WHERE l.kind = 'purchase') SELECT session, seq, call_seq FROM a WHERE n = 1""")
def as_of_call(read):
    return L.as_of(event_lines(read("events")), F.col("kind") == "signup", "seq", "call_seq").where("kind = 'purchase'").select("session", "seq", "call_seq")


@query("j8_last_call_of_turn", TURNED + " SELECT session, turn_i, max(seq) AS seq FROM turns WHERE kind = 'signup' GROUP BY session, turn_i")
def last_call_of_turn(read):
    return turned(read).where("kind = 'signup'").groupBy("session", "turn_i").agg(F.max("seq").alias("seq"))


@query("j1_call_results", TURNED + """, c AS (SELECT session, turn_i, seq, tokens % 5 AS id FROM turns WHERE kind = 'click'), r AS (SELECT session, turn_i, seq AS result_seq, tokens % 5 AS id, value FROM turns WHERE kind = 'view'),
    f AS (SELECT session, turn_i, id, arg_min(value, result_seq) AS content FROM r GROUP BY session, turn_i, id)
    SELECT c.session, c.turn_i, c.seq, r.result_seq, f.content FROM c LEFT JOIN r USING (session, turn_i, id) LEFT JOIN f USING (session, turn_i, id)""")
def call_results(read):
    from turnmill.operators.pairing import calls_with_results

    lines = turned(read).withColumn("id", F.col("tokens") % 5)
    return calls_with_results(lines.where("kind = 'click'"), lines.where("kind = 'view'"))


@query("j2_result_tools", TURNED + """, c AS (SELECT session, turn_i, tokens % 5 AS id, arg_max(event_id, seq) AS tool FROM turns WHERE kind = 'click' GROUP BY session, turn_i, id)
    SELECT t.session, t.seq, coalesce(CAST(c.tool AS VARCHAR), 'unknown') AS tool FROM turns AS t LEFT JOIN c ON t.session = c.session AND t.turn_i = c.turn_i AND t.tokens % 5 = c.id WHERE t.kind = 'view'""")
def result_tools(read):
    lines = turned(read).withColumn("id", F.col("tokens") % 5)
    calls = lines.where("kind = 'click'").groupBy("session", "turn_i", "id").agg(F.max_by("event_id", "seq").alias("tool"))
    return lines.where("kind = 'view'").join(calls, ["session", "turn_i", "id"], "left").select("session", "seq", F.coalesce(F.col("tool").cast("string"), F.lit("unknown")).alias("tool"))


@query("j3_attributed_tokens", f"""{W}, c AS (SELECT DISTINCT session, seq, tokens % 7 AS id, kind FROM lines WHERE kind IN ('click', 'signup')) SELECT c.session, c.kind AS tool, CAST(sum(r.tokens) AS BIGINT) AS tokens FROM c JOIN (SELECT * FROM lines WHERE kind = 'view') AS r ON c.session = r.session AND c.id = r.tokens % 7 GROUP BY c.session, c.kind""")
def attributed_tokens(read):
    from turnmill.operators.pairing import attributed

    lines = event_lines(read("events")).withColumn("id", F.col("tokens") % 7)
    return attributed(lines.where("kind in ('click', 'signup')"), lines.where("kind = 'view'"))


@query("j4_last_result", TURNED + """, r AS (SELECT session, turn_i, tokens % 5 AS id, arg_max(value, CASE WHEN kind = 'view' THEN 1000000 + seq ELSE -seq END) AS result FROM turns WHERE kind IN ('view', 'error') GROUP BY session, turn_i, id)
    SELECT t.session, t.seq, r.result, r.result IS NULL AS missing FROM turns AS t LEFT JOIN r ON t.session = r.session AND t.turn_i = r.turn_i AND t.tokens % 5 = r.id WHERE t.kind = 'click'""")
def last_result(read):
    from turnmill.operators.pairing import calls_with_last_result

    lines = turned(read).withColumn("id", F.col("tokens") % 5)
    return calls_with_last_result(lines.where("kind = 'click'"), lines.where("kind in ('view', 'error')"), F.col("kind") == "error")


@query("j14_shards_touched", PER_TURN + """, b AS (SELECT session, turn_i // 4 AS shard, min(turn_i) AS a, max(turn_i) AS z FROM per GROUP BY session, shard)
    SELECT t.session, t.kind, count(DISTINCT b.shard) AS shards FROM turns AS t JOIN b ON t.session = b.session AND t.turn_i BETWEEN b.a AND b.z GROUP BY t.session, t.kind""")
def shards_touched(read):
    lines = turned(read)
    # Shards are runs of four turns, so a turn's number names its shard.
    return lines.groupBy("session", "kind").agg(F.count_distinct(F.floor(F.col("turn_i") / 4)).alias("shards"))


@query("a24_evidence_scores", f"""{W}, e AS (SELECT session, count(*) AS n, count(DISTINCT kind) AS k, max(CASE kind WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.9 WHEN 'click' THEN 0.6 ELSE 0.45 END * least(1, value / 50)) AS top FROM lines GROUP BY session)
    SELECT session, round(least(1, top + least(0.16, ln(1 + greatest(0, n - 1)) * 0.06) + least(0.10, (k - 1) * 0.04)), 9) AS score FROM e""")
def evidence_scores(read):
    from turnmill.operators.graph import evidence_score

    return evidence_score(evidence(read), ["session"]).select("session", F.round("score", 9).alias("score"))


def evidence(read):
    """Lines as evidence: the kind names the source."""
    named = F.when(F.col("kind") == "purchase", "user").when(F.col("kind") == "signup", "reply").when(F.col("kind") == "click", "tool_summary").otherwise("reasoning_summary")
    cap = F.when(F.col("kind") == "purchase", 1.0).when(F.col("kind") == "signup", 0.9).when(F.col("kind") == "click", 0.6).otherwise(0.45)
    return turned(read).select("session", "turn_i", "seq", "kind", named.alias("source"), (cap * F.least(F.lit(1.0), F.col("value") / 50)).alias("weight"), F.col("tokens").cast("string").alias("text"))


@query("a25_confidence", TURNED + """, g AS (SELECT session, kind, count(*) AS n, max(CASE kind WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.9 WHEN 'click' THEN 0.6 ELSE 0.45 END * least(1, value / 50)) AS top, count(DISTINCT turn_i) AS t, count(DISTINCT turn_i // 4) AS shards FROM turns GROUP BY session, kind),
    s AS (SELECT *, least(1, top + least(0.16, ln(1 + greatest(0, n - 1)) * 0.06)) AS score FROM g),
    c AS (SELECT session, kind, (score * 0.62 + least(0.18, ln(1 + greatest(1, t)) * 0.075) + 0.5 * 0.12) * (1 + 0.06 * least(shards - 1, 3)) * 0.9 AS c FROM s)
    SELECT session, kind, round(least(0.95, greatest(0.25, CASE WHEN kind IN ('view', 'error') THEN least(c, 0.55) WHEN kind = 'click' THEN least(c, 0.65) ELSE c END)), 9) AS conf FROM c""")
def confidence(read):
    from turnmill.operators.graph import confidence as conf
    from turnmill.operators.graph import evidence_score

    ev = evidence(read)
    scored = evidence_score(ev, ["session", "kind"])
    support = ev.groupBy("session", "kind").agg(F.count_distinct("turn_i").alias("turns"), F.count_distinct(F.floor(F.col("turn_i") / 4)).alias("shards"))
    return scored.join(support, ["session", "kind"]).select("session", "kind", F.round(conf(F.lit(0.5), F.lit(False)), 9).alias("conf"))


@query("a26_status", f"""{W} SELECT session, CASE WHEN bool_or(kind IN ('purchase', 'signup')) THEN 'confirmed' WHEN bool_and(kind IN ('view', 'error')) THEN 'needs_confirmation' ELSE 'inferred' END AS status FROM lines GROUP BY session""")
def status(read):
    from turnmill.operators.graph import evidence_score
    from turnmill.operators.graph import status as of

    return evidence_score(evidence(read), ["session"]).select("session", of(F.lit(None).cast("string")).alias("status"))


@query("a27_top_evidence", TURNED + """, e AS (SELECT session, turn_i, CASE kind WHEN 'purchase' THEN 'user' WHEN 'signup' THEN 'reply' WHEN 'click' THEN 'tool_summary' ELSE 'reasoning_summary' END AS source, CAST(tokens AS VARCHAR) AS text, seq, round(CASE kind WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.9 WHEN 'click' THEN 0.6 ELSE 0.45 END * least(1, value / 50), 9) AS weight FROM turns),
    d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, turn_i, source, text ORDER BY seq) AS n FROM e) WHERE n = 1)
    SELECT session, turn_i, source, text, weight FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn_i, weight DESC, source, seq) AS k FROM d) WHERE k <= 8""")
def top_evidence(read):
    once = first_of(evidence(read).withColumn("weight", F.round("weight", 9)), ["session", "turn_i", "source", "text"], ["seq"])
    return top_of(once, S, ["turn_i", F.desc("weight"), "source", "seq"], 8).select("session", "turn_i", "source", "text", "weight")


@query("a29_shard_progress", f"""{W} SELECT session, count(*) FILTER (kind = 'purchase') AS done, count(*) FILTER (kind = 'error') AS failed, arg_max(tokens, seq) AS config FROM lines GROUP BY session""")
def shard_progress(read):
    return event_lines(read("events")).groupBy("session").agg(F.count_if(F.col("kind") == "purchase").alias("done"), F.count_if(F.col("kind") == "error").alias("failed"), F.max_by("tokens", "seq").alias("config"))


@query("a31_evidence_notes", f"""{W}, c AS (SELECT session, kind, count(*) AS n FROM lines GROUP BY session, kind) SELECT session, string_agg(kind || ': ' || n, '; ' ORDER BY kind) AS note FROM c GROUP BY session""")
def evidence_notes(read):
    counts = event_lines(read("events")).groupBy("session", "kind").agg(F.count("*").alias("n"))
    return counts.groupBy("session").agg(F.array_join(F.array_sort(F.collect_list(F.concat("kind", F.lit(": "), "n"))), "; ").alias("note"))


@query("a33_exact_tool_override", f"""{W}, s AS (SELECT session, coalesce(sum(tokens) FILTER (kind = 'signup'), 0) AS task, coalesce(sum(tokens) FILTER (kind <> 'signup'), 0) AS other FROM lines GROUP BY session)
    SELECT session, CAST(CASE WHEN task > 0 THEN task ELSE 11 END AS BIGINT) AS subagent, CAST(CASE WHEN other > 0 THEN other ELSE 22 END AS BIGINT) AS "toolResults" FROM s""")
def exact_tool_override(read):
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("tokens"))), F.lit(0)).cast("long")
    sums = event_lines(read("events")).groupBy("session").agg(part(F.col("kind") == "signup").alias("a"), part(F.col("kind") != "signup").alias("b"))
    return sums.select("session", F.when(F.col("a") > 0, F.col("a")).otherwise(11).cast("long").alias("subagent"), F.when(F.col("b") > 0, F.col("b")).otherwise(22).cast("long").alias("toolResults"))


@query("o7_latest_config", f"{W} SELECT session, arg_max(event_id, seq) AS event_id FROM lines WHERE kind = 'purchase' GROUP BY session")
def latest_config(read):
    return event_lines(read("events")).where("kind = 'purchase'").groupBy("session").agg(F.max_by("event_id", "seq").alias("event_id"))


@query("o9_newest_active", """SELECT user_id AS session, max(epoch_us(ts) // 1000) AS ms FROM events GROUP BY user_id HAVING max(epoch_us(ts) // 1000) >= (SELECT max(epoch_us(ts) // 1000) - 1800000 FROM events) ORDER BY ms DESC, session LIMIT 1""")
def newest_active(read):
    seen = event_lines(read("events")).groupBy("session").agg(F.max("ms").alias("ms"))
    last = seen.agg((F.max("ms") - 1_800_000).alias("least"))
    return seen.join(F.broadcast(last), F.col("ms") >= F.col("least")).orderBy(F.desc("ms"), "session").limit(1).select("session", "ms")


@query("s17_first_tools", f"""{W}, f AS (SELECT session, kind, min(seq) AS first_seq FROM lines GROUP BY session, kind), t AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY first_seq) AS n FROM f)
    SELECT session, string_agg(kind, ',' ORDER BY first_seq) AS tools FROM t WHERE n <= 3 GROUP BY session""")
def first_tools(read):
    first = event_lines(read("events")).groupBy("session", "kind").agg(F.min("seq").alias("first_seq"))
    kept = top_of(first, S, ["first_seq"], 3)
    return kept.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_seq", "kind"))), lambda x: x["kind"]), ",").alias("tools"))


@query("s22_latest_wins", "SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_wins(read):
    from turnmill.sources.tables import upserted

    e = read("events")
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    return upserted(old, new, ["user_id", "event_type"], ["-ts", "-event_id"]).select("user_id", "event_type", "value", "event_id")


@query("u4_shard_replacement", """WITH o AS (SELECT user_id, event_type, max(event_id) AS event_id, false AS fresh FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL), n AS (SELECT user_id, event_type, max(event_id) AS event_id, true AS fresh FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_type <> 'error' GROUP BY ALL)
    SELECT * FROM n UNION ALL SELECT o.* FROM o ANTI JOIN n USING (user_id, event_type)""")
def shard_replacement(read):
    cut = F.to_timestamp(F.lit("2024-01-15"))
    e = read("events").withColumn("ts", F.col("ts").cast("timestamp"))
    side = lambda rows, fresh: rows.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id")).withColumn("fresh", F.lit(fresh))
    new = side(e.where((F.col("ts") >= cut) & (F.col("event_type") != "error")), True)
    return new.unionByName(side(e.where(F.col("ts") < cut), False).join(new, ["user_id", "event_type"], "left_anti"))


@query("w3_next_turn_start", PER_TURN + " SELECT session, turn_i, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY session ORDER BY turn_i), 9223372036854775807) AS until FROM per")
def next_turn_start(read):
    return per_turn(read).select("session", "turn_i", "start_ms", F.coalesce(F.lead("start_ms").over(over(S, ["turn_i"])), F.lit(9223372036854775807)).alias("until"))


@query("w5_carried_usage", f"{W} SELECT session, seq, last_value(CASE WHEN kind = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS usage FROM lines")
def carried_usage(read):
    return carried(event_lines(read("events")), S, ["seq"], F.when(F.col("kind") == "view", F.col("value")), "usage").select("session", "seq", "usage")


@query("w7_last_five", f"{W} SELECT session, seq, round(avg(tokens) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean5 FROM lines")
def last_five(read):
    return event_lines(read("events")).select("session", "seq", F.round(F.avg("tokens").over(over(S, ["seq"]).rowsBetween(-4, 0)), 6).alias("mean5"))


@query("w8_kind_runs", f"""{W}, g AS (SELECT *, sum(CASE WHEN kind IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER {RUN} AS run FROM (SELECT *, lag(kind) OVER {RUN} AS p FROM lines)) SELECT session, CAST(run AS BIGINT) AS run, any_value(kind) AS kind, count(*) AS n FROM g GROUP BY session, run""")
def kind_runs(read):
    new = F.coalesce(F.col("kind") != F.lag("kind").over(over(S, ["seq"])), F.lit(True))
    return islands(event_lines(read("events")), S, ["seq"], new, "run").groupBy("session", "run").agg(F.first("kind").alias("kind"), F.count("*").alias("n"))


CATEGORIES = f"{W}, c AS (SELECT session, kind AS category, CAST(sum(tokens) AS BIGINT) AS tokens FROM lines GROUP BY session, kind)"


def categories(read):
    return event_lines(read("events")).groupBy("session", F.col("kind").alias("category")).agg(F.sum("tokens").alias("tokens"))


@query("w9_scaled_categories", CATEGORIES + """, p AS (SELECT *, floor(tokens * 1000 / sum(tokens) OVER (PARTITION BY session) + 0.5) AS part, row_number() OVER (PARTITION BY session ORDER BY tokens DESC, category) AS n FROM c)
    SELECT session, category, tokens, CAST(part + CASE WHEN n = 1 THEN 1000 - sum(part) OVER (PARTITION BY session) ELSE 0 END AS BIGINT) AS scaled FROM p""")
def scaled_categories(read):
    return L.shares(categories(read), S, "tokens", "scaled", F.lit(1000)).select("session", "category", "tokens", "scaled")


@query("w10_bars_of_maximum", CATEGORIES + " SELECT session, category, round(100.0 * tokens / max(tokens) OVER (PARTITION BY session), 6) AS bar FROM c")
def bars_of_maximum(read):
    return categories(read).select("session", "category", F.round(100.0 * F.col("tokens") / F.max("tokens").over(L.whole(S)), 6).alias("bar"))


@query("w11_cumulative_stops", CATEGORIES + " SELECT session, category, round(100.0 * sum(tokens) OVER (PARTITION BY session ORDER BY category) / sum(tokens) OVER (PARTITION BY session), 6) AS stop FROM c")
def cumulative_stops(read):
    return categories(read).select("session", "category", F.round(100.0 * F.sum("tokens").over(up_to(S, ["category"])) / F.sum("tokens").over(L.whole(S)), 6).alias("stop"))


@query("x25_gantt_widths", PER_TURN + ", t AS (SELECT *, greatest(1, max(end_ms) OVER (PARTITION BY session) - min(start_ms) OVER (PARTITION BY session)) AS whole FROM per) SELECT session, turn_i, round(greatest(0.15, 100.0 * (end_ms - start_ms) / whole), 6) AS width FROM t")
def gantt_widths(read):
    whole = F.greatest(F.lit(1), F.max("end_ms").over(L.whole(S)) - F.min("start_ms").over(L.whole(S)))
    return per_turn(read).select("session", "turn_i", F.round(F.greatest(F.lit(0.15), 100.0 * (F.col("end_ms") - F.col("start_ms")) / whole), 6).alias("width"))


@query("x30_delta_bars", CATEGORIES + " SELECT session, category, round(greatest(3, 100.0 * tokens / sum(tokens) OVER (PARTITION BY session)), 6) AS bar FROM c WHERE tokens > 0")
def delta_bars(read):
    return categories(read).where("tokens > 0").select("session", "category", F.round(F.greatest(F.lit(3.0), 100.0 * F.col("tokens") / F.sum("tokens").over(L.whole(S))), 6).alias("bar"))


@query("x5_gaps", f"{W} SELECT session, seq, CAST(greatest(0, coalesce(ms - lag(ms) OVER {RUN}, 0)) AS BIGINT) AS since FROM lines")
def since_last(read):
    return event_lines(read("events")).select("session", "seq", F.greatest(F.lit(0), F.coalesce(F.col("ms") - F.lag("ms").over(over(S, ["seq"])), F.lit(0))).cast("long").alias("since"))


@query("f1_known_kinds", "SELECT event_id FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL AND event_type IN ('view', 'click', 'purchase')")
def known_kinds(read):
    return read("events").where(F.col("event_id").isNotNull() & F.col("ts").isNotNull() & F.col("event_type").isin("view", "click", "purchase")).select("event_id")


@query("p10_json_columns", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props IS NULL AS missing FROM events")
def json_columns(read):
    parsed = F.from_json("props", "k bigint")
    return read("events").select("event_id", parsed["k"].alias("k"), F.col("props").isNull().alias("missing"))


@query("r7_requests_once", "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def requests_once(read):
    return first_of(read("events"), ["user_id", "event_type"], ["event_id"]).select("event_id", "user_id", "event_type")


@query("r2_tumbling_windows", "SELECT epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS start_ms, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(read):
    e = read("events").withColumn("ts", F.col("ts").cast("timestamp"))
    each = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return each.select(F.unix_millis("w.start").alias("start_ms"), "event_type", "n", "total")


@query("r9_idle_sessions", f"""{W}, g AS (SELECT *, sum(CASE WHEN p IS NULL OR ms - p >= 1800000 THEN 1 ELSE 0 END) OVER {RUN} AS s FROM (SELECT *, lag(ms) OVER {RUN} AS p FROM lines)) SELECT session, min(ms) AS start_ms, max(ms) AS last_ms, count(*) AS n FROM g GROUP BY session, s""")
def idle_sessions(read):
    lines = event_lines(read("events"))
    new = F.coalesce(F.col("ms") - F.lag("ms").over(over(S, ["seq"])) >= 1_800_000, F.lit(True))
    return islands(lines, S, ["seq"], new, "s").groupBy("session", "s").agg(F.min("ms").alias("start_ms"), F.max("ms").alias("last_ms"), F.count("*").alias("n")).drop("s")


@query("a34_rollup", "SELECT event_type, user_id, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY ROLLUP (event_type, user_id)")
def rolled_up(read):
    """An extension: totals at every level at once."""
    return read("events").rollup("event_type", "user_id").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens"))
