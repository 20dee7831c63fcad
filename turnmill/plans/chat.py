"""Queries over ``conversations``: transcripts of one line per message."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.functions.text import half_up, tokens, units
from turnmill.operators import turns as T
from turnmill.operators.windows import first_of, over, running, top_of
from turnmill.plans.base import CHAT_TURNS, chat_lines, query

PROFILE_SQL = f"""
    WITH {CHAT_TURNS}, c AS (
        SELECT session, turn_i, coalesce(sum(length(text) / 3.0) FILTER (role = 'user'), 0) AS u, coalesce(sum(length(text) / 3.0) FILTER (role = 'assistant'), 0) AS a,
               count(*) FILTER (role = 'assistant') AS requests FROM turns GROUP BY session, turn_i),
    s AS (SELECT session, turn_i, requests,
                 CAST(floor(round(sum(u) OVER w, 6) + 0.5) AS BIGINT) AS "userMsgs", CAST(floor(round(sum(a) OVER w, 6) + 0.5) AS BIGINT) AS "asstText"
          FROM c WINDOW w AS (PARTITION BY session ORDER BY turn_i))"""


@query("t1_turn_token_profile", PROFILE_SQL + """ SELECT *, "userMsgs" + "asstText" AS total, "userMsgs" + "asstText" - coalesce(lag("userMsgs" + "asstText") OVER (PARTITION BY session ORDER BY turn_i), 0) AS growth FROM s""")
def turn_token_profile(read):
    totals = T.composition(T.turn_lines(chat_lines(read("conversations")))).withColumn("total", F.col("userMsgs") + F.col("asstText"))
    return totals.withColumn("growth", F.col("total") - F.coalesce(F.lag("total").over(over(T.KEYS, ["turn_i"])), F.lit(0)))


@query("t1_turn_groups", f"WITH {CHAT_TURNS} SELECT session, turn_i, count(*) AS lines, min(line_no) AS first_line, max(line_no) AS last_line FROM turns GROUP BY session, turn_i")
def turn_groups(read):
    return T.turn_lines(chat_lines(read("conversations"))).groupBy("session", "turn_i").agg(F.count("*").alias("lines"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


@query("t9_deltas", PROFILE_SQL + """, d AS (SELECT session, turn_i, "userMsgs" - lag("userMsgs") OVER w AS "userMsgs", "asstText" - lag("asstText") OVER w AS "asstText" FROM s WINDOW w AS (PARTITION BY session ORDER BY turn_i))
    SELECT session, turn_i, category, delta FROM (UNPIVOT d ON "userMsgs", "asstText" INTO NAME category VALUE delta) WHERE delta > 0""")
def delta_rows(read):
    return T.deltas(T.composition(T.turn_lines(chat_lines(read("conversations")))), ["userMsgs", "asstText"])


@query("t10_rounded_fold", f"""WITH {CHAT_TURNS} SELECT session, turn_i, line_no, CAST(sum(CAST(floor(length(text) / 3.33 + 0.5) AS BIGINT)) OVER (PARTITION BY session ORDER BY line_no) AS BIGINT) AS tokens FROM turns""")
def rounded_fold(read):
    lines = T.turn_lines(chat_lines(read("conversations")))
    return running(lines, T.KEYS, ["line_no"], half_up(units(F.col("text")) / 3.33), "tokens").select("session", "turn_i", "line_no", "tokens")


@query("t5_chunk_runs", """WITH f AS (SELECT conv_id AS session, turn AS line_no, role, text, sum(CASE WHEN role IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run
        FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations))
    SELECT session, CAST(run AS BIGINT) AS run, any_value(role) AS role, min(line_no) AS first_line, count(*) AS lines, string_agg(text, chr(10) ORDER BY line_no) AS text FROM f GROUP BY session, run""")
def chunk_runs(read):
    return T.runs(chat_lines(read("conversations")), "role")


@query("t4_run_change_turns", """WITH f AS (SELECT conv_id AS session, turn AS line_no, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
    SELECT session, line_no, CAST(sum(CASE WHEN role = 'user' AND p IS DISTINCT FROM 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY line_no) AS BIGINT) AS turn_no FROM f""")
def run_change_turns(read):
    lines = chat_lines(read("conversations")).withColumn("p", F.lag("role").over(over(T.KEYS, ["line_no"])))
    return running(lines, T.KEYS, ["line_no"], F.when((F.col("role") == "user") & ~F.col("p").eqNullSafe(F.lit("user")), 1).otherwise(0), "turn_no").select("session", "line_no", "turn_no")


@query("t7_context_composition", PROFILE_SQL + """ SELECT session, turn_i, 5768 + 98949 + 9122 + 2474 + 222 + 409 + 612 AS core, "userMsgs", "asstText", 5768 + 98949 + 9122 + 2474 + 222 + 409 + 612 + "userMsgs" + "asstText" AS assembled FROM s""")
def context_composition(read):
    core = sum(SEEDS.values())
    return T.composition(T.turn_lines(chat_lines(read("conversations")))).select("session", "turn_i", F.lit(core).alias("core"), "userMsgs", "asstText", (F.lit(core) + F.col("userMsgs") + F.col("asstText")).alias("assembled"))


# Seed characters of the core categories.
SEEDS = {"sysPrompt": 5768, "tool_defs": 98949, "skills": 9122, "memory": 2474, "mcp": 222, "reminders": 409, "userWrapper": 612}


@query("a3_peak_categories", PROFILE_SQL + """, p AS (SELECT session, arg_max(turn_i, ("userMsgs" + "asstText") * 1000000 - turn_i) AS turn_i FROM s GROUP BY session), x AS (SELECT s.session, s.turn_i, "userMsgs", "asstText" FROM s JOIN p USING (session, turn_i))
    SELECT session, turn_i, category, tokens, row_number() OVER (PARTITION BY session ORDER BY tokens DESC, category) AS place FROM (UNPIVOT x ON "userMsgs", "asstText" INTO NAME category VALUE tokens)""")
def peak_categories(read):
    totals = T.composition(T.turn_lines(chat_lines(read("conversations"))))
    peak = totals.groupBy("session").agg(F.max_by("turn_i", F.struct(F.col("userMsgs") + F.col("asstText"), -F.col("turn_i"))).alias("turn_i"))
    long = totals.join(peak, ["session", "turn_i"]).unpivot(["session", "turn_i"], ["userMsgs", "asstText"], "category", "tokens")
    return long.withColumn("place", F.row_number().over(over(T.KEYS, [F.desc("tokens"), "category"])))


@query("a12_session_headers", f"""WITH {CHAT_TURNS} SELECT session, arg_min(left(text, 120), line_no) FILTER (role = 'user') AS title, count(DISTINCT turn_i) AS turns, count(*) FILTER (role = 'assistant') AS requests, max(length(text)) AS longest FROM turns GROUP BY session""")
def session_headers(read):
    user = F.col("role") == "user"
    return T.turn_lines(chat_lines(read("conversations"))).groupBy("session").agg(F.min_by(F.when(user, F.substring("text", 1, 120)), F.when(user, F.col("line_no"))).alias("title"), F.count_distinct("turn_i").alias("turns"), F.count_if(F.col("role") == "assistant").alias("requests"), F.max(units(F.col("text"))).alias("longest"))


@query("a32_running_requests", f"""WITH {CHAT_TURNS}, c AS (SELECT session, turn_i, count(*) FILTER (role = 'assistant') AS n FROM turns GROUP BY session, turn_i) SELECT session, turn_i, CAST(sum(n) OVER (PARTITION BY session ORDER BY turn_i) AS BIGINT) AS requests_so_far FROM c""")
def running_requests(read):
    each = T.contributions(T.turn_lines(chat_lines(read("conversations"))))
    return running(each, T.KEYS, ["turn_i"], F.col("requests"), "requests_so_far").select("session", "turn_i", "requests_so_far")


@query("s11_quick_metadata", """SELECT conv_id AS session, count(*) FILTER (role = 'assistant') AS requests, count(*) FILTER (role = 'user') AS turn_count, max(length(text)) FILTER (role = 'assistant') AS peak_chars, arg_min(left(text, 120), turn) FILTER (role = 'user') AS title FROM conversations GROUP BY conv_id""")
def quick_metadata(read):
    user, asst = F.col("role") == "user", F.col("role") == "assistant"
    return chat_lines(read("conversations")).groupBy("session").agg(F.count_if(asst).alias("requests"), F.count_if(user).alias("turn_count"), F.max(F.when(asst, units(F.col("text")))).alias("peak_chars"), F.min_by(F.when(user, F.substring("text", 1, 120)), F.when(user, F.col("line_no"))).alias("title"))


@query("s13_session_title", """SELECT conv_id AS session, arg_min(left(trim(text), 120), turn) AS title FROM conversations WHERE turn < 50 AND role = 'user' AND trim(text) <> '' GROUP BY conv_id""")
def session_title(read):
    first = chat_lines(read("conversations")).where((F.col("line_no") < 50) & (F.col("role") == "user") & (F.trim("text") != ""))
    return first.groupBy("session").agg(F.min_by(F.substring(F.trim("text"), 1, 120), "line_no").alias("title"))


@query("a16_scan_summary", """WITH m AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS requests, count(*) FILTER (role = 'user') AS turns FROM conversations GROUP BY conv_id)
    SELECT count(*) AS total, count(*) FILTER (conv_id % 3 = 0) AS imported, count(*) FILTER (turns >= 5) AS long_ones, CAST(sum(requests) AS BIGINT) AS requests FROM m WHERE NOT (turns = 0 AND requests = 0)""")
def scan_summary(read):
    meta = chat_lines(read("conversations")).groupBy("session").agg(F.count_if(F.col("role") == "assistant").alias("requests"), F.count_if(F.col("role") == "user").alias("turns"))
    return meta.where(~((F.col("turns") == 0) & (F.col("requests") == 0))).agg(F.count("*").alias("total"), F.count_if(F.col("session") % 3 == 0).alias("imported"), F.count_if(F.col("turns") >= 5).alias("long_ones"), F.sum("requests").alias("requests"))


@query("f6_long_sessions", """WITH m AS (SELECT conv_id AS session, count(*) FILTER (role = 'user') AS turns FROM conversations GROUP BY conv_id) SELECT * FROM m WHERE turns IS NULL OR turns >= 3""")
def long_sessions(read):
    meta = chat_lines(read("conversations")).groupBy("session").agg(F.count_if(F.col("role") == "user").alias("turns"))
    return meta.where(F.col("turns").isNull() | (F.col("turns") >= 3))


@query("f2_turn_starters", """SELECT conv_id AS session, turn AS line_no FROM conversations WHERE role = 'user' AND text <> '' AND NOT starts_with(text, '<task-notification>')""")
def turn_starters(read):
    return chat_lines(read("conversations")).where(T.starts_turn(F.col("role"), F.col("text"))).select("session", "line_no")


@query("j16_imported_flag", """SELECT c.conv_id AS session, any_value(s.n_chars) IS NOT NULL AS imported FROM conversations AS c LEFT JOIN (SELECT doc_id, max(n_chars) AS n_chars FROM documents GROUP BY doc_id) AS s ON s.doc_id = c.conv_id * 20 GROUP BY c.conv_id""")
def imported_flag(read):
    known = read("documents").groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    files = chat_lines(read("conversations")).select("session").distinct()
    return files.join(known, F.col("session") * 20 == F.col("doc_id"), "left").select("session", F.col("n_chars").isNotNull().alias("imported"))


@query("o2_turn_page", f"""WITH {CHAT_TURNS} SELECT session, turn_i, count(*) AS lines FROM turns GROUP BY session, turn_i ORDER BY turn_i DESC, session LIMIT 50 OFFSET 10""")
def turn_page(read):
    each = T.turn_lines(chat_lines(read("conversations"))).groupBy("session", "turn_i").agg(F.count("*").alias("lines"))
    return each.orderBy(F.desc("turn_i"), "session").offset(10).limit(50)


SHARDS_SQL = f"""
    WITH RECURSIVE {CHAT_TURNS}, c AS (SELECT session, turn_i, CAST(sum(length(text)) AS BIGINT) AS chars FROM turns GROUP BY session, turn_i),
    bins AS (
        SELECT session, turn_i, chars, CAST(0 AS BIGINT) AS shard, CAST(1 AS BIGINT) AS n, chars AS size FROM c WHERE turn_i = 0
        UNION ALL
        SELECT c.session, c.turn_i, c.chars,
               CASE WHEN b.n >= 3 OR b.size + c.chars > 4000 THEN b.shard + 1 ELSE b.shard END,
               CASE WHEN b.n >= 3 OR b.size + c.chars > 4000 THEN 1 ELSE b.n + 1 END,
               CASE WHEN b.n >= 3 OR b.size + c.chars > 4000 THEN c.chars ELSE b.size + c.chars END
        FROM bins AS b JOIN c ON c.session = b.session AND c.turn_i = b.turn_i + 1)"""


@query("t20_turn_shards", SHARDS_SQL + " SELECT session, turn_i, chars, shard FROM bins")
def turn_shards(read):
    sizes = T.turn_lines(chat_lines(read("conversations"))).groupBy("session", "turn_i").agg(F.sum(units(F.col("text"))).alias("chars"))
    return T.pack(sizes, 3, 4000)


@query("t21_incremental_shards", SHARDS_SQL.replace("WHERE turn_i = 0", "WHERE turn_i = 1") + " SELECT session, turn_i, chars, shard + 1 AS shard FROM bins")
def incremental_shards(read):
    """Turns from the old total (here 1) on are packed anew; shard numbers go on."""
    sizes = T.turn_lines(chat_lines(read("conversations"))).groupBy("session", "turn_i").agg(F.sum(units(F.col("text"))).alias("chars"))
    return T.pack(sizes.where("turn_i >= 1"), 3, 4000).withColumn("shard", F.col("shard") + 1)


@query("x13_turn_documents", f"""WITH {CHAT_TURNS} SELECT session, turn_i, '## Turn ' || turn_i || chr(10) || string_agg('[' || upper(role) || '] ' || text, chr(10) ORDER BY line_no) AS content FROM turns GROUP BY session, turn_i""")
def turn_documents(read):
    lines = T.turn_lines(chat_lines(read("conversations")))
    part = F.array_sort(F.collect_list(F.struct("line_no", F.concat(F.lit("["), F.upper("role"), F.lit("] "), F.col("text")).alias("t"))))
    return lines.groupBy("session", "turn_i").agg(F.array_join(F.transform(part, lambda x: x["t"]), "\n").alias("body")).select("session", "turn_i", F.concat(F.lit("## Turn "), F.col("turn_i"), F.lit("\n"), F.col("body")).alias("content"))


@query("o6_longest_lines", """SELECT session, line_no, chars FROM (SELECT conv_id AS session, turn AS line_no, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS n FROM conversations) WHERE n <= 3""")
def longest_lines(read):
    return top_of(chat_lines(read("conversations")).withColumn("chars", units(F.col("text"))), T.KEYS, [F.desc("chars"), "line_no"], 3).select("session", "line_no", "chars")


@query("p5_prompt_text", f"""WITH {CHAT_TURNS} SELECT session, turn_i, text AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY session, turn_i ORDER BY line_no) AS n FROM turns) WHERE n = 1""")
def prompt_text(read):
    return first_of(T.turn_lines(chat_lines(read("conversations"))), ["session", "turn_i"], ["line_no"]).select("session", "turn_i", F.col("text").alias("prompt"))


@query("p16_turn_facts", PROFILE_SQL + f""", f AS (SELECT session, turn_i, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM turns GROUP BY session, turn_i) SELECT session, turn_i, lines, chars, "userMsgs", "asstText", requests FROM s JOIN f USING (session, turn_i)""")
def turn_facts(read):
    lines = T.turn_lines(chat_lines(read("conversations")))
    facts = lines.groupBy("session", "turn_i").agg(F.count("*").alias("lines"), F.sum(units(F.col("text"))).alias("chars"))
    return facts.join(T.composition(lines), ["session", "turn_i"])


@query("e1_length_estimator", f"""WITH {CHAT_TURNS} SELECT session, turn_i, CAST(sum(length(text)) AS BIGINT) AS tokens, round(sum(length(text) / 3.0), 6) AS estimated FROM turns GROUP BY session, turn_i""")
def length_estimator(read):
    """The estimator is a parameter: any function from a column to a column."""
    lines = T.turn_lines(chat_lines(read("conversations")))
    return lines.groupBy("session", "turn_i").agg(F.sum(units(F.col("text"))).alias("tokens"), F.round(F.sum(tokens(F.col("text"))), 6).alias("estimated"))
