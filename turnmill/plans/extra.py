"""Smaller queries: lookups, validations, orders and layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.functions import content as C
from turnmill.functions.json_text import collected_items, pure_code
from turnmill.operators.layout import treemap
from turnmill.plans.base import chat_lines, event_lines, query


@query("f9_turns_in_range", "SELECT p_partkey, array_to_string(list_filter(range(p_size, p_size + 6), lambda t: t BETWEEN 10 AND 30), ',') AS turns FROM part")
def turns_in_range(read):
    turns = F.filter(F.sequence(F.col("p_size"), F.col("p_size") + 5), lambda t: t.between(10, 30))
    return read("part").select("p_partkey", F.array_join(turns, ",").alias("turns"))


@query("f10_evidence_sources", """SELECT event_id, CASE lower(trim(event_type)) WHEN 'purchase' THEN 'user' WHEN 'signup' THEN 'reply' WHEN 'click' THEN 'tool_summary' ELSE 'reasoning_summary' END AS source FROM events""")
def evidence_sources(read):
    """Spellings of a source meet in one name; unknown ones count as the weakest."""
    names = F.create_map(*[F.lit(x) for pair in (("purchase", "user"), ("signup", "reply"), ("click", "tool_summary")) for x in pair])
    return read("events").select("event_id", F.coalesce(F.element_at(names, F.lower(F.trim("event_type"))), F.lit("reasoning_summary")).alias("source"))


@query("j17_fresh_cache", """SELECT d.doc_id, c.doc_id IS NOT NULL AND c.stamp = d.n_chars AND d.n_chars > 0 AS cached FROM documents AS d LEFT JOIN (SELECT doc_id, n_chars + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS stamp FROM documents WHERE doc_id % 2 = 0) AS c USING (doc_id)""")
def fresh_cache(read):
    d = read("documents")
    cache = d.where("doc_id % 2 = 0").select("doc_id", (F.col("n_chars") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("stamp"))
    return d.join(cache, "doc_id", "left").select("doc_id", F.coalesce((F.col("stamp") == F.col("n_chars")) & (F.col("n_chars") > 0), F.lit(False)).alias("cached"))


@query("a13_versions", "SELECT p_partkey, string_split(p_brand, '#')[-1] AS version FROM part")
def versions(read):
    return read("part").select("p_partkey", F.element_at(F.split("p_brand", "#"), -1).alias("version"))


@query("x21_short_paths", "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN '~/' || substr(url, 9) ELSE url END AS shown FROM pages")
def short_paths(read):
    return read("pages").select("page_id", F.when(F.col("url").startswith("https://"), F.concat(F.lit("~/"), F.expr("substring(url, 9)"))).otherwise(F.col("url")).alias("shown"))


@query("o8_newest_log", "SELECT event_type, arg_max(event_id, epoch_us(ts) * 1000 + event_id % 1000) AS event_id FROM events GROUP BY event_type")
def newest_log(read):
    return read("events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", F.col("event_id") % 1000)).alias("event_id"))


@query("o10_category_order", "SELECT event_type, row_number() OVER (ORDER BY CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, event_type) AS place FROM (SELECT DISTINCT event_type FROM events)")
def category_order(read):
    rank = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    kinds = read("events").select("event_type").distinct()
    ordered = F.array_sort(F.collect_list(F.struct(rank.alias("r"), "event_type")))
    return kinds.agg(ordered.alias("k")).select(F.posexplode("k").alias("at", "k")).select("k.event_type", (F.col("at") + 1).cast("long").alias("place"))


@query("s12_first_nonempty", "SELECT conv_id AS session, arg_min(text, turn) AS text FROM conversations WHERE turn < 50 AND text <> '' AND role <> 'system' GROUP BY conv_id")
def first_nonempty(read):
    return chat_lines(read("conversations")).where("line_no < 50 and text <> '' and role <> 'system'").groupBy("session").agg(F.min_by("text", "line_no").alias("text"))


# Names of models, versions and files, dealt to pages by number.
MODELS, VERSIONS, FILES = ("Claude-Opus", "opencode", "PI", "openclaw", "gpt-x", "other"), ("1.0", "opencode-2", "pi", "OpenClaw 3", "codex 4"), ("rollout-1.jsonl", "a.jsonl")
SOURCE_ROWS = f"""m AS (SELECT page_id, url, CASE WHEN page_id % 13 = 0 THEN 'pi' WHEN page_id % 13 = 1 THEN 'elsewhere' END AS source, {list(MODELS)}[page_id % 7 + 1] AS model, {list(VERSIONS)}[page_id // 7 % 6 + 1] AS version, {list(FILES)}[page_id // 42 % 2 + 1] AS filename FROM pages),
    l AS (SELECT *, lower(coalesce(model, '')) AS lm, lower(coalesce(version, '')) AS lv, lower(coalesce(filename, '')) AS lf FROM m),
    s AS (SELECT *, CASE WHEN source IN ('codex', 'claude', 'opencode', 'pi', 'openclaw') THEN source WHEN contains(lm, 'claude') THEN 'claude' WHEN lm = 'opencode' OR contains(lv, 'opencode') THEN 'opencode' WHEN lm = 'pi' OR lv = 'pi' THEN 'pi'
          WHEN lm = 'openclaw' OR contains(lv, 'openclaw') THEN 'openclaw' WHEN contains(lm, 'gpt') OR contains(lm, 'codex') OR contains(lv, 'codex') OR starts_with(lf, 'rollout-') THEN 'codex' ELSE 'claude' END AS found FROM l)"""


def source_rows(read):
    k = F.col("page_id")
    dealt = lambda names, at: F.get(F.array(*map(F.lit, names)), at.cast("int"))
    stored = F.when(k % 13 == 0, "pi").when(k % 13 == 1, "elsewhere")
    return read("pages").select("page_id", "url", stored.alias("source"), dealt(MODELS, k % 7).alias("model"), dealt(VERSIONS, F.floor(k / 7) % 6).alias("version"), dealt(FILES, F.floor(k / 42) % 2).alias("filename"))


@query("p11_session_source", f"WITH {SOURCE_ROWS} SELECT page_id, found AS source FROM s")
def session_source(read):
    return source_rows(read).select("page_id", C.session_source(F.col("source"), F.col("model"), F.col("version"), F.col("filename")).alias("source"))


@query("p12_inferred_source", f"""WITH {SOURCE_ROWS}, p AS (SELECT *, '/home/u/' || CASE page_id % 5 WHEN 0 THEN '.codex/' WHEN 1 THEN '.pi/agent/sessions/' WHEN 2 THEN '.local/share/opencode/' WHEN 3 THEN '.openclaw/' ELSE 'work/' END || filename AS path FROM l)
    SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'codex' WHEN 1 THEN 'pi' WHEN 2 THEN 'opencode' WHEN 3 THEN 'openclaw' ELSE CASE WHEN version = 'pi' THEN 'pi' ELSE 'claude' END END AS by_path,
           CASE WHEN lm IN ('opencode', 'pi', 'openclaw') THEN lm WHEN contains(lm, 'codex') THEN 'codex' WHEN contains(lm, 'claude') THEN 'claude' END AS by_model FROM p""")
def inferred_source(read):
    folder = F.get(F.array(*[F.lit(folder) for folder, _ in C.FOLDERS]), (F.col("page_id") % 5).cast("int"))
    path = F.concat(F.lit("/home/u/"), F.coalesce(folder, F.lit("work/")), "filename")
    label = F.when(F.col("version") == "pi", "pi-session").otherwise("unknown")
    return source_rows(read).where("filename IS NOT NULL").select("page_id", C.source_of_file(path, "/home/u", label).alias("by_path"), C.source_of_model(F.col("model")).alias("by_model"))


@query("p13_model_for_source", f"WITH {SOURCE_ROWS} SELECT page_id, CASE WHEN found = 'openclaw' AND lm = 'pi' THEN 'openclaw' ELSE lm END AS model FROM s")
def model_for_source(read):
    rows = source_rows(read).withColumn("model", F.lower(F.coalesce("model", F.lit(""))))
    return rows.select("page_id", C.model_for_source(F.col("model"), C.session_source(F.col("source"), F.col("model"), F.col("version"), F.col("filename"))).alias("model"))


def blocks_of(read, *made):
    """``conversations`` with v, a variant of a list of the given structs."""
    return read("conversations").select("conv_id", "turn", F.parse_json(F.concat(F.lit("["), F.concat_ws(",", *[F.to_json(x) for x in made]), F.lit("]"))).alias("v"))


@query("p6_codex_texts", r"""SELECT conv_id, turn, concat_ws(chr(10), nullif(text, ''), nullif(role, '')) AS content, concat_ws(chr(10) || chr(10), nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), ''), 'no', nullif(regexp_replace(role, '^\s+|\s+$', '', 'g'), '')) AS reasoning,
    concat_ws(chr(10), coalesce(text, '{"type":"input_text"}'), '{"content":"no","type":"image"}', coalesce(role, '{"type":"output_text"}')) AS output FROM conversations""")
def codex_texts(read):
    block = lambda kind, name: F.struct(F.lit(kind).alias("type"), F.col(name).alias("text"))
    v = F.col("v")
    rows = blocks_of(read, block("input_text", "text"), F.struct(F.lit("image").alias("type"), F.lit("no").alias("content")), block("output_text", "role"))
    return rows.select("conv_id", "turn", C.codex_text(v).alias("content"), C.codex_reasoning(v).alias("reasoning"), C.output_text(v).alias("output"))


@query("p7_nested_texts", """SELECT conv_id, turn, concat_ws(chr(10), nullif(text, ''), nullif(role, '')) AS pi, concat_ws(chr(10), coalesce(nullif(text, ''), CASE WHEN text IS NULL THEN '{}' END), coalesce(nullif(role, ''), CASE WHEN role IS NULL THEN '{}' END), '{"n":' || turn || '}') AS openclaw FROM conversations""")
def nested_texts(read):
    rows = blocks_of(read, F.struct("text"), F.struct(F.col("role").alias("content")), F.struct(F.col("turn").alias("n")))
    return rows.select("conv_id", "turn", C.pi_text(F.col("v")).alias("pi"), C.openclaw_text(F.col("v")).alias("openclaw"))


@query("p8_opencode_parts", """SELECT event_id, event_type AS name, '{"n":' || event_id || '}' AS input, 'done' AS result, CAST(greatest(user_id - event_id, 0) AS BIGINT) AS duration_ms, event_type = 'error' AS is_error, CAST(user_id AS DOUBLE) AS input_tokens, CAST(event_id AS DOUBLE) AS cached FROM events""")
def opencode_parts(read):
    struct = lambda **c: F.struct(*[x.alias(n) for n, x in c.items()])
    event, user = F.col("event_id"), F.col("user_id")
    state = struct(input=struct(n=event), output=F.lit("done"), status=F.upper("event_type"), time=struct(start=event, end=user))
    part = F.parse_json(F.to_json(struct(tool=F.col("event_type"), state=state, tokens=struct(input=user, cache=struct(read=event)))))
    rows = read("events").select("event_id", part.alias("part")).select("event_id", C.opencode_tool(F.col("part")).alias("t"), C.opencode_usage(F.col("part")).alias("u"))
    return rows.select("event_id", "t.*", F.col("u.input").alias("input_tokens"), "u.cached")


@query("x26_treemap")
def treemap_layout(read):
    """Rectangles by category of each session; held by tests to fill the area without overlap."""
    return treemap(event_lines(read("events")).groupBy("session", F.col("kind").alias("category")).agg(F.sum("tokens").alias("tokens")))


@query("x15_collected_items", """SELECT page_id, 0 AS place, page_id AS n FROM pages UNION ALL SELECT page_id, 1, page_id + 1 FROM pages UNION ALL SELECT page_id, 2, CAST(length(url) AS BIGINT) FROM pages WHERE url IS NOT NULL""")
def items_collected(read):
    """Answers of three items: an object, one within a text, and one within a fence within a text."""
    n = lambda x: F.to_json(F.struct(x.alias("n")))
    plain, quoted = n(F.col("page_id")), F.to_json(F.struct(n(F.col("page_id") + 1).alias("text")))
    fenced = F.coalesce(F.to_json(F.struct(F.concat(F.lit("so:\n```json\n"), n(F.length("url")), F.lit("\n```")).alias("text"))), F.lit("7"))
    answers = read("pages").select("page_id", "url", F.concat(F.lit('{"results":['), F.concat_ws(",", plain, quoted, F.when(F.col("url").isNotNull(), fenced)), F.lit("]}")).alias("answer"))
    return collected_items(answers, "answer").select("page_id", F.element_at("place", 2).alias("place"), F.try_variant_get("item", "$.n", "long").alias("n"))


@query("x32_pure_code", """WITH t AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '# Title' || chr(10) || '```py' || chr(10) || url || chr(10) || '```' WHEN 1 THEN '{"id": ' || page_id || '}' WHEN 2 THEN ' `a` `b`' || chr(10) || '字符数: 12 ' WHEN 3 THEN '[' || url ELSE html END AS text FROM pages UNION ALL SELECT -1 - doc_id, text FROM documents),
    o AS (SELECT page_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS own FROM t),
    r AS (SELECT page_id, own, regexp_replace(regexp_replace(regexp_replace(regexp_replace(own, '(?m)^# [^\\n]+\\n*', '', 'g'), '(?m)^字符数:\\s*\\d+\\s*$', '', 'g'), '(?m)^```[^\\n]*\\n[\\s\\S]*?\\n```$', '', 'g'), '`[^`\\n]+`', '', 'g') AS rest FROM o)
    SELECT page_id, own <> '' AND (((starts_with(own, '{') OR starts_with(own, '[')) AND json_valid(own)) OR regexp_replace(rest, '^\\s+|\\s+$', '', 'g') = '') AS code FROM r""")
def code_alone(read):
    k, url = F.col("page_id") % 5, F.col("url")
    made = (
        F.when(k == 0, F.concat(F.lit("# Title\n```py\n"), url, F.lit("\n```")))
        .when(k == 1, F.concat(F.lit('{"id": '), F.col("page_id").cast("string"), F.lit("}")))
        .when(k == 2, F.lit(" `a` `b`\n字符数: 12 "))
        .when(k == 3, F.concat(F.lit("["), url))
        .otherwise(F.col("html"))
    )
    rows = read("pages").select("page_id", made.alias("text")).unionByName(read("documents").select((F.lit(-1) - F.col("doc_id")).alias("page_id"), "text"))
    return rows.select("page_id", pure_code(F.col("text"), F.lit(True)).alias("code"))
