"""Queries over ``documents``, ``pages`` and ``labels``: text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnmill.functions import redact
from turnmill.functions import text as X
from turnmill.operators.windows import first_of, top_of
from turnmill.plans.base import query

# DuckDB twins of the character classes.
CJK = "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{3000}-\\x{303F}\\x{FF00}-\\x{FFEF}]"
SIGNS = "[{}\\[\\]();=<>/\\\\]"


@query("x1_token_estimate", "SELECT doc_id, length(text) AS units, CAST(floor(length(text) / 3.0 + 0.5) AS BIGINT) AS tokens FROM documents")
def token_estimate(read):
    t = F.col("text")
    return read("documents").select("doc_id", X.units(t).alias("units"), X.half_up(X.tokens(t)).alias("tokens"))


MODE_SQL = f"""WITH s AS (SELECT doc_id, text, length(text) AS n, length(text) - length(regexp_replace(text, '{CJK}', '', 'g')) AS cjk, length(text) - length(regexp_replace(text, '{SIGNS}', '', 'g')) AS signs FROM documents),
    m AS (SELECT doc_id, n, CASE WHEN n = 0 THEN 'mixed' WHEN cjk / n > 0.3 THEN 'zh' WHEN cjk / n < 0.05 THEN CASE WHEN signs > n * 0.05 THEN 'code' ELSE 'en' END ELSE 'mixed' END AS mode FROM s)"""


@query("x2_text_mode", MODE_SQL + " SELECT doc_id, mode FROM m")
def text_mode(read):
    return read("documents").select("doc_id", X.mode(F.col("text")).alias("mode"))


@query("x3_tokens_by_mode", MODE_SQL + " SELECT doc_id, mode, CAST(floor(n / CASE mode WHEN 'en' THEN 3.33 WHEN 'zh' THEN 1.67 WHEN 'code' THEN 2.5 ELSE 3.0 END + 0.5) AS BIGINT) AS tokens FROM m")
def tokens_by_mode(read):
    moded = read("documents").withColumn("mode", X.mode(F.col("text")))
    return moded.select("doc_id", "mode", X.half_up(X.tokens_by_mode(F.col("text"), F.col("mode"))).alias("tokens"))


@query("x4_context_window", """WITH m AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Claude-Opus-x' WHEN 1 THEN 'deepseek-v3.1' WHEN 2 THEN 'deepseek-v4-pro' ELSE 'other' END AS model FROM documents)
    SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN 200000 WHEN 1 THEN 128000 WHEN 2 THEN 1000000 ELSE 200000 END AS BIGINT) AS size FROM m""")
def context_window(read):
    turn = F.col("doc_id") % 4
    model = F.when(turn == 0, "Claude-Opus-x").when(turn == 1, "deepseek-v3.1").when(turn == 2, "deepseek-v4-pro").otherwise("other")
    return read("documents").select("doc_id", X.context_window(model).alias("size"))


@query("x6_epoch_numbers", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN (1700000000 + doc_id) * 1000 ELSE 1700000000000 + doc_id END AS ms FROM documents")
def epoch_numbers(read):
    raw = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") + 1_700_000_000).otherwise(F.col("doc_id") + 1_700_000_000_000)
    return read("documents").select("doc_id", X.instant_ms(raw).alias("ms"))


NORMAL = "regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query("x8_normal_text", f"SELECT doc_id, {NORMAL} AS text FROM documents")
def normal_text(read):
    return read("documents").select("doc_id", X.normal(F.col("text")).alias("text"))


@query("x9_compact_text", f"""WITH n AS (SELECT doc_id, {NORMAL} AS t FROM documents), p AS (SELECT doc_id, t, regexp_replace(left(t, 172), '^\\s+|\\s+$', '', 'g') AS h, regexp_replace(right(t, 48), '^\\s+|\\s+$', '', 'g') AS e FROM n)
    SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE h || chr(10) || '...[中间省略 ' || (length(t) - length(h) - length(e)) || ' 字]...' || chr(10) || e END AS text FROM p""")
def compact_text(read):
    return read("documents").select("doc_id", X.compact(F.col("text"), 240).alias("text"))


MARKS = "[" + ", ".join(f"'{m}'" for m in X.KNOWLEDGE_MARKS) + "]"
SCORE = f"""CAST(3 * len(list_filter({MARKS}, lambda m: contains(line, m))) + CASE WHEN regexp_matches(trim(line), '{X.KNOWLEDGE_HEAD}') THEN 6 ELSE 0 END + CASE WHEN regexp_matches(trim(line), '[。；;]$') THEN 1 ELSE 0 END
    - CASE WHEN regexp_matches(line, '[{{}}()\\[\\]<>]') THEN 2 ELSE 0 END - CASE WHEN regexp_matches(line, '{X.CODE_LIKE}') THEN 3 ELSE 0 END - CASE WHEN length(line) < 18 THEN 2 ELSE 0 END - CASE WHEN length(line) > 280 THEN 1 ELSE 0 END AS BIGINT)"""


@query("x10_knowledge_lines", f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents) SELECT doc_id, place, {SCORE} AS score FROM l")
def knowledge_lines(read):
    lines = read("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return lines.select("doc_id", F.col("place").cast("long").alias("place"), X.knowledge_score(F.col("line")).alias("score"))


TRIM = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
#: Reasoning: lines without list marks of 8 characters or more, those scored above 0, best first, one for each first 80 characters, ten at most; else the whole.
BEST_LINES = f"""WITH w AS (SELECT doc_id, {TRIM("replace(text, chr(13) || chr(10), chr(10))")} AS whole, len(string_split(regexp_extract(replace(text, chr(13) || chr(10), chr(10)), '^\\s*'), chr(10))) - 1 AS lead FROM documents),
    t AS (SELECT * FROM w WHERE whole <> ''), l AS (SELECT doc_id, unnest(string_split(whole, chr(10))) AS raw, generate_subscripts(string_split(whole, chr(10)), 1) - 1 + lead AS place FROM t),
    b AS (SELECT doc_id, place, {TRIM("regexp_replace(raw, '^[-*]\\s+', '')")} AS line FROM l), s AS (SELECT doc_id, place, line, {SCORE} AS score FROM b WHERE length(line) >= 8),
    k AS (SELECT * FROM s WHERE score > 0), d AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, left(line, 80) ORDER BY score DESC, place) = 1)
    SELECT doc_id, CAST(place AS BIGINT) AS place FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) <= 10)
    UNION ALL SELECT doc_id, NULL FROM t WHERE doc_id NOT IN (SELECT doc_id FROM k)"""


@query("x11_best_lines", BEST_LINES)
def best_lines(read):
    """Lines of a knowledge score above 0, best first: one per first 80 characters, ten per text.

    A text without such a line stands as a whole for itself: a row with a null place.
    """
    text = F.replace("text", F.lit("\r\n"), F.lit("\n"))
    lead = F.size(F.split(F.regexp_extract(text, r"^\s*", 0), "\n")) - 1
    # Lines are cleaned before they are exploded: a filter on them then doesn't repeat the cleaning for each name of it.
    cleaned = F.transform(F.split(X.trimmed(text), "\n"), lambda x: X.trimmed(F.regexp_replace(x, r"^[-*]\s+", "")))
    # A row at place -1 stands for the whole text, so texts are read once.
    each = read("documents").where(F.col("text").rlike(r"\S")).select("doc_id", lead.alias("lead"), F.posexplode(F.concat(F.array(F.lit("")), cleaned)).alias("pos", "line"))
    rows = each.where((F.col("pos") == 0) | X.may_score(F.col("line")) & (X.units(F.col("line")) >= 8))
    place = F.when(F.col("pos") > 0, (F.col("pos") + F.col("lead") - 1).cast("long"))
    scored = rows.select("doc_id", place.alias("place"), F.substring("line", 1, 80).alias("head"), F.when(F.col("pos") > 0, X.knowledge_score(F.col("line"))).alias("score"))
    best = top_of(first_of(scored.where("place is null or score > 0"), ["doc_id", "head"], ["-score", "place"]), ["doc_id"], [F.desc_nulls_first("score"), "place"], 11)
    found = F.max("score").over(Window.partitionBy("doc_id")).isNotNull()
    return best.withColumn("_found", found).where(F.col("place").isNotNull() | ~F.col("_found")).select("doc_id", "place")


@query("x12_outcome_lines", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents)
    SELECT doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n FROM l WHERE regexp_matches(line, '(?i)licen[sc]e|error|fail|pass')) WHERE n <= 10""")
def outcome_lines(read):
    lines = read("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return top_of(lines.where(F.col("line").rlike("(?i)licen[sc]e|error|fail|pass")), ["doc_id"], ["place"], 10).select("doc_id", F.col("place").cast("long").alias("place"))


@query("x20_number_formats", """SELECT doc_id, CASE WHEN n_chars * 997 >= 1000000 THEN format('{:.2f}M', floor(n_chars * 997 / 10000.0 + 0.5) / 100) WHEN n_chars * 997 >= 1000 THEN format('{:.2f}K', floor(n_chars * 997 / 10.0 + 0.5) / 100) ELSE CAST(n_chars * 997 AS VARCHAR) END AS shown FROM documents""")
def number_formats(read):
    return read("documents").select("doc_id", X.compact_number(F.col("n_chars") * 997).alias("shown"))


@query("x22_file_names", "SELECT doc_id, left(regexp_replace(trim(left(text, 40)), '[\\\\/:*?\"<>|#\\n]+', '-', 'g'), 30) || '-' || left(sha1(text), 8) || '.md' AS name FROM documents")
def file_names(read):
    head = F.regexp_replace(F.trim(F.substring("text", 1, 40)), '[\\\\/:*?"<>|#\\n]+', "-")
    return read("documents").select("doc_id", F.concat(F.substring(head, 1, 30), F.lit("-"), F.substring(F.sha1("text"), 1, 8), F.lit(".md")).alias("name"))


TAG_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{pattern}') THEN '{tag}' END" for pattern, tag in X.VAULT_TAGS) + "], lambda x: x IS NOT NULL)"


@query("x23_tags", f"SELECT doc_id, array_to_string({TAG_SQL}, ',') AS tags FROM (SELECT doc_id, text FROM documents UNION ALL SELECT 1000000000 + conv_id * 1000 + turn, text || ' subagent 代码库 LoRA' FROM conversations)")
def tags(read):
    chat = read("conversations").select((F.lit(1_000_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.concat("text", F.lit(" subagent 代码库 LoRA")).alias("text"))
    rows = read("documents").select("doc_id", "text").unionByName(chat)
    return rows.select("doc_id", F.array_join(X.vault_tags(F.col("text")), ",").alias("tags"))


@query("x24_xml_escaped", """SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS text FROM documents""")
def xml_escaped(read):
    return read("documents").select("doc_id", X.xml_escaped(F.col("text")).alias("text"))


@query("x28_confidence_bands", "SELECT doc_id, CASE WHEN n_chars % 100 / 100.0 >= 0.85 THEN 'high' WHEN n_chars % 100 / 100.0 >= 0.70 THEN 'medium' ELSE 'low' END AS band FROM documents")
def confidence_bands(read):
    c = F.col("n_chars") % 100 / 100.0
    return read("documents").select("doc_id", F.when(c >= 0.85, "high").when(c >= 0.70, "medium").otherwise("low").alias("band"))


@query("x35_masked_keys", "SELECT doc_id, CASE WHEN length(k) <= 8 THEN '***' ELSE left(k, 4) || '...' || right(k, 4) END AS shown FROM (SELECT doc_id, left(md5(CAST(doc_id AS VARCHAR)), 4 + doc_id % 12) AS k FROM documents)")
def masked_keys(read):
    key = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(1), (F.col("doc_id") % 12 + 4).cast("int"))
    return read("documents").select("doc_id", X.masked(key).alias("shown"))


@query("u6_distinct_content", "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def distinct_content(read):
    return read("documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("f12_code_like", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    r AS (SELECT doc_id, count(*) FILTER (regexp_matches(line, '\\S')) AS n, count(*) FILTER (regexp_matches(line, '{X.NUMBERED_LINE}')) AS numbered, count(*) FILTER (regexp_matches(line, '{X.CODE_WORD}')) AS signs FROM l GROUP BY doc_id)
    SELECT doc_id, n >= 2 AND (numbered >= 0.6 * n OR (numbered >= 0.3 * n AND signs >= 2) OR signs >= 0.3 * n OR signs >= 5) AS code FROM r""")
def code_like(read):
    return read("documents").where("text is not null").select("doc_id", X.looks_like_code(F.col("text")).alias("code"))


@query("f12_diff_like", r"""WITH n AS (SELECT doc_id, text, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM (
        SELECT doc_id, text FROM documents UNION ALL SELECT -1 - page_id, CASE page_id % 3 WHEN 0 THEN 'x' || chr(10) || '  diff --git a b' WHEN 1 THEN '+| a | b |' || chr(10) || ' |---|---|' ELSE '|a|' || chr(10) || '|-|' END || url FROM pages))
    SELECT doc_id, list_bool_or(list_transform(l, lambda x: starts_with(regexp_replace(x, '^\s+|\s+$', '', 'g'), 'diff --git '))) OR list_bool_or(list_transform(range(1, len(l)), lambda i: regexp_matches(l[i], '^[+\- ]\|.*\|\s*$') AND regexp_matches(l[i + 1], '^\s?\|[\s\-:|]+\|\s*$'))) IS TRUE AS diff FROM n WHERE text IS NOT NULL""".replace("\\\\", "\\"))
def diff_like(read):
    made = F.when(F.col("page_id") % 3 == 0, F.lit("x\n  diff --git a b")).when(F.col("page_id") % 3 == 1, F.lit("+| a | b |\n |---|---|")).otherwise(F.lit("|a|\n|-|"))
    rows = read("documents").select("doc_id", "text").unionByName(read("pages").select((-1 - F.col("page_id")).alias("doc_id"), F.concat(made, "url").alias("text")))
    return rows.where("text is not null").select("doc_id", X.looks_like_diff(F.col("text")).alias("diff"))


@query("f13_redacted", f"""SELECT doc_id, CASE WHEN length(text) >= 20 AND regexp_matches(text, '{redact.SECRET_VALUE}') THEN '{redact.SANITIZED}' WHEN length(text) > 200 THEN left(text, 197) || '...' ELSE text END AS text
    FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, sha256(text) FROM documents UNION ALL SELECT -1000000000 - doc_id, left(text, 30) FROM documents)""")
def redacted(read):
    docs = read("documents")
    rows = docs.select("doc_id", "text").union(docs.select(-1 - F.col("doc_id"), F.sha2("text", 256))).union(docs.select(-1_000_000_000 - F.col("doc_id"), F.substring("text", 1, 30)))
    return rows.select("doc_id", redact.for_log(F.col("text")).alias("text"))


@query("f13_sensitive_keys", f"""WITH k AS (SELECT page_id, unnest(['api-key', 'apikey', 'X_TOKEN', 'host', 'Authorization', 'credentials', 'passwordless', 'note']) AS key, url FROM pages)
    SELECT page_id, key, CASE WHEN regexp_matches(key, '(?i){redact.SENSITIVE_KEY}') THEN '{redact.SANITIZED}' WHEN length(url) >= 20 AND regexp_matches(url, '{redact.SECRET_VALUE}') THEN '{redact.SANITIZED}' WHEN length(url) > 200 THEN left(url, 197) || '...' ELSE url END AS value FROM k""")
def sensitive_keys(read):
    names = F.array(*[F.lit(x) for x in ("api-key", "apikey", "X_TOKEN", "host", "Authorization", "credentials", "passwordless", "note")])
    filled = read("pages").select("page_id", F.explode(redact.fields(F.map_from_arrays(names, F.array_repeat(F.col("url"), 8)))).alias("key", "value"))
    return filled


@query("f14_headers", """WITH k AS (SELECT page_id, unnest(['Cookie', 'Set-Cookie', 'X-Auth-Token', 'api-key', 'accept', 'Proxy-Authorization', 'client_secret']) AS key, url FROM pages)
    SELECT page_id, key, CASE WHEN lower(key) = 'cookie' OR contains(lower(key), 'auth') OR contains(lower(key), 'key') OR contains(lower(key), 'token') OR contains(lower(key), 'secret') THEN '[REDACTED]' ELSE url END AS value FROM k""")
def shown_headers(read):
    names = F.array(*[F.lit(x) for x in ("Cookie", "Set-Cookie", "X-Auth-Token", "api-key", "accept", "Proxy-Authorization", "client_secret")])
    return read("pages").select("page_id", F.explode(redact.headers(F.map_from_arrays(names, F.array_repeat(F.col("url"), 7)))).alias("key", "value"))


@query("x7_instruction_kinds", """WITH m AS (SELECT page_id, (CASE page_id % 6 WHEN 0 THEN '<skills_instructions>' WHEN 1 THEN '<plugins_instructions>' WHEN 2 THEN '<permissions instructions>' WHEN 3 THEN '<app-context>' WHEN 4 THEN '<collaboration_mode>' ELSE '' END) || html AS text FROM pages)
    SELECT page_id, CASE WHEN contains(text, '<skills_instructions>') THEN 'skills' WHEN contains(text, '<plugins_instructions>') THEN 'mcp' WHEN contains(text, '<permissions instructions>') OR contains(text, '<collaboration_mode>') OR contains(text, '<app-context>') THEN 'reminders' ELSE 'sysPrompt' END AS kind FROM m""")
def instruction_kinds(read):
    marks = F.array(*[F.lit(m) for m in ("<skills_instructions>", "<plugins_instructions>", "<permissions instructions>", "<app-context>", "<collaboration_mode>", "")])
    return read("pages").select("page_id", X.instruction_kind(F.concat(F.get(marks, F.col("page_id") % 6), "html")).alias("kind"))


@query("x17_decoded_entities", """SELECT page_id, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS html FROM pages""")
def decoded_entities(read):
    return read("pages").select("page_id", X.decoded(F.col("html")).alias("html"))


@query("s10_virtual_paths", "SELECT page_id, url AS db, CAST(page_id AS VARCHAR) AS session FROM pages WHERE url IS NOT NULL")
def virtual_paths(read):
    """Encode a store and a session as one path, then take it apart again at the last #."""
    coded = read("pages").where(F.col("url").isNotNull()).select("page_id", F.concat(F.lit("store:"), F.url_encode("url"), F.lit("#"), F.url_encode(F.col("page_id").cast("string"))).alias("path"))
    bare = F.substring_index(F.expr("substring(path, 7)"), "#", 1)
    return coded.select("page_id", F.url_decode(bare).alias("db"), F.url_decode(F.substring_index("path", "#", -1)).alias("session"))


@query("a14_distinct_blocks", "SELECT lang AS category, CAST(sum(n) AS BIGINT) AS chars FROM (SELECT DISTINCT source, lang, text, length(text) AS n FROM documents) GROUP BY lang")
def distinct_blocks(read):
    once = read("documents").select("source", F.col("lang").alias("category"), "text").distinct()
    return once.groupBy("category").agg(F.sum(X.units(F.col("text"))).alias("chars"))


@query("a15_filled_seeds", "SELECT source, coalesce(nullif(CAST(sum(n_chars) AS BIGINT), 0), 5768) AS chars FROM documents GROUP BY source")
def filled_seeds(read):
    own = F.coalesce(F.sum("n_chars"), F.lit(0))
    return read("documents").groupBy("source").agg(F.when(own == 0, 5768).otherwise(own).cast("long").alias("chars"))


@query("a30_memory_chars", "SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source")
def memory_chars(read):
    return read("documents").groupBy("source").agg(F.sum(X.units(F.col("text"))).alias("chars"))


@query("p4_content_lengths", "SELECT doc_id, CAST(sum(length(b) + 23) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS b FROM documents) GROUP BY doc_id")
def content_lengths(read):
    """Each text block weighs its length and 23 characters of wrapping."""
    return read("documents").select("doc_id", F.aggregate(F.split("text", "\n"), F.lit(0).cast("long"), lambda n, b: n + F.char_length(b) + 23).alias("chars"))


@query("t22_theme_runs", """WITH f AS (SELECT source, doc_id, lang, sum(CASE WHEN lang IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id) AS run FROM (SELECT *, lag(lang) OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents))
    SELECT source, CAST(run AS BIGINT) AS run, any_value(lang) AS theme, min(doc_id) AS first_turn, max(doc_id) AS last_turn FROM f GROUP BY source, run""")
def theme_runs(read):
    from turnmill.operators.windows import islands, over

    d = read("documents")
    new = F.coalesce(F.col("lang") != F.lag("lang").over(over(["source"], ["doc_id"])), F.lit(True))
    return islands(d, ["source"], ["doc_id"], new, "run").groupBy("source", "run").agg(F.first("lang").alias("theme"), F.min("doc_id").alias("first_turn"), F.max("doc_id").alias("last_turn"))
