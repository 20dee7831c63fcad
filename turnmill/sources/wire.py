"""Captured requests of two agents, opened to their parts: system prompt, tools, sections of the first message, usage told by a stream of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions.content import at, bound, items, stringified
from turnmill.functions.text import trimmed, units
from turnmill.sources.transcripts import has_type, number_of, parsed, text_of

# Marks of system blocks, and of the sections of a first message in the order in which they are looked for.
BILLING, IDENTITY = ("cc_version", "billing-header"), "You are a Claude agent"
GLOBAL, PROJECT, SERVERS, SKILLS, DATE, CLOSING = "Contents of /Users/", "Contents of", "# MCP Server Instructions", "The following skills are available", "# currentDate", "</system-reminder>"
SKILL_TEXT, PLUGIN_TEXT = "<skills_instructions>", "<plugins_instructions>"
DONE = "[DONE]"


def posts(lines: DataFrame) -> DataFrame:
    """session, line_no, v of the POST requests with an object as their body."""
    v = F.col("v")
    return parsed(lines).where((text_of(v, "$.request.method") == "POST") & has_type(v, "$.request.body", "OBJECT")).select("session", "line_no", "v")


def first_per_session(rows: DataFrame) -> DataFrame:
    """session and v of each session's first row: all that is told of a session is opened from that one, the others are only looked at."""
    return rows.groupBy("session").agg(F.min_by("v", "line_no").alias("v"))


def event_usage(body: Column) -> Column:
    """struct(input, cached, output, reasoning) of the last usage object among the data lines of a stream of events; other lines, what is no JSON and the closing mark don't count."""
    data = F.transform(F.filter(F.split(body, r"\r?\n"), lambda x: x.startswith("data:")), lambda x: trimmed(F.substring(x, F.lit(6), F.char_length(x))))
    events = F.transform(F.filter(data, lambda x: (x != "") & (x != DONE)), F.try_parse_json)
    used = lambda e: F.coalesce(F.when(has_type(e, "$.response.usage", "OBJECT"), at(e, "$.response.usage")), F.when(has_type(e, "$.usage", "OBJECT"), at(e, "$.usage")))
    last = F.try_element_at(F.filter(F.transform(events, used), lambda u: u.isNotNull()), F.lit(-1))
    n = lambda u, *paths: F.coalesce(*[number_of(u, p) for p in paths]).cast("long")
    return bound(last, lambda u: F.struct(
        n(u, "$.input_tokens").alias("input"), n(u, "$.input_tokens_details.cached_tokens", "$.cached_input_tokens").alias("cached"), n(u, "$.output_tokens").alias("output"), n(u, "$.output_tokens_details.reasoning_tokens", "$.reasoning_output_tokens").alias("reasoning"),
    ))


def _texts(content: Column) -> Column:
    """Texts of a content: itself, or those of its blocks that aren't empty."""
    blocks = F.filter(F.transform(items(content), lambda b: F.coalesce(text_of(b, "$.text"), F.lit(""))), lambda t: t != "")
    return F.when(has_type(content, "$", "STRING"), F.array(text_of(content, "$"))).when(has_type(content, "$", "ARRAY"), blocks).otherwise(F.array().cast("array<string>"))


def codex_captures(lines: DataFrame) -> DataFrame:
    """One row per capture log with a request to ``/responses``: session, wire_api, model, version, sys_prompt, tools, runtime, skills, plugins (characters), tool_names, input, cached, output, reasoning, prompt_hash, tools_hash.

    Of the older layout instructions stand alone and developers' texts are told apart by their marks; of the newer one they are the instructions,
    and tools come as items.  Sizes are UTF-16 units; JSON is compact, its keys in alphabetic order.
    """
    v = F.col("v")
    url = F.coalesce(F.nullif(text_of(v, "$.request.url"), F.lit("")), text_of(v, "$.request.upstream_url"), F.lit(""))
    old = has_type(v, "$.request.body.instructions", "STRING")
    inputs = F.when(has_type(v, "$.request.body.input", "ARRAY"), items(at(v, "$.request.body.input"))).otherwise(F.array().cast("array<variant>"))
    fit = posts(lines).where(url.contains("/responses") & (old | F.try_variant_get(v, "$.request.body.input[0]", "variant").isNotNull()))
    kept = first_per_session(fit).select("session", "v", old.alias("old"), inputs.alias("inputs"))
    told = F.flatten(F.transform(F.filter("inputs", lambda x: F.coalesce(text_of(x, "$.role") == "developer", F.lit(False))), lambda x: bound(at(x, "$.content"), _texts)))
    own = F.when(has_type(v, "$.request.body.tools", "ARRAY"), items(at(v, "$.request.body.tools"))).otherwise(F.array().cast("array<variant>"))
    added = F.flatten(F.transform(F.filter("inputs", lambda x: F.coalesce(text_of(x, "$.type") == "additional_tools", F.lit(False)) & has_type(x, "$.tools", "ARRAY")), lambda x: items(at(x, "$.tools"))))
    opened = kept.select("session", "old", "v", told.alias("told"), own.alias("own"), added.alias("added"))
    tools = F.when(F.col("old") | (F.size("added") == 0), F.col("own")).otherwise(F.col("added"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(tools, lambda x: F.to_json(x)), ","), F.lit("]"))
    name = lambda x: F.coalesce(text_of(x, "$.name"), text_of(x, "$.function.name"), F.lit(""))
    prompt = F.when(F.col("old"), text_of(v, "$.request.body.instructions")).otherwise(F.array_join("told", "\n\n"))
    is_skill, is_plugin = (lambda t: t.contains(SKILL_TEXT)), (lambda t: ~t.contains(SKILL_TEXT) & t.contains(PLUGIN_TEXT))
    size = lambda which: F.when(F.col("old"), units(F.array_join(F.filter("told", which), "\n\n"))).otherwise(0).cast("long")
    body = F.coalesce(text_of(v, "$.response.body"), stringified(at(v, "$.response.body")))
    columns = [
        F.when(F.col("old"), "responses").otherwise("chat_completions").alias("wire_api"), F.coalesce(text_of(v, "$.request.body.model"), F.lit("unknown")).alias("model"),
        F.coalesce(F.nullif(F.regexp_extract(F.coalesce(text_of(v, "$.request.headers.user-agent"), F.lit("")), r"codex(?:-cli)?/([\d.]+)", 1), F.lit("")), F.lit("unknown")).alias("version"),
        units(prompt).alias("sys_prompt"), units(listed).alias("tools"), size(lambda t: ~is_skill(t) & ~is_plugin(t)).alias("runtime"), size(is_skill).alias("skills"), size(is_plugin).alias("plugins"),
        F.array_join(F.array_sort(F.filter(F.transform(tools, name), lambda x: x != "")), ",").alias("tool_names"), event_usage(body).alias("usage"), F.sha2(prompt, 256).alias("prompt_hash"), F.sha2(listed, 256).alias("tools_hash"),
    ]
    found = opened.select("session", *columns)
    return found.select(*[c for c in found.columns if c not in ("usage", "prompt_hash", "tools_hash")], "usage.*", "prompt_hash", "tools_hash")


def message_sections(text: Column) -> dict[str, Column]:
    """Sizes of a first message's parts: total, global, project, servers, skills (contents of the sections), date, wrapper (all else before the closing tag), and the wrapper's text.

    A section's content begins behind the first empty line after its mark and ends before the next section in the fixed order (not the nearest),
    line feeds at its end left out.  Sections may overlap where marks stand in another order: the wrapper's size then counts them twice, its text loses them once.
    """
    find = lambda mark, begin=1: F.call_function("locate", F.lit(mark), text, begin if isinstance(begin, Column) else F.lit(begin)).cast("int") - 1
    whole = F.char_length(text)
    start = {"global": find(GLOBAL)}
    start["project"] = F.when(start["global"] >= 0, find(PROJECT, start["global"] + 21)).otherwise(-1)
    start |= {"servers": find(SERVERS), "skills": find(SKILLS), "date": find(DATE)}
    closing = find(CLOSING)
    end = F.when(closing >= 0, closing).otherwise(whole)

    def content(name: str, following: tuple[str, ...]) -> Column:
        """struct(begin, end) of a section's content; null where it has none."""
        own = start[name]
        until = end
        for x in reversed(following):
            until = F.when(start[x] > own, start[x]).otherwise(until)
        gap = find("\n\n", own + 1)
        begin = F.when(gap >= 0, gap + 2).otherwise(own)
        stop = F.greatest(F.char_length(F.regexp_replace(F.substring(text, F.lit(1), until), r"\n+\z", "")), F.least(until, F.lit(1)))
        there = (own > 0) if name == "project" else (own >= 0)
        return F.when(there & (stop > begin), F.struct(begin.alias("begin"), stop.alias("end")))

    found = {
        "global": content("global", ("project", "servers", "skills", "date")), "project": content("project", ("servers", "skills", "date")),
        "servers": content("servers", ("skills", "date")), "skills": content("skills", ("date",)),
    }
    piece = lambda r: F.substring(text, r["begin"] + 1, r["end"] - r["begin"])
    sizes = {name: F.coalesce(units(piece(r)), F.lit(0)).cast("long") for name, r in found.items()}
    head = F.substring(text, F.lit(1), end)
    ranges = F.array_sort(F.array_compact(F.array(*found.values())))
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    kept = F.aggregate(ranges, none, lambda acc, r: F.struct(F.greatest(acc["at"], r["end"]).alias("at"), F.concat(acc["text"], F.substring(head, acc["at"] + 1, F.greatest(r["begin"] - acc["at"], F.lit(0)))).alias("text")))
    wrapper = bound(kept, lambda k: trimmed(F.concat(k["text"], F.substring(head, k["at"] + 1, F.char_length(head)))))
    return {
        "total": units(text), **sizes, "date": F.when(start["date"] >= 0, end - start["date"]).otherwise(0).cast("long"),
        "wrapper": F.greatest(F.lit(0), units(head) - sum(sizes.values())).cast("long"), "wrapper_text": F.when(F.size(ranges) == 0, head).otherwise(wrapper),
    }


def claude_captures(lines: DataFrame) -> DataFrame:
    """One row per capture log with a request that lists messages: session, model, version, sys_prompt, billing, identity, harness, tools, input, and the sizes of message_sections() (section_total, section_global and so on)."""
    v = F.col("v")
    kept = first_per_session(posts(lines).where(has_type(v, "$.request.body.messages", "ARRAY")))
    blocks = F.when(has_type(v, "$.request.body.system", "ARRAY"), F.transform(items(at(v, "$.request.body.system")), lambda b: F.coalesce(text_of(b, "$.text"), F.lit("")))).otherwise(F.array().cast("array<string>"))
    text = F.when(has_type(v, "$.request.body.messages[0].content", "ARRAY"), text_of(v, "$.request.body.messages[0].content[0].text"))
    agent = F.coalesce(text_of(v, "$.request.headers.user-agent"), F.lit(""))
    reply = F.coalesce(text_of(v, "$.response.body"), F.lit(""))
    opened = kept.select(
        "session", blocks.alias("blocks"), F.coalesce(text, F.lit("")).alias("text"), F.when(at(v, "$.request.body.tools").isNull(), "[]").otherwise(F.to_json(at(v, "$.request.body.tools"))).alias("tools"),
        F.coalesce(F.nullif(stringified(at(v, "$.request.body.model")), F.lit("")), F.lit("unknown")).alias("model"), F.coalesce(F.nullif(F.regexp_extract(agent, r"claude-cli/([\d.]+)", 1), F.lit("")), F.lit("unknown")).alias("version"),
        F.coalesce(F.nullif(F.regexp_extract(reply, r'"input_tokens":(\d+)', 1), F.lit("")).cast("long"), F.lit(0)).alias("input"),
    )
    bills = lambda t: t.contains(BILLING[0]) | t.contains(BILLING[1])
    size = lambda which: F.aggregate(F.filter("blocks", which), F.lit(0).cast("long"), lambda n, t: n + units(t))
    columns = [
        "model", "version", size(lambda t: F.lit(True)).alias("sys_prompt"), size(bills).alias("billing"), size(lambda t: ~bills(t) & t.contains(IDENTITY)).alias("identity"), size(lambda t: ~bills(t) & ~t.contains(IDENTITY)).alias("harness"),
        units(F.col("tools")).alias("tools"), "input", *[c.alias(f"section_{n}") for n, c in message_sections(F.col("text")).items()],
    ]
    return opened.select("session", *columns)
