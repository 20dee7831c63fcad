"""Contents of transcript lines, as variants, to text; each format by its own rule.

A value that is neither text nor known is given as JSON, with the keys of objects in alphabetic order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnmill.sources.transcripts import has_type, number_of, text_of

# Blocks of text.
CODEX_TEXTS = ("input_text", "output_text", "text")
FAILED = ("error", "failed")
# Fixed value: what stands for the JSON around a block of text.
WRAPPER = " " * 23
#: How deep lists within lists are opened; what lies deeper is given as JSON.
NESTED = 3


def at(v: Column, path: str) -> Column:
    """The value at ``path``; null where there is none or a JSON null."""
    return F.when(~has_type(v, path, "VOID"), F.try_variant_get(v, path, "variant"))


def items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def joined(texts: Column, between: str = "\n") -> Column:
    """The texts that aren't empty."""
    return F.array_join(F.filter(texts, lambda x: x != ""), between)


def stringified(v: Column) -> Column:
    return F.when(v.isNull() | has_type(v, "$", "VOID"), "").otherwise(F.coalesce(text_of(v, "$"), F.to_json(v)))


def output_text(v: Column) -> Column:
    """A tool's output: text, a list of texts and blocks by line, a block's text."""
    one = lambda x: F.coalesce(text_of(x, "$"), text_of(x, "$.text"), stringified(x))
    return F.when(has_type(v, "$", "ARRAY"), F.array_join(F.transform(items(v), one), "\n")).otherwise(one(v))


def bound(value: Column, then) -> Column:
    """``then`` of a value that it names more than once, without as many copies of the expression."""
    return F.transform(F.array(value), then)[0]


def content_text(v: Column, depth: int = NESTED) -> Column:
    """A message's content: text, or its text blocks, each with the blanks that stand for its wrapper, and the texts of results within; else empty."""
    block = lambda x: F.when(text_of(x, "$.type") == "text", F.concat(F.coalesce(text_of(x, "$.text"), F.lit("")), F.lit(WRAPPER)))
    inner = (lambda x: F.when(text_of(x, "$.type") == "tool_result", bound(at(x, "$.content"), lambda y: content_text(y, depth - 1)))) if depth else (lambda x: F.lit(None))
    listed = F.array_join(F.transform(items(v), lambda x: F.coalesce(block(x), inner(x), F.lit(""))), "")
    return F.coalesce(text_of(v, "$"), F.when(has_type(v, "$", "ARRAY"), listed), F.lit(""))


def codex_text(v: Column) -> Column:
    block = lambda x: F.when(text_of(x, "$.type").isin(*CODEX_TEXTS), F.coalesce(text_of(x, "$.text"), F.lit(""))).otherwise("")
    return F.when(has_type(v, "$", "ARRAY"), joined(F.transform(items(v), block))).otherwise(F.coalesce(text_of(v, "$"), F.lit("")))


def codex_reasoning(v: Column) -> Column:
    """A summary of reasoning: its parts, trimmed, by paragraph."""
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    part = lambda x: trimmed(F.coalesce(text_of(x, "$"), text_of(x, "$.text"), text_of(x, "$.content"), F.lit("")))
    return F.when(has_type(v, "$", "ARRAY"), joined(F.transform(items(v), part), "\n\n")).otherwise(trimmed(F.coalesce(text_of(v, "$"), F.lit(""))))


def pi_text(v: Column) -> Column:
    one = lambda x: F.coalesce(text_of(x, "$"), text_of(x, "$.text"), text_of(x, "$.content"), F.lit(""))
    return F.when(has_type(v, "$", "ARRAY"), joined(F.transform(items(v), one))).otherwise(one(v))


def openclaw_text(v: Column, depth: int = NESTED) -> Column:
    one = F.coalesce(text_of(v, "$"), text_of(v, "$.text"), text_of(v, "$.content"), stringified(v))
    return F.when(has_type(v, "$", "ARRAY"), joined(F.transform(items(v), lambda x: openclaw_text(x, depth - 1)))).otherwise(one) if depth else one


def opencode_usage(part: Column) -> Column:
    """struct(input, output, reasoning, cached) of a part's tokens, else of its usage; null without either."""
    held = F.when(has_type(part, "$.tokens", "OBJECT"), at(part, "$.tokens")).when(has_type(part, "$.usage", "OBJECT"), at(part, "$.usage"))
    paths = (("$.input", "input"), ("$.output", "output"), ("$.reasoning", "reasoning"), ("$.cache.read", "cached"))
    return F.when(held.isNotNull(), F.struct(*[number_of(held, p).alias(name) for p, name in paths]))


def opencode_tool(part: Column) -> Column:
    """struct(name, input, result, duration_ms, is_error) of a part that is a tool's call."""
    state = lambda path: at(part, "$.state." + path)
    first = lambda *found: bound(F.coalesce(*found), stringified)
    lasted = number_of(part, "$.state.time.end") - number_of(part, "$.state.time.start")
    return F.struct(
        first(at(part, "$.tool"), at(part, "$.name"), state("tool"), F.parse_json(F.lit('"tool"'))).alias("name"),
        first(state("input"), at(part, "$.input"), F.parse_json(F.lit("{}"))).alias("input"),
        first(state("output"), state("result"), at(part, "$.output")).alias("result"),
        F.coalesce(F.greatest(F.floor(lasted + 0.5), F.lit(0)), F.lit(0)).cast("long").alias("duration_ms"),
        F.lower(first(state("status"), at(part, "$.status"))).isin(*FAILED).alias("is_error"),
    )


# Agents, and the folders of their logs below a home folder.
SOURCES = ("codex", "claude", "opencode", "pi", "openclaw")
FOLDERS = ((".codex/", "codex"), (".pi/agent/sessions/", "pi"), (".local/share/opencode/", "opencode"), (".openclaw/", "openclaw"))


def session_source(source: Column, model: Column, version: Column, filename: Column) -> Column:
    """The agent that wrote a session: as stored, else by model, version and file name, else claude."""
    model, version, filename = (F.lower(F.coalesce(x, F.lit(""))) for x in (model, version, filename))
    return (
        F.when(source.isin(*SOURCES), source)
        .when(model.contains("claude"), "claude")
        .when((model == "opencode") | version.contains("opencode"), "opencode")
        .when((model == "pi") | (version == "pi"), "pi")
        .when((model == "openclaw") | version.contains("openclaw"), "openclaw")
        .when(model.contains("gpt") | model.contains("codex") | version.contains("codex") | filename.startswith("rollout-"), "codex")
        .otherwise("claude")
    )


def source_of_path(path: Column, home: str) -> Column:
    """By the agents' folders below ``home``; null elsewhere."""
    return F.coalesce(*[F.when(path.contains(f"{home}/{folder}"), source) for folder, source in FOLDERS])


def source_of_file(path: Column, home: str, label: Column) -> Column:
    """By folder, else by the format's ``label``, else claude."""
    by_label = F.when(label.isin("codex", "opencode", "openclaw"), label).when(label.isin("pi-session", "pi-event-stream"), "pi")
    return F.coalesce(source_of_path(path, home), by_label, F.lit("claude"))


def source_of_model(model: Column) -> Column:
    model = F.lower(model)
    return F.when(model.isin("opencode", "pi", "openclaw"), model).when(model.contains("codex"), "codex").when(model.contains("claude"), "claude")


def model_for_source(model: Column, source: Column) -> Column:
    """A session that one agent ran inside another counts as the outer one's."""
    return F.when((source == "openclaw") & (model == "pi"), "openclaw").otherwise(model)
