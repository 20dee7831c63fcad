"""Turns of codex logs and their steps: texts told twice count once, marks of one compaction are one, calls meet their results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions.content import at, bound, codex_reasoning, codex_text, output_text, stringified
from turnmill.operators.lineage import settled
from turnmill.operators.pi import COMPACTION_STEP, MODEL_STEP, STEP
from turnmill.operators.segments import AGENT_TOOLS
from turnmill.operators.steps import KEYS, aware, rounded, timed
from turnmill.operators.turns import closed_turns
from turnmill.operators.windows import before, over, up_to
from turnmill.sources.transcripts import codex_lines, has_type, number_of, text_of

# Calls and results by type, and what stands where a log has no text.
CALLS = ("function_call", "custom_tool_call", "web_search_call", "tool_search_call")
RESULTS = ("function_call_output", "custom_tool_call_output", "tool_search_output", "web_search_end", "mcp_tool_call_end", "patch_apply_end")
NO_PROMPT = "(Codex 日志未记录用户输入)"
HIDDEN_THOUGHT = "（Codex 推理内容已加密或不可读；仅保留 reasoning token 统计。）"
COMPACTED = "Codex 在本轮执行中触发上下文压缩，后续步骤基于压缩后的新窗口继续。"
NO_RESULT = "（未发现匹配的 Codex 工具结果；该调用可能被中断或日志不完整。）"
ONLY_COUNTS = "（Codex 日志记录了 token_count，但未记录可读的 assistant 文本、推理摘要或工具事件；该轮只展示 token 统计。）"
NOTHING = "（Codex 日志未记录可读的 assistant 事件或 token_count；该轮可能被中断、压缩，或来自早期日志格式。）"
ENVIRONMENT = "<environment_context>"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def turn_events(lines: DataFrame) -> DataFrame:
    """Lines inside turns: session, turn_i, seq, ms, type, what (the payload's type), v.  A task's start opens a turn (and ends one that is open), its completion or abortion closes it."""
    v = F.col("v")
    good = codex_lines(lines).where(F.col("error").isNull()).withColumn("what", F.coalesce(text_of(v, "$.payload.type"), F.lit("")))
    message = F.col("type") == "event_msg"
    # Turns and steps both read these, and a line is parsed once.
    return settled(closed_turns(good, message & (F.col("what") == "task_started"), message & F.col("what").isin("task_complete", "turn_aborted")))


def codex_turns(lines: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """session, turn_i, turn_id, prompt, model, window, start_ms, end_ms, duration_ms, aborted, compacted, requests, out_tok, max_input, last_input.

    The prompt is the first message of the user that isn't empty, as an event or as an item (but not the environment); model and window are
    those named last, before the turn or in it.  last_input is that of the last usage behind the turn's last compaction.
    """
    v, t, what = F.col("v"), F.col("type"), F.col("what")
    events = turn_events(lines) if events is None else events
    is_event, is_item = t == "event_msg", t == "response_item"
    said = F.when(is_event & (what == "user_message"), text_of(v, "$.payload.message"))
    item = F.when(is_item & (what == "message") & (text_of(v, "$.payload.role") == "user"), _trimmed(bound(at(v, "$.payload.content"), lambda x: codex_text(x))))
    prompt = F.coalesce(F.nullif(said, F.lit("")), F.when((item != "") & ~item.startswith(ENVIRONMENT), item))
    usage = F.when(is_event & (what == "token_count") & has_type(v, "$.payload.info.last_token_usage", "OBJECT"), F.struct(*[F.coalesce(number_of(v, f"$.payload.info.last_token_usage.{n}"), F.lit(0.0)).cast("long").alias(a) for n, a in (("input_tokens", "input"), ("cached_input_tokens", "cached"), ("output_tokens", "output"))]))
    compaction = (t == "compacted") | is_event & (what == "context_compacted")
    small = events.select(
        *KEYS, "seq", "ms", prompt.alias("prompt"), usage.alias("usage"), compaction.alias("compaction"), (is_event & (what == "turn_aborted")).alias("aborted"), (is_event & (what == "task_started")).alias("opens"),
        F.when(is_event & what.isin("task_complete", "turn_aborted"), number_of(v, "$.payload.duration_ms")).alias("lasted"), text_of(v, "$.payload.turn_id").alias("own_id"),
    )
    last_mark = F.coalesce(F.max(F.when(F.col("compaction"), F.col("seq"))).over(Window.partitionBy(*KEYS)), F.lit(-1))
    counts = F.col("usage").isNotNull()
    real = counts & ((F.col("usage.input") > 0) | (F.col("usage.cached") > 0) | (F.col("usage.output") > 0)) & (F.col("seq") > F.col("_mark"))
    by_seq = lambda value, where: F.min_by(value, F.when(where, F.col("seq")))
    per = small.withColumn("_mark", last_mark).groupBy(*KEYS).agg(
        F.min("seq").alias("_first"), F.coalesce(by_seq("own_id", F.col("opens")), F.concat(F.lit("turn_"), F.col("turn_i") + 1)).alias("turn_id"), F.coalesce(by_seq("prompt", F.col("prompt").isNotNull()), F.lit(NO_PROMPT)).alias("prompt"),
        F.max(F.when(F.col("opens"), F.col("ms"))).alias("start_ms"), F.max_by("ms", F.when(F.col("ms").isNotNull(), F.col("seq"))).alias("end_ms"), F.max("lasted").cast("long").alias("duration_ms"),
        F.max("aborted").alias("aborted"), F.max("compaction").alias("compacted"), F.count_if(counts).alias("requests"), F.coalesce(F.sum("usage.output"), F.lit(0)).alias("out_tok"),
        F.coalesce(F.max("usage.input"), F.lit(0)).alias("max_input"), F.coalesce(F.max_by("usage.input", F.when(real, F.col("seq"))), F.lit(0)).alias("last_input"),
    )
    # What is said about model and window, on any line of the session, up to a turn's last line.
    context = codex_lines(lines).where("error is null").withColumn("what", text_of(v, "$.payload.type"))
    window = F.when((t == "turn_context") | what.isin("token_count", "task_started") & (t == "event_msg"), F.coalesce(number_of(v, "$.payload.model_context_window"), number_of(v, "$.payload.info.model_context_window")).cast("long"))
    told = context.select("session", "seq", F.lit(None).cast("long").alias("turn_i"), F.when(t == "turn_context", text_of(v, "$.payload.model")).alias("model"), window.alias("window"))
    inside = events.groupBy(*KEYS).agg(F.max("seq").alias("seq")).select("session", "seq", "turn_i", F.lit(None).cast("string").alias("model"), F.lit(None).cast("long").alias("window"))
    carried = told.where("model is not null or window is not null").unionByName(inside)
    known = carried.select("session", "turn_i", *[F.coalesce(F.last(c, ignorenulls=True).over(up_to(["session"], ["seq", F.col("turn_i").asc_nulls_first()])), F.lit(default)).alias(c) for c, default in (("model", "codex"), ("window", 200_000))])
    return per.drop("_first").join(known.where("turn_i is not null"), KEYS)


def codex_steps(events: DataFrame, turns: DataFrame) -> DataFrame:
    """session, turn_i, step_i, STEP, in_tok and out_tok (of the usage nearest to the step's line within its turn)."""
    v, t, what = F.col("v"), F.col("type"), F.col("what")
    is_event, is_item = t == "event_msg", t == "response_item"
    call_id = text_of(v, "$.payload.call_id")
    payload = F.try_variant_get(v, "$.payload", "variant")
    asked = F.when(what.isin("function_call", "tool_search_call"), at(v, "$.payload.arguments")).when(what == "web_search_call", at(v, "$.payload.action")).otherwise(at(v, "$.payload.input"))
    told = (
        F.when(what == "tool_search_output", F.coalesce(at(v, "$.payload.tools"), payload)).when(what == "web_search_end", F.coalesce(at(v, "$.payload.action"), at(v, "$.payload.query"), payload))
        .when(what == "mcp_tool_call_end", F.coalesce(at(v, "$.payload.result.Ok.content"), at(v, "$.payload.result.Err"), at(v, "$.payload.result"))).when(what == "patch_apply_end", payload).otherwise(at(v, "$.payload.output"))
    )
    printed = F.array_join(F.filter(F.array(text_of(v, "$.payload.stdout"), text_of(v, "$.payload.stderr")), lambda x: x != ""), "\n")
    output = F.coalesce(F.when(what == "patch_apply_end", F.nullif(printed, F.lit(""))), bound(told, lambda x: F.coalesce(output_text(x), F.lit(""))))
    flag = lambda path: F.coalesce(F.try_variant_get(v, path, "boolean"), F.lit(False))
    failed = F.coalesce(text_of(v, "$.payload.status") == "failed", F.lit(False))
    is_error = (
        F.when(what == "tool_search_output", failed).when(what == "mcp_tool_call_end", flag("$.payload.result.Ok.isError") | at(v, "$.payload.result.Err").isNotNull())
        .when(what == "patch_apply_end", failed | ~F.coalesce(F.try_variant_get(v, "$.payload.success", "boolean"), F.lit(True))).otherwise(F.lit(False))
    )
    took = F.coalesce(F.floor(F.coalesce(number_of(v, "$.payload.duration.secs"), F.lit(0.0)) * 1000 + F.coalesce(number_of(v, "$.payload.duration.nanos"), F.lit(0.0)) / 1e6 + 0.5), F.lit(0)).cast("long")
    text = (
        F.when(is_event & (what == "agent_message"), text_of(v, "$.payload.message"))
        .when(is_item & (what == "message") & (text_of(v, "$.payload.role") == "assistant"), F.nullif(_trimmed(bound(at(v, "$.payload.content"), lambda x: codex_text(x))), F.lit("")))
        .when(is_item & (what == "reasoning"), bound(at(v, "$.payload.summary"), lambda x: F.coalesce(codex_reasoning(x), F.lit(""))))
    )
    usage = F.when(is_event & (what == "token_count") & has_type(v, "$.payload.info.last_token_usage", "OBJECT"), F.struct("seq", *[F.coalesce(number_of(v, f"$.payload.info.last_token_usage.{n}"), F.lit(0.0)).cast("long").alias(a) for n, a in (("input_tokens", "input"), ("output_tokens", "output"), ("reasoning_output_tokens", "reasoning"))]))
    label = (
        F.when(t == "compacted", "mark").when(is_event & (what == "context_compacted"), "echo").when(is_item & (what == "reasoning"), "thought").when(text.isNotNull(), "text")
        .when(call_id.isNotNull() & what.isin(*CALLS), "call").when(call_id.isNotNull() & what.isin(*RESULTS), "result").when(usage.isNotNull(), "usage")
    )
    name = F.coalesce(text_of(v, "$.payload.name"), F.when(what == "web_search_call", "web_search").when(what == "tool_search_call", "tool_search").otherwise("unknown"))
    calling, answering = label == "call", label == "result"
    read = events.select(
        *KEYS, "seq", "ms", label.alias("label"), text.alias("text"), F.when(calling | answering, call_id).alias("id"), F.when(calling, F.struct("seq", name.alias("name"), stringified(asked).alias("input"), "ms")).alias("call"),
        F.when(answering, F.struct((what != "patch_apply_end").alias("rank"), F.when(what == "patch_apply_end", -F.col("seq")).otherwise(F.col("seq")).alias("at"), output.alias("output"), is_error.alias("is_error"), took.alias("took"), F.col("ms").alias("ms"))).alias("result"), usage.alias("usage"),
    ).where("label is not null")
    # Nearest usage: the nearer of the last before and the first behind, the earlier of two at one distance.
    last, following = F.last("usage", ignorenulls=True).over(up_to(KEYS, ["seq"])), F.first("usage", ignorenulls=True).over(over(KEYS, ["seq"]).rowsBetween(0, Window.unboundedFollowing))
    near = read.withColumn("_l", last).withColumn("_f", following)
    nearest = F.when(F.col("_f").isNull() | (F.col("seq") - F.col("_l.seq") <= F.col("_f.seq") - F.col("seq")), F.col("_l")).otherwise(F.col("_f"))
    marks = F.col("label").isin("mark", "echo")
    near = near.withColumn("near", nearest).drop("_l", "_f").withColumn("_mark", F.last(F.when(marks, F.col("label")), ignorenulls=True).over(before(KEYS, ["seq"])))
    near = settled(near)
    once = F.row_number().over(Window.partitionBy(*KEYS, "label", F.when(F.col("label") == "text", F.col("text"))).orderBy("seq")) == 1
    none, zero, no = F.lit(""), F.lit(0).cast("long"), F.lit(False)
    tokens_in, tokens_out = (F.coalesce(F.col(f"near.{c}"), zero) for c in ("input", "output"))

    def step(kind, name, at_ms, ms, text, input_, result, error, text_tok, asst_tok, think_tok, call_tok, result_tok, order) -> list[Column]:
        found = (kind, name, at_ms, ms, text, input_, result, error, text_tok, asst_tok, think_tok, call_tok, result_tok)
        return [*KEYS, *[(x if isinstance(x, Column) else F.lit(x)).alias(n) for x, n in zip(found, STEP, strict=True)], tokens_in.alias("in_tok"), tokens_out.alias("out_tok"), "seq", F.lit(order).alias("part")]

    text, ms = F.col("text"), F.col("ms")
    compactions = near.where((F.col("label") == "mark") | (F.col("label") == "echo") & F.coalesce(F.col("_mark") != "mark", F.lit(True))).select(step("i", COMPACTION_STEP, ms, zero, COMPACTED, none, none, no, zero, zero, zero, zero, zero, 0))
    thoughts = near.where("label = 'thought'").select(step("m", MODEL_STEP, ms, zero, F.coalesce(F.nullif(text, none), F.lit(HIDDEN_THOUGHT)), none, none, no, zero, zero, F.coalesce("near.reasoning", zero), zero, zero, 0))
    texts = near.withColumn("_once", once).where("label = 'text' and _once").select(step("m", MODEL_STEP, ms, zero, text, none, none, no, rounded(text), aware(text), zero, zero, zero, 0))
    by_id = near.where("label in ('call', 'result')").groupBy(*KEYS, "id").agg(F.max("call").alias("c"), F.max("result").alias("r"))
    calls = near.where("label = 'call'").drop("call", "result").join(by_id, [*KEYS, "id"])
    calling = calls.select(step("m", MODEL_STEP, ms, zero, none, F.col("c.input"), none, no, zero, zero, zero, rounded(F.concat("c.name", "c.input")), zero, 0))
    kind = F.when(F.col("c.name").isin(*AGENT_TOOLS), "s").otherwise("t")
    result = F.coalesce("r.output", F.lit(NO_RESULT))
    answered = calls.select(step(kind, F.col("c.name"), F.coalesce("r.ms", "c.ms"), F.coalesce("r.took", zero), none, F.col("c.input"), result, F.coalesce("r.is_error", F.lit(True)), zero, zero, zero, zero, F.when(F.col("r").isNotNull(), rounded(F.col("r.output"))).otherwise(zero), 1))
    made = settled(reduce(DataFrame.unionByName, (compactions, thoughts, texts, calling, answered)))
    # Turns without a step get one that says so, with the last usage if there is any.
    usages = near.where("label = 'usage'").groupBy(*KEYS).agg(F.max(F.struct("seq", "ms", "usage")).alias("u"))
    bare = turns.select(*KEYS, "start_ms").join(made.select(*KEYS).distinct(), KEYS, "left_anti").join(usages, KEYS, "left")
    bare = bare.select(*KEYS, F.coalesce("u.ms", "start_ms").alias("ms"), F.when(F.col("u").isNotNull(), ONLY_COUNTS).otherwise(NOTHING).alias("text"), F.col("u.usage").alias("near"), F.lit(0).cast("long").alias("seq"))
    # Its words are no text of the assistant's, but they count as such in the composition.
    empty = bare.select(step("m", MODEL_STEP, ms, zero, text, none, none, no, zero, aware(text), zero, zero, zero, 0))
    steps = timed(made.unionByName(empty), turns, ["seq", "part"])
    spent = F.col("out_tok") + F.col("think_tok") + F.col("text_tok")
    slow = F.when((F.col("kind") == "m") & (F.col("ms") == 0) & (spent > 0), F.greatest(F.lit(1), F.floor(spent / 30 + 0.5) * 1000)).otherwise(F.col("ms"))
    return steps.withColumn("ms", slow.cast("long")).select(*KEYS, "step_i", *STEP, "in_tok", "out_tok")
