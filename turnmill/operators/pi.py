"""Turns of pi logs: event streams, whose messages are tentative until they end, and tree-shaped sessions, of which one branch counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions.content import at, bound, pi_text, stringified
from turnmill.operators.lineage import settled
from turnmill.operators.steps import KEYS, aware, between, rounded, timed
from turnmill.operators.windows import before, islands, ordinal, over
from turnmill.sources.transcripts import TREE_TYPES, has_type, longest_branch, pi_lines, text_of

S = ["session"]
# Names of steps, and what stands for a compaction without a summary.
MODEL_STEP, COMPACTION_STEP = "模型生成", "上下文压缩"
COMPACTED = "Pi Code Agent 触发上下文压缩。"
STREAM, SESSION = "Pi stream: ", "Pi session: "
COMPACTIONS = ("auto_compaction_start", "auto_compaction_end")
#: Lines that open a turn where none is open.
ENSURING = ("message_update", "message_end", "tool_execution_end", *COMPACTIONS)
STEP = ["kind", "name", "at_ms", "ms", "text", "input", "result", "is_error", "text_tok", "asst_tok", "think_tok", "call_tok", "result_tok"]


def _some(*texts: Column) -> Column:
    """The first text that isn't empty, else the last one's emptiness."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def _value(*found: Column) -> Column:
    return F.coalesce(*found)


def _said(content: Column) -> Column:
    return bound(content, lambda x: F.coalesce(pi_text(x), F.lit("")))


def _step(kind: Column | str, name: Column | str, text: Column, input_: Column, result: Column, ms: Column, is_error: Column) -> list[Column]:
    """The columns of STEP but at_ms."""
    kind, name = (x if isinstance(x, Column) else F.lit(x) for x in (kind, name))
    model = kind == "m"
    none = F.lit(0).cast("long")
    return [
        kind.alias("kind"), name.alias("name"), ms.cast("long").alias("ms"), text.alias("text"), input_.alias("input"), result.alias("result"), is_error.alias("is_error"),
        F.when(model, rounded(text)).otherwise(none).alias("text_tok"), F.when(model, aware(text)).otherwise(none).alias("asst_tok"), none.alias("think_tok"), none.alias("call_tok"),
        F.when(kind == "t", rounded(result)).otherwise(none).alias("result_tok"),
    ]


def event_turns(lines: DataFrame, filename: Column | str = "") -> tuple[DataFrame, DataFrame]:
    """(turns, steps) of event streams.

    A turn reaches from its start line to its end line; other lines open one where none is open.  Of the updates of an open message the last one
    with a text counts, until the message's end takes its place; without an end it counts when its turn closes or the log ends, behind all
    other steps.  turns: session, turn_i, prompt, start_ms, end_ms, compaction; steps: session, turn_i, step_i and STEP.
    """
    v, t = F.col("v"), F.col("type")
    role = _some(text_of(v, "$.message.role"), text_of(v, "$.role"))
    tool_id = _some(text_of(v, "$.toolCallId"), text_of(v, "$.id"), F.concat(F.lit("tool_"), F.col("seq").cast("string")))
    result = F.when(has_type(v, "$.result", "OBJECT"), at(v, "$.result.content")).otherwise(at(v, "$.result"))
    content = F.when(t.isin(*COMPACTIONS), _value(at(v, "$.summary"), at(v, "$.message"))).when(t == "tool_execution_end", result).otherwise(_value(at(v, "$.message.content"), at(v, "$.content")))
    read = pi_lines(lines).where(F.col("error").isNull() & t.isin("turn_start", "turn_end", "tool_execution_start", *ENSURING)).select(
        "session", "seq", "type", "ms", role.alias("role"), _said(content).alias("text"), _said(_value(at(v, "$.prompt"), at(v, "$.input"), at(v, "$.message"))).alias("asked"),
        tool_id.alias("tool_id"), text_of(v, "$.toolName").alias("tool_name"), text_of(v, "$.name").alias("other_name"), stringified(_value(at(v, "$.args"), at(v, "$.input"))).alias("args"),
        stringified(at(v, "$.result")).alias("raw_result"), F.coalesce(F.try_variant_get(v, "$.isError", "boolean"), F.lit(False)).alias("is_error"),
    )
    # Messages and tools both read these, and a line is parsed once.
    read = settled(read)
    started = F.last(F.when(t == "tool_execution_start", F.struct("ms", _some(F.col("tool_name"), F.col("other_name"), F.lit("tool")).alias("name"), F.col("args").alias("input"))), ignorenulls=True)
    tools = read.where(t.startswith("tool_execution")).withColumn("start", started.over(before(["session", "tool_id"], ["seq"])))

    flow = read.where(t != "tool_execution_start").select("session", "seq", "type", "ms", "role", "text", "asked")
    closed = F.coalesce(F.lag("type").over(over(S, ["seq"])) == "turn_end", F.lag("type").over(over(S, ["seq"])).isNull())
    marked = flow.withColumn("_closed", closed).withColumn("_opens", (t == "turn_start") | (t.isin(*ENSURING) & F.col("_closed")))
    inside = islands(marked, S, ["seq"], F.col("_opens"), "_t").withColumn("turn_i", (F.col("_t") - 1).cast("long")).where((t != "turn_end") | ~F.col("_closed"))
    inside = settled(inside)

    filename = filename if isinstance(filename, Column) else F.lit(filename)
    first = F.when(F.col("_opens"), _some(F.col("asked"), F.concat(F.lit(STREAM), filename)))
    user = F.when(t.isin("message_update", "message_end") & (F.col("role") == "user") & (F.col("text") != ""), F.col("text"))
    own = lambda x: F.when(~x.startswith(STREAM[:-1]), x)
    turns = inside.groupBy(*KEYS).agg(
        F.coalesce(F.max(own(first)), F.min_by(own(user), F.when(own(user).isNotNull(), F.col("seq"))), F.max_by(user, F.when(user.isNotNull(), F.col("seq"))), F.max(first)).alias("prompt"),
        F.max(F.when(F.col("_opens"), F.col("ms"))).alias("start_ms"), F.max_by("ms", F.when(F.col("ms").isNotNull(), F.col("seq"))).alias("end_ms"), F.max(t.isin(*COMPACTIONS)).alias("compaction"),
    )

    spoken = inside.where((F.col("role") == "assistant") & ((t == "message_end") | (t == "message_update") & (F.col("text") != "")))
    ended = F.coalesce(F.sum(F.when(t == "message_end", 1)).over(before(KEYS, ["seq"])), F.lit(0))
    update, end = (F.when(t == kind, F.struct("seq", "text", "ms")) for kind in ("message_update", "message_end"))
    messages = spoken.withColumn("_m", ended).groupBy(*KEYS, "_m").agg(F.max(update).alias("u"), F.max(end).alias("e"))
    said = _some(F.col("e.text"), F.col("u.text"))
    none = F.lit("")
    replies = messages.where(said != "").select(*KEYS, F.coalesce("e.ms", "u.ms").alias("at_ms"), F.col("e").isNull().cast("int").alias("late"), F.coalesce("e.seq", "u.seq").alias("seq"), *_step("m", MODEL_STEP, said, none, none, F.lit(0), F.lit(False)))
    summaries = inside.where(t.isin(*COMPACTIONS)).select(*KEYS, F.col("ms").alias("at_ms"), F.lit(0).alias("late"), "seq", *_step("i", COMPACTION_STEP, _some(F.col("text"), F.lit(COMPACTED)), none, none, F.lit(0), F.lit(False)))
    name = _some(F.col("tool_name"), F.col("start.name"), F.col("other_name"), F.lit("tool"))
    done = tools.where(t == "tool_execution_end").join(inside.select("session", "seq", "turn_i"), ["session", "seq"])
    calls = done.select(*KEYS, F.col("ms").alias("at_ms"), F.lit(0).alias("late"), "seq", *_step("t", name, none, F.coalesce("start.input", "args"), _some(F.col("text"), F.col("raw_result")), between(F.col("start.ms"), F.col("ms")), F.col("is_error")))
    steps = reduce(DataFrame.unionByName, (replies, summaries, calls))
    return turns, timed(steps, turns, ["late", "seq"]).select(*KEYS, "step_i", *STEP)


def session_turns(lines: DataFrame, filename: Column | str = "") -> tuple[DataFrame, DataFrame]:
    """(turns, steps) of tree-shaped sessions, from the longest branch; of sessions without entries that have an id, from all lines.

    A user's message opens a turn; answers, results and compactions before the first one open it.  Columns as of event_turns().
    """
    v, t = F.col("v"), F.col("type")
    good = settled(pi_lines(lines).where(F.col("error").isNull()))
    branch = longest_branch(lines).select("session", "seq", "depth")
    flat = good.where(t != "header").join(good.where(t.isin(*TREE_TYPES) & text_of(v, "$.id").isNotNull()).select("session").distinct(), "session", "left_anti").withColumn("depth", F.col("seq").cast("long"))
    path = good.join(branch, ["session", "seq"]).unionByName(flat)
    message = has_type(v, "$.message", "OBJECT")
    inner = lambda name: F.when(message, at(v, f"$.message.{name}")).otherwise(at(v, f"$.{name}"))
    role = F.when(t == "message", F.coalesce(F.when(message, text_of(v, "$.message.role")).otherwise(text_of(v, "$.role")), F.lit(""))).when(t == "compaction", "compaction").otherwise("")
    read = path.select(
        "session", "depth", "ms", role.alias("role"), _said(inner("content")).alias("text"), _some(F.when(message, text_of(v, "$.message.toolName")).otherwise(F.lit("")), text_of(v, "$.toolName"), F.lit("tool")).alias("tool"),
        stringified(_value(inner("input"), at(v, "$.input"))).alias("input"), stringified(_value(inner("result"), at(v, "$.result"))).alias("result"), _some(text_of(v, "$.summary"), text_of(v, "$.text"), F.lit(COMPACTED)).alias("summary"),
    ).where(F.col("role").isin("user", "assistant", "toolResult", "compaction"))
    opens = (F.col("role") == "user") | (F.col("_n") == 0)
    inside = islands(ordinal(read, S, ["depth"], "_n").withColumn("_opens", opens), S, ["depth"], F.col("_opens"), "_t").withColumn("turn_i", (F.col("_t") - 1).cast("long"))
    inside = settled(inside)
    filename = filename if isinstance(filename, Column) else F.lit(filename)
    asked = F.when(F.col("_opens"), F.when(F.col("role") == "user", _some(F.col("text"), F.concat(F.lit(SESSION), filename))).otherwise(F.concat(F.lit(SESSION), filename)))
    turns = inside.groupBy(*KEYS).agg(
        F.max(asked).alias("prompt"), F.max(F.when(F.col("_opens"), F.col("ms"))).alias("start_ms"), F.max_by("ms", F.when(F.col("ms").isNotNull(), F.col("depth"))).alias("end_ms"), F.max(F.col("role") == "compaction").alias("compaction")
    )
    none, role = F.lit(""), F.col("role")
    kind = F.when(role == "assistant", "m").when(role == "toolResult", "t").otherwise("i")
    name = F.when(role == "assistant", MODEL_STEP).when(role == "toolResult", F.col("tool")).otherwise(COMPACTION_STEP)
    text = F.when(role == "assistant", F.col("text")).when(role == "compaction", F.col("summary")).otherwise(none)
    is_tool = role == "toolResult"
    steps = inside.where((role != "user") & ((role != "assistant") | (F.col("text") != ""))).select(
        *KEYS, F.col("ms").alias("at_ms"), "depth", *_step(kind, name, text, F.when(is_tool, F.col("input")).otherwise(none), F.when(is_tool, _some(F.col("text"), F.col("result"))).otherwise(none), F.lit(0), F.lit(False))
    )
    return turns, timed(steps, turns, ["depth"]).select(*KEYS, "step_i", *STEP)
