"""Turns and steps of opencode logs: each step's start opens a turn."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions.content import at, bound, opencode_tool, opencode_usage, stringified
from turnmill.operators.lineage import settled
from turnmill.operators.pi import MODEL_STEP, STEP
from turnmill.operators.steps import KEYS, aware, rounded, timed
from turnmill.operators.windows import islands, ordinal, over, up_to
from turnmill.sources.transcripts import has_type, opencode_lines, text_of

# What stands where a log has no name or text.
STREAM, ERROR_STEP, NOTHING = "OpenCode stream: ", "OpenCode 错误", "（OpenCode 日志未记录可读的 assistant 文本或工具事件。）"
SUB_AGENT = "task"


def step_events(lines: DataFrame, keep: bool = True) -> DataFrame:
    """Lines with turn_i: session, turn_i, seq, ms, type, part, v.  The first line opens a turn too.

    Turns and steps both read these, and a line is parsed once: they are settled, unless nothing is to ``keep`` because one reads them alone.
    """
    good = opencode_lines(lines).where(F.col("error").isNull()).select("session", "seq", "ms", "type", "part", "v")
    opened = islands(ordinal(good, ["session"], ["seq"], "_n"), ["session"], ["seq"], (F.col("type") == "step_start") | (F.col("_n") == 0), "_t")
    numbered = opened.withColumn("turn_i", (F.col("_t") - 1).cast("long")).drop("_t", "_n")
    return settled(numbered) if keep else numbered


def _usage(events: DataFrame) -> Column:
    """struct(seq, input, cached, output) of a finished step with usage."""
    n = lambda used, c: F.coalesce(used[c], F.lit(0.0)).cast("long").alias(c)
    told = lambda used: F.when(used.isNotNull(), F.struct("seq", n(used, "input"), n(used, "cached"), n(used, "output")))
    return F.when(F.col("type") == "step_finish", bound(bound(F.col("part"), opencode_usage), told))


def opencode_turns(events: DataFrame, filename: Column | str = "") -> DataFrame:
    """session, turn_i, prompt, start_ms, end_ms, requests, out_tok, max_input, last_input.  The prompt is that of the step's start, trimmed, else the stream's name."""
    filename = filename if isinstance(filename, Column) else F.lit(filename)
    asked = F.when(F.col("type") == "step_start", F.nullif(F.regexp_replace(text_of(F.col("part"), "$.prompt"), r"^\s+|\s+$", ""), F.lit("")))
    small = events.select(*KEYS, "seq", "ms", asked.alias("asked"), (F.col("type") == "step_start").alias("start"), _usage(events).alias("u"))
    real = F.when((F.col("u.input") > 0) | (F.col("u.cached") > 0) | (F.col("u.output") > 0), F.col("seq"))
    return small.groupBy(*KEYS).agg(
        F.coalesce(F.max("asked"), F.concat(F.lit(STREAM), filename)).alias("prompt"), F.min_by("ms", "seq").alias("start_ms"), F.max_by("ms", F.when(F.col("ms").isNotNull(), F.col("seq"))).alias("end_ms"),
        F.greatest(F.count("u"), F.max(F.col("start").cast("int"))).alias("requests"), F.coalesce(F.sum("u.output"), F.lit(0)).alias("out_tok"), F.coalesce(F.max("u.input"), F.lit(0)).alias("max_input"), F.coalesce(F.max_by("u.input", real), F.lit(0)).alias("last_input"),
    )


def opencode_steps(events: DataFrame, turns: DataFrame) -> DataFrame:
    """session, turn_i, step_i, STEP, in_tok and used_tok (of the usage nearest within the turn)."""
    t, part, v = F.col("type"), F.col("part"), F.col("v")
    text = F.when(t == "text", F.coalesce(text_of(part, "$.text"), text_of(part, "$.content"), F.lit("")))
    error = F.when(has_type(v, "$.error", "OBJECT"), at(v, "$.error")).otherwise(v)
    said = bound(error, lambda e: F.coalesce(text_of(e, "$.message"), text_of(e, "$.data.message"), stringified(e)))
    read = events.select(*KEYS, "seq", "ms", "type", text.alias("text"), F.when(t == "tool_use", bound(part, opencode_tool)).alias("tool"), F.when(t == "error", said).alias("said"), _usage(events).alias("u"))
    last, following = F.last("u", ignorenulls=True).over(up_to(KEYS, ["seq"])), F.first("u", ignorenulls=True).over(over(KEYS, ["seq"]).rowsBetween(0, Window.unboundedFollowing))
    near = read.withColumn("_l", last).withColumn("_f", following)
    nearest = F.when(F.col("_f").isNull() | (F.col("seq") - F.col("_l.seq") <= F.col("_f.seq") - F.col("seq")), F.col("_l")).otherwise(F.col("_f"))
    near = settled(near.withColumn("near", nearest).where("text <> '' or tool is not null or said is not null").drop("_l", "_f"))
    none, zero, no, own = F.lit(""), F.lit(0).cast("long"), F.lit(False), F.col("text")

    def step(kind, name, ms, text, input_, result, error, text_tok, asst_tok, call_tok, result_tok, order) -> list[Column]:
        found = (kind, name, F.col("ms"), ms, text, input_, result, error, text_tok, asst_tok, zero, call_tok, result_tok)
        used = (F.coalesce(F.col(f"near.{c}"), zero).alias(n) for c, n in (("input", "in_tok"), ("output", "used_tok")))
        return [*KEYS, *[(x if isinstance(x, Column) else F.lit(x)).alias(n) for x, n in zip(found, STEP, strict=True)], *used, "seq", F.lit(order).alias("part")]

    tool = lambda c: F.col(f"tool.{c}")
    texts = near.where("text <> ''").select(step("m", MODEL_STEP, zero, own, none, none, no, rounded(own), aware(own), zero, zero, 0))
    calls = near.where("tool is not null")
    calling = calls.select(step("m", MODEL_STEP, zero, none, tool("input"), none, no, zero, zero, rounded(F.concat(tool("name"), tool("input"))), zero, 0))
    kind = F.when(tool("name") == SUB_AGENT, "s").otherwise("t")
    answered = calls.select(step(kind, tool("name"), tool("duration_ms"), none, tool("input"), tool("result"), tool("is_error"), zero, zero, zero, rounded(tool("result")), 1))
    errors = near.where("said is not null").select(step("i", ERROR_STEP, zero, F.col("said"), none, none, no, zero, zero, zero, zero, 0))
    made = reduce(DataFrame.unionByName, (texts, calling, answered, errors))
    bare = turns.join(made.select(*KEYS).distinct(), KEYS, "left_anti").select(*KEYS, F.col("start_ms").alias("ms"), F.lit(NOTHING).alias("text"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("struct<seq:bigint,input:bigint,cached:bigint,output:bigint>").alias("near"))
    empty = bare.select(step("m", MODEL_STEP, zero, own, none, none, no, zero, aware(own), zero, zero, 0))
    return timed(made.unionByName(empty), turns, ["seq", "part"]).select(*KEYS, "step_i", *STEP, "in_tok", "used_tok")
