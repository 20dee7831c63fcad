"""Steps of a turn as the builders of several log formats make them: durations, and running totals over their turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions.text import half_up, mode, tokens, tokens_by_mode
from turnmill.operators.windows import ordinal, over, up_to

KEYS = ["session", "turn_i"]


def aware(text: Column) -> Column:
    """Tokens by the text's mode, rounded; an empty text has none."""
    return F.when(text == "", 0).otherwise(half_up(tokens_by_mode(text, mode(text)))).cast("long")


def rounded(text: Column) -> Column:
    return half_up(tokens(text))


def between(start: Column, end: Column) -> Column:
    """Milliseconds from one moment to another; 0 backwards or where either is unknown."""
    return F.coalesce(F.greatest(end - start, F.lit(0)), F.lit(0)).cast("long")


def timed(steps: DataFrame, turns: DataFrame, order: list[str]) -> DataFrame:
    """Numbers a turn's steps by ``order`` (step_i from 0) and gives those that last 0 ms the time to the next step, the last one that to the turn's end.

    ``steps``: session, turn_i, at_ms, ms and more; ``turns``: session, turn_i, start_ms, end_ms.
    """
    following = F.lead("at_ms").over(over(KEYS, order))
    numbered = ordinal(steps, KEYS, order, "step_i").withColumn("_next", following).drop(*order)
    with_next = numbered.join(turns.select(*KEYS, "start_ms", "end_ms"), KEYS)
    until = F.coalesce("_next", "end_ms", "start_ms")
    return with_next.withColumn("ms", F.when(F.col("ms") > 0, F.col("ms")).otherwise(between(F.coalesce("at_ms", "start_ms"), until))).drop("_next", "start_ms", "end_ms")


def turn_facts(turns: DataFrame, steps: DataFrame) -> DataFrame:
    """Of each turn: steps by kind and their time, the longest, and the running composition (per part rounded) after it.

    ``turns``: session, turn_i, prompt, start_ms, end_ms and more; ``steps``: as of timed(), with kind (m, t, s, i), name, ms and the tokens
    text_tok, think_tok, call_tok, result_tok (0 where there are none) and asst_tok (of the text, by mode).
    """
    is_ = lambda k: F.col("kind") == k
    total = lambda c, k: F.coalesce(F.sum(F.when(is_(k), F.col(c))), F.lit(0))
    per = steps.groupBy(*KEYS).agg(
        total("ms", "m").alias("model_ms"), total("ms", "t").alias("tool_ms"), total("ms", "s").alias("sub_ms"), F.count_if(is_("m")).alias("steps"), total("text_tok", "m").alias("said_tok"),
        F.max_by("name", F.when(F.col("ms") > 0, F.struct("ms", -F.col("step_i")))).alias("longest"),
        total("think_tok", "m").alias("thinking"), total("asst_tok", "m").alias("asstText"), total("call_tok", "m").alias("toolCalls"), total("result_tok", "t").alias("toolResults"), total("result_tok", "s").alias("subagent"),
    )
    each = turns.join(per, KEYS, "left").withColumn("userMsgs", aware(F.col("prompt")))
    for c in ("model_ms", "tool_ms", "sub_ms", "steps", "said_tok"):
        each = each.withColumn(c, F.coalesce(c, F.lit(0)).cast("long"))
    run = up_to(["session"], ["turn_i"])
    for c in ("thinking", "asstText", "toolCalls", "toolResults", "userMsgs", "subagent"):
        each = each.withColumn(c, F.sum(F.coalesce(F.col(c), F.lit(0))).over(run).cast("long"))
    return each.withColumn("longest", F.coalesce("longest", F.lit(""))).withColumn("dur_ms", F.greatest(F.col("model_ms") + F.col("tool_ms") + F.col("sub_ms"), between(F.col("start_ms"), F.col("end_ms"))))
