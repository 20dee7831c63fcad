"""Steps of a turn from typed transcript lines: model phases, then the tools that they call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.functions.text import half_up, units
from turnmill.operators.windows import ordinal
from turnmill.sources.transcripts import claude_blocks

# Tools that start another agent.
AGENT_TOOLS = ("Agent", "Workflow")


def model_steps(turns: DataFrame) -> DataFrame:
    """Up to three steps of an assistant line: thinking, text, calls; one diagnostic step for a line with none of them."""
    kinds = F.coalesce(F.transform("blocks", lambda b: b["type"]), F.array().cast("array<string>"))
    has = lambda *names: F.exists(kinds, lambda k: k.isin(*names))
    phases = F.array_compact(F.array(F.when(has("thinking", "redacted_thinking"), F.struct(F.lit(0).alias("phase"), F.lit("thinking").alias("name"))), F.when(has("text"), F.struct(F.lit(1).alias("phase"), F.lit("text").alias("name"))), F.when(has("tool_use"), F.struct(F.lit(2).alias("phase"), F.lit("calls").alias("name")))))
    some = F.when(F.size(phases) > 0, phases).otherwise(F.array(F.struct(F.lit(0).alias("phase"), F.lit("diagnostic").alias("name"))))
    out = F.coalesce(F.col("usage.output"), F.lit(0))
    return turns.where("type = 'assistant'").select("session", "turn_i", "line_no", "timestamp", out.alias("tokens"), F.explode(some).alias("p")).select("session", "turn_i", "line_no", F.lit("m").alias("kind"), "p.name", "p.phase", F.lit(0).alias("block_i"), "timestamp", "tokens")


def tool_steps(turns: DataFrame) -> DataFrame:
    """One step per call and line with its result, within the turn; the result's size is its length over 3 characters a token."""
    blocks = claude_blocks(turns)
    calls = blocks.where("role = 'assistant' and type = 'tool_use'").select("session", "turn_i", "line_no", "block_i", "id", "name")
    results = blocks.where("role = 'user' and type = 'tool_result'").select("session", "turn_i", F.col("tool_use_id").alias("id"), F.col("line_no").alias("result_line"), "content")
    joined = calls.join(results, ["session", "turn_i", "id"], "left")
    return joined.select("session", "turn_i", "line_no", F.when(F.col("name").isin(*AGENT_TOOLS), "s").otherwise("t").alias("kind"), "name", F.lit(3).alias("phase"), "block_i", F.lit(None).cast("string").alias("timestamp"), half_up(units(F.coalesce("content", F.lit(""))) / 3.0).alias("tokens"))


def steps(turns: DataFrame) -> DataFrame:
    """All steps in order: the phases of an assistant line, its tools, then those of the next line; step_i from 0."""
    both = model_steps(turns).unionByName(tool_steps(turns))
    return ordinal(both, ["session", "turn_i"], ["line_no", "phase", "block_i", "kind"], "step_i")
