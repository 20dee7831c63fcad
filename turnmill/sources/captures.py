"""Captured request bodies of agents, to the character counts that seed a context's core categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.functions.text import units

ITEMS = "array<struct<type:string,text:string,content:string,role:string>>"
TOOLS = "array<string>"


def requests(lines: DataFrame) -> DataFrame:
    """(session, line_no, body) of the POST requests of a capture log whose body has messages or input."""
    v = F.try_parse_json("value")
    body = F.try_variant_get(v, "$.request.body", "variant")
    kept = lines.select("session", "line_no", F.upper(F.try_variant_get(v, "$.request.method", "string")).alias("method"), F.to_json(body).alias("body"))
    return kept.where((F.col("method") == "POST") & (F.get_json_object("body", "$.messages").isNotNull() | F.get_json_object("body", "$.input").isNotNull())).select("session", "line_no", "body")


def core_sizes(lines: DataFrame) -> DataFrame:
    """One row per capture log: characters of the system prompt (a string, blocks, or instructions) and of the tool definitions, from the first request; the rest is left to calibration."""
    first = requests(lines).groupBy("session").agg(F.min_by("body", "line_no").alias("body"))
    system = F.get_json_object("body", "$.system")
    blocks = F.from_json(system, ITEMS)
    prompt = F.coalesce(F.when(system.startswith("["), F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + F.coalesce(units(b["text"]), F.lit(0)))), units(system), units(F.get_json_object("body", "$.instructions")), F.lit(0))
    tools = F.get_json_object("body", "$.tools")
    return first.select("session", prompt.cast("long").alias("sysPrompt"), F.coalesce(units(tools), F.lit(0)).cast("long").alias("tool_defs"), F.coalesce(F.size(F.from_json(tools, TOOLS)), F.lit(0)).alias("n_tools"), F.sha2(F.coalesce(tools, F.lit("")), 256).alias("tools_hash"))


def filled(sizes: DataFrame, seeds: dict[str, int]) -> DataFrame:
    """Categories that came out as 0 take their seed."""
    return sizes.select("session", *[F.when(F.coalesce(F.col(c), F.lit(0)) == 0, seed).otherwise(F.col(c)).cast("long").alias(c) for c, seed in seeds.items()])
