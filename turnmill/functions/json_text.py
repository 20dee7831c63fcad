"""JSON inside of prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_in(text: Column) -> Column:
    """A variant from the whole text, else its json fence, else any fence, else what stands from the first { to the last }."""
    fenced = lambda mark: F.regexp_extract(text, rf"(?s)```{mark}\s*\n(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    tries = [F.try_parse_json(F.nullif(F.trim(x), F.lit(""))) for x in (text, fenced("json"), fenced(r"\w*"), braces)]
    return F.coalesce(*tries)


#: How deep lists, results and texts may be nested.
DEPTH = 4


def collected_items(rows: DataFrame, text: str, into: str = "item") -> DataFrame:
    """One row per object in the JSON of column ``text``, as a variant ``into``, with ``place``, its path among its siblings.

    Lists are opened, an object with a list of results stands for that list, one with a text for the JSON within the text.
    Columns of ``rows`` are kept; rows without an object vanish.
    """
    held = rows.withColumn(into, json_in(F.col(text))).withColumn("place", F.array().cast("array<int>")).withColumn("_done", F.lit(False))
    for _ in range(DEPTH + 1):
        v = F.col(into)
        kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit(""))
        results, nested = F.try_variant_get(v, "$.results", "variant"), F.try_variant_get(v, "$.text", "variant")
        one = lambda done, x: F.array(F.struct(F.lit(done).alias("done"), x.alias("v")))
        opened = (
            F.when(F.col("_done"), one(True, v))
            .when(kind(v).startswith("ARRAY"), F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.lit(False).alias("done"), x.alias("v"))))
            .when(~kind(v).startswith("OBJECT"), F.array().cast("array<struct<done:boolean,v:variant>>"))
            .when(kind(results).startswith("ARRAY"), one(False, results))
            .when(kind(nested) == "STRING", one(False, json_in(F.try_variant_get(v, "$.text", "string"))))
            .otherwise(one(True, v))
        )
        kept = [c for c in held.columns if c not in (into, "place", "_done")]
        held = held.select(*kept, "place", F.posexplode(opened).alias("_at", "_x")).select(*kept, F.col("_x.v").alias(into), F.concat("place", F.array("_at")).alias("place"), F.col("_x.done").alias("_done"))
    return held.where("_done").drop("_done")


def pure_code(text: Column, markdown: Column) -> Column:
    """Whether a text is JSON, or is Markdown of which nothing but headings, a count of characters, fences and code spans is there."""
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    own = trimmed(text)
    rest = own
    for pattern in CODE_PARTS:
        rest = F.regexp_replace(rest, "(?md)" + pattern, "")
    json = own.rlike(r"^[\[{]") & F.try_parse_json(own).isNotNull()
    return (own != "") & (json | (markdown & (trimmed(rest) == "")))


# What counts as no prose.
CODE_PARTS = (r"^# [^\n]+\n*", r"^字符数:\s*\d+\s*$", r"^```[^\n]*\n[\s\S]*?\n```$", r"`[^`\n]+`")
