"""Exact deduplication by content-defined chunk recipes, with DataFrame functions alone.

A text is cut where its own content says so, so an edit moves only the cuts near
it.  Each chunk gets a 64-bit identifier, verified against the chunk's SHA-256 over the whole corpus; a
document is then the ordered list of its chunks' identifiers (its recipe), a few bytes per
kilobyte of text.  Documents are compared by recipe; their texts are read once and never moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import ascii_lower, durable, without

MIN_CHUNK, MAX_CHUNK = 1024, 8192
#: Up to so many clashing identifiers are sent to every task (8 bytes each); more are joined by shuffle.
MANY_CLASHES = 1_000_000


def chunk_pattern(shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> str:
    """Matches one chunk: from ``shortest`` characters on, it ends after the first white space that
    follows two letters of given kinds; failing that, at ``longest`` characters or the text's end."""
    return rf"(?s).{{{shortest},{longest}}}?(?<=[aeiou][nrst][\s.,])|.{{1,{longest}}}"


def chunks(text: Column, shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> Column:
    """The text's chunks in order; joined, they are the text.  An empty text has none."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern(shortest, longest)), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> DataFrame:
    """One row per row of ``docs``: id, text_sha256 (of the normalised text) and chunks, an array of (id, digest)."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    cut = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"))
    return cut.select(
        "doc_id",
        F.sha2(F.col("_t"), 256).alias("text_sha256"),
        F.transform(chunks(F.col("_t"), shortest, longest), lambda c: F.struct(F.xxhash64(c).alias("id"), F.unhex(F.sha2(c, 256)).alias("digest"))).alias("chunks"),
    )


def chunk_store(cut: DataFrame) -> DataFrame:
    """The distinct chunks of ``recipes()``: id, digest (the least), uses, and conflict where one id stands for several digests."""
    each = cut.select(F.explode("chunks").alias("c")).select("c.id", "c.digest")
    return each.groupBy("id").agg(F.min("digest").alias("digest"), F.max("digest").alias("_hi"), F.count("*").alias("uses")).select("id", "digest", "uses", (F.col("digest") != F.col("_hi")).alias("conflict"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null counts as
    empty.  Of equal texts the largest doc_id stays; if that doc_id itself
    occurs on several equal rows, each of those rows is marked as kept (``drop_copies`` leaves one).  A null
    doc_id never wins over a number; where all of a group are null, all are marked.  Other columns are ignored; an empty table gives no rows.
    """
    cut = durable(recipes(docs, id_col, text_col, shortest, longest))
    clashing = durable(chunk_store(cut).where("conflict").select(F.col("id").alias("_clash")))
    # Some 10 ** -7 of such ids are to be expected among 10 ** 6 chunks, one in 10 ** 9: as a rule there is nothing to join, and a chunk
    # that many documents share goes nowhere.
    clashes = clashing.limit(MANY_CLASHES + 1).count()
    if clashes:
        named = F.broadcast(clashing) if clashes <= MANY_CLASHES else clashing
        touched = durable(cut.select("text_sha256", F.explode("chunks.id").alias("_id")).join(named, F.col("_id") == F.col("_clash"), "left_semi").select(F.col("text_sha256").alias("_sha")).distinct())
    else:
        touched = None
    # Where an identifier isn't proven unique, the digests stand in for the recipe's identifiers.
    told = cut.withColumn("_sha", F.lit(None).cast("string")) if touched is None else cut.join(touched, F.col("text_sha256") == F.col("_sha"), "left")
    listed = told.select(
        "doc_id",
        "text_sha256",
        F.col("chunks.id").alias("recipe"),
        F.when(F.col("_sha").isNotNull(), F.col("chunks.digest")).alias("exact"),
    )
    groups = durable(listed.groupBy("recipe", "exact").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1").select(F.col("recipe").alias("_r"), F.col("exact").alias("_e"), "keep_id", "group_size"))
    # Both sides are exchanged anew, so that AQE can split the partition of a very large group.
    out = listed.join(groups, (F.col("recipe") == F.col("_r")) & F.col("exact").eqNullSafe(F.col("_e")), "left")
    single = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows of one doc_id with equal texts, one.

    The recipes decide; texts only stay where they are or go.  A row is named by its doc_id and its text's digest.
    Where rows of the same name occur (one doc_id on equal texts), texts are moved once, to keep one of each.
    """
    key = lambda doc_id, sha: F.concat(sha, F.lit("/"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    told = durable(exact_dedup(docs, id_col, text_col).select(key(F.col("doc_id"), F.col("text_sha256")).alias("name"), "kept"))
    own = key(F.col(id_col), F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
    left = without(docs.withColumn("_turnmill_name", own), F.col("_turnmill_name"), told.where("not kept").select("name"))
    if not told.where("kept").groupBy("name").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["_turnmill_name"])
    return left.select(*docs.columns)
