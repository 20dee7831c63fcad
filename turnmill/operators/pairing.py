"""Calls and their results, matched by id within a turn or a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = ["session", "turn_i", "id"]


def calls_with_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row per call and matching result line (or one without); the content is that of the first match."""
    each = results.select(*TURN, F.col("seq").alias("result_seq"))
    first = results.groupBy(*TURN).agg(F.min_by("value", "seq").alias("content"))
    return calls.select(*TURN, "seq").join(each, TURN, "left").join(first, TURN, "left").select("session", "turn_i", "seq", "result_seq", "content")


def calls_with_last_result(calls: DataFrame, results: DataFrame, stand_in: Column) -> DataFrame:
    """Each call with its last result; a line where ``stand_in`` holds counts only where there is no other, the first of them."""
    rank = F.struct(F.when(stand_in, 0).otherwise(1), F.when(stand_in, -F.col("seq")).otherwise(F.col("seq")))
    last = results.groupBy(*TURN).agg(F.max_by("value", rank).alias("result"))
    return calls.select(*TURN, "seq").join(last, TURN, "left").select("session", "seq", "result", F.col("result").isNull().alias("missing"))


def attributed(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Result tokens by tool; a result counts once for each calling line that names its id."""
    sums = results.groupBy("session", "id").agg(F.sum("tokens").alias("tokens"))
    return calls.select("session", "seq", "id", F.col("kind").alias("tool")).distinct().join(sums, ["session", "id"]).groupBy("session", "tool").agg(F.sum("tokens").alias("tokens"))
