"""State of live sessions from their last turns, and the alerts that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.operators.timeline import whole
from turnmill.operators.windows import over

LAST = 5


def recent(turns: DataFrame) -> DataFrame:
    """The last five turns of a session with back (1: the last) and delta to the turn before."""
    w = over(["session"], ["turn_i"])
    return turns.withColumn("delta", F.col("total") - F.lag("total").over(w)).withColumn("back", F.row_number().over(over(["session"], [F.desc("turn_i")]))).where(F.col("back") <= LAST)


def latest(value: str | Column) -> Column:
    return F.max_by(value, "turn_i")


def snapshot(turns: DataFrame, window: float) -> DataFrame:
    moved = F.col("delta").isNotNull()
    return recent(turns).groupBy("session").agg(
        F.max("turn_i").alias("last_turn"),
        latest("total").alias("last_total"),
        F.round(F.coalesce(F.max_by(F.when(moved, F.col("delta")), F.when(moved, F.col("turn_i"))), F.lit(0.0)), 6).alias("last_delta"),
        F.sum("lines").alias("lines5"),
        F.round(F.avg("tokens"), 6).alias("mean_tokens"),
        F.round(100 * latest("total") / window, 6).alias("pct"),
    )


def alerts(turns: DataFrame, window: float) -> DataFrame:
    """How full the context is, whether it was just reset, whether tools are called too often, whether the cache went cold."""
    seen = recent(turns).withColumn("k", F.count("*").over(whole(["session"])))
    s = seen.groupBy("session").agg(
        (100 * latest("total") / window).alias("pct"),
        latest("failed").alias("reset"),
        F.avg("lines").alias("calls"),
        F.count("*").alias("n"),
        F.avg(F.when(F.col("back") <= 3, F.col("tokens"))).alias("late"),
        F.avg(F.when(F.col("back") > F.col("k") - 3, F.col("tokens"))).alias("early"),
    )
    return s.select(
        "session",
        F.when(F.col("pct") > 90, "critical").when(F.col("pct") > 75, "high").otherwise("none").alias("fill"),
        F.coalesce("reset", F.lit(False)).alias("reset"),
        (F.col("calls") > 15).alias("busy"),
        F.coalesce((F.col("n") >= 3) & (F.col("late") < 0.5 * F.col("early")), F.lit(False)).alias("cold"),
    )
