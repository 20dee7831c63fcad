"""Steps of a turn in time: durations, nearest and as-of lookups, running tool totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.operators.windows import before, islands, over, running, up_to

SESSION = ["session"]


def gaps(steps: DataFrame, keys: list[str], order: list, ms: str = "ms") -> DataFrame:
    """Adds lasts: milliseconds to the next step of the same keys, 0 for the last one and never below 0."""
    following = F.lead(ms).over(over(keys, order))
    return steps.withColumn("lasts", F.greatest(F.lit(0), F.coalesce(following - F.col(ms), F.lit(0))).cast("long"))


def shared_gaps(steps: DataFrame, weight: Column, end_ms: Column, slow: int = 30_000, rate: int = 30) -> DataFrame:
    """Adds lasts: the time to the next different moment, split among the steps of one moment by ``weight`` + 1.

    The last step of a moment takes what is left over; every step lasts 1 ms at least.  A last moment that would
    last longer than ``slow`` lasts weight / ``rate`` seconds instead.
    """
    new = F.coalesce(F.col("ms") != F.lag("ms").over(over(SESSION, ["seq"])), F.lit(True))
    runs = islands(steps, SESSION, ["seq"], new, "moment")
    per = runs.groupBy("session", "moment").agg(F.max("ms").alias("at"), F.sum(weight + 1).alias("weight_sum"), F.sum(weight).alias("out"), F.max(end_ms).alias("until"), F.max("seq").alias("last_seq"))
    following = F.lead("at").over(over(SESSION, ["moment"]))
    tail = F.greatest(F.lit(0), F.col("until") - F.col("at"))
    per = per.withColumn("span", F.when(following.isNotNull(), following - F.col("at")).when(tail > slow, F.floor(F.col("out") / rate + 0.5) * 1000).otherwise(tail))
    joined = runs.join(per.select("session", "moment", "span", "weight_sum", "last_seq"), ["session", "moment"])
    share = F.greatest(F.lit(1), F.floor(F.col("span") * (weight + 1) / F.col("weight_sum"))).cast("long")
    given = joined.withColumn("_share", share).withColumn("_given", F.coalesce(F.sum("_share").over(before(["session", "moment"], ["seq"])), F.lit(0)))
    return given.withColumn("lasts", F.when(F.col("seq") == F.col("last_seq"), F.greatest(F.lit(1), F.col("span") - F.col("_given"))).otherwise(F.col("_share")).cast("long")).drop("_share", "_given", "span", "weight_sum", "last_seq")


def idle(turns: DataFrame, least: int = 1000) -> DataFrame:
    """(session, turn_i, idle): pauses of more than ``least`` ms between the end of the turn before and the start of this one."""
    pause = F.col("start_ms") - F.lag("end_ms").over(over(SESSION, ["turn_i"]))
    return turns.withColumn("idle", pause).where(F.col("idle") > least).select("session", "turn_i", "idle")


def nearest(lines: DataFrame, is_usage: Column, value: str, out: str) -> DataFrame:
    """Adds the ``value`` of the usage line nearest by seq; of two equally near the earlier.

    Two carried values, from either side, in one sort: no pair is built.
    """
    mark = F.when(is_usage, F.struct("seq", value))
    later = over(SESSION, ["seq"]).rowsBetween(0, Window.unboundedFollowing)
    sides = lines.withColumn("_p", F.last(mark, ignorenulls=True).over(up_to(SESSION, ["seq"]))).withColumn("_n", F.first(mark, ignorenulls=True).over(later))
    left, right = F.col("seq") - F.col("_p.seq"), F.col("_n.seq") - F.col("seq")
    return sides.withColumn(out, F.when(F.col("_n").isNull() | (left <= right), F.col(f"_p.{value}")).otherwise(F.col(f"_n.{value}"))).drop("_p", "_n")


def as_of(lines: DataFrame, is_call: Column, value: str, out: str) -> DataFrame:
    """Adds the ``value`` of the latest call strictly before or at a line's moment; of calls at one moment the earliest."""
    first = F.row_number().over(over(["session", "ms"], [F.when(is_call, 0).otherwise(1), "seq"])) == 1
    mark = F.when(is_call & first, F.col(value))
    return lines.withColumn(out, F.last(mark, ignorenulls=True).over(over(SESSION, ["ms"]).rangeBetween(Window.unboundedPreceding, Window.currentRow)))


def tool_totals(lines: DataFrame, reset: Column) -> DataFrame:
    """Running calls and result tokens per tool; both begin anew after a line where ``reset`` holds."""
    epoch = lines.withColumn("epoch", F.coalesce(F.sum(F.when(reset, 1).otherwise(0)).over(up_to(SESSION, ["seq"])), F.lit(0)))
    keys = ["session", "epoch", "kind"]
    return running(running(epoch, keys, ["seq"], F.lit(1), "calls"), keys, ["seq"], F.col("tokens"), "result_tokens")


def step_groups(lines: DataFrame, is_model: Column) -> DataFrame:
    """Adds step, and size and end of step: a step begins at each model line that follows another kind."""
    previous = F.lag(is_model).over(over(SESSION, ["seq"]))
    starts = previous.isNull() | (is_model & ~previous)
    each = islands(lines, SESSION, ["seq"], starts, "step")
    last = F.max("seq").over(whole(["session", "step"]))
    return each.withColumn("size", F.count("*").over(whole(["session", "step"]))).withColumn("is_end", F.col("seq") == last)


def whole(keys: list[str]) -> Window:
    """All rows of the keys."""
    return Window.partitionBy(*keys)


def shares(rows: DataFrame, keys: list[str], value: str, out: str, total: Column) -> DataFrame:
    """Whole parts of ``total`` in proportion to ``value``; what rounding leaves goes to the largest row."""
    part = F.floor(F.col(value) * total / F.sum(value).over(whole(keys)) + 0.5)
    first = F.row_number().over(over(keys, [F.desc(value), "category"])) == 1
    rounded = rows.withColumn(out, part)
    return rounded.withColumn(out, (F.col(out) + F.when(first, total - F.sum(out).over(whole(keys))).otherwise(0)).cast("long"))
