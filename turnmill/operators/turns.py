"""Grouping transcript lines into turns and accumulating their context composition."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions.text import half_up, tokens
from turnmill.operators.windows import before, carried, islands, ordinal, over, running, up_to

KEYS = ["session"]


def starts_turn(role: Column, text: Column) -> Column:
    """A user line opens a turn unless it is empty or a task notification."""
    return (role == "user") & (text != "") & ~text.startswith("<task-notification>")


def turn_lines(lines: DataFrame, starts: Column | None = None) -> DataFrame:
    """Lines with turn_i, 0-based; those before a session's first turn go."""
    opened = starts if starts is not None else starts_turn(F.col("role"), F.col("text"))
    return islands(lines, KEYS, ["line_no"], opened, "_t").withColumn("turn_i", (F.col("_t") - 1).cast("long")).where("turn_i >= 0").drop("_t")


def contributions(turns: DataFrame) -> DataFrame:
    """(session, turn_i, userMsgs, asstText): exact tokens that a turn adds."""
    each = tokens(F.col("text"))
    return turns.groupBy("session", "turn_i").agg(
        F.coalesce(F.sum(F.when(F.col("role") == "user", each)), F.lit(0.0)).alias("userMsgs"),
        F.coalesce(F.sum(F.when(F.col("role") == "assistant", each)), F.lit(0.0)).alias("asstText"),
        F.count_if(F.col("role") == "assistant").alias("requests"),
    )


def composition(turns: DataFrame) -> DataFrame:
    """Running totals by category, rounded at the snapshot."""
    each = contributions(turns)
    for c in ("userMsgs", "asstText"):
        each = running(each, KEYS, ["turn_i"], F.col(c), f"_{c}").withColumn(c, half_up(F.round(f"_{c}", 6))).drop(f"_{c}")
    return each


def deltas(totals: DataFrame, categories: list[str]) -> DataFrame:
    """Long form (session, turn_i, category, delta): rises over the turn before, from the second turn on."""
    moved = totals
    for c in categories:
        moved = moved.withColumn(f"_{c}", F.col(c) - F.lag(c).over(over(KEYS, ["turn_i"])))
    long = moved.select("session", "turn_i", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"_{c}").alias("delta")) for c in categories])).alias("x"))
    return long.select("session", "turn_i", "x.category", "x.delta").where("delta > 0")


def runs(lines: DataFrame, value: str) -> DataFrame:
    """Consecutive lines of one ``value`` merged: session, run, value, first line, lines, text joined by line feeds."""
    changed = F.coalesce(F.col(value) != F.lag(value).over(over(KEYS, ["line_no"])), F.lit(True))
    each = islands(lines, KEYS, ["line_no"], changed, "run")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return each.groupBy("session", "run").agg(F.first(value).alias(value), F.min("line_no").alias("first_line"), F.count("*").alias("lines"), joined.alias("text"))


def epochs(turns: DataFrame, total: str = "total") -> DataFrame:
    """Adds reset and epoch: a turn whose total falls below half of the last one that isn't 0 begins a new epoch."""
    seen = turns.withColumn("_last", F.last(F.when(F.col(total) > 0, F.col(total)), ignorenulls=True).over(before(KEYS, ["turn_i"])))
    flagged = seen.withColumn("reset", F.coalesce((F.col(total) > 0) & (F.col(total) < 0.5 * F.col("_last")), F.lit(False)))
    return running(flagged, KEYS, ["turn_i"], F.col("reset").cast("int"), "epoch").drop("_last")


def totals_carried(turns: DataFrame, total: str = "total") -> DataFrame:
    """Adds cum_total (a turn without usage has that of the turn before; 0 at first) and dropped (cum_total fell)."""
    filled = carried(turns, KEYS, ["turn_i"], F.when(F.col(total) > 0, F.col(total)), "_c").withColumn("cum_total", F.coalesce("_c", F.lit(0.0))).drop("_c")
    return filled.withColumn("dropped", F.coalesce(F.col("cum_total") < F.lag("cum_total").over(over(KEYS, ["turn_i"])), F.lit(False)))


def pack(turns: DataFrame, most_turns: int = 30, most_chars: int = 45_000) -> DataFrame:
    """(session, turn_i, chars) -> with shard: bins in turn order; a bin that holds anything is closed when it is full or the next turn would overfill it.

    The state of a bin decides where the next one begins, so a session's turns (numbers only) are folded in order.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, shard, count, size = None, 0, 0, 0
        for batch in batches:
            shards = []
            for session, chars in zip(batch["session"], batch["chars"], strict=True):
                if session != at:
                    at, shard, count, size = session, 0, 0, 0
                elif count >= most_turns or size + chars > most_chars:
                    shard, count, size = shard + 1, 0, 0
                count, size = count + 1, size + chars
                shards.append(shard)
            yield batch.assign(shard=pd.Series(shards, dtype="int64").values)

    ordered = turns.select("session", "turn_i", "chars").repartition("session").sortWithinPartitions("session", "turn_i")
    return ordered.mapInPandas(fold, "session long, turn_i long, chars long, shard long")


def closed_turns(events: DataFrame, opens: Column, closes: Column, out: str = "turn_i") -> DataFrame:
    """Lines inside turns that one kind of line opens and another closes (the closing line belongs to its turn)."""
    w, b = up_to(KEYS, ["seq"]), before(KEYS, ["seq"])
    mark = F.when(opens, F.lit(1)).when(closes, F.lit(0))
    state = events.withColumn("_o", F.sum(F.when(opens, 1).otherwise(0)).over(w)).withColumn("_s", F.last(mark, ignorenulls=True).over(w)).withColumn("_b", F.last(mark, ignorenulls=True).over(b))
    inside = state.where((F.col("_s") == 1) | (closes & (F.col("_b") == 1)))
    return inside.withColumn(out, (F.col("_o") - 1).cast("long")).drop("_o", "_s", "_b")


def opened_turns(events: DataFrame, opens: Column, out: str = "turn_i") -> DataFrame:
    """Turns that one kind of line opens; lines before the first belong to turn 0, which opens by itself."""
    first = islands(ordinal(events, KEYS, ["seq"], "_n"), KEYS, ["seq"], opens | (F.col("_n") == 0), "_t")
    return first.withColumn(out, (F.col("_t") - 1).cast("long")).drop("_t", "_n")
