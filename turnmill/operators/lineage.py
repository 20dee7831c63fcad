"""Lineage of iterative work, cut where executors can be lost without losing it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of spark.checkpoint.dir; without that setting a temporary one, in local mode only."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="turnmill-"))
    return df.checkpoint(eager=True)


#: Rows that a task sorts and walks at a time, where keys allow it.
TASK_ROWS = 100_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Rows dealt by their keys into parts of some TASK_ROWS.

    The number of parts grows with the rows (counted unless told), so that a task's share doesn't; parts of a number that is told aren't
    merged by their compressed size, of which lines of logs have little.
    """
    n = df.count() if rows is None else rows
    return df.repartition(max(1, -(-n // TASK_ROWS)), *keys)
