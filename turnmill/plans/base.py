"""Registration of queries, and the tables that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (table reader) -> DataFrame under ``name``, with DuckDB SQL for the same rows."""

    def add(build: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return build

    return add


def event_lines(events: DataFrame) -> DataFrame:
    """``events`` as an agent's log: session, seq (0-based), ms, kind, value, tokens."""
    from turnmill.operators.windows import ordinal

    return ordinal(
        events.select(
            F.col("user_id").alias("session"), "event_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("long").alias("tokens")
        ),
        ["session"],
        ["ts", "event_id"],
        "seq",
    )


#: The same in SQL, as a common table expression.
EVENT_LINES = """lines AS (
    SELECT user_id AS session, event_id, ts, epoch_us(ts) // 1000 AS ms, event_type AS kind, value,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq
    FROM events)"""


def chat_lines(conversations: DataFrame) -> DataFrame:
    """``conversations`` as a transcript: session, line_no, role, text."""
    return conversations.select(F.col("conv_id").alias("session"), F.col("turn").alias("line_no"), "role", "text")


CHAT_TURNS = """turns AS (
    SELECT * FROM (
        SELECT conv_id AS session, turn AS line_no, role, text,
               CAST(sum(CASE WHEN role = 'user' AND text <> '' AND NOT starts_with(text, '<task-notification>') THEN 1 ELSE 0 END)
                    OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) - 1 AS turn_i
        FROM conversations) WHERE turn_i >= 0)"""
