"""Derived tables: latest-wins merges and partitioned writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.operators.windows import first_of


def upserted(old: DataFrame, new: DataFrame, keys: list[str], newest_first: list[str]) -> DataFrame:
    """Both together; of rows with equal keys the first by ``newest_first`` stays."""
    return first_of(old.unionByName(new), keys, newest_first)


def append_sessions(rows: DataFrame, path: str) -> None:
    """Write new sessions, one folder per session, so that a read of one session prunes the rest."""
    rows.write.mode("append").partitionBy("session").parquet(path)


def refresh_sessions(rows: DataFrame, path: str) -> None:
    """Replace the sessions that ``rows`` holds and leave the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(path)


MANIFEST = "session string, shard int, first_turn long, last_turn long, turns long, file string"


def write_shards(turns: DataFrame, path: str, force: bool = False) -> None:
    """Write each session's shards (shard, value) below ``path``/shards, a folder for each session, so that a session written anew leaves no old shard, and a manifest of them below ``path``/manifests.

    ``turns`` holds session, shard, turn_i and content.  A session with a manifest is skipped unless ``force``.  Manifests are written last, so a
    session whose writing broke off is written again as a whole.  A shard is of bounded size by the packing of turns.
    """
    spark = turns.sparkSession
    manifests = f"{path}/manifests"
    folder = spark._jvm.org.apache.hadoop.fs.Path(manifests)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    turns = turns.withColumn("session", F.col("session").cast("string")).withColumn("shard", F.col("shard").cast("int"))
    if there and not force:
        turns = turns.join(spark.read.schema(MANIFEST).json(manifests).select("session").distinct(), "session", "left_anti")
    parts = F.array_sort(F.collect_list(F.struct("turn_i", "content")))
    shards = turns.groupBy("session", "shard").agg(F.min("turn_i").alias("first_turn"), F.max("turn_i").alias("last_turn"), F.count("*").alias("turns"), F.array_join(F.transform(parts, lambda x: x["content"]), "\n").alias("value"))
    replaced = {"partitionOverwriteMode": "dynamic"}
    shards.select("session", "shard", "value").write.mode("overwrite").options(**replaced).partitionBy("session").json(f"{path}/shards")
    file = F.format_string("shards/session=%s", "session")
    shards.select("session", "shard", "first_turn", "last_turn", "turns", file.alias("file")).write.mode("overwrite").options(**replaced).partitionBy("session").json(manifests)
