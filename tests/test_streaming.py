"""A stream that has seen everything equals the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.streaming import live

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_turn_state(spark, tmp_path):
    events = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    days = events.withColumn("day", F.to_date("ts")).repartition(1).orderBy("ts")
    for i, day in enumerate(sorted(r[0] for r in days.select("day").distinct().collect())[:4]):
        days.where(F.col("day") == day).drop("day").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = live.stream_table(spark, str(tmp_path / "in"), events.schema, 1)
    live.turn_state(source).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(live.upsert_into(str(tmp_path / "out"), ["user_id"])).start().awaitTermination()
    last = spark.read.parquet(str(tmp_path / "out")).groupBy("user_id").agg(F.max("lines").alias("lines"), F.max("turns").alias("turns"))
    seen = spark.read.parquet(str(tmp_path / "in"))
    want = seen.groupBy("user_id").agg(F.count("*").alias("lines"), F.count_if(F.col("event_type") == "purchase").alias("opened"), (F.min_by("event_type", F.struct("ts", "event_id")) == "purchase").alias("first"))
    joined = want.join(last.withColumnRenamed("lines", "n"), "user_id")
    assert joined.count() == want.count() and joined.where("lines <> n or turns <> opened + if(first, 0, 1)").count() == 0


def test_windows_and_once(spark, tmp_path):
    events = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).union(events.coalesce(1)).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = live.stream_table(spark, str(tmp_path / "in"), events.schema)

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    assert run(live.windowed_counts(source), "counts", "complete").agg(F.sum("n")).first()[0] == 2 * events.count()
    assert run(live.once(source, ["event_id"]), "singles", "append").count() == events.count()
    assert run(live.idle_sessions(source), "idle", "complete").agg(F.sum("n")).first()[0] == 2 * events.count()


def test_job_states(spark, tmp_path):
    rows = [("a", i, e) for i, e in enumerate(["shard-done", "start", "shard-start", "shard-done", "merge", "shard-done", "build", "complete"])] + [("b", 0, "start"), ("b", 1, "error"), ("b", 2, "complete")]
    table = spark.createDataFrame(rows, "job string, at int, event string")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    live.job_states(live.stream_table(spark, str(tmp_path / "in"), table.schema)).writeStream.format("memory").queryName("jobs").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("jobs").collect()} == {("a", "complete", 1, 2), ("b", "error", 0, 1)}


def test_snapshots_recover_from_a_checkpoint(spark, tmp_path):
    """Two runs of one query, with lines sent again between them, count as one pass over all lines; idle sessions end."""
    import json
    import random

    from turnmill.sources import transcripts as S

    rng = random.Random(3)
    lines = []
    for session in ("a", "b", "c"):
        for i in range(1, 60):
            at = {"uuid": f"u{i}", "timestamp": "2024-01-01T00:00:00Z"}
            if i % 9 == 1:
                row = {"type": "user", "promptId": f"p{i}", "message": {"content": "ask"}, **at}
            elif i % 9 == 2:
                row = {"type": "user", "promptId": f"p{i - 1}", "isMeta": True, "message": {"content": "go on"}, **at}
            elif i % 9 in (3, 5):
                row = {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "x", "content": "y"}]}, **at}
            else:
                row = {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "x", "name": rng.choice("RW"), "input": {}}], "usage": {"input_tokens": rng.choice([0, 100, 900, 30]), "output_tokens": 1}}, **at}
            lines.append((session, i, json.dumps(row), 1_704_067_200 + i * 60 + (0 if session != "c" else -7_200)))
    lines += [("a", 60, "{broken", 1_704_067_200 + 3_600)]
    df = spark.createDataFrame(lines, "session string, line_no int, value string, at long").withColumn("ts", F.col("at").cast("timestamp")).drop("at")
    spark.conf.set(*live.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    (tmp_path / "in").mkdir()
    source = live.stream_table(spark, str(tmp_path / "in"), df.schema, 1)

    def run():
        snapped = live.snapshots(source, window=1000, late="1 minute", forget_after="90 minutes")
        snapped.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(live.upsert_into(str(tmp_path / "out"), ["session"], ["lines"])).start().awaitTermination()
        return {r["session"]: r for r in live.latest(spark, str(tmp_path / "out"), ["session"]).collect()}

    try:
        df.where("line_no <= 20").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        first = run()
        assert {s: (r["lines"], r["turns"]) for s, r in first.items()} == dict.fromkeys("abc", (20, 3))
        df.where("line_no between 11 and 60 and session <> 'c'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = run()
    finally:
        spark.conf.unset(live.STATE_STORE[0])
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [got["c"][x] for x in ("active", "lines", "turns")] == [False, 20, 3]
    turns = S.claude_turns(df.where("session <> 'c'"))
    for session in "ab":
        own = turns.where(F.col("session") == session)
        totals, carried = {r["turn_i"]: r["n"] for r in own.groupBy("turn_i").agg(F.max(F.col("usage.input")).alias("n")).collect()}, []
        for i in sorted(totals):
            carried.append(float(totals[i] or 0) or (carried[-1] if carried else 0.0))
        recent = own.where(F.col("turn_i") >= len(totals) - 5)
        tools = {r["name"]: r["count"] for r in S.claude_blocks(recent).where("type = 'tool_use'").groupBy("name").count().collect()}
        r = got[session]
        assert (r["active"], r["lines"], r["turns"], r["trend"], r["tools"]) == (True, 59, len(totals), carried[-5:], tools)
        assert (r["context_tokens"], r["last_delta"], r["compaction"]) == (carried[-1], carried[-1] - carried[-2], carried[-1] < carried[-2])


def test_upsert_keeps_the_last_row_and_repeats_itself(spark, tmp_path):
    write = live.upsert_into(str(tmp_path), ["k"], ["at"])
    batch = spark.createDataFrame([("a", 3, "new"), ("a", 1, "old"), ("b", 1, "x"), ("b", 1, "y")], "k string, at int, v string")
    write(batch, 0)
    write(spark.createDataFrame([("a", 4, "newest")], "k string, at int, v string"), 1)
    write(batch, 0)
    assert {tuple(r) for r in live.latest(spark, str(tmp_path), ["k"]).collect()} == {("a", 4, "newest"), ("b", 1, "y")}


def test_changed_turns(spark):
    turns = lambda rows: live.turn_prints(spark.createDataFrame(rows, "session string, turn_i long, requests long, max_input long, steps int"))
    got = live.changed_turns(turns([("s", 0, 1, 10, 3), ("s", 1, 1, 20, 3), ("s", 2, 1, 5, 1), ("t", 0, 1, 1, 1)]), turns([("s", 0, 1, 10, 3), ("s", 1, 2, 20, 3), ("s", 2, 1, 5, 4), ("s", 3, 1, 1, 1)]))
    assert {tuple(r) for r in got.collect()} == {("s", 1, "listed"), ("s", 2, "longer"), ("s", 3, "new"), ("t", 0, "gone")}
