"""Live forms of the batch operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from turnmill.sources.transcripts import claude_lines, opens_turn

# Which phases of an extraction job accept which event.
ACCEPTED = {
    "start": ("idle", "extracting"), "shard-start": ("extracting",), "shard-retry": ("extracting",), "shard-done": ("extracting",), "shard-error": ("extracting",),
    "merge": ("extracting",), "build": ("extracting", "merging"), "complete": ("extracting", "merging", "building"), "error": ("idle", "extracting", "merging", "building", "complete", "error"),
}
PHASE_AFTER = {"start": "extracting", "merge": "merging", "build": "building", "complete": "complete", "error": "error"}


def stream_table(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Rows and values per kind and window; what comes later than ``late`` is dropped and its window's state freed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def idle_sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """A user's sessions, ended by a pause."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("w.start", "w.end", "user_id", "n")


def once(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key; keys are remembered as long as duplicates may come."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def turn_state(events: DataFrame) -> DataFrame:
    """Per user: turns opened so far, lines, and the total of the current turn.  State is three numbers per user, whatever the log's length."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns, lines, total = state.get if state.exists else (0, 0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind, value in zip(rows["event_type"], rows["value"], strict=True):
            if kind == "purchase" or lines == 0:
                turns, total = turns + 1, 0.0
            lines, total = lines + 1, total + float(value)
        state.update((turns, lines, total))
        yield pd.DataFrame({"user_id": [key[0]], "turns": [turns], "lines": [lines], "turn_total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, turns long, lines long, turn_total double", "turns long, lines long, total double", "update", GroupStateTimeout.NoTimeout)


def job_states(events: DataFrame) -> DataFrame:
    """Phase of each job after its events in order; an event that the phase doesn't accept is counted and ignored.  Columns: job, at, event."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase, done, ignored = state.get if state.exists else ("idle", 0, 0)
        for event in pd.concat(list(batches)).sort_values("at")["event"]:
            if phase not in ACCEPTED.get(event, ()):
                ignored += 1
                continue
            phase, done = PHASE_AFTER.get(event, phase), done + (event == "shard-done")
        state.update((phase, done, ignored))
        yield pd.DataFrame({"job": [key[0]], "phase": [phase], "done": [done], "ignored": [ignored]})

    return events.groupBy("job").applyInPandasWithState(step, "job string, phase string, done long, ignored long", "phase string, done long, ignored long", "update", GroupStateTimeout.NoTimeout)


#: What snapshots() gives per session.
SNAPSHOT = "session string, active boolean, lines long, turns long, context_tokens double, context_pct long, last_delta double, trend array<double>, compaction boolean, tools map<string,long>"
#: Turns that trend and tools of a snapshot look back on.
RECENT = 5


def snapshots(lines: DataFrame, window: int = 200_000, late: str = "10 minutes", forget_after: str = "1 day") -> DataFrame:
    """A stream of raw transcript lines (session, line_no, value, ts: when the line came) to monitor snapshots, one per session and batch that brings lines.

    Lines are typed by column functions; state per session is its last line's number, its turn's opening prompt and its last five turns, whatever its
    length.  Lines sent again count once; lines of one batch may come in any order, but a session's batches follow each other.  A session without lines for
    ``forget_after`` gives a last snapshot with active false, and its state is freed: lines that come later begin a new count.
    Needs the RocksDB state store (STATE_STORE).
    """

    class Session(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.at = handle.getValueState("at", "line long, turns long, prompt string, seen boolean")
            self.recent = handle.getListState("recent", "total double, most double, before double, tools map<string,long>")

        def snapshot(self, key, active, line, turns, recent) -> pd.DataFrame:
            tools: dict[str, int] = {}
            for _, _, _, counts in recent:
                for name, n in counts.items():
                    tools[name] = tools.get(name, 0) + n
            now, before = (recent[-1][0], recent[-1][2]) if recent else (0.0, 0.0)
            row = (key[0], active, line, turns, now, int(now / window * 100 + 0.5) if window else 0, now - before if turns > 1 else 0.0, [r[0] for r in recent], now < before, tools)
            return pd.DataFrame([row], columns=[c.split()[0] for c in SNAPSHOT.split(", ")])

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            line, turns, prompt, seen = self.at.get() if self.at.exists() else (0, 0, None, False)
            recent = [list(r) for r in self.recent.get()] if self.recent.exists() else []
            batch = pd.concat(list(rows)).sort_values("line_no")
            for r in batch.itertuples(index=False):
                if r.line_no <= line:
                    continue
                line = r.line_no
                if r.type == "user":
                    goes_on = bool(r.is_meta) and turns > 0 and r.prompt_id is not None and r.prompt_id == prompt
                    if (r.may or not seen) and not goes_on:
                        before = recent[-1][0] if recent else 0.0
                        recent = [*recent, [before, 0.0, before, {}]][-RECENT:]
                        turns, prompt = turns + 1, r.prompt_id
                    seen = True
                elif r.type == "assistant" and turns:
                    now = recent[-1]
                    if r.billed > now[1]:
                        now[0] = now[1] = float(r.billed)
                    now[3] = dict(now[3])
                    for name in r.tools if r.tools is not None else ():
                        now[3][name] = now[3].get(name, 0) + 1
            self.at.update((int(line), int(turns), prompt, seen))
            self.recent.put([tuple(x) for x in recent])
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(batch["ms"].max()) + forget_ms)
            yield self.snapshot(key, True, line, turns, recent)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            line, turns, _, _ = self.at.get() if self.at.exists() else (0, 0, None, False)
            recent = [list(r) for r in self.recent.get()] if self.recent.exists() else []
            self.at.clear()
            self.recent.clear()
            yield self.snapshot(key, False, line, turns, recent)

        def close(self) -> None:
            pass

    forget_ms = int(pd.Timedelta(forget_after).total_seconds() * 1000)
    calls = F.transform(F.filter("blocks", lambda b: b["type"] == "tool_use"), lambda b: F.coalesce(b["name"], F.lit("")))
    billed = F.coalesce(F.col("usage.input") + F.col("usage.cache_read"), F.lit(0))
    stamped = lines.withWatermark("ts", late)
    typed = claude_lines(stamped, ["ts"]).where(F.col("error").isNull() & F.col("type").isin("user", "assistant"))
    small = typed.select("session", "ts", F.unix_millis("ts").alias("ms"), "line_no", "type", F.coalesce(opens_turn(), F.lit(False)).alias("may"), "is_meta", "prompt_id", billed.alias("billed"), calls.alias("tools"))
    return small.groupBy("session").transformWithStateInPandas(statefulProcessor=Session(), outputStructType=SNAPSHOT, outputMode="Update", timeMode="EventTime")


# Fixed value: the store that snapshots() needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def upsert_into(path: str, keys: list[str], order: list[str] | None = None):
    """A foreachBatch sink: of each batch the last row per key by ``order`` (then by all columns), kept as one Parquet folder per batch number, so
    that a repeated batch replaces itself.  latest() reads what holds."""

    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in keys and not dict(batch.dtypes)[c].startswith("map")]
        last = F.max_by(F.struct(*batch.columns), F.struct(*(order or []), *[c for c in rest if c not in (order or [])])) if rest else F.first(F.struct(*batch.columns))
        batch.groupBy(*keys).agg(last.alias("_row")).select("_row.*").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What upsert_into() has made of its batches: per key the row of the last batch that has one."""
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "batch")]), "batch").alias("_row")).select(*keys, "_row.*")


def turn_prints(turns: DataFrame) -> DataFrame:
    """(session, turn_i, print, steps): what tells whether a turn has changed: its number, requests and largest input; ``turns`` has requests, max_input and steps."""
    return turns.select("session", "turn_i", F.concat_ws(":", "turn_i", "requests", "max_input").alias("print"), F.col("steps").cast("long").alias("steps"))


def changed_turns(before: DataFrame, after: DataFrame) -> DataFrame:
    """Of two snapshots of turn_prints(): session, turn_i, change, for turns that are new, listed anew (another print), longer (another number of steps) or gone.

    Joined by session and turn, so only prints move; sessions whose turns are all as before have no row.
    """
    a, b = before.withColumnsRenamed({"print": "_print", "steps": "_steps"}), after
    both = b.join(a, ["session", "turn_i"], "full")
    change = F.when(F.col("_print").isNull(), "new").when(F.col("print").isNull(), "gone").when(F.col("print") != F.col("_print"), "listed").when(F.col("steps") != F.col("_steps"), "longer")
    return both.select("session", "turn_i", change.alias("change")).where("change is not null")
