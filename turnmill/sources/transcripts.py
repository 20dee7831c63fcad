"""Readers of agent transcripts: newline-delimited JSON in five formats, to typed lines and a table of faulty lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.operators.lineage import dealt, settled
from turnmill.operators.turns import turn_lines
from turnmill.operators.windows import over

# The line types of the formats.
KNOWN_TYPES = ("assistant", "user", "system", "attachment", "mode", "permission-mode", "ai-title", "last-prompt", "file-history-snapshot", "task_reminder", "Project", "nested_memory")
OPENCODE_TYPES = ("step_start", "step_finish", "tool_use", "text", "error")
OPENCLAW_UPDATES = ("user_message_chunk", "agent_message_chunk", "agent_thought_chunk", "tool_call", "tool_call_update", "usage_update", "session_info_update")
PI_EVENTS = ("agent_start", "agent_end", "turn_start", "turn_end", "message_start", "message_update", "message_end", "tool_execution_start", "tool_execution_end", "auto_compaction_start", "auto_compaction_end")
TREE_TYPES = ("message", "custom", "compaction")
ATTACHMENTS = ("skill_listing", "task_reminder", "mcp_instructions_delta", "ultra_effort_enter")
SNIFFED_LINES = 25
#: Lines of a session that one task walks by itself.
WALKED = 100_000
NOTIFICATION = "<task-notification>"
BLOCKS = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean,content:string>>"


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(session, line_no from 1, value): the lines of every *.jsonl file below ``path``, but not those of sub-agents.

    A file is one session and is read whole, since its line numbers must be right.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path, wholetext=True).withColumn("session", F.col("_metadata.file_path"))
    kept = files.where(~F.col("session").rlike(r"/(subagents|\.[^/]*)/") & ~F.regexp_extract("session", "[^/]*$", 0).startswith("agent-"))
    return kept.select("session", F.posexplode(F.split("value", "\n")).alias("line_no", "value")).withColumn("line_no", F.col("line_no") + 1)


def parsed(lines: DataFrame) -> DataFrame:
    """Adds v, the line as a variant (null where it isn't JSON), and kind, its outer type; blank lines go."""
    # A generator's row: a filter on v, or several names of it, would else repeat the parsing.
    once = F.explode(F.array(F.try_parse_json("value"))).alias("v")
    return lines.where(F.trim("value") != "").select("*", once).withColumn("kind", F.schema_of_variant("v"))


#: Casts that only values of a type survive: the schema of one means a walk over all that it holds.
CASTS = {"OBJECT": "struct<x:variant>", "ARRAY": "array<variant>"}


def has_type(v: Column, path: str, prefix: str) -> Column:
    if prefix in CASTS:
        return F.try_variant_get(v, path, CASTS[prefix]).isNotNull()
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith(prefix), F.lit(False))


def text_of(v: Column, path: str) -> Column:
    """The string at ``path``; null where there is none or something else."""
    return F.when(has_type(v, path, "STRING"), F.try_variant_get(v, path, "string"))


def number_of(v: Column, path: str) -> Column:
    numeric = has_type(v, path, "BIGINT") | has_type(v, path, "DECIMAL") | has_type(v, path, "DOUBLE")
    return F.when(numeric, F.try_variant_get(v, path, "double"))


def is_object(kind: Column) -> Column:
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))


def moment(v: Column, *paths: str) -> Column:
    """Milliseconds of the first path that holds a time: ISO text, or a number of seconds (below 1e12) or milliseconds."""
    found = []
    for path in paths:
        n = number_of(v, path)
        found += [F.unix_millis(F.try_to_timestamp(text_of(v, path))), F.when(F.abs(n) < 1e12, n * 1000).otherwise(n).cast("long")]
    return F.coalesce(*found)


def formats(lines: DataFrame) -> DataFrame:
    """(session, format): the label of the first decisive line among a file's first 25; a line before it that is no JSON object makes it unknown."""
    v, t = F.col("v"), text_of(F.col("v"), "$.type")
    update = F.coalesce(text_of(v, "$.update.sessionUpdate"), text_of(v, "$.sessionUpdate"))
    linked = F.try_variant_get(v, "$.id", "variant").isNotNull() | F.try_variant_get(v, "$.parentId", "variant").isNotNull()
    message = has_type(v, "$.message", "OBJECT")
    version = has_type(v, "$.version", "STRING") | number_of(v, "$.version").isNotNull() | has_type(v, "$.workingDirectory", "STRING")
    label = (
        F.when(~is_object(F.col("kind")), "unknown")
        .when(t.isin("session_meta", "turn_context") | (t.isin("event_msg", "response_item") & has_type(v, "$.payload.type", "STRING")), "codex")
        .when(t.isin(*OPENCODE_TYPES) & (has_type(v, "$.sessionID", "STRING") | has_type(v, "$.part", "OBJECT")), "opencode")
        .when((t == "openclaw_session") | update.isin(*OPENCLAW_UPDATES), "openclaw")
        .when(t.isin(*PI_EVENTS), "pi-event-stream")
        .when(((t == "header") & version) | ((t == "message") & linked & message) | (t.isin("custom", "compaction") & linked), "pi-session")
        .when(t.isin("user", "assistant", "system", "ai-title") & (has_type(v, "$.uuid", "STRING") | message | has_type(v, "$.aiTitle", "STRING")), "claude")
    )
    seen = parsed(lines.where(F.col("line_no") <= SNIFFED_LINES)).withColumn("kind", F.coalesce("kind", F.lit("none"))).withColumn("label", label).where(F.col("label").isNotNull())
    first = seen.groupBy("session").agg(F.min_by("label", "line_no").alias("label"))
    return lines.select("session").distinct().join(first, "session", "left").select("session", F.coalesce("label", F.lit("unknown")).alias("format"))


def claude_lines(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Typed lines, good and faulty, with the columns to ``keep``: session, line_no, error (null: good), type, uuid, timestamp, prompt_id, is_meta, text, blocks, usage, model,
    content (the message's, as a variant), attachment_type and attachment (its content, else the whole, as a variant), cwd."""
    v = F.col("v")
    t, uuid, ts = text_of(v, "$.type"), text_of(v, "$.uuid"), text_of(v, "$.timestamp")
    error = (
        F.when(v.isNull(), "Invalid JSON: could not parse line")
        .when(~has_type(v, "$", "OBJECT"), "Line is not a JSON object")
        .when(t.isNull() | uuid.isNull() | ts.isNull(), "Missing required fields")
        .when(~t.isin(*KNOWN_TYPES), "Unknown line type")
        .when((t == "assistant") & ~has_type(v, "$.message", "OBJECT"), 'Assistant line missing or invalid "message" field')
        .when((t == "user") & ~has_type(v, "$.message", "OBJECT"), 'User line missing or invalid "message" field')
    )
    used = lambda name: number_of(v, f"$.message.usage.{name}")
    usage = F.when(
        used("input_tokens").isNotNull() & used("output_tokens").isNotNull(),
        F.struct(*[F.coalesce(used(n), F.lit(0.0)).cast("long").alias(a) for n, a in (("input_tokens", "input"), ("output_tokens", "output"), ("cache_read_input_tokens", "cache_read"), ("cache_creation_input_tokens", "cache_made"))]),
    )
    content = F.when(has_type(v, "$.message.content", "ARRAY"), F.from_json(F.to_json(F.try_variant_get(v, "$.message.content", "variant")), BLOCKS))
    return parsed(lines).select(
        "session", "line_no", *keep, error.alias("error"), t.alias("type"), uuid.alias("uuid"), ts.alias("timestamp"), text_of(v, "$.promptId").alias("prompt_id"), F.coalesce(F.try_variant_get(v, "$.isMeta", "boolean"), F.lit(False)).alias("is_meta"),
        text_of(v, "$.message.content").alias("text"), content.alias("blocks"), F.when(t == "assistant", usage).alias("usage"), F.when(t == "assistant", F.coalesce(text_of(v, "$.message.model"), F.lit("unknown"))).alias("model"),
        F.try_variant_get(v, "$.message.content", "variant").alias("content"), F.when(t == "attachment", text_of(v, "$.attachment.type")).alias("attachment_type"),
        F.coalesce(F.try_variant_get(v, "$.attachment.content", "variant"), F.try_variant_get(v, "$.attachment", "variant")).alias("attachment"),
        text_of(v, "$.cwd").alias("cwd"),
    )


def opens_turn() -> Column:
    """Over claude_lines(): whether a user line may open a turn."""
    listed = F.try_variant_get("content", "$", "array<variant>")
    kinds = F.coalesce(F.transform(listed, lambda b: F.try_variant_get(b, "$.type", "string")), F.array().cast("array<string>"))
    written = F.coalesce(F.col("text") != "", F.lit(False)) | F.arrays_overlap(kinds, F.array(F.lit("text"), F.lit("image")))
    noted = F.coalesce(F.col("text").startswith(NOTIFICATION), F.lit(False))
    return (F.col("type") == "user") & ~F.array_contains(kinds, "tool_result") & ~noted & (written | F.col("prompt_id").isNotNull())


def claude_turns(lines: DataFrame) -> DataFrame:
    """Good lines with turn_i, opens and goes_on.  A meta line with the prompt id of the turn's opening line continues that turn; a session's first user line opens one whatever it says."""
    good = claude_lines(lines).where(F.col("error").isNull())
    users = F.count_if(F.col("type") == "user").over(over(["session"], ["line_no"]))
    good = good.withColumn("_may", opens_turn() | (F.col("type") == "user") & (users == 1))
    before = F.last(F.when(F.col("_may"), F.struct("prompt_id")), ignorenulls=True).over(over(["session"], ["line_no"]).rowsBetween(-(1 << 31), -1))
    goes_on = F.coalesce((F.col("type") == "user") & F.col("is_meta") & (F.col("prompt_id") == before["prompt_id"]), F.lit(False))
    marked = good.withColumn("goes_on", goes_on).withColumn("opens", F.col("_may") & ~F.col("goes_on"))
    return turn_lines(marked, F.col("opens")).drop("_may")


def claude_requests(turns: DataFrame) -> DataFrame:
    """One row per assistant line with usage: session, turn_i, line_no, model, billed (input and cache read), cache_read, output."""
    u = F.col("usage")
    return turns.where(u.isNotNull()).select("session", "turn_i", "line_no", "model", (u["input"] + u["cache_read"]).alias("billed"), u["cache_read"].alias("cache_read"), u["output"].alias("output"))


def claude_blocks(turns: DataFrame) -> DataFrame:
    """One row per content block: session, turn_i, line_no, block_i, and the block's fields."""
    return turns.select("session", "turn_i", "line_no", "type", F.posexplode("blocks").alias("block_i", "b")).select("session", "turn_i", "line_no", F.col("type").alias("role"), "block_i", "b.*")


def typed_lines(lines: DataFrame, what: str) -> DataFrame:
    """Lines of the formats that need a ``type`` alone (codex, pi): session, seq (0-based), error, type, ms, v."""
    v = F.col("v")
    t = text_of(v, "$.type")
    error = F.when(v.isNull(), "Invalid JSON: could not parse line").when(t.isNull(), f"{what} line missing type")
    return parsed(lines).select("session", (F.col("line_no") - 1).alias("seq"), error.alias("error"), t.alias("type"), moment(v, "$.timestamp", "$.message.timestamp").alias("ms"), "v")


def codex_lines(lines: DataFrame) -> DataFrame:
    return typed_lines(lines, "Codex")


def pi_lines(lines: DataFrame) -> DataFrame:
    return typed_lines(lines, "Pi")


def opencode_lines(lines: DataFrame) -> DataFrame:
    """As typed_lines(), with part and the session named by the line or its part."""
    own = F.coalesce(text_of(F.col("v"), "$.sessionID"), text_of(F.col("v"), "$.part.sessionID"), F.lit(""))
    return typed_lines(lines, "OpenCode").withColumn("session_id", own).withColumn("part", F.try_variant_get("v", "$.part", "variant"))


def openclaw_lines(lines: DataFrame) -> DataFrame:
    """session, seq, error, session_id, run_id, update kind, ms, v; names in either spelling, updates nested or not."""
    v = F.col("v")
    either = lambda a, b: F.coalesce(F.nullif(text_of(v, a), F.lit("")), text_of(v, b), F.lit(""))
    update = F.coalesce(text_of(v, "$.sessionUpdate"), text_of(v, "$.update.sessionUpdate"))
    error = F.when(v.isNull(), "Invalid JSON: could not parse line").when(~has_type(v, "$", "OBJECT"), "OpenClaw line must be an object").when(update.isNull() & ~F.coalesce(text_of(v, "$.type") == "openclaw_session", F.lit(False)), "OpenClaw line missing sessionUpdate")
    return parsed(lines).select("session", (F.col("line_no") - 1).alias("seq"), error.alias("error"), either("$.sessionId", "$.session_id").alias("session_id"), either("$.runId", "$.run_id").alias("run_id"), update.alias("update"), moment(v, "$.timestamp", "$.at").alias("ms"), "v")


def codex_usage(lines: DataFrame) -> DataFrame:
    """Token counts of a codex log: session, seq, input, cached, output, reasoning, window."""
    v = F.col("v")
    last = "$.payload.info.last_token_usage"
    n = lambda path: number_of(v, path).cast("long")
    return codex_lines(lines).where(F.col("error").isNull() & (text_of(v, "$.payload.type") == "token_count")).select(
        "session", "seq", n(f"{last}.input_tokens").alias("input"), n(f"{last}.cached_input_tokens").alias("cached"), n(f"{last}.output_tokens").alias("output"), n(f"{last}.reasoning_output_tokens").alias("reasoning"), n("$.payload.info.model_context_window").alias("window")
    )


def longest_branch(lines: DataFrame) -> DataFrame:
    """(session, seq, id, depth): entries on a tree-shaped log's longest path from root to leaf; of equally long paths that of the later leaf.

    Of entries with one id the last counts.  What hangs from a cycle has no root and is left out.  A session of up to WALKED lines is walked in
    its task, every entry once.  In longer ones ancestors are found at distances 1, 2, 4 and so on, so a branch of n entries takes log2(n)
    joins, and no path is ever held in one row.
    """
    v = F.col("v")
    # One row per session; of the long ones there are few, as each has more than WALKED lines.
    sizes = settled(lines.groupBy("session").count())
    whole, longest = sizes.agg(F.sum("count"), F.max("count")).first()
    split = (longest or 0) > WALKED
    long = sizes.where(F.col("count") > WALKED).select("session")

    def entries(some: DataFrame) -> DataFrame:
        good = pi_lines(some).where(F.col("error").isNull() & F.col("type").isin(*TREE_TYPES))
        return good.select("session", "seq", text_of(v, "$.id").alias("id"), text_of(v, "$.parentId").alias("parent")).where("id <> ''")

    walked = _walked(dealt(entries(lines.join(F.broadcast(long), "session", "left_anti") if split else lines).where("session IS NOT NULL"), "session", rows=whole or 0))
    return walked.unionByName(_jumped(entries(lines.join(F.broadcast(long), "session", "left_semi")))) if split else walked


def _walked(entries: DataFrame) -> DataFrame:
    """longest_branch() of entries dealt by their session, of sessions that a task can hold one of."""

    def path(ids: list[str], seqs: list[int], parents: list[str | None]) -> list[tuple[int, str, int]]:
        last = dict(zip(ids, zip(seqs, parents, strict=True), strict=True))
        depth: dict[str, int] = {}
        for own in last:
            above, at = [], own
            # Entries that are met again before a known one are of a cycle: -1 for good.
            while at in last and at not in depth:
                depth[at] = -1
                above.append(at)
                at = last[at][1]
            n = depth[at] if at in last else -1
            if at in last and n < 0:
                continue
            for x in reversed(above):
                n += 1
                depth[x] = n
        leaf = max((x for x in last if depth[x] >= 0), key=lambda x: (depth[x], last[x][0]), default=None)
        out = []
        while leaf in last:
            out.append((last[leaf][0], leaf, depth[leaf]))
            leaf = last[leaf][1]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            own, out = batch["session"].to_numpy(), []
            starts = [0, *((own[1:] != own[:-1]).nonzero()[0] + 1).tolist()] if len(own) else []
            for a, b in zip(starts, [*starts[1:], len(batch)][: len(starts)], strict=True):
                piece = batch.iloc[a:b]
                if held and held[0]["session"].iloc[0] != piece["session"].iloc[0]:
                    out.append(told(held))
                    held = []
                held.append(piece)
            if out:
                yield pd.concat(out)
        if held:
            yield told(held)

    def told(held: list[pd.DataFrame]) -> pd.DataFrame:
        whole = pd.concat(held)
        found = path(whole["id"].tolist(), whole["seq"].tolist(), whole["parent"].tolist())
        seq, ids, depth = zip(*found, strict=True) if found else ((), (), ())
        return pd.DataFrame({"session": pd.Series([whole["session"].iloc[0]] * len(found), dtype=whole["session"].dtype), "seq": pd.Series(seq, dtype="int64"), "id": pd.Series(ids, dtype=object), "depth": pd.Series(depth, dtype="int64")})

    kind = dict(entries.dtypes)["session"]
    ordered = entries.withColumn("seq", F.col("seq").cast("long")).sortWithinPartitions("session", "seq")
    found = ordered.mapInPandas(run, f"session {kind}, seq long, id string, depth long")
    return found.withColumn("seq", F.col("seq").cast(dict(entries.dtypes)["seq"]))


def _jumped(entries: DataFrame) -> DataFrame:
    """longest_branch() of sessions of any length."""
    nodes = entries.groupBy("session", "id").agg(F.max_by(F.struct("seq", "parent"), "seq").alias("own")).select("session", "id", "own.*")
    known = nodes.select("session", F.col("id").alias("up"))
    tied = nodes.withColumnRenamed("parent", "up").join(known.withColumn("_known", F.lit(True)), ["session", "up"], "left")
    level = settled(tied.select("session", "id", "seq", F.when(F.col("_known"), F.col("up")).alias("up"), F.when(F.col("_known"), 1).otherwise(0).cast("long").alias("depth")))
    largest = level.groupBy("session").count().agg(F.max("count")).first()[0] or 0
    levels, reach = [], 1
    while reach <= largest and not level.where("up IS NOT NULL").isEmpty():
        levels.append(level)
        further = level.select("session", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_more"))
        level = settled(level.join(further, ["session", "up"], "left").select("session", "id", "seq", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")))
        reach *= 2
    rooted = level.where("up IS NULL").select("session", "id", "seq", "depth")
    marked = rooted.groupBy("session").agg(F.max_by("id", F.struct("depth", "seq")).alias("id"))
    # Every distance is a sum of different powers of two, so each ancestor of the leaf is marked once.
    for jumps in reversed(levels):
        marked = marked.join(jumps.select("session", "id", "up"), ["session", "id"], "left").select("session", F.explode(F.array_compact(F.array("id", "up"))).alias("id"))
    return rooted.join(marked, ["session", "id"]).select("session", "seq", "id", "depth")


def claude_attachments(lines: DataFrame) -> DataFrame:
    """session, line_no, attachment, content (JSON) of attachment lines of the kinds that add to the context; without content, the whole attachment."""
    v = F.col("v")
    kind = text_of(v, "$.attachment.type")
    content = F.coalesce(F.try_variant_get(v, "$.attachment.content", "variant"), F.try_variant_get(v, "$.attachment", "variant"))
    kept = parsed(lines).where((text_of(v, "$.type") == "attachment") & kind.isin(*ATTACHMENTS))
    return kept.select("session", "line_no", kind.alias("attachment"), F.to_json(content).alias("content"))
