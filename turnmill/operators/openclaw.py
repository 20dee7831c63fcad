"""Turns and steps of openclaw logs: chunks that belong together become one, a user's next words after an answer open a turn."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions.content import at, bound, openclaw_text, stringified
from turnmill.operators.lineage import settled
from turnmill.operators.pi import MODEL_STEP, STEP
from turnmill.operators.steps import KEYS, aware, rounded, timed
from turnmill.operators.windows import before, islands, ordinal, over, up_to
from turnmill.sources.transcripts import has_type, number_of, openclaw_lines, text_of

S = ["session"]
# Updates that are an assistant's doing, and what stands where a log has no prompt.
USER, TEXT, THOUGHT, CALL, RESULT, USAGE = "user_message_chunk", "agent_message_chunk", "agent_thought_chunk", "tool_call", "tool_call_update", "usage_update"
ACTIVITY = (TEXT, THOUGHT, CALL, RESULT, USAGE)
STREAM = "OpenClaw stream:"
SUB_AGENT = "task"


def _some(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def update_events(lines: DataFrame) -> DataFrame:
    """Updates with turn_i and opens: session, turn_i, opens, seq, ms, run_id, update, u (the update as a variant).

    The first update opens a turn.  A user's chunk opens one behind any doing of the assistant, and before that if it names another run
    than the update that opened the turn (one of them without a run is no other).
    """
    v = F.col("v")
    u = F.when(has_type(v, "$.sessionUpdate", "STRING"), v).otherwise(at(v, "$.update"))
    good = openclaw_lines(lines).where(F.col("error").isNull() & F.col("update").isNotNull()).select("session", "seq", "ms", "run_id", "update", u.alias("u"))
    does, is_user = F.col("update").isin(*ACTIVITY), F.col("update") == USER
    # Stretches without doing: the first update of one decides for the chunks behind it.
    marked = ordinal(good, S, ["seq"], "_n").withColumn("_b", F.coalesce(F.sum(F.when(does, 1)).over(before(S, ["seq"])), F.lit(0)))
    own = ["session", "_b"]
    counts = is_user | (F.col("_n") == 0)
    first_run = F.first(F.when(counts, F.col("run_id")), ignorenulls=True).over(up_to(own, ["seq"]))
    last_run = F.last(F.when(counts & (F.col("run_id") != ""), F.col("run_id")), ignorenulls=True).over(before(own, ["seq"]))
    is_first = F.coalesce(F.sum(F.when(counts, 1)).over(before(own, ["seq"])), F.lit(0)) == 0
    other = (F.col("run_id") != "") & (first_run != "") & (F.col("run_id") != last_run)
    opens = (F.col("_n") == 0) | is_user & (is_first | F.coalesce(other, F.lit(False)))
    opened = islands(marked.withColumn("opens", opens), S, ["seq"], F.col("opens"), "_t")
    # Turns and steps both read these, and a line is parsed once.
    return settled(opened.withColumn("turn_i", (F.col("_t") - 1).cast("long")).drop("_t", "_b", "_n"))


def _content() -> Column:
    return bound(F.coalesce(at(F.col("u"), "$.content"), at(F.col("u"), "$.text")), lambda x: F.when(x.isNull(), "").otherwise(openclaw_text(x, 1)))


def openclaw_turns(events: DataFrame, filename: Column | str = "") -> DataFrame:
    """session, turn_i, prompt, start_ms, end_ms, requests, max_input, last_input.

    The prompt is what the user's chunks of the turn say, by line; the stream's name until they say something.  A turn's requests are the
    assistant's runs in it, chunks without a run counting as one.
    """
    filename = filename if isinstance(filename, Column) else F.lit(filename)
    said = F.when(F.col("update") == USER, _content())
    used = F.when(F.col("update") == USAGE, F.struct("seq", *[F.coalesce(number_of(F.col("u"), f"$.{n}"), F.lit(0.0)).cast("long").alias(n) for n in ("used", "size")]))
    small = events.select(*KEYS, "seq", "ms", "opens", said.alias("said"), F.when(F.col("update").isin(*ACTIVITY), F.nvl(F.nullif("run_id", F.lit("")), F.lit("__openclaw_run__"))).alias("run"), used.alias("used"))
    named = F.concat(F.lit(STREAM + " "), filename)
    chunk = F.when(F.col("opens"), F.struct("seq", _some(F.col("said"), named).alias("text"))).when(F.col("said") != "", F.struct("seq", F.col("said").alias("text")))
    per = small.groupBy(*KEYS).agg(
        F.collect_list(chunk).alias("_c"), F.min_by("ms", "seq").alias("start_ms"), F.max_by("ms", F.when(F.col("ms").isNotNull(), F.col("seq"))).alias("end_ms"), F.count_distinct("run").alias("requests"),
        F.coalesce(F.max("used.used"), F.lit(0)).alias("max_input"), F.coalesce(F.max_by("used.used", F.when(F.col("used.used") > 0, F.col("seq"))), F.lit(0)).alias("last_input"),
    )
    ordered = F.transform(F.array_sort("_c"), lambda x: x["text"])
    prompt = bound(ordered, lambda a: F.aggregate(F.slice(a, F.lit(2), F.size(a)), a[0], lambda all_, x: F.when(all_.startswith(STREAM), x).otherwise(F.concat(all_, F.lit("\n"), x))))
    return per.withColumn("prompt", prompt).select(*KEYS, "prompt", "start_ms", "end_ms", "requests", "max_input", "last_input")


def openclaw_steps(events: DataFrame, turns: DataFrame) -> DataFrame:
    """session, turn_i, step_i, STEP.  Neighbouring chunks of one kind are one step, whatever comes between them that makes no step."""
    u, kind = F.col("u"), F.col("update")
    title = lambda fallback: _some(text_of(u, "$.title"), text_of(u, "$.kind"), text_of(u, "$.name"), fallback, F.lit("tool"))
    own_id = _some(text_of(u, "$.toolCallId"), text_of(u, "$.id"))
    output = bound(F.coalesce(at(u, "$.rawOutput"), at(u, "$.output"), at(u, "$.result")), lambda x: F.when(x.isNull(), "").otherwise(openclaw_text(x, 1)))
    answer = _some(bound(at(u, "$.content"), lambda x: F.when(x.isNull(), "").otherwise(openclaw_text(x, 1))), output)
    status = F.lower(F.coalesce(text_of(u, "$.status"), F.lit("")))
    asked = F.coalesce(at(u, "$.rawInput"), at(u, "$.input"), at(u, "$.args"))
    text = F.when(kind.isin(TEXT, THOUGHT), _content()).when(kind == RESULT, answer).otherwise("")
    read = events.where(kind.isin(TEXT, THOUGHT, CALL, RESULT)).select(
        *KEYS, "seq", "ms", "update", text.alias("text"), own_id.alias("own_id"), title(own_id).alias("title"), title(F.lit("")).alias("bare"), F.when(asked.isNull(), "{}").otherwise(stringified(asked)).alias("asked"), status.alias("status")
    )
    kept = read.where(((kind.isin(TEXT, THOUGHT)) & (F.col("text") != "")) | (kind == CALL) | (kind == RESULT) & ((F.col("text") != "") | (F.col("status") != "in_progress")))
    goes_on = F.coalesce((F.lag("update").over(over(KEYS, ["seq"])) == kind) & kind.isin(TEXT, THOUGHT), F.lit(False))
    runs = islands(kept, KEYS, ["seq"], ~goes_on, "_r")
    # A call without an id is named by the number of steps before it.
    id_ = F.when((kind == CALL) & (F.col("own_id") == ""), F.concat(F.lit("tool_"), (F.col("_r") - 1).cast("string"))).otherwise(F.col("own_id"))
    runs = settled(runs.withColumn("id", id_))
    name = F.when((kind == CALL) & (F.col("own_id") == "") & (F.col("bare") == "tool"), F.col("id")).otherwise(F.col("title"))
    calls = runs.where(kind == CALL).select(*KEYS, "seq", "ms", "_r", "id", name.alias("name"), "asked")
    none, zero, no = F.lit(""), F.lit(0).cast("long"), F.lit(False)

    def step(kind, name, at_ms, text, input_, result, error, text_tok, asst_tok, think_tok, call_tok, result_tok) -> list[Column]:
        found = (kind, name, at_ms, zero, text, input_, result, error, text_tok, asst_tok, think_tok, call_tok, result_tok)
        return [*KEYS, *[(x if isinstance(x, Column) else F.lit(x)).alias(n) for x, n in zip(found, STEP, strict=True)], "_r"]

    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    chunks = runs.where(kind.isin(TEXT, THOUGHT)).groupBy(*KEYS, "_r", "update").agg(joined.alias("text"), F.min_by("ms", "seq").alias("ms"))
    is_text, own = F.col("update") == TEXT, F.col("text")
    said = chunks.select(step("m", MODEL_STEP, F.col("ms"), own, none, none, no, F.when(is_text, rounded(own)).otherwise(zero), F.when(is_text, aware(own)).otherwise(zero), F.when(is_text, zero).otherwise(rounded(own)), zero, zero))
    calling = calls.select(step("m", MODEL_STEP, F.col("ms"), none, F.col("asked"), none, no, zero, zero, zero, rounded(F.concat("name", "asked")), zero))
    # A result takes name and input of the last call before it that has its id, within the turn.
    both = runs.where(kind.isin(CALL, RESULT)).withColumn("_call", F.when(kind == CALL, F.struct(name.alias("name"), "asked")))
    known = both.withColumn("_k", F.last("_call", ignorenulls=True).over(before([*KEYS, "id"], ["seq"]))).where(kind == RESULT)
    known = known.withColumn("_k", F.when(F.col("id") != "", F.col("_k")))
    result_name = F.coalesce("_k.name", "title")
    failed = F.col("status").isin("failed", "error")
    answered = known.select(step(F.when(result_name == SUB_AGENT, "s").otherwise("t"), result_name, F.col("ms"), none, F.coalesce("_k.asked", none), own, failed, zero, zero, zero, zero, rounded(own)))
    return timed(reduce(DataFrame.unionByName, (said, calling, answered)), turns, ["_r"]).select(*KEYS, "step_i", *STEP)
