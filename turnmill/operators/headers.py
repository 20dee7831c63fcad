"""Headers of sessions, each format by its own rule: model, version, folder, title, requests, output, and where the context was fullest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions.content import bound, opencode_usage
from turnmill.operators.opencode import step_events
from turnmill.operators.steps import turn_facts
from turnmill.operators.windows import over
from turnmill.sources.transcripts import claude_turns, codex_lines, has_type, number_of, openclaw_lines, opencode_lines, pi_lines, text_of

S = ["session"]
HEADER = ["session", "model", "version", "cwd", "title", "requests", "total_output", "peak_index", "peak_tokens", "peak_turn", "context_limit"]
COMPOSITION = ("thinking", "asstText", "toolCalls", "toolResults", "userMsgs", "subagent")
DEFAULT_LIMIT = 200_000


def _first(value: Column, where: Column, order: str = "seq") -> Column:
    """The first value that isn't empty where ``where`` holds."""
    good = where & value.isNotNull() & (value != "")
    return F.min_by(F.when(good, value), F.when(good, F.col(order)))


def _peak(requests: DataFrame) -> DataFrame:
    """session, peak_index, peak_tokens, peak_turn of (session, turn_i, at, input): the first request of the largest input, counted from 0 over the session; 0 where none is above 0."""
    numbered = requests.withColumn("_i", F.row_number().over(over(S, ["turn_i", "at"])) - 1)
    best = F.max_by(F.struct("_i", "input", "turn_i"), F.when(F.col("input") > 0, F.struct("input", -F.col("_i"))))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return numbered.groupBy("session").agg(best.alias("b")).select("session", zero(F.col("b._i")).alias("peak_index"), zero(F.col("b.input")).alias("peak_tokens"), zero(F.col("b.turn_i")).alias("peak_turn"))


def _joined(named: DataFrame, turns: DataFrame, peaks: DataFrame) -> DataFrame:
    """``named``: session, version, cwd and maybe context_limit; ``turns``: session, turn_i, model, prompt, requests, out_tok and maybe limit."""
    sums = turns.groupBy("session").agg(
        F.min_by("model", "turn_i").alias("model"), F.min_by("prompt", "turn_i").alias("title"), F.sum("requests").cast("long").alias("requests"), F.sum("out_tok").cast("long").alias("total_output"), F.min_by("limit", "turn_i").alias("limit")
    )
    both = sums.join(named, "session", "left").join(peaks, "session", "left")
    limit = F.coalesce("context_limit", "limit", F.lit(DEFAULT_LIMIT)) if "context_limit" in named.columns else F.coalesce("limit", F.lit(DEFAULT_LIMIT))
    filled = both.withColumn("context_limit", limit.cast("long"))
    for c in ("version", "cwd"):
        filled = filled.withColumn(c, F.coalesce(c, F.lit("")))
    for c in ("peak_index", "peak_tokens", "peak_turn"):
        filled = filled.withColumn(c, F.coalesce(c, F.lit(0)).cast("long"))
    return filled.select(*HEADER)


def _or_file(version: Column, filename: Column | str) -> Column:
    return F.coalesce(version, filename if isinstance(filename, Column) else F.lit(filename))


def cum_totals(facts: DataFrame) -> Column:
    total = F.lit(0)
    for c in COMPOSITION:
        total = total + F.col(c)
    return total


def carried_totals(turns: DataFrame, total: Column) -> DataFrame:
    """Adds cum_total: a turn's last input where it has one, else the larger of the total before and its own composition."""
    with_own = turns.withColumn("_own", total)
    # From the last turn with an input on, the largest of that input and the compositions since.
    marked = with_own.withColumn("_g", F.sum(F.when(F.col("last_input") > 0, 1).otherwise(0)).over(over(S, ["turn_i"])))
    value = F.when(F.col("last_input") > 0, F.col("last_input")).otherwise(F.col("_own"))
    return marked.withColumn("cum_total", F.max(value).over(over(["session", "_g"], ["turn_i"]))).drop("_own", "_g")


def codex_headers(lines: DataFrame, events: DataFrame, turns: DataFrame, filename: Column | str = "") -> DataFrame:
    """Of codex_turns(): model, title and limit of the first turn; version and folder of the session's meta line, else the file's name and the first folder a turn names."""
    v = F.col("v")
    meta = F.col("type") == "session_meta"
    read = codex_lines(lines).where(F.col("error").isNull())
    named = read.groupBy("session").agg(
        _or_file(F.min_by(text_of(v, "$.payload.cli_version"), F.when(meta, F.col("seq"))), filename).alias("version"),
        F.coalesce(F.min_by(text_of(v, "$.payload.cwd"), F.when(meta, F.col("seq"))), _first(text_of(v, "$.payload.cwd"), F.col("type") == "turn_context")).alias("cwd"),
    )
    usage = (F.col("type") == "event_msg") & (F.col("what") == "token_count") & has_type(v, "$.payload.info.last_token_usage", "OBJECT")
    requests = events.where(usage).select("session", "turn_i", F.col("seq").alias("at"), F.coalesce(number_of(v, "$.payload.info.last_token_usage.input_tokens"), F.lit(0.0)).cast("long").alias("input"))
    return _joined(named, turns.withColumnRenamed("window", "limit"), _peak(requests))


def opencode_headers(lines: DataFrame, turns: DataFrame, steps: DataFrame, filename: Column | str = "", events: DataFrame | None = None) -> DataFrame:
    """Of opencode_turns() and opencode_steps(), and step_events() where they are at hand: the peak is that of the largest request, without any that of the largest total of a turn."""
    v = F.col("v")
    read = opencode_lines(lines).where(F.col("error").isNull())
    always = F.lit(True)
    named = read.groupBy("session").agg(_or_file(_first(F.col("session_id"), always), filename).alias("version"), F.coalesce(_first(text_of(v, "$.cwd"), always), _first(text_of(v, "$.part.cwd"), always)).alias("cwd"))
    used = bound(F.col("part"), opencode_usage)
    requests = (step_events(lines) if events is None else events).where((F.col("type") == "step_finish") & used.isNotNull()).select("session", "turn_i", F.col("seq").alias("at"), F.coalesce(used["input"], F.lit(0.0)).cast("long").alias("input"))
    peaks = _peak(requests)
    facts = turn_facts(turns, steps)
    totals = carried_totals(facts, cum_totals(facts)).join(requests.select("session").distinct(), "session", "left_anti")
    without = _peak(totals.select("session", "turn_i", F.lit(0).alias("at"), F.col("cum_total").alias("input"))).withColumn("peak_index", F.lit(0).cast("long"))
    return _joined(named, turns.select("session", "turn_i", F.lit("opencode").alias("model"), "prompt", "requests", "out_tok", F.lit(None).cast("long").alias("limit")), peaks.unionByName(without))


def openclaw_headers(lines: DataFrame, turns: DataFrame, steps: DataFrame, filename: Column | str = "") -> DataFrame:
    """Of openclaw_turns() and openclaw_steps(): a turn's input is its largest use, else its total; its index counts the turns with requests before it; the limit is the last size told."""
    v = F.col("v")
    read = openclaw_lines(lines).where(F.col("error").isNull())
    always = F.lit(True)
    size = F.coalesce(number_of(v, "$.update.size"), number_of(v, "$.size"))
    named = read.groupBy("session").agg(
        _or_file(_first(F.col("session_id"), always), filename).alias("version"), F.coalesce(_first(text_of(v, "$.cwd"), always), _first(text_of(v, "$.update.cwd"), always)).alias("cwd"), F.max_by(size, F.when(size > 0, F.col("seq"))).cast("long").alias("context_limit")
    )
    facts = turn_facts(turns, steps)
    totals = carried_totals(facts, cum_totals(facts)).withColumn("input", F.when(F.col("max_input") > 0, F.col("max_input")).otherwise(F.col("cum_total")))
    index = F.coalesce(F.sum(F.when(F.col("requests") > 0, 1).otherwise(0)).over(over(S, ["turn_i"]).rowsBetween(-(1 << 31), -1)), F.lit(0))
    best = totals.withColumn("_i", index).groupBy("session").agg(F.max_by(F.struct("_i", "input", "turn_i"), F.when(F.col("input") > 0, F.struct("input", -F.col("turn_i")))).alias("b"))
    peaks = best.select("session", F.col("b._i").cast("long").alias("peak_index"), F.col("b.input").cast("long").alias("peak_tokens"), F.col("b.turn_i").alias("peak_turn"))
    return _joined(named, totals.select("session", "turn_i", F.lit("openclaw").alias("model"), "prompt", "requests", F.col("said_tok").alias("out_tok"), F.lit(None).cast("long").alias("limit")), peaks)


def pi_headers(lines: DataFrame, turns: DataFrame, steps: DataFrame, filename: Column | str = "") -> DataFrame:
    """Of event_turns() or session_turns(): version is the session's id, else the header's version; the fullest turn is the peak and its own index."""
    v, t = F.col("v"), F.col("type")
    read = pi_lines(lines).where(F.col("error").isNull())
    own = F.when((t == "session") & text_of(v, "$.id").isNotNull(), text_of(v, "$.id")).when((t == "header") & F.try_variant_get(v, "$.version", "variant").isNotNull(), F.try_variant_get(v, "$.version", "string"))
    folder = F.coalesce(F.when(t == "header", text_of(v, "$.workingDirectory")), text_of(v, "$.cwd"), text_of(v, "$.workingDirectory"))
    named = read.groupBy("session").agg(_or_file(F.min_by(own, F.when(own.isNotNull(), F.col("seq"))), filename).alias("version"), F.min_by(folder, F.when(folder.isNotNull(), F.col("seq"))).alias("cwd"))
    facts = turn_facts(turns, steps)
    totals = facts.withColumn("cum_total", cum_totals(facts))
    peaks = _peak(totals.select("session", "turn_i", F.lit(0).alias("at"), F.col("cum_total").alias("input"))).withColumn("peak_index", F.col("peak_turn"))
    return _joined(named, totals.select("session", "turn_i", F.lit("pi").alias("model"), "prompt", F.col("steps").alias("requests"), F.col("said_tok").alias("out_tok"), F.lit(None).cast("long").alias("limit")), peaks)


def claude_meta(lines: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """session, model, version, cwd: the first model that an assistant's line of a turn names (its last part between dashes is the version), the first folder that a turn's opening line names; ``unknown`` and empty without.

    ``lines`` are read only where claude_turns() of them aren't at hand, and one aggregate takes all, so that a line is parsed once.
    """
    turns = claude_turns(lines) if turns is None else turns
    found = turns.groupBy("session").agg(
        _first(F.col("model"), (F.col("type") == "assistant") & (F.col("model") != "unknown"), "line_no").alias("model"), _first(F.col("cwd"), F.col("opens"), "line_no").alias("cwd")
    )
    version = F.when(F.col("model").isNull(), "unknown").otherwise(F.regexp_extract("model", "[^-]*$", 0))
    return found.select("session", F.coalesce("model", F.lit("unknown")).alias("model"), version.alias("version"), F.coalesce("cwd", F.lit("")).alias("cwd"))
