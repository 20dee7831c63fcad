"""What fills a session's context, turn by turn: thirteen categories that add up, are replaced, or outlast a compaction.

A turn's parts (rows of a category, a text and how it counts) become running values per category:

* ``add``: sums since the last compaction;
* ``replace``: the last part's size, from its turn on, kept through compactions;
* ``refill``: the first part takes the seed's place, later ones add to it, kept through compactions;
* ``once``: the first part takes the seed's place, later ones are ignored, kept through compactions.

Categories without parts have their seed.  A compaction is a turn whose largest request falls below half of that of the
last turn with requests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions.content import at, bound, content_text, items
from turnmill.functions.text import half_up, tokens, units
from turnmill.operators.lineage import settled
from turnmill.operators.segments import AGENT_TOOLS
from turnmill.operators.turns import epochs
from turnmill.operators.windows import up_to
from turnmill.sources.transcripts import has_type, text_of

# Characters of the categories that a transcript doesn't show, and what an effort attachment stands for.
SEEDS = {"sysPrompt": 5768, "tool_defs": 98949, "skills": 9122, "memory": 2474, "mcp": 222, "reminders": 409, "userWrapper": 612}
EFFORT = "Ultracode is on: optimize for the most exhaustive, correct answer."
ADDED = ("toolResults", "thinking", "toolCalls", "userMsgs", "asstText", "subagent")
REPLACED = ("skills", "mcp")
FILLED = ("memory", "reminders")
CATEGORIES = (*SEEDS, *ADDED)
KEYS = ["session", "turn_i"]


def calibrated(constants: dict | None) -> dict[str, int]:
    """Seeds with a project's own sizes: ``categories`` of characters, or the three names of the older form.  What is missing or 0 keeps its default."""
    found = dict(SEEDS)
    if not constants:
        return found
    if "categories" in constants:
        chars = lambda name: int((constants["categories"].get(name) or {}).get("chars") or 0)
        own = {"sysPrompt": chars("sysPrompt"), "tool_defs": chars("tool_defs"), "userWrapper": chars("userMsgs"), "memory": chars("memoryGlobal") + chars("memoryProject") or chars("memory")}
    else:
        own = {"sysPrompt": constants.get("SYS_PROMPT_FALLBACK_CHARS"), "tool_defs": constants.get("TOOL_DEFS_FALLBACK_CHARS"), "userWrapper": constants.get("SYSTEM_REMINDER_CHROME_CHARS")}
    return found | {k: n for k, n in own.items() if n}


PART = "struct<pos:int,category:string,how:string,text:string,id:string,name:string>"


def _part(category: Column | str, how: str, text: Column, pos: Column | int = 0, id: Column | None = None, name: Column | None = None) -> Column:
    fields = (pos, category, how, text, id, name)
    return F.struct(*[(f if isinstance(f, Column) else F.lit(f)).alias(n) for f, n in zip(fields, ("pos", "category", "how", "text", "id", "name"), strict=True)]).cast(PART)


def context_parts(turns: DataFrame, estimate: Callable[[Column], Column] = tokens) -> DataFrame:
    """Of claude_turns(): session, turn_i, line_no, pos, category, how, raw (characters), tok.

    A line is opened once, into all its parts, and texts are left behind at once: only sizes move.  Results find the name of the call that
    they answer within their turn; of calls with one id the last counts.
    """
    return _lines_parts(turns, estimate).where("category is not null").drop("used")


def _lines_parts(turns: DataFrame, estimate: Callable[[Column], Column]) -> DataFrame:
    """context_parts() and used, the tokens of the line's request; lines without parts have a row too, that has no category."""
    own = lambda x, name: F.coalesce(text_of(x, f"$.{name}"), F.lit(""))
    content = F.col("content")

    def block(b: Column, i: Column) -> Column:
        kind = text_of(b, "$.type")
        call = F.concat(own(b, "name"), F.when(has_type(b, "$.input", "OBJECT"), F.to_json(F.try_variant_get(b, "$.input", "variant"))).otherwise("{}"))
        return (
            F.when(kind == "thinking", _part("thinking", "add", own(b, "thinking"), i)).when(kind == "text", _part("asstText", "add", own(b, "text"), i))
            .when(kind == "tool_use", _part("toolCalls", "add", call, i, own(b, "id"), own(b, "name")))
        )

    def result(b: Column, i: Column) -> Column:
        answer = bound(at(b, "$.content"), lambda y: content_text(y))
        return F.when(text_of(b, "$.type") == "tool_result", _part("toolResults", "add", answer, i + 1, own(b, "tool_use_id")))

    none = F.array().cast(f"array<{PART}>")
    listed = F.when(has_type(content, "$", "ARRAY"), items(content))
    said = F.when(F.col("opens") | F.col("goes_on"), F.array(_part("userMsgs", "add", bound(content, lambda y: content_text(y))))).otherwise(none)
    results = F.when(~F.col("goes_on"), F.coalesce(F.transform(listed, result), none)).otherwise(none)
    parts = F.when(F.col("type") == "assistant", F.transform(listed, block)).when(F.col("type") == "user", F.concat(said, results)).when(F.col("type") == "attachment", _attached())
    used = F.col("usage.input") + F.col("usage.cache_read")
    rows = turns.select("session", "turn_i", "line_no", used.alias("used"), F.explode_outer(parts).alias("p")).select("session", "turn_i", "line_no", "used", "p.*")
    # An empty text only counts where it replaces.
    counts = (F.col("text") != "") | (F.col("how") == "replace")
    sized = rows.select("session", "turn_i", "line_no", "used", "pos", F.when(counts, F.col("category")).alias("category"), "how", "id", "name", units(F.col("text")).alias("raw"), estimate(F.col("text")).cast("double").alias("tok"))
    name = F.max_by("name", F.when(F.col("name").isNotNull(), F.struct("line_no", "pos"))).over(Window.partitionBy("session", "turn_i", "id"))
    named = sized.withColumn("called", name)
    category = F.when((F.col("category") == "toolResults") & F.col("called").isin(*AGENT_TOOLS), "subagent").otherwise(F.col("category"))
    return named.select("session", "turn_i", "line_no", "pos", category.alias("category"), "how", "raw", "tok", "used")


def _attached() -> Column:
    content, kind = F.col("attachment"), F.col("attachment_type")
    one = lambda x: F.coalesce(text_of(x, "$"), F.concat(F.coalesce(text_of(x, "$.title"), F.lit("")), F.lit("\n"), F.coalesce(text_of(x, "$.description"), F.lit(""))))
    listed = F.when(has_type(content, "$", "ARRAY"), items(content)).when(has_type(content, "$", "VOID"), F.array().cast("array<variant>")).otherwise(F.array(content))
    written = F.filter(F.transform(listed, one), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "") != "")
    added = F.array_join(F.transform(F.try_variant_get(content, "$.addedBlocks", "array<variant>"), lambda x: F.coalesce(text_of(x, "$"), F.to_json(x))), "\n")
    return (
        F.when((kind == "skill_listing") & text_of(content, "$").isNotNull(), F.array(_part("skills", "replace", text_of(content, "$"))))
        .when(kind == "task_reminder", F.transform(written, lambda x, i: _part("reminders", "refill", x, i)))
        .when((kind == "mcp_instructions_delta") & (added != ""), F.array(_part("mcp", "replace", added)))
        .when(kind == "ultra_effort_enter", F.array(_part("reminders", "refill", F.lit(EFFORT))))
    )


def compositions(turns: DataFrame, parts: DataFrame, seeds: dict[str, int] = SEEDS, estimate: Callable[[Column], Column] = tokens) -> DataFrame:
    """session, turn_i and the tokens of each of CATEGORIES after the turn.

    ``turns``: session, turn_i, total (of the largest request; 0 without one), every turn once.  ``parts``: as of context_parts(), in any
    order.  Sums are rounded (half up) where they are told, not before.
    """
    own, filled = _own(parts), _filled(parts.where(F.col("category").isin(*FILLED)), seeds)
    return _running(turns.select(*KEYS, "total").join(own, KEYS, "left").join(filled, KEYS, "left"), seeds, estimate)


def _own(parts: DataFrame, *more: Column, keys: Sequence[Column | str] = KEYS) -> DataFrame:
    """What the parts of a turn (or of other ``keys``) add up to, or replace."""
    sized = parts.withColumn("at", F.struct("line_no", "pos"))
    is_ = lambda c: F.col("category") == c
    return sized.groupBy(*keys).agg(*[F.sum(F.when(is_(c), F.col("tok"))).alias(c) for c in ADDED], *[F.max_by(F.when(is_(c), F.col("tok")), F.when(is_(c), F.col("at"))).alias(f"{c}_new") for c in REPLACED], *more)


def _running(turns: DataFrame, seeds: dict[str, int], estimate: Callable[[Column], Column]) -> DataFrame:
    """compositions() of turns with their total, what their parts add or replace, and what is filled after them."""
    seed = {c: estimate(F.repeat(F.lit(" "), F.lit(n))).cast("double") for c, n in seeds.items()}
    every = epochs(turns)
    by_turn, since = up_to(["session"], ["turn_i"]), up_to(["session", "epoch"], ["turn_i"])

    def kept(c: str) -> Column:
        """The last own value; one of no tokens gives way to the seed at the next compaction."""
        last = F.last(F.when(F.col(f"{c}_new").isNotNull(), F.struct(F.col(f"{c}_new").alias("tok"), F.col("epoch").alias("epoch"))), ignorenulls=True).over(by_turn)
        return F.when(last.isNull() | (last["tok"] <= 0) & (last["epoch"] < F.col("epoch")), seed[c]).otherwise(last["tok"])

    told = {c: seed[c] for c in SEEDS} | {c: kept(c) for c in (*REPLACED, *FILLED)} | {c: F.sum(F.coalesce(F.col(c), F.lit(0.0))).over(since) for c in ADDED}
    return every.select(*KEYS, *[half_up(F.round(told[c], 6)).alias(c) for c in CATEGORIES])


def _filled(parts: DataFrame, seeds: dict[str, int]) -> DataFrame:
    """(session, turn_i, memory_new, reminders_new): tokens after each turn with such parts.

    Whether a part takes the place of what is there depends on the size so far being that of the seed, hence a fold over a session's few
    parts in order, with one size and one sum of tokens as its state.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[tuple, tuple[int, float]] = {}
        session = object()
        for batch in batches:
            out = []
            for s, category, how, raw, tok in zip(batch["session"], batch["category"], batch["how"], batch["raw"], batch["tok"], strict=True):
                if s != session:
                    session, state = s, {}
                have, sum_ = state.get(category, (seeds[category], 0.0))
                if have == seeds[category]:
                    state[category] = (raw, tok)
                elif how == "refill":
                    state[category] = (have + raw, sum_ + tok)
                out.append(state[category][1])
            yield batch[["session", "turn_i", "category"]].assign(after=out)

    kind = dict(parts.dtypes)["session"]
    ordered = parts.select("session", "turn_i", "line_no", "pos", "category", "how", "raw", "tok").repartition("session").sortWithinPartitions("session", "turn_i", "line_no", "pos")
    numbered = ordered.select("session", "turn_i", "category", "how", "raw", "tok")
    folded = numbered.mapInPandas(fold, f"session {kind}, turn_i long, category string, after double")
    # Rows come out in the order in which they were folded, each session's in one partition.
    last = folded.withColumn("_n", F.monotonically_increasing_id())
    return last.groupBy("session", "turn_i").agg(*[F.max_by(F.when(F.col("category") == c, F.col("after")), F.when(F.col("category") == c, F.col("_n"))).alias(f"{c}_new") for c in FILLED])


def claude_composition(turns: DataFrame, seeds: dict[str, int] = SEEDS, estimate: Callable[[Column], Column] = tokens) -> DataFrame:
    """compositions() of claude_turns().

    Lines are parsed once, for totals and parts: one row per turn and one per part that fills are settled, the order of those still to be told.
    """
    parts = _lines_parts(turns, estimate)
    fills = F.when(F.col("category").isin(*FILLED), F.struct("line_no", "pos", "category", "how", "raw", "tok"))
    # Numbers that fall to one row: each part that fills has its own, all others share their turn's.
    told = settled(_own(parts, F.max("used").alias("total"), keys=[*KEYS, fills.alias("fill")]))
    filled = _filled(told.where("fill is not null").select(*KEYS, "fill.*"), seeds)
    summed = told.groupBy(*KEYS).agg(F.coalesce(F.max("total"), F.lit(0)).cast("double").alias("total"), *[F.sum(c).alias(c) for c in ADDED], *[F.max(f"{c}_new").alias(f"{c}_new") for c in REPLACED])
    return _running(summed.join(filled, KEYS, "left"), seeds, estimate)
