"""A small typed knowledge graph: merging candidates and relations, scoring evidence, neighbourhoods and checks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions.text import characters, jaccard
from turnmill.operators.lineage import dealt, settled
from turnmill.operators.windows import first_of

# The most that evidence of a source may weigh; other sources count as the last one.
SOURCE_CAP = {"user": 1.0, "reply": 0.9, "tool_summary": 0.6, "reasoning_summary": 0.45}

#: Rows of a class that are paired at a time, and pairs that a task makes.
CHUNK_ROWS, TASK_PAIRS = 200, 5_000_000


def capped(source: Column, weight: Column) -> Column:
    cap = F.when(source == "user", 1.0).when(source == "reply", 0.9).when(source == "tool_summary", 0.6).otherwise(0.45)
    return F.greatest(F.lit(0.0), F.least(cap, F.when(F.isnan(weight), cap).otherwise(F.coalesce(weight, cap))))


def evidence_score(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score, n, primary, reasoning_only, tool_only: the strongest evidence, plus a bonus for repetition and one for variety."""
    source = F.col("source")
    e = evidence.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("source").alias("kinds"), F.max(capped(source, F.col("weight"))).alias("top"), F.max(source.isin("user", "reply")).alias("primary"), F.min(source == "reasoning_summary").alias("reasoning_only"), F.min(source == "tool_summary").alias("tool_only"))
    bonus = F.least(F.lit(0.16), F.log1p(F.greatest(F.lit(0), F.col("n") - 1)) * 0.06) + F.least(F.lit(0.10), (F.col("kinds") - 1) * 0.04)
    return e.withColumn("score", F.least(F.lit(1.0), F.col("top") + bonus))


def status(given: Column) -> Column:
    """Over evidence_score(): reasoning alone needs confirmation; a user's or reply's word confirms unless it was flagged."""
    return F.when(F.col("reasoning_only"), "needs_confirmation").when(F.col("primary"), F.when(given == "needs_confirmation", given).otherwise("confirmed")).otherwise("inferred")


def confidence(raw: Column, supported: Column) -> Column:
    """Over evidence_score() with turns and shards: 0.25 to 0.95, lower where no user or reply speaks for it."""
    base = F.col("score") * 0.62 + F.least(F.lit(0.18), F.log1p(F.greatest(F.lit(1), F.col("turns"))) * 0.075) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) * 0.12
    c = base * (1 + 0.06 * F.least(F.greatest(F.lit(1), F.col("shards")) - 1, F.lit(3))) * F.when(supported, 1.0).otherwise(0.9)
    most = F.when(F.col("reasoning_only"), 0.55).when(~F.col("primary") & F.col("tool_only"), 0.65).when(~F.col("primary"), 0.60).otherwise(1e9)
    return F.least(F.lit(0.95), F.greatest(F.lit(0.25), F.least(c, most)))


def distinct_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """(s, t, label, directed, ...): one edge per unordered pair of ends, or ordered pair if directed, with label and direction."""
    keyed = edges.withColumn("_a", F.when(F.col("directed"), F.col("s")).otherwise(F.least("s", "t"))).withColumn("_b", F.when(F.col("directed"), F.col("t")).otherwise(F.greatest("s", "t")))
    return first_of(keyed, ["_a", "_b", "label", "directed"], order).drop("_a", "_b")


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among the nodes (column id)."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "s"), "s", "left_semi").join(ids.withColumnRenamed("id", "t"), "t", "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("s", "t")).alias("id")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, degree: ends of edges at a node (a loop counts twice), 0 for nodes without any."""
    ends = edges.select(F.explode(F.array("s", "t")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def merged_candidates(rows: DataFrame) -> DataFrame:
    """One row per id: the first record of highest confidence; turns sorted, distinct and joined.

    Turns are made distinct per id before any id's are gathered, so what is gathered is what is returned.
    """
    best = rows.groupBy("id").agg(F.max_by("label", F.struct("conf", -F.col("seq"))).alias("label"), F.max("conf").alias("conf"), F.min("first_turn").alias("first_turn"))
    turns = rows.select("id", F.explode("turns").alias("turn")).distinct().groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("turn")), ",").alias("turns"))
    return best.join(turns, "id", "left").select("id", "label", "conf", "first_turn", F.coalesce("turns", F.lit("")).alias("turns"))


def merged_relations(edges: DataFrame) -> DataFrame:
    return edges.groupBy("s", "t", "label").agg(F.max("conf").alias("conf"), F.min("first_turn").alias("first_turn"), F.count("*").alias("evidence"))


def neighbours(edges: DataFrame, centre: Column) -> DataFrame:
    """The centre and the nodes one edge away."""
    touching = edges.where((F.col("s") == centre) | (F.col("t") == centre))
    return touching.select(F.explode(F.array("s", "t")).alias("id")).distinct()


def farther(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of ``ids`` and those one edge further away: neighbours() of it are the nodes of two hops."""
    out = edges.join(ids.withColumnRenamed("id", "s"), "s", "left_semi").select(F.col("t").alias("id"))
    back = edges.join(ids.withColumnRenamed("id", "t"), "t", "left_semi").select(F.col("s").alias("id"))
    return ids.union(out.distinct()).union(back.distinct()).distinct()


def merged_graphs(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; where both have a key the new one wins."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def first_range(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each point (id, at) with the first range (range_id, low, high; whole numbers) that holds it, or none.

    The axis is cut into stretches as long as a range is on average, so all ranges together meet about twice as many stretches as there are
    ranges, and a point meets those of its own stretch alone.
    """
    whole = ranges.where("low <= high")
    size = whole.agg(F.ceil(F.avg(F.col("high") - F.col("low") + 1)).cast("long")).first()[0] or 1
    stretch = lambda x: F.floor(F.col(x) / size).cast("long")
    cut = whole.select("range_id", "low", "high", F.explode(F.sequence(stretch("low"), stretch("high"))).alias("_s"))
    met = points.withColumn("_s", stretch("at")).join(cut, "_s").where(F.col("at").between(F.col("low"), F.col("high")))
    found = met.groupBy("id", "at").agg(F.min("range_id").alias("range_id"))
    return points.select("id", "at").distinct().join(found, ["id", "at"], "left")


def alike_within(rows: DataFrame, tenths: int = 7) -> DataFrame:
    """(a, b, similarity), a < b: pairs of rows (id, block, c) of one block whose sets c are more than ``tenths`` tenths alike.

    Such sets share one of their rarest members (of n all but tenths * n / 10), so only rows that do are compared, by the
    first of these that they share.
    """
    rarity = rows.select(F.explode("c").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    members = rows.select("id", F.explode("c").alias("x")).join(rarity, "x").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda m: m["x"]).alias("c"))
    rare = members.withColumn("rare", F.slice("c", F.lit(1), F.size("c") - F.expr(f"{tenths} * size(c) div 10").cast("int"))).join(rows.select("id", "block"), "id")
    each = rare.select("id", "block", "c", "rare", F.explode("rare").alias("x"))
    side = lambda n: each.select("block", "x", F.col("id").alias(n), F.col("c").alias(f"c{n}"), F.col("rare").alias(f"r{n}"))
    met = side("a").join(side("b"), ["block", "x"]).where((F.col("a") < F.col("b")) & (F.get(F.array_intersect("ra", "rb"), F.lit(0)) == F.col("x")))
    return met.withColumn("similarity", jaccard(F.col("ca"), F.col("cb"))).where(F.col("similarity") > tenths / 10).select("a", "b", "similarity")


def alike_classes(rows: DataFrame, tenths: int = 7) -> DataFrame:
    """(id, block, text) -> kind, a, b, similarity: which texts of a block are more than ``tenths`` tenths alike by their characters.

    Equal texts of a block are a class, told by its smallest id.  A ``member`` row per row (b) names its class (a); a ``pair`` row links two classes
    (a < b), so rows of different texts are linked if their classes are, and copies are not expanded.  A row without text or block is a class of its own.
    """
    firsts = rows.where(F.col("block").isNotNull() & F.col("text").isNotNull()).groupBy("block", "text").agg(F.min("id").alias("a"))
    pairs = alike_within(firsts.select(F.col("a").alias("id"), "block", characters(F.col("text")).alias("c")), tenths)
    members = rows.join(firsts, ["block", "text"], "left").select(F.lit("member").alias("kind"), F.coalesce("a", "id").alias("a"), F.col("id").alias("b"), F.when(F.col("a").isNotNull(), 1.0).alias("similarity"))
    return members.unionByName(pairs.select(F.lit("pair").alias("kind"), "a", "b", "similarity"))


def alike_pairs(rows: DataFrame, tenths: int = 7, places: int = 6) -> DataFrame:
    """(id, block, text) -> a, b, similarity (to ``places``), a < b: all pairs of rows of one block whose texts are more than ``tenths`` tenths alike by their characters.

    Texts of a block that have the same characters are a class, and only classes are compared.  Alike classes, and each class with itself, are then
    opened into the pairs of their rows: ids are gathered in chunks of some CHUNK_ROWS, each two chunks meet in a row, and such rows are dealt into
    parts of some TASK_PAIRS pairs.  So a task holds two chunks at a time, however large a class is; the pairs themselves grow with its square.
    """
    kind = F.array_join(F.sort_array(characters(F.col("text"))), "").alias("text")
    known = rows.where(F.col("id").isNotNull() & F.col("block").isNotNull() & F.col("text").isNotNull()).select("id", "block", "text")
    classes = settled(known.groupBy("block", "text").agg(F.count("*").alias("n")).groupBy("block", kind).agg(F.sum("n").alias("n")).withColumn("k", F.ceil(F.col("n") / CHUNK_ROWS)))
    alike = alike_within(classes.select(F.struct("block", "text").alias("id"), "block", characters(F.col("text")).alias("c")), tenths)
    links = alike.select(F.col("a.block").alias("block"), F.col("a.text").alias("ta"), F.col("b.text").alias("tb"), F.round("similarity", places).alias("similarity"))
    links = links.unionByName(classes.select("block", F.col("text").alias("ta"), F.col("text").alias("tb"), F.lit(1.0).alias("similarity")))
    sized = lambda x: classes.select("block", F.col("text").alias(f"t{x}"), F.col("n").alias(f"n{x}"), F.col("k").alias(f"k{x}"))
    links = settled(links.join(sized("a"), ["block", "ta"]).join(sized("b"), ["block", "tb"]))
    pairs, meetings = (n or 0 for n in links.agg(F.sum(F.col("na") * F.col("nb")), F.sum(F.col("ka") * F.col("kb"))).first())

    # One side's chunks are told and dealt before the other's, so that a class of many chunks is not opened by one task.
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1)).alias(k)
    met = dealt(links.select("block", "ta", "tb", "similarity", "kb", each("ka")), "block", "ta", "tb", "ka", rows=meetings)
    met = met.select("block", "ta", "tb", "similarity", "ka", each("kb")).where("ta <> tb or ka <= kb")
    cut = known.select("id", "block", kind).join(classes, ["block", "text"]).groupBy("block", "text", F.pmod(F.xxhash64("id"), "k").alias("k")).agg(F.collect_list("id").alias("ids"))
    side = lambda x: cut.select("block", F.col("text").alias(f"t{x}"), F.col("k").alias(f"k{x}"), F.col("ids").alias(f"i{x}"))
    met = met.join(side("a"), ["block", "ta", "ka"]).join(side("b"), ["block", "tb", "kb"]).repartition(max(1, -(-pairs // TASK_PAIRS)), "block", "ta", "tb", "ka", "kb")
    own = (F.col("ta") == F.col("tb")) & (F.col("ka") == F.col("kb"))
    opened = met.select(own.alias("own"), "similarity", "ib", F.explode("ia").alias("x")).select("own", "similarity", "x", F.explode("ib").alias("y"))
    return opened.where("x < y or (not own and x > y)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def greedy_leaders(rows: DataFrame, tenths: int = 7) -> DataFrame:
    """(session, seq, label) -> with leader: in order of seq a label joins the first leader whose characters are more than ``tenths`` tenths alike, else it leads itself.

    seq is unique within a session.  Leaders are the lexicographically first independent set of the graph of alike labels, found by rounds: a
    label with no earlier alike one that could still lead is a leader, and those alike to it and later are none.  Labels of the same
    characters are one, the first; a label without characters is alike to none.  No session meets in one row or task.
    """
    sets = rows.select("session", F.col("seq").cast("long").alias("seq"), "label", F.array_sort(characters(F.col("label"))).alias("c"))
    firsts = sets.where(F.size("c") > 0).groupBy("session", "c").agg(F.min("seq").alias("first"))
    alike = alike_within(firsts.select(F.struct("session", "first").alias("id"), F.col("session").alias("block"), "c"), tenths)
    pairs = settled(alike.select(F.col("a.session").alias("session"), F.col("a.first").alias("a"), F.col("b.first").alias("b")))
    left, found = pairs, []
    while not left.isEmpty():
        free = left.select("session", "a").distinct().join(left.select("session", F.col("b").alias("a")).distinct(), ["session", "a"], "left_anti")
        follow = settled(left.join(free, ["session", "a"], "left_semi").select("session", "b").distinct())
        found.append(follow)
        open_ = left.join(free, ["session", "a"], "left_anti").join(follow, ["session", "b"], "left_anti")
        left = settled(open_.join(follow.withColumnRenamed("b", "a"), ["session", "a"], "left_anti"))
    if found:
        followers = reduce(DataFrame.unionByName, found)
        leaders = pairs.join(followers.withColumnRenamed("b", "a"), ["session", "a"], "left_anti").groupBy("session", F.col("b").alias("first")).agg(F.min("a").alias("leader"))
    else:
        leaders = pairs.select("session", F.col("b").alias("first"), F.col("a").alias("leader"))
    told = firsts.join(leaders, ["session", "first"], "left").select("session", "c", F.coalesce("leader", "first").alias("leader"))
    return sets.join(told, ["session", "c"], "left").select("session", "seq", "label", F.coalesce("leader", "seq").alias("leader"))


def merged_themes(runs: DataFrame, least: float = 0.5) -> DataFrame:
    """(session, run, theme, first_turn, last_turn) -> session, place (from 0), theme, first_turn, last_turn: neighbouring runs whose themes'
    characters are more than ``least`` alike become one, under the shorter theme (the earlier of two of one length).

    Each comparison is with the theme merged so far, so a session's runs are folded in order; the state is the run that is open.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = lambda text: len(text.encode("utf-16-le"))
        held = None
        for batch in batches:
            out = []
            for session, theme, first, last in zip(batch["session"], batch["theme"], batch["first_turn"], batch["last_turn"], strict=True):
                if held is not None and held[0] == session:
                    a, b = set(held[2]), set(theme)
                    if len(a & b) > least * len(a | b):
                        shorter = held[2] if size(held[2]) <= size(theme) else theme
                        held = (session, held[1], shorter, held[3], last)
                        continue
                if held is not None:
                    out.append(held)
                held = (session, held[1] + 1 if held is not None and held[0] == session else 0, theme, first, last)
            yield pd.DataFrame(out, columns=["session", "place", "theme", "first_turn", "last_turn"])
        if held is not None:
            yield pd.DataFrame([held], columns=["session", "place", "theme", "first_turn", "last_turn"])

    kind = dict(runs.dtypes)["session"]
    ordered = runs.repartition("session").sortWithinPartitions("session", "run").select("session", "theme", "first_turn", "last_turn")
    return ordered.mapInPandas(fold, f"session {kind}, place long, theme string, first_turn long, last_turn long")
