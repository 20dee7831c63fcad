"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to).  A flow network sends
each pattern's words to the quotas of its sources; the first use of a word costs nothing, each repeat costs one more
than the one before.  The least-cost largest flow says how many words each pattern gives; within a
pattern documents are taken in a seeded order until that many words are reached.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.llm.common import durable, n_words, with_offsets

#: So many patterns at most go to the driver and through the flow.  Where there are more, sources that share no document with
#: another one are solved where they are; an error tells when the rest is still too many.
FLOW_PATTERNS = 20_000


@dataclass
class Flow:
    """A small min-cost flow network: successive cheapest augmenting paths."""

    to: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    cost: list[int] = field(default_factory=list)
    out: dict[int, list[int]] = field(default_factory=dict)

    def arc(self, a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.to))
            self.to.append(y)
            self.left.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, start: int, end: int) -> None:
        while True:
            best, by, waiting = {start: 0}, {}, deque([start])
            while waiting:
                a = waiting.popleft()
                for e in self.out[a]:
                    if self.left[e] > 0 and best[a] + self.cost[e] < best.get(self.to[e], 1 << 60):
                        best[self.to[e]], by[self.to[e]] = best[a] + self.cost[e], e
                        waiting.append(self.to[e])
            if end not in best:
                return
            path, at = [], end
            while at != start:
                path.append(by[at])
                at = self.to[by[at] ^ 1]
            room = min(self.left[e] for e in path)
            for e in path:
                self.left[e] -= room
                self.left[e ^ 1] += room


def route(sizes: dict[tuple, int], quotas: dict, repeats: int) -> dict[tuple, int]:
    """Words that each pattern gives.  ``sizes``: words by pattern, a tuple of sources; ``quotas``: words by source."""
    flow, names = Flow(), {}
    number = lambda x: names.setdefault(x, len(names))
    start, end = number("start"), number("end")
    flow.out |= {start: [], end: []}
    given: dict[tuple, list[int]] = {}
    for p in sorted(sizes, key=repr):
        given[p] = [flow.arc(start, number(("pattern", p)), sizes[p], use) for use in range(repeats)]
        for s in p:
            flow.arc(number(("pattern", p)), number(("source", s)), sizes[p] * repeats, 0)
    for s, quota in quotas.items():
        flow.arc(number(("source", s)), end, round(quota), 0)
    flow.run(start, end)
    return {p: sum(flow.left[e ^ 1] for e in arcs) for p, arcs in given.items()}


def water_level(sources: DataFrame, total: float, most: float) -> float:
    """The level L at which every source gets the lesser of L times its weight and ``most`` times its size, all together ``total``.

    ``sources``: size, weight.  Each round shares anew what the full sources leave; only sums reach the driver.
    """
    level = -1.0
    while True:
        full = F.col("weight") * level > F.col("size") * most
        facts = sources.agg(F.sum(F.when(full, F.col("size") * most).otherwise(0.0)).alias("taken"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if not facts["weight"]:
            return float("inf") if level < 0 else level
        after = (total - facts["taken"]) / facts["weight"]
        if after <= level:
            return level
        level = after


def targets_of(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """A row per source: _source, source_size, target.  Sources weigh ``weights`` in turn by code point, null last; their places are
    counted in ranges of the order, so no task and no driver holds them all."""
    each = sized.select(F.explode("pattern").alias("_source"), "size").groupBy("_source").agg(F.sum("size").alias("source_size"))
    ranged = durable(each.repartitionByRange(F.col("_source").isNull(), "_source").withColumn("_range", F.spark_partition_id()))
    order = [F.col("_source").isNull(), F.col("_source")]
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: a few hundred, whatever the number of sources.
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1).join(starts, F.col("_range") == F.col("_r"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_start") + F.col("_in")) % len(weights) + 1).cast("int"))
    weighed = durable(placed.select("_source", "source_size", weight.alias("weight")))
    total = sized.agg(F.sum("size")).first()[0] or 0
    level = water_level(weighed.select(F.col("source_size").alias("size"), "weight"), share * total, most)
    return weighed.select("_source", "source_size", F.least(F.lit(level) * F.col("weight"), F.col("source_size") * F.lit(float(most))).alias("target"))


def gives_of(patterns: DataFrame, targets: DataFrame, repeats: int) -> DataFrame:
    """How many words each pattern gives: _pattern, _size, _gives.

    Patterns of sources that no document shares with another are networks of one path; where all patterns are too many for one flow, such a
    path's flow is taken as it is, the lesser of quota and capacity, and only the others are collected.
    """
    spark, told = patterns.sparkSession, "_pattern array<string>, _size long, _gives long"
    rest, alone = patterns, None
    if patterns.limit(FLOW_PATTERNS + 1).count() > FLOW_PATTERNS:
        shared = durable(patterns.where(F.size("pattern") > 1).select(F.explode("pattern").alias("_s")).distinct())
        one = F.col("pattern")[0].eqNullSafe(F.col("_s"))
        single = patterns.where(F.size("pattern") == 1)
        rest = durable(patterns.where(F.size("pattern") != 1).unionByName(single.join(shared, one, "left_semi")))
        if (n := rest.limit(FLOW_PATTERNS + 1).count()) > FLOW_PATTERNS:
            raise ValueError(f"more than {FLOW_PATTERNS} membership patterns share sources ({n} and more): merge rare ones, or raise FLOW_PATTERNS")
        alone = single.join(shared, one, "left_anti").join(targets, F.col("pattern")[0].eqNullSafe(F.col("_source")))
        alone = alone.select(F.col("pattern").alias("_pattern"), F.col("size").alias("_size"), F.least(F.round("target").cast("long"), F.col("size") * repeats).alias("_gives"))
    sizes = {tuple(r["pattern"]): r["size"] for r in rest.collect()}
    # Quotas only of sources that these patterns name: as many as the patterns at most times their length.
    wanted = spark.createDataFrame([(s,) for s in {s for p in sizes for s in p}], "_s string")
    quotas = {r["_source"]: r["target"] for r in targets.join(F.broadcast(wanted), F.col("_source").eqNullSafe(F.col("_s")), "left_semi").collect()}
    gives = route(sizes, quotas, repeats)
    plan = spark.createDataFrame([(list(p), sizes[p], gives[p]) for p in sizes], told)
    return plan if alone is None else plan.union(alone)


def mix(docs: DataFrame, members: Column | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, copies.

    ``members``: an array of the sources that a document belongs to; by default the one of ``source_col`` (null is a source of its own, the last).
    Sources weigh ``weights`` in turn, by code point, and share ``share`` times all sizes; a target stops at ``repeats`` times its
    source's size.  A document is taken 0 to ``repeats`` times.  The order is a hash of seed and doc_id, so reruns agree, and
    wholly equal rows are alike.  Texts of any length are counted whole; documents without words are never taken; other columns
    are ignored; an empty table gives no rows.
    """
    own = F.col(source_col)
    sized = docs.select(F.col(id_col).alias("doc_id"), own.cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), (F.array(own.cast("string")) if members is None else F.array_sort(F.array_distinct(members))).alias("pattern"))
    sized = durable(sized)
    targets = durable(targets_of(sized, weights, share, repeats))
    plan = durable(gives_of(sized.groupBy("pattern").agg(F.sum("size").alias("size")), targets, repeats))

    # A text names a pattern in joins and windows: nulls are equal there.  Spark broadcasts plan and targets where they are small.
    name = lambda pattern: F.to_json(F.struct(pattern.alias("pattern")), {"ignoreNullFields": "false"})
    placed = sized.withColumn("key", name(F.col("pattern"))).withColumn("draw", F.xxhash64(F.lit(seed), "doc_id"))
    run = with_offsets(placed, "key", ["draw", "doc_id", "size"], F.col("size"), "start")
    joined = run.join(plan.withColumn("_key", name(F.col("_pattern"))), F.col("key") == F.col("_key"))
    # A document's copy counts when its middle lies within the words that its pattern gives.
    uses = [F.when(F.col("_size") * use + F.col("start") + F.col("size") / 2 <= F.col("_gives"), 1).otherwise(0) for use in range(repeats)]
    copies = F.when(F.col("size") > 0, sum(uses[1:], uses[0])).otherwise(0).cast("int")
    counted = joined.withColumn("copies", copies).join(targets, F.col("source").eqNullSafe(F.col("_source")), "left")
    return counted.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


def take(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken.  Rows of the same doc_id, source and size share one decision."""
    chosen = mix(docs, **how).where("copies > 0").groupBy(*[F.col(c).alias(f"_turnmill_{c}") for c in ("doc_id", "source", "size")]).agg(F.max("copies").alias("_turnmill_copies"))
    on = F.col("doc_id").eqNullSafe(F.col("_turnmill_doc_id")) & F.col("source").eqNullSafe(F.col("_turnmill_source")) & (n_words(F.col("text")) == F.col("_turnmill_size"))
    return docs.join(chosen, on).withColumn("_turnmill_copy", F.explode(F.sequence(F.lit(1), F.col("_turnmill_copies")))).select(*docs.columns)
