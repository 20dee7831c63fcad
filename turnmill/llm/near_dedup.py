"""Near-duplicate detection by HyperMinHash.

1. A document's word shingles become 160 registers of 16 bits: leading-zero count and mantissa of a bucket's least hash.
   Documents of the same shingle set (same 128-bit digest) are one node from here on.
2. Bands of compressed registers are the buckets of the search.
3. Per bucket, the least member is paired with the others.  Pairs whose collision-corrected estimate
   from the registers is clearly too low go (six standard errors below the threshold); the rest are confirmed on
   the full shingle sets of their texts.
4. Components of the confirmed links; then, in every bucket that still holds several components, all
   pairs across components are estimated and confirmed likewise, those of large buckets in blocks of bounded size.  So every pair that
   shares a bucket is either confirmed, ruled out, or already known to be in one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import durable, forget, ship, without
from turnmill.llm.components import components
from turnmill.llm.shingles import estimate, least_estimate, registers, shingle_set

#: Pairs that one document leads per task; members per block of a bucket; from how many members on a bucket counts as large.
SPREAD, BLOCK, LARGE = 32, 1000, 64


@dataclass(frozen=True)
class Near:
    """Shingle length, least similarity in hundredths, registers and registers per band."""

    words: int = 5
    percent: int = 80
    n_registers: int = 160
    per_band: int = 5

    @property
    def bands(self) -> int:
        return self.n_registers // self.per_band


def sketches(docs: DataFrame, how: Near, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest of the shingle set, registers (null for an empty set)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = shingle_set(text, how.words)
                rows.append((len(found), xxhash.xxh3_128_digest(found.tobytes()), registers(found, how.n_registers).tobytes() if len(found) else None))
            out = pd.DataFrame(rows, columns=["n_shingles", "digest", "registers"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").values)
            yield out

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id bigint, n_shingles bigint, digest binary, registers binary")


def band_rows(sets: DataFrame, how: Near) -> DataFrame:
    """(bucket, band, id): a bucket is a hash of a band's number and of its registers' bytes."""
    width = 2 * how.per_band
    bands = F.transform(F.sequence(F.lit(0), F.lit(how.bands - 1)), lambda b: F.xxhash64(b, F.substring("registers", b * width + 1, F.lit(width))))
    return sets.select(F.col("id"), F.posexplode(bands).alias("band", "bucket"))


def likely(pairs: DataFrame, sets: DataFrame, how: Near) -> DataFrame:
    """Those of the pairs (a, b) whose estimate doesn't rule them out."""

    @F.pandas_udf("boolean")
    def passes(left: pd.Series, right: pd.Series, n_left: pd.Series, n_right: pd.Series) -> pd.Series:
        return pd.Series([not ruled_out(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), m, n, how) for x, y, m, n in zip(left, right, n_left, n_right, strict=True)], dtype=bool)

    own = lambda side: sets.select(F.col("id").alias(side), F.col("registers").alias(f"r{side}"), F.col("n_shingles").alias(f"n{side}"))
    return pairs.join(own("a"), "a").join(own("b"), "b").where(passes("ra", "rb", "na", "nb")).select("a", "b")


def ruled_out(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int, how: Near) -> bool:
    if 100 * min(n_left, n_right) < how.percent * max(n_left, n_right):
        return True
    return estimate(int((left == right).sum()), how.n_registers, n_left, n_right) < least_estimate(how.percent / 100, how.n_registers, min(n_left, n_right))


def confirmed(pairs: DataFrame, docs: DataFrame, how: Near) -> DataFrame:
    """Those of the distinct pairs (a, b) that reach the threshold on their full shingle sets.

    A text goes once to each group of SPREAD pairs that it leads, so neither a document
    with many pairs nor its copies meet in one task.
    """
    many = durable(pairs.groupBy("a").count().where(F.col("count") > SPREAD).select(F.col("a").alias("_a"), F.ceil(F.col("count") / SPREAD).alias("_s")))
    dealt = pairs.join(many, F.col("a") == F.col("_a"), "left").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.coalesce("_s", F.lit(1)))).alias("task"))
    wanted = dealt.select(F.col("a").alias("id"), "task", F.lit(0).alias("side"), F.col("a").alias("lead")).distinct().union(dealt.select(F.col("b").alias("id"), "task", F.lit(1).alias("side"), F.col("a").alias("lead")))
    texts = docs.select(F.col("doc_id").alias("_id"), "text")
    sent = durable(wanted).join(texts, F.col("id") == F.col("_id")).select("task", "lead", "side", "id", "text").repartition("task").sortWithinPartitions("task", "lead", "side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, leads = None, []
        for batch in batches:
            links = []
            for task, lead, side, row, text in zip(batch["task"], batch["lead"], batch["side"], batch["id"], batch["text"], strict=True):
                if (task, lead) != at:
                    at, leads = (task, lead), []
                own = shingle_set(text, how.words)
                if side == 0:
                    leads.append(own)
                elif any(linked(x, own, how) for x in leads):
                    links.append((lead, row))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return sent.mapInPandas(run, "a bigint, b bigint")


def linked(x: np.ndarray, y: np.ndarray, how: Near) -> bool:
    """100 * intersection >= percent * union, of sorted distinct hashes; empty sets link with nothing."""
    if not len(x) or not len(y):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[at] == y).sum())
    return 100 * both >= how.percent * (len(x) + len(y) - both)


def mixed_buckets(crowded: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the rows (bucket, band, id): those with their component's label, and the buckets that hold several components.

    Such a bucket has its size, its most frequent component and a number of blocks.
    """
    named = durable(crowded.join(labels.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("bucket", "band", "id", F.coalesce("component", "id").alias("label")))
    sizes = named.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.sum("n").alias("total"), F.max(F.struct("n", "label"))["label"].alias("main"), F.count("*").alias("k")).where("k > 1")
    return named, durable(mixed.select(F.col("bucket").alias("_bucket"), "main", "total", F.ceil(F.col("total") / BLOCK).cast("long").alias("blocks")))


def dealt_members(named: DataFrame, mixed: DataFrame) -> DataFrame:
    """The members of the ``mixed`` buckets dealt into blocks: bucket, band, id, label, minor, block, probe.

    Members of a bucket's most frequent component only wait to be compared (probe 0); the others also go, as probes, to each block.
    """
    rows = named.join(mixed, F.col("bucket") == F.col("_bucket")).withColumn("minor", F.col("label") != F.col("main"))
    columns = ["bucket", "band", "id", "label", "minor"]
    stays = rows.select(*columns, F.pmod(F.xxhash64("id", "bucket"), "blocks").alias("block"), F.lit(0).alias("probe"))
    return stays.unionByName(rows.where("minor").select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("probe")))


def in_blocks(members: DataFrame, sets: DataFrame, texts: DataFrame | None) -> DataFrame:
    """``dealt_members()`` with their registers, and texts where given, each block in one piece, those that wait first."""
    rows = members.join(sets.select(F.col("id").alias("_id"), "registers", "n_shingles"), F.col("id") == F.col("_id")).drop("_id")
    rows = rows.withColumn("text", F.lit("")) if texts is None else rows.join(texts.select(F.col("doc_id").alias("_id"), "text"), F.col("id") == F.col("_id")).drop("_id")
    return rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "probe")


class Block:
    """Members of one block of a bucket, and which of them a probe may be linked with by its registers."""

    def __init__(self, how: Near):
        self.how, self.held, self.matrix, self.root = how, [], None, {}

    def top(self, x: int) -> int:
        while self.root.setdefault(x, x) != x:
            self.root[x] = x = self.root[self.root[x]]
        return x

    def partners(self, row: int, band: int, label: int, minor: bool, registers_: np.ndarray, n: int) -> Iterator[int]:
        """Places of the members that share this band with the probe and none before it (a pair is looked at in the first band
        that it shares, once), are not of its component, and are not ruled out by the estimate."""
        if self.matrix is None:
            self.matrix = np.stack([h[4] for h in self.held]) if self.held else np.empty((0, self.how.n_registers), np.uint16)
        width, same = self.how.per_band, self.matrix == registers_
        earlier = same[:, : band * width].reshape(len(self.held), band, width).all(axis=2).any(axis=1)
        for i in np.flatnonzero(~earlier & same[:, band * width : (band + 1) * width].all(axis=1)):
            other, its_label, its_minor, m, its_registers, _ = self.held[i]
            if its_label != label and not (its_minor and other > row) and self.top(label) != self.top(its_label) and not ruled_out(registers_, its_registers, n, m, self.how):
                yield i


COLUMNS = ["bucket", "block", "probe", "band", "id", "label", "minor", "registers", "n_shingles", "text"]


def walk(batches: Iterator[pd.DataFrame], how: Near, met, of_text) -> Iterator[list]:
    """Go through blocks as ``in_blocks()`` deals them; ``met(block, row, place of its partner)`` gives what a likely pair adds to the output, or None."""
    at, block = None, Block(how)
    for batch in batches:
        found = []
        for bucket, part, probe, band, row, label, minor, regs, n, text in zip(*(batch[c] for c in COLUMNS), strict=True):
            if (bucket, part) != at:
                at, block = (bucket, part), Block(how)
            own, extra = np.frombuffer(regs, np.uint16), of_text(text)
            if not probe:
                block.held.append((row, label, minor, n, own, extra))
                continue
            for i in block.partners(row, band, label, minor, own, n):
                found += met((bucket, part, band), block, (row, label, minor, extra), i)
        yield found


def across(named: DataFrame, mixed: DataFrame, sets: DataFrame, how: Near) -> DataFrame:
    """Every likely pair (a, b) of different components that share one of the ``mixed`` (small) buckets, once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = lambda _, block, probe, i: [(min(probe[0], block.held[i][0]), max(probe[0], block.held[i][0]))]
        for found in walk(batches, how, pair, lambda text: None):
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return in_blocks(dealt_members(named, mixed), sets, None).mapInPandas(run, "a bigint, b bigint")


def needed(named: DataFrame, mixed: DataFrame, sets: DataFrame, how: Near) -> DataFrame:
    """Of the members of ``mixed`` (large) buckets, dealt into blocks: those that have a likely partner in their block, by registers
    alone.  At most one row for each member and block, however many pairs there are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def both(place, block, probe, i):
            bucket, part, band = place
            row, label, minor, _ = probe
            other, its_label, its_minor, *_ = block.held[i]
            new = [(bucket, band, row, label, minor, part, 1), (bucket, band, other, its_label, its_minor, part, 0)]
            return [x for x in new if x not in told and not told.add(x)]

        told: set = set()
        for found in walk(batches, how, both, lambda text: None):
            if len(told) > 200_000:
                told.clear()
            yield pd.DataFrame(found, columns=["bucket", "band", "id", "label", "minor", "block", "probe"])

    return in_blocks(dealt_members(named, mixed), sets, None).mapInPandas(run, "bucket bigint, band int, id bigint, label bigint, minor boolean, block bigint, probe int").distinct()


def linked_in_blocks(members: DataFrame, sets: DataFrame, texts: DataFrame, how: Near) -> DataFrame:
    """Links (a, b) among ``needed()`` members, confirmed on the spot.  Only those are reported that join two components not yet joined
    within the block: at most one for each component there, however many pairs a large bucket has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def confirm(_, block, probe, i):
            row, label, _, words = probe
            other, its_label, *_, its_words = block.held[i]
            if block.top(label) == block.top(its_label) or not linked(words, its_words, how):
                return []
            block.root[block.top(label)] = block.top(its_label)
            return [(min(row, other), max(row, other))]

        for found in walk(batches, how, confirm, lambda text: shingle_set(text, how.words)):
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return in_blocks(members, sets, texts).mapInPandas(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, how: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable, itself included), kept.

    Documents are linked when their sets of ``how.words``-word shingles (A-Z lower-cased, words split at ASCII white
    space; a shorter text is one shingle) have at least ``how.percent`` hundredths in common; exactly so many are enough.  Texts without words are
    linked with nothing.  Rows of one doc_id are one node; a null doc_id is linked with nothing, has a null component and is kept.
    Texts of any length are read whole; other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = durable(sketches(texts, how))
    sets = durable(cut.where("n_shingles > 0 and doc_id is not null").groupBy("digest", "registers", "n_shingles").agg(F.min("doc_id").alias("id")))
    rows = band_rows(sets, how)
    lead = rows.groupBy("bucket").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1").select(F.col("bucket").alias("_bucket"), "lead")
    crowded = durable(rows.join(durable(lead), F.col("bucket") == F.col("_bucket")).select("bucket", "band", "id", "lead"))
    # Texts are moved once as a whole; from here on only those of candidates are.
    texts = durable(texts.join(crowded.select(F.col("id").alias("_id")).distinct(), F.col("doc_id") == F.col("_id"), "left_semi"))
    stars = durable(crowded.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct())
    links = durable(confirmed(durable(likely(stars, sets, how)), texts, how))
    named, mixed = mixed_buckets(crowded.select("bucket", "band", "id"), components(links))
    more = durable(across(named, mixed.where(F.col("total") <= LARGE), sets, how))
    links = links.union(durable(confirmed(more, texts, how))) if not more.isEmpty() else links
    large = mixed.where(F.col("total") > LARGE)
    if not large.isEmpty():
        # By registers first: only members with a likely partner are sent on, with their texts, to the blocks where they have one.
        links = links.union(durable(linked_in_blocks(durable(needed(named, large, sets, how)), sets, texts, how)))
    # Rows of one doc_id with different texts are the same node: each such row names its own set's least id.
    several = cut.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.count_distinct("digest").alias("k")).where("k > 1").select(F.col("doc_id").alias("_d"))
    own = cut.where("n_shingles > 0 and doc_id is not null")
    repeats = own.join(several, F.col("doc_id") == F.col("_d")).join(sets.select(F.col("digest").alias("_g"), "id"), F.col("digest") == F.col("_g")).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    named = components(links.union(repeats))
    reached = durable(sets.join(named.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select(F.col("digest").alias("_digest"), F.coalesce("component", "id").alias("_component")))
    forget(crowded, texts, stars)
    out = cut.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(reached, F.col("digest") == F.col("_digest"), "left")
    component = F.least(F.coalesce("_component", "doc_id"), "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each group, and all without a doc_id."""
    gone = near_duplicates(docs, how).where("not kept and doc_id is not null").select("doc_id")
    return without(docs, F.col("doc_id").cast("long"), gone)
