"""Sharding by a hierarchical weighted hash tree, with DataFrame functions alone.

A document descends from the root through region and rack to a shard.  At each node every child draws
-ln(u) / weight, u a hash of document and child; the least draw wins.  A child's
draw depends on nothing but itself and its weight, so a change of weight moves rows only between
that child and its siblings: subtrees whose weights stay keep their rows among themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import durable, unit_draw, with_offsets


@dataclass(frozen=True)
class Node:
    """A subtree: a shard number at a leaf, else children.  A subtree weighs what its leaves weigh together."""

    name: str
    shard: int | None = None
    leaf_weight: float = 1.0
    children: tuple["Node", ...] = ()

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.leaf_weight


def tree(n_shards: int, regions: int = 2, racks: int = 3, per_rack: int = 4) -> Node:
    """The layout of regions x racks x per_rack shards of weight 1, whole also where fewer shards are asked for; each shard beyond
    it is a region of its own, so that growth by one shard moves rows into that shard alone."""
    number = lambda r, k, s: (r * racks + k) * per_rack + s
    made = [Node(f"{r}", children=tuple(Node(f"{r}.{k}", children=tuple(Node(f"{r}.{k}.{s}", shard=number(r, k, s)) for s in range(per_rack))) for k in range(racks))) for r in range(regions)]
    made += [Node(f"x{s}", children=(Node(f"x{s}.0", children=(Node(f"x{s}.0.0", shard=s),)),)) for s in range(regions * racks * per_rack, n_shards)]
    return Node("root", children=tuple(made))


def _inner(node: Node) -> list[Node]:
    return [node, *(n for c in node.children for n in _inner(c))] if node.children else []


def _leaves(node: Node) -> list[Node]:
    return [leaf for c in node.children for leaf in _leaves(c)] if node.children else [node]


def descend(key: Column, root: Node, salt: str = "shard") -> Column:
    """The shard that ``key`` reaches from ``root`` over three levels: an expression of hashes, one draw per child on the way."""
    offered = F.create_map(*[x for n in _inner(root) for x in (F.lit(n.name), F.array(*[F.struct(F.lit(c.name).alias("name"), F.lit(float(c.weight)).alias("weight")) for c in n.children]))])
    shards = F.create_map(*[x for leaf in _leaves(root) for x in (F.lit(leaf.name), F.lit(leaf.shard))])
    at = F.lit(root.name)
    for _ in range(3):
        at = F.array_min(F.transform(F.element_at(offered, at), lambda c: F.struct((-F.ln(unit_draw(key, F.concat(F.lit(f"{salt}/"), c["name"]))) / c["weight"]).alias("draw"), c["name"].alias("name"))))["name"]
    return F.element_at(shards, at).cast("int")


def shard_of(key: Column, n_shards: int) -> Column:
    """The shard of ``key`` among ``n_shards``; with one more shard, rows move only into that one, whatever the number.

    A key whose leaf of the layout is not there yet is drawn anew among the shards that are, by the least of their hash draws.  When
    the next shard comes it takes the keys of its leaf, and of the redrawn ones those for which its draw is the least.
    """
    leaf = descend(key, tree(n_shards))
    if n_shards >= len(_leaves(tree(0))):
        return leaf
    draws = F.transform(F.array(*[F.lit(s) for s in range(n_shards)]), lambda s: F.struct(unit_draw(key, F.concat(F.lit("redraw/"), s.cast("string"))).alias("draw"), s.alias("shard")))
    return F.when(leaf < n_shards, leaf).otherwise(F.array_min(draws)["shard"])


def assign_shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``key``: doc_id and the shard count (1 at least) decide.  size: UTF-8 bytes of the text, of any length, plus 8, null text none.
    text_crc32 of a null text is that of no bytes, 0.  slot counts a shard's rows from 0 without gaps; repeated rows get
    slots of their own.  A null doc_id is hashed like any other key.  grown_shard: with one more shard.  Equal draws go to the
    lesser name; other columns are ignored; an empty table gives no rows.
    """
    if n_shards < 1:
        raise ValueError("at least one shard is needed")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A null is not hashed by xxhash64, so such a key is told apart by a flag.
    key = F.struct(F.col("doc_id"), F.col("doc_id").isNull())
    placed = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = placed.select("*", F.lit("key").alias("law"), shard_of(key, n_shards).alias("shard"), shard_of(key, n_shards + 1).alias("grown_shard"))
    # The texts are read once; what follows moves a few numbers per row.
    return with_offsets(durable(placed), "shard", ["doc_id", "size", "text_crc32"], F.lit(1), "slot", buckets).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
