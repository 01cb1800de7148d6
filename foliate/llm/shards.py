"""Sharding by a tree of weighted hash draws. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless, text_of


@dataclass(frozen=True)
class Node:
    """A region, a rack or (without children) a shard. The name decides its draws, the weight its share."""

    name: str
    own: float = 1.0
    children: tuple[Node, ...] = field(default=())

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def tree(regions: int, racks: int, shards: int) -> Node:
    """A tree of equal shards, numbered from 0 in its names."""
    number = iter(range(regions * racks * shards))
    return Node("root", children=tuple(Node(f"r{i}", children=tuple(Node(f"r{i}k{j}", children=tuple(Node(f"s{next(number)}") for _ in range(shards))) for j in range(racks))) for i in range(regions)))


def grown(root: Node, name: str, weight: float = 1.0) -> Node:
    """One more shard, in a region and a rack of its own: no other subtree's weight changes.

    So rows move only into the new shard. A shard put into a rack that exists would confine movement to that rack's
    subtree, but let what comes in land on the rack's other shards as well.
    """
    return Node(root.name, children=(*root.children, Node(f"region-{name}", children=(Node(f"rack-{name}", children=(Node(name, weight),)),))))


def draw(key: Column, node: Node) -> Column:
    """A child's draw for a row: exponential with the child's weight as its rate, and so the least one wins with a
    chance in proportion to the weight; a child's change leaves all other draws as they were."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(node.name), key), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return -F.log(uniform) / F.lit(float(node.weight))


def choose(key: Column, root: Node) -> Column:
    """The name of the leaf reached from the root; below each level, only the chosen child's draws are made."""
    children = [c for c in root.children if c.weight > 0]
    if not root.children:
        return F.lit(root.name)
    if not children:
        raise ValueError(f"{root.name} has no weight")
    if len(children) == 1:
        return choose(key, children[0])
    # `transform` over one element binds the winner, so that it is found once and not once for each branch
    won = F.array_min(F.array(*[F.struct(draw(key, c).alias("score"), F.lit(i).alias("child")) for i, c in enumerate(children)]))

    def branch(w: Column) -> Column:
        out = F.when(w["child"] == 0, choose(key, children[0]))
        for i, c in enumerate(children[1:], 1):
            out = out.when(w["child"] == i, choose(key, c))
        return out

    return F.get(F.transform(F.array(won), branch), F.lit(0))


def shard(docs: DataFrame, key: str, root: Node) -> Column:
    """The leaf's name by the key's text; a null key counts as the empty text."""
    return choose(F.coalesce(F.col(key).cast("string"), F.lit("")), root)


def shard_documents(docs: DataFrame, regions: int = 4, racks: int = 3, shards: int = 2) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard by the law `key`.

    A null text has size 8 and the check sum of the empty text; null ids share one shard; repeated rows get a slot
    each; a text of any length is measured whole; of children with equal draws the first wins; extra columns are left
    out; an empty table gives no rows. Texts never move: sizes and check sums are taken
    in the scan, and only these are exchanged for the slots.
    """
    now = tree(regions, racks, shards)
    more = grown(now, f"s{regions * racks * shards}")
    number = lambda c: F.substring(c, 2, 9).cast("int")
    octets = text_of().cast("binary")
    rows = docs.select(
        F.col("doc_id"), (F.octet_length(octets).cast("long") + 8).alias("size"), F.crc32(octets).alias("text_crc32"), F.lit("key").alias("law"),
        number(shard(docs, "doc_id", now)).alias("shard"), number(shard(docs, "doc_id", more)).alias("grown_shard"),
    )
    return gapless(rows, ["shard"], ["doc_id", "size", "text_crc32"], "slot", chunks=256).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
