"""Shards from a hierarchical weighted hash tree, in DataFrame operations only.

A document descends region, rack and shard. At each level every child draws
``-ln(u) / weight`` with u from a hash of the document's key and the child, and the
smallest draw wins, so a child is taken in proportion to its weight. A change of a
child's weight alters that child's draw alone: rows move into or out of the
subtrees whose weights changed and nowhere else. A shard beyond the base layout
opens a region of its own, so adding one takes rows only into itself.

Law ``key``: the key and the number of shards decide. Defined results: a null key
hashes as the empty string; a null text has no bytes. Repeated rows get slots of
their own; rows with one key share its shard. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless

SHARDS = 40
RACKS, PER_RACK = 2, 4


@dataclass(frozen=True)
class Node:
    """A subtree: a label, its weight, its children or its shard number."""

    name: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int = -1


def tree(shards: int, base: int = SHARDS, racks: int = RACKS, per_rack: int = PER_RACK) -> Node:
    """``base`` shards of weight 1 in regions of ``racks * per_rack``; each later one a
    region of its own."""
    low, regions = min(shards, base), []
    for r, start in enumerate(range(0, low, racks * per_rack)):
        parts = []
        for k, s in enumerate(range(start, min(low, start + racks * per_rack), per_rack)):
            leaves = tuple(Node(f"s{i}", 1.0, shard=i) for i in range(s, min(s + per_rack, start + racks * per_rack, low)))
            parts.append(Node(f"g{r}k{k}", float(len(leaves)), leaves))
        regions.append(Node(f"g{r}", sum(p.weight for p in parts), tuple(parts)))
    for s in range(base, shards):
        leaf = Node(f"s{s}", 1.0, shard=s)
        regions.append(Node(f"g+{s}", 1.0, (Node(f"g+{s}k0", 1.0, (leaf,)),)))
    return Node("", float(shards), tuple(regions))


def draw(key: Column, name: Column, weight: Column) -> Column:
    """-ln(u) / weight, u in (0, 1) from the upper 52 bits of XXH64; no weight never wins."""
    bits = F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit("|"), name)), 12)
    u = (bits.cast("double") + 0.5) / float(1 << 52)
    return F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))


def _pick(df: DataFrame, key: str, above: list[tuple[str, int]], table: list[float], most: int, out: str) -> DataFrame:
    """Choose a child at one level. ``above``: the columns chosen so far with the
    number of places each has; ``table``: the weights of all nodes of this level,
    ``most`` places below each parent; an absent child weighs nothing."""
    parent, name = F.lit(0), F.lit("t")
    for column, places in above:
        parent = parent * places + F.col(column)
        name = F.concat(name, F.lit("."), F.col(column).cast("string"))
    weights = F.array(*(F.lit(w) for w in table))
    draws = [
        F.struct(draw(F.col(key), F.concat(name, F.lit(f".{i}")), F.element_at(weights, parent * most + i + 1)).alias("d"), F.lit(i).alias("i"))
        for i in range(most)
    ]
    return df.withColumn(out, (F.least(*draws) if most > 1 else draws[0])["i"])


def _levels(df: DataFrame, key: str, root: Node, out: str) -> DataFrame:
    """Descend region, rack and shard; the draws of a level are computed for the chosen
    parent alone."""
    regions = root.children
    racks = max(len(g.children) for g in regions)
    leaves = max(len(k.children) for g in regions for k in g.children)
    of_rack = [g.children[k].weight if k < len(g.children) else 0.0 for g in regions for k in range(racks)]
    nodes = [g.children[k] if k < len(g.children) else Node("", 0.0) for g in regions for k in range(racks)]
    of_leaf = [k.children[i].weight if i < len(k.children) else 0.0 for k in nodes for i in range(leaves)]
    number = [k.children[i].shard if i < len(k.children) else -1 for k in nodes for i in range(leaves)]
    df = _pick(df, key, [], [g.weight for g in regions], len(regions), "_region")
    df = _pick(df, key, [("_region", len(regions))], of_rack, racks, "_rack")
    df = _pick(df, key, [("_region", len(regions)), ("_rack", racks)], of_leaf, leaves, "_leaf")
    place = (F.col("_region") * racks + F.col("_rack")) * leaves + F.col("_leaf") + 1
    return df.withColumn(out, F.element_at(F.array(*(F.lit(n) for n in number)), place)).drop("_region", "_rack", "_leaf")


def assign_shards(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", out: str = "shard", base: int = SHARDS) -> DataFrame:
    """``docs`` with an int column ``out`` from 0 to ``shards - 1``."""
    keyed = docs.withColumn("_shard_key", F.coalesce(F.col(key).cast("string"), F.lit("")))
    return _levels(keyed, "_shard_key", tree(shards, base), out).drop("_shard_key")


def shard_table(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    placed = assign_shards(assign_shards(slim, shards, "doc_id"), shards + 1, "doc_id", "grown_shard")
    slotted = gapless(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot", docs.select(key).count() // shards + 1)
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
