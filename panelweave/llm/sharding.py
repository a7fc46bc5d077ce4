"""Shards by a weighted hash tree of regions, racks and shards.

A row descends the tree, at each node into the child with the smallest draw. A shard draws a number
from the row's key and its own name, exponentially distributed with its weight as rate; a rack or
region draws the least of what its shards draw, which is exponential with the sum of their weights, so
each child takes a share in proportion to its weight. A row that a growing subtree gains therefore
descends to the very shard that grew, and one that a shrinking subtree loses comes from the shard that
shrank: whatever the number of shards, one more takes rows into itself and moves no other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.llm.shared import text_of
from panelweave.session import materialize

RACKS_PER_REGION = 2
SHARDS_PER_RACK = 5
#: Rows of a shard that are numbered together.
CELL_ROWS = 5_000


@dataclass(frozen=True)
class Node:
    """A region or rack with children, or a shard (``shard`` is its number) with a weight."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = field(default=1.0)

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def uniform_tree(shards: int, weights: dict[int, float] | None = None) -> Node:
    """``shards`` numbered shards in racks and regions of fixed size, filled one after the other."""
    if shards < 1:
        raise ValueError("at least one shard")
    per_region = RACKS_PER_REGION * SHARDS_PER_RACK
    regions: dict[int, dict[int, list[Node]]] = {}
    for s in range(shards):
        leaf = Node(f"shard{s}", shard=s, own_weight=(weights or {}).get(s, 1.0))
        regions.setdefault(s // per_region, {}).setdefault(s % per_region // SHARDS_PER_RACK, []).append(leaf)
    return Node(
        "root",
        tuple(Node(f"region{r}", tuple(Node(f"region{r}/rack{k}", tuple(leaves)) for k, leaves in racks.items())) for r, racks in regions.items()),
    )


def _draw(key: Column, node: Node) -> Column:
    """A node's draw and the shard that the descent from it ends in.

    A shard's draw comes from 53 bits of the hash of name and key.
    """
    if node.shard is not None:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(node.name), key), 11)
        return F.struct((-F.log((bits + 0.5) / float(1 << 53)) / node.own_weight).alias("draw"), F.lit(node.shard).alias("shard"))
    return F.array_min(F.array(*[_draw(key, c) for c in node.children if c.weight > 0]))


def place(key: Column, tree: Node) -> Column:
    """Shard number for ``key``; null keys all take the same shard. Subtrees without weight take nothing."""
    if tree.weight <= 0:
        raise ValueError(f"{tree.name} has no weight")
    return _draw(key, tree)["shard"]


def shard_documents(docs: DataFrame, tree: Node, grown: Node | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and, with a ``grown`` tree, grown_shard of each row.

    Size is the UTF-8 length of the text plus 16, a null text counting as none. Slots number the rows
    of a shard from 0 without a gap, by cells of about ``CELL_ROWS`` rows and by doc_id inside a cell;
    rows alike in id, size and checksum take neighbouring slots in any order. Rows with a null doc_id
    share one shard, rows that repeat a doc_id share theirs. An empty table gives an empty result;
    other columns are dropped.
    """
    key = F.col(f"`{doc_id}`")
    body = text_of(text).cast("binary")
    placed = docs.select(
        key.alias("doc_id"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        place(key, tree).cast("int").alias("shard"),
        (place(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    placed = materialize(placed, "placed")
    shards = placed.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("shard").alias("shards")).first()
    cells = max(1, -(-shards["n"] // (CELL_ROWS * max(1, shards["shards"]))))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64(F.lit("cell"), "doc_id", "text_crc32", "size"), F.lit(cells)))
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = W.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("place", F.row_number().over(order) - 1)
        .join(starts, ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), "grown_shard")
    )
