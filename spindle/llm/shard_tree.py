"""Sharding by a hierarchical weighted hash tree (operator 12, native).

Shards hang in racks, racks in regions. A row descends the tree: at each level
every child draws from a hash of the row's key and the child's own name, the
draw is ``-ln(u) / weight`` with the weight of the child's subtree, and the
smallest draw wins, so a child gets keys in proportion to its weight. A child's
draw depends on nothing but the key, its name and its weight. Therefore a change
of weights moves keys only at the nodes above the change: into the subtree that
grew (or out of the one that shrank) and inside it; all other subtrees keep their
keys where they are. A shard that is added as a region of its own takes keys only
into itself, which is the law ``key`` of :func:`shards`.

Draws are column expressions over one row; slots are numbered by a range
shuffle of the thin table, so no shard is ever in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import whole_text
from spindle.operators.ordering import row_numbers

SHARDS = 40
REGION, RACK = 20, 5     # shards of a region and of a rack in the even tree
DIGITS = 13              # hex digits of a draw: 52 bits, exact in a double
OVERHEAD = 16            # bytes a row takes besides its text


@dataclass(frozen=True)
class Node:
    """A region, a rack or a shard (``shard`` is its number) with what hangs below it."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def even_tree(shards: int = SHARDS, region: int = REGION, rack: int = RACK) -> Node:
    """Regions of ``region`` shards of weight 1 in racks of ``rack``; the last ones may be smaller."""
    regions = []
    for r in range(0, shards, region):
        racks = []
        for k in range(r, min(r + region, shards), rack):
            leaves = tuple(Node(f"shard{i}", shard=i) for i in range(k, min(k + rack, r + region, shards)))
            racks.append(Node(f"rack{r}.{k}", leaves))
        regions.append(Node(f"region{r}", tuple(racks)))
    return Node("root", tuple(regions))


def grown(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, as a region and a rack of its own: rows move only into it."""
    leaf = Node(f"shard{shard}", shard=shard, own=weight)
    return Node(tree.name, (*tree.children, Node(f"region.of{shard}", (Node(f"rack.of{shard}", (leaf,)),))))


def reweighted(tree: Node, weights: dict[int, float]) -> Node:
    """The tree with other weights of some shards (0 empties one)."""
    if not tree.children:
        return Node(tree.name, (), tree.shard, weights.get(tree.shard, tree.own))
    return Node(tree.name, tuple(reweighted(c, weights) for c in tree.children), tree.shard, tree.own)


def key_text(c: str | Column) -> Column:
    """A null key is a key of its own."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("null"))


def draw(key: Column, node: Node) -> Column:
    """``-ln(u) / weight`` with ``u`` in (0, 1) from the key and the child's name."""
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{node.name}")).cast("binary")), 1, DIGITS), 16, 10).cast("long")
    return -F.log((h + 0.5) / float(16 ** DIGITS)) / F.lit(float(node.weight))


def placed(key: Column, tree: Node) -> Column:
    """The number of the shard at the end of a key's descent; of equal draws the first child's wins.

    Only the children of the nodes on the key's path draw.
    """
    if not tree.children:
        return F.lit(tree.shard)
    open_ = [c for c in tree.children if c.weight > 0]
    if not open_:
        raise ValueError("a tree needs a shard of positive weight")
    if len(open_) == 1:
        return placed(key, open_[0])
    draws = F.array(*[draw(key, c) for c in open_])
    winner = F.get(F.transform(F.array(draws), lambda d: F.array_position(d, F.array_min(d))), F.lit(0))
    # the winner is looked up once; a CASE evaluates no other subtree's draws
    return F.get(F.transform(F.array(winner), lambda w: _chosen(w, [placed(key, c) for c in open_])), F.lit(0))


def _chosen(winner: Column, options: Sequence[Column]) -> Column:
    out = F.lit(None).cast("int")
    for i in reversed(range(len(options))):
        out = F.when(winner == i + 1, options[i]).otherwise(out)
    return out


def shards(df: DataFrame, tree: Node | None = None, more: Node | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the text's UTF-8 bytes (none of a null text) plus 16; ``slot`` counts
    a shard's rows from 0 without gaps, by identifier (nulls first), checksum and
    size; ``grown_shard`` is the shard in the tree ``more`` (default: with one more
    shard). Rows that repeat an identifier share a shard and follow one another
    in it. An empty table gives no rows.
    """
    tree = tree or even_tree()
    more = more or grown(tree, 1 + max(_numbers(tree)))
    text = whole_text(text_col)
    thin = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
                     F.crc32(text.cast("binary")).alias("text_crc32"), key_text(id_col).alias("key"))
    thin = thin.select("doc_id", "size", "text_crc32", placed(F.col("key"), tree).alias("shard"), placed(F.col("key"), more).alias("grown_shard"))
    numbered = row_numbers(thin, ["shard"], [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")], out="slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                           (F.col("slot") - 1).cast("long").alias("slot"), "grown_shard")


def _numbers(tree: Node) -> list[int]:
    return [tree.shard] if not tree.children else [n for c in tree.children for n in _numbers(c)]


def with_shards(df: DataFrame, tree: Node | None = None, id_col: str = "doc_id", out: str = "shard") -> DataFrame:
    """The input's rows and columns and their shard, in one pass and without a shuffle: as
    for a ``partitionBy`` write."""
    return df.withColumn(out, placed(key_text(id_col), tree or even_tree()))
