"""Sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowferry.llm.common import running_sum

#: region -> rack -> shard -> weight, each by its number.
Tree = dict[int, dict[int, dict[int, float]]]


def grid(shards: int, region_racks: int = 4, rack_shards: int = 5) -> Tree:
    """``shards`` equal shards in racks of ``rack_shards`` and regions of ``region_racks`` racks."""
    tree: Tree = {}
    for shard in range(shards):
        rack = shard // rack_shards
        tree.setdefault(rack // region_racks, {}).setdefault(rack, {})[shard] = 1.0
    return tree


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a rack and region of its own. No other subtree changes its
    weight, so rows move into the new shard only."""
    racks = [rack for region in tree.values() for rack in region]
    shards = [shard for region in tree.values() for rack in region.values() for shard in rack]
    return {**tree, max(tree) + 1: {max(racks) + 1: {max(shards) + 1: weight}}}


def _weight(tree: dict | float) -> float:
    return sum(map(_weight, tree.values())) if isinstance(tree, dict) else tree


def _children(children: dict) -> Column:
    return F.array(*[F.struct(F.lit(c).alias("child"), F.lit(float(_weight(t))).alias("weight"))
                     for c, t in children.items()])


def _draw(key: Column, level: str, children: Column, seed: int) -> Column:
    """The child with the least -ln(u) / weight, u being a hash of key and child in (0, 1)."""
    def race(c: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{seed}/{level}"), c["child"]), 11)
        u = (bits.cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / c["weight"]).alias("time"), c["child"].alias("child"))

    return F.array_min(F.transform(children, race))["child"]


def shard_of(key: Column, tree: Tree, seed: int = 42) -> Column:
    """Descend region, rack and shard. A child draws -ln(u) / weight from a hash of the key and its
    own number, so a changed weight moves keys into or out of that child only; below unchanged
    children nothing moves. Every child has a positive weight."""
    racks = F.create_map(*[x for region, below in tree.items() for x in (F.lit(region), _children(below))])
    shards_ = F.create_map(*[x for region in tree.values() for rack, below in region.items()
                             for x in (F.lit(rack), _children(below))])
    region = _draw(key, "region", _children(tree), seed)
    return _draw(key, "shard", shards_[_draw(key, "rack", racks[region], seed)], seed)


def shards(docs: DataFrame, tree: Tree, *, id: str = "doc_id", text: str = "text", overhead: int = 16,
           seed: int = 42) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    law is ``key``: the id and the tree decide the shard. slot counts a shard's rows from 0 without
    a gap, in an order that id, size and checksum decide. grown_shard is the shard after ``grown``.
    A NULL text has no bytes (size ``overhead``, crc32 0). Rows with a NULL id go to one shard.
    Repeated rows keep their own slots; an empty table gives no rows; other columns are not used.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("doc_id"), (F.octet_length(content) + F.lit(overhead).cast("long")).alias("size"),
                       F.crc32(content).alias("text_crc32"), F.lit("key").alias("law"))
    rows = rows.withColumn("shard", shard_of(F.col("doc_id"), tree, seed)).withColumn("one", F.lit(1).cast("long"))
    placed = running_sum(rows, "shard", "one", ["doc_id", "size", "text_crc32"], "slot", docs.count())
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot",
                         shard_of(F.col("doc_id"), grown(tree), seed).alias("grown_shard"))
