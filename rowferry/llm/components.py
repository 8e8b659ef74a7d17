"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowferry.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b); root is the component's least node.

    Rounds of large-star and small-star steps (Kiveris et al., 2014) until the links no longer
    change. A step is an aggregate that combines before its shuffle and one join on the node, so no
    list of neighbours is ever gathered. Each round is written to the shared folder and replaces the
    one before it; the driver sees a count and a checksum per round. Loops and repeated links are
    allowed; no links give no rows.
    """
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        after = written(_small_star(_large_star(now)), "links")
        reached = _mark(after)
        discard(now)
        now, before, mark = after, mark, reached
        if before == mark:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Link every greater neighbour of a node to the least of the node and its neighbours."""
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link every node and its lesser neighbours to the least of these."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
