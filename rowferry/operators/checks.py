"""Checks of loaded data: keys, NULLs, counts, checksums and differences."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of a row's canonical text.
NULL_TEXT = "\\N"
FIELD_END = "\x1f"


def key_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that do not identify one row: those that repeat and those with a NULL part."""
    missing = functools.reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    problem = F.when(missing, "NULL_KEY").when(F.col("rows") > 1, "DUPLICATE_KEY")
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
            .select(*keys, "rows", problem.alias("problem")).filter("problem is not null"))


def null_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs per column, all columns in one pass: (column_name, null_rows, total_rows)."""
    counts = df.agg(F.count(F.lit(1)).alias("_all"),
                    *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("null_rows"))
        for i, c in enumerate(columns)])
    return (counts.select(F.explode(pairs).alias("p"), F.col("_all").alias("total_rows"))
            .select("p.column_name", "p.null_rows", "total_rows"))


def recon_counts(source: DataFrame, loaded: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row (source_rows, loaded_rows, rejected_rows, difference, balanced)."""
    total = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    one = source.agg(F.count(F.lit(1)).alias("source_rows"))
    gap = F.col("source_rows") - F.col("loaded_rows") - F.col("rejected_rows")
    return (one.select("source_rows", total(loaded).alias("loaded_rows"), total(rejected).alias("rejected_rows"))
            .select("*", gap.alias("difference"), (gap == 0).alias("balanced")))


def row_text(columns: Sequence[str]) -> Column:
    """All values of a row as one text: each with its length before it, a NULL with a mark that is no
    length. So rows have equal texts only if all their values are equal."""
    return F.concat(F.lit(""), *[F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(FIELD_END),
                                              F.col(c).cast("string")), F.lit(NULL_TEXT)) for c in columns])


def row_hash(text: Column) -> Column:
    """The first 60 bits of the text's MD5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def recon_checksum(df: DataFrame, columns: Sequence[str], bucket: Column | None = None) -> DataFrame:
    """Order-free checksum per bucket: (bucket, rows, checksum). Equal row sets give equal sums."""
    where = (bucket if bucket is not None else F.lit(0)).cast("bigint")
    return (df.select(where.alias("bucket"), row_hash(row_text(columns)).alias("h"))
            .groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.sum(F.col("h").cast("decimal(38,0)")).cast("decimal(38,0)").alias("checksum")))


def compare_checksums(source: DataFrame, target: DataFrame) -> DataFrame:
    """Buckets whose checksums differ, from two ``recon_checksum`` results."""
    s = source.select("bucket", F.col("rows").alias("source_rows"), F.col("checksum").alias("source_checksum"))
    t = target.select("bucket", F.col("rows").alias("target_rows"), F.col("checksum").alias("target_checksum"))
    return s.join(t, "bucket", "full").filter(
        ~F.col("source_checksum").eqNullSafe(F.col("target_checksum")) | ~F.col("source_rows").eqNullSafe(F.col("target_rows")))


def recon_diff(
    source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str],
) -> DataFrame:
    """Keys that are missing, extra or different, with the columns that differ.

    ``columns`` is empty for a key whose rows hold the same values in other combinations.
    Both sides are first reduced to one row per key: its row count, and the sums of the hashes of its
    rows and of their values. A key that repeats is compared as a whole and never pairs its rows.
    """
    keys = list(keys)
    parts = [list(columns), *[[c] for c in columns]]

    def per_key(df: DataFrame, side: str) -> DataFrame:
        sums = []
        for i, part in enumerate(parts):
            low, high = _hash_halves(part)
            sums += [F.sum(low).alias(f"_{side}{i}l"), F.sum(high).alias(f"_{side}{i}h")]
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{side}_rows"), *sums)

    def same(i: int) -> Column:
        return F.col(f"_source{i}l").eqNullSafe(F.col(f"_target{i}l")) & F.col(f"_source{i}h").eqNullSafe(
            F.col(f"_target{i}h"))

    s, t = per_key(source, "source"), per_key(target, "target")
    t = t.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                 *[c for c in t.columns if c not in keys])
    on = functools.reduce(lambda a, b: a & b, [
        F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    unequal = [F.when(~same(i), F.lit(c)) for i, c in enumerate(columns, 1)]
    there, here = F.col("target_rows").isNotNull(), F.col("source_rows").isNotNull()
    status = (F.when(~there, "MISSING").when(~here, "EXTRA")
              .when(~same(0) | (F.col("source_rows") != F.col("target_rows")), "DIFFERENT"))
    return (s.join(t, on, "full")
            .select(*[F.coalesce(F.col(k), F.col(f"_k{i}")).alias(k) for i, k in enumerate(keys)],
                    status.alias("status"),
                    F.coalesce("source_rows", F.lit(0)).alias("source_rows"),
                    F.coalesce("target_rows", F.lit(0)).alias("target_rows"),
                    F.when(here & there, F.concat_ws(",", *unequal)).alias("columns"))
            .filter("status is not null"))


# ---------------------------------------------------------------------------------------------
# Differences by a tree of checksums

#: Levels below the root of a tree, and the children of each node.
LEVELS, FANOUT = 3, 32


def tree_leaf(keys: Sequence[str], levels: int = LEVELS, fanout: int = FANOUT) -> Column:
    """The leaf that a key's rows are under."""
    flags = [x for k in keys for x in (F.col(k).isNull(), F.col(k))]
    return F.pmod(F.xxhash64(*flags), F.lit(fanout ** levels))


def checksum_tree(df: DataFrame, keys: Sequence[str], columns: Sequence[str], levels: int = LEVELS,
                  fanout: int = FANOUT) -> DataFrame:
    """(level, node, rows, low, high): row counts and hash sums of the rows under each node, from the root
    (level 0) to the leaves; nodes without rows are left out.

    One aggregate by leaf, which combines before its shuffle; the levels above add up what is below. The tree has at
    most ``fanout ** levels`` leaves whatever the table holds, so it can be kept with a table and compared later.
    """
    low, high = _hash_halves([*keys, *columns])
    leaves = (df.select(tree_leaf(keys, levels, fanout).alias("leaf"), low.alias("low"), high.alias("high"))
              .groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"), F.sum("low").alias("low"), F.sum("high").alias("high")))
    above = F.array(*[F.struct(F.lit(i).alias("level"), F.call_function("div", F.col("leaf"), F.lit(fanout ** (levels - i)).cast("bigint")).alias("node"))
                      for i in range(levels + 1)])
    return (leaves.select(F.explode(above).alias("at"), "rows", "low", "high").groupBy("at.level", "at.node")
            .agg(*[F.sum(c).alias(c) for c in ("rows", "low", "high")]))


def different_leaves(source: DataFrame, target: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> list[int]:
    """The leaves whose rows differ between two trees: from the root down, only the children of nodes that
    differ are compared. The driver gets the numbers of differing nodes, a level at a time."""
    parents, nodes = None, []
    for level in range(levels + 1):
        def at(tree: DataFrame) -> DataFrame:
            own = tree.filter(F.col("level") == level)  # noqa: B023
            if parents is None:  # noqa: B023
                return own
            return own.filter(F.call_function("div", F.col("node"), F.lit(fanout).cast("bigint")).isin(parents))  # noqa: B023

        sides = [at(tree).select("node", F.struct("rows", "low", "high").alias(name)) for tree, name in ((source, "s"), (target, "t"))]
        unequal = sides[0].join(sides[1], "node", "full").filter(~F.col("s").eqNullSafe(F.col("t")))
        nodes = parents = sorted(r[0] for r in unequal.select("node").collect())
        if not nodes:
            return []
    return nodes


def recon_tree(
    source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str], *, levels: int = LEVELS, fanout: int = FANOUT,
    source_tree: DataFrame | None = None, target_tree: DataFrame | None = None,
) -> DataFrame:
    """``recon_diff`` of only those rows whose leaf of the checksum trees differs; the same result.

    Trees that were kept with their tables spare a side its first scan. Equal tables are told by their roots; with few
    differences few rows are shuffled and compared.
    """
    trees = [tree if tree is not None else checksum_tree(df, keys, columns, levels, fanout).persist()
             for tree, df in ((source_tree, source), (target_tree, target))]
    try:
        leaves = different_leaves(*trees, levels, fanout)
    finally:
        for tree, kept in zip(trees, (source_tree, target_tree)):
            if kept is None:
                tree.unpersist()
    leaf = tree_leaf(keys, levels, fanout)
    return recon_diff(source.filter(leaf.isin(leaves)), target.filter(leaf.isin(leaves)), keys, columns)


def _hash_halves(columns: Sequence[str]) -> tuple[Column, Column]:
    """48 bits of a hash as two numbers of 24, whose sums over 10**11 rows still fit a BIGINT.

    xxhash64 passes over NULLs, so each value is hashed with a flag that tells whether it is one.
    """
    h = F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])
    low = h.bitwiseAND(F.lit(0xFFFFFF))
    return low, F.shiftrightunsigned(h, 24).bitwiseAND(F.lit(0xFFFFFF))


def diff_summary(diff: DataFrame) -> DataFrame:
    """Differences per status."""
    return diff.groupBy("status").agg(F.count(F.lit(1)).alias("keys"))
