"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints that differ in at most t bits differ in at most t // 2 bits of one of their
halves. On each half the anchors are the words of a covering code: the perfect [31, 26] Hamming code
on 31 bits, with the 32nd bit free. Every half word lies within the covering radius R = 1 of an
anchor, so two half words at distance s share the anchor nearest to either one once each is
replicated to every anchor within R + s. For t = 3, s = 1: 17 anchors of 2^27 for nearly every half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rowferry.llm.common import written
from rowferry.llm.components import components

SEED = 42
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Hashes unpacked into bits at a time.
HASHES = 1 << 18
#: Most fingerprints of one anchor that are compared in one go; more are cut into blocks.
BLOCK = 8192


def simhash(text: str | None, width: int) -> int:
    """The signed 64-bit fingerprint of a text's shingles of ``width`` words; 0 without a word."""
    found = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        size = np.fromiter(map(len, found), np.int64, len(found))
        end = np.cumsum(size + 1) - 1
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED)
                  for a, b in zip((end - size).tolist(), end[width - 1:].tolist())]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES):
        part = np.array(hashes[at:at + HASHES], np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, width: int = 3) -> Column:
    """SimHash of a text column. Words are runs of other characters than ASCII white space, A-Z is
    lowered, shingles count as often as they occur, and a text of fewer words is one shingle. NULL
    and texts without a word have fingerprint 0."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, width) for t in texts], dtype="int64")

    return of(text)


def _masks() -> np.ndarray:
    """[syndrome, k]: what to flip in a half word to reach its anchors within distance 2; -1: none."""
    out = np.full((32, 17), -1, np.int64)
    free = 1 << 31
    for s in range(32):
        near = [0 if s == 0 else 1 << (s - 1)]
        pairs = [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if s and i < i ^ s]
        masks = near + [near[0] | free] + pairs
        out[s, :len(masks)] = masks
    return out


MASKS = _masks()


def anchors(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor of both halves of each fingerprint; halves share no anchor."""
    rows, found = [], []
    for half in (0, 1):
        word = (fingerprints >> np.int64(32 * half)) & np.int64(0xFFFFFFFF)
        syndrome = np.zeros(len(word), np.int64)
        for i in range(1, 32):
            syndrome ^= i * ((word >> np.int64(i - 1)) & 1)
        masks = MASKS[syndrome]
        row, k = np.nonzero(masks >= 0)
        rows.append(row)
        found.append((word[row] ^ masks[row, k]) | np.int64(half << 32))
    return np.concatenate(rows), np.concatenate(found)


def forest(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect all members within ``distance`` bits of each other, one less than each
    component has members. A member found is never compared again, so a dense group costs little."""
    links: list[tuple[int, int]] = []
    left = members
    while left.size > 1:
        stack, left = [left[0]], left[1:]
        while stack and left.size:
            last = stack.pop()
            near = np.bitwise_count(left ^ last) <= distance
            if near.any():
                found = left[near].tolist()
                left = left[~near]
                links += zip([int(last), *found], found)
                stack += map(np.int64, found)
    return links


def near_links(fingerprints: DataFrame, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect every two of the distinct ``fingerprint``s within ``distance`` <= 3
    bits, directly or over others that are within it.

    Fingerprints meet at their anchors. An anchor with more than ``block`` of them is cut into blocks
    by a hash, and every two blocks meet in a cell of their own, so no task holds more than two
    blocks of one anchor and no link is lost. A cell gives a spanning forest, not its pairs.
    """
    if not 0 <= distance <= 3:
        raise ValueError("halves of a fingerprint are covered up to a distance of 3 bits")

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 20_000):
                value = batch["fingerprint"].to_numpy(np.int64)[at:at + 20_000]
                row, anchor = anchors(value)
                yield pd.DataFrame({"anchor": anchor, "fingerprint": value[row]})

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch])
            key = batch[["anchor", "cell"]].to_numpy()
            starts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            whole = starts[-1] if len(starts) else 0
            rest = batch.iloc[whole:]
            yield _links(batch.iloc[:whole], distance)
        if rest is not None:
            yield _links(rest, distance)

    replicas = fingerprints.select("fingerprint").mapInPandas(replicate, "anchor long, fingerprint long")
    hot = written(replicas.groupBy("anchor").count().where(F.col("count") > block), "anchors")
    if hot.isEmpty():
        cells = replicas.withColumn("cell", F.lit(0).cast("long"))
    else:
        blocks = F.ceil(F.col("count") / block).cast("long")
        own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks"))
        meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
                            lambda k: F.least(F.col("own"), k) * F.col("blocks") + F.greatest(F.col("own"), k))
        cells = (replicas.join(hot, "anchor", "left")
                 .withColumn("blocks", F.coalesce(blocks, F.lit(1))).withColumn("own", own)
                 .select("anchor", "fingerprint", F.explode(meets).alias("cell")))
    return (cells.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell")
            .mapInPandas(link, "a long, b long"))


def _links(rows: pd.DataFrame, distance: int) -> pd.DataFrame:
    """Links of whole cells, sorted by anchor and cell."""
    anchor, cell = rows["anchor"].to_numpy(), rows["cell"].to_numpy()
    value = rows["fingerprint"].to_numpy(np.int64)
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])) + 1
    bounds = np.concatenate([[0], cut, [len(rows)]])
    sizes = np.diff(bounds)
    links: list[tuple[int, int]] = []
    two = bounds[:-1][sizes == 2]
    two = two[np.bitwise_count(value[two] ^ value[two + 1]) <= distance]
    links += zip(value[two].tolist(), value[two + 1].tolist())
    for at in np.flatnonzero(sizes > 2):
        links += forest(value[bounds[at]:bounds[at + 1]], distance)
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64").drop_duplicates()


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 3,
                    distance: int = 3) -> DataFrame:
    """(doc_id, key, fingerprint, class, component_id) of every row of ``docs``.

    key: a checksum of the text. fingerprint: 16 hex digits. class: the least fingerprint of the group. component_id: the least id that can be reached over fingerprints
    that differ in at most ``distance`` bits. Equal fingerprints are one node from the start, so
    copies cost one row each. NULL and empty texts have fingerprint 0 and are linked like others.
    Repeated rows come back as often as they are given; an empty table gives no rows; other columns
    are not used. NULL ids take part and name no component unless all ids of one are NULL.
    """
    marked = written(docs.select(F.col(id).alias("doc_id"), F.xxhash64(text).alias("key"),
                                 fingerprint(F.col(text), width).alias("fingerprint")),
                     "fingerprints")
    nodes = written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(near_links(nodes, distance)).withColumnRenamed("node", "fingerprint")
    rooted = (nodes.join(roots, "fingerprint", "left")
              .select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("class")))
    named = rooted.groupBy("class").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "class").select("fingerprint", "class", "component_id")
    return (marked.join(classes, "fingerprint")
            .select("doc_id", "key", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "class",
                    "component_id"))
