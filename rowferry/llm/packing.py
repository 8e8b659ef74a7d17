"""Token ids in packed sequences of one length."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary cuts a text into words, and the free id that ends a document.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
#: Packed rows that a task hands over at once.
ROWS_PER_FRAME = 512


@lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Capacities:
    """How many open rows have each number of free places, in a segment tree of sums."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, free: int, change: int) -> None:
        node = self.leaves + free
        while node:
            self.count[node] += change
            node //= 2

    def tightest(self, need: int) -> int | None:
        """The least number of free places that is at least ``need``, among open rows."""
        node = self.leaves + need
        if self.count[node]:
            return need
        while node > 1 and (node % 2 or not self.count[node + 1]):
            node //= 2
        if node <= 1:
            return None
        node += 1
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of item numbers: the longest first, each into the open row with the least room for it."""
    rows: list[list[int]] = []
    open_rows: list[list[int]] = [[] for _ in range(capacity + 1)]
    tree = Capacities(capacity)
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        free = tree.tightest(lengths[item])
        if free is None:
            free = capacity
            open_rows[free].append(len(rows))
            rows.append([])
            tree.add(free, 1)
        row = open_rows[free].pop()
        tree.add(free, -1)
        rows[row].append(item)
        rest = free - lengths[item]
        if rest:
            open_rows[rest].append(row)
            tree.add(rest, 1)
    return rows


def sequences(pieces: list[tuple[str | None, int, np.ndarray]], shard: int, length: int) -> Iterator[pd.DataFrame]:
    """The packed rows of one shard, in frames of a bounded number of rows. pieces: (document, part, ids)."""
    packs = best_fit_decreasing([len(ids) for _, _, ids in pieces], length)
    for first in range(0, len(packs), ROWS_PER_FRAME):
        out = []
        for number, items in enumerate(packs[first:first + ROWS_PER_FRAME], first):
            docs, parts, ids = zip(*[pieces[i] for i in items])
            sizes = [len(x) for x in ids]
            pad = length - sum(sizes)
            row = np.concatenate([*ids, np.full(pad, END, "<u2")])
            position = np.concatenate([np.arange(n, dtype="<u2") for n in [*sizes, pad]])
            out.append((shard, number, list(docs), list(parts), [0, *np.cumsum(sizes).tolist()], row.tobytes(), position.tobytes()))
        yield pd.DataFrame(out, columns=["shard", "row", "doc_ids", "parts", "cu_seqlens", "ids", "position_ids"])


def packed(docs: DataFrame, *, id: str = "doc_id", text: str = "text", length: int = 2048, vocabulary: str = VOCABULARY,
           shard_bytes: int = 16 << 20) -> DataFrame:
    """(shard, row, doc_ids, parts, cu_seqlens, ids, position_ids): one row for each packed sequence.

    ids: ``length`` 16-bit little-endian token ids, the end id filling up; all rows of a shard are its
    id matrix. cu_seqlens: 0 and the end of each segment. position_ids: 16-bit numbers that start at 0
    with each segment. doc_ids, parts: the document of each segment, and which part of it, from 0.
    Texts longer than a row are cut every ``length`` ids and lose nothing; all parts of all documents
    are in the result once.

    Every task packs the documents it reads as they come, without a shuffle: as soon as it holds
    ``shard_bytes`` of ids they are packed by best fit decreasing, as a shard of their own. So a task holds
    one shard, however many rows its partition has and however often one repeats. A shard's number has its task's
    above the lowest 32 bits. Documents that lie together are packed together; order them otherwise before, if
    that matters, and ``repartition`` a table of few large partitions.

    NULL texts have no tokens and no segment; empty ones have the end id alone. Repeated rows are
    packed as often as given; NULL ids stay NULL; an empty table gives no rows; other columns are not
    used.
    """
    if not 1 <= length <= 1 << 16:
        raise ValueError("position ids have 16 bits")
    rows = docs.select(F.col(id).cast("string").alias("doc_id"), F.col(text).alias("text")).where("text is not null")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(vocabulary).encode_ordinary
        shard = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            for key, content in zip(batch["doc_id"], batch["text"]):
                ids = np.array([*encode(content), END], "<u2")
                for part, at in enumerate(range(0, len(ids), length)):
                    held.append((key, part, ids[at:at + length]))
                    size += held[-1][2].nbytes
                    if size >= shard_bytes:
                        yield from sequences(held, shard, length)
                        held, size, shard = [], 0, shard + 1
        if held:
            yield from sequences(held, shard, length)

    schema = ("shard long, row int, doc_ids array<string>, parts array<int>, cu_seqlens array<int>, ids binary, "
              "position_ids binary")
    return (rows.mapInPandas(pack, schema)
            .withColumn("doc_ids", F.col("doc_ids").cast(f"array<{docs.schema[id].dataType.simpleString()}>")))


def write_packed(sequences: DataFrame, path: str) -> None:
    """Packed sequences as Parquet files whose binary columns are the matrices' rows."""
    sequences.write.parquet(path)
