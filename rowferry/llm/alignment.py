"""Alignment of the tokens of two tokenizers over the bytes of each text.

Both token sequences cover the same bytes. ``pandas.merge_asof`` by document finds, for each token's
start, the token of the other side that covers it; both directions together are all overlaps. Where
tokens of both sides end at one byte, a group of tokens that say the same ends.

How often a pair of ids is linked in the whole corpus is counted on Spark. Texts are worked on in
chunks of a bounded size, each with a dictionary of its distinct pairs, so what is shuffled is one row
per chunk and distinct pair, not one per link, and a common pair comes once per chunk.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from rowferry.llm.common import discard, written
from rowferry.llm.packing import PATTERN

BYTE_TOKENS = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_TOKENS = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters tokenized at a time, and of a chunk.
SLICE, CHUNK = 1 << 19, 8 << 20
#: A blank between letters: tokens of both sides end before it.
CUT = regex.compile(r"(?<=\p{L}) (?=\p{L})")
#: Words and blanks from this length on are left to the tokenizer that takes long ones in linear time.
LONG = 1000
BLANKS = re.compile(rf"\s{{{LONG}}}")


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as its own Latin-1 letter if that prints, and the other
    bytes, in order, as the letters from 256 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in prints]
    return {**{chr(b): b for b in prints}, **{chr(256 + i): b for i, b in enumerate(others)}}


class ByteTokens:
    """A byte-level BPE vocabulary: a text's ids, and the bytes of each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True  # their strings in a text are ordinary text
        letters, vocabulary = byte_letters(), self.exact.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * self.exact.get_vocab_size(with_added_tokens=True)
        for name, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in name)
        self.fast = self._fast(path, vocabulary)

    def _fast(self, path: str, vocabulary: dict[str, int]):
        """The same vocabulary for the faster library, if its ids are in the order of its merges and
        texts are cut into words by the usual pattern; else None."""
        import tiktoken

        with open(path) as lines:
            told = json.load(lines)
        merges = (m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"])
        cut = told["pre_tokenizer"] or {}
        usual = (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) == ("ByteLevel", False, True)
        if not usual or told["normalizer"] or any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        ranks = {self.bytes[i]: i for i in vocabulary.values()}
        return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for t in texts:
            short = len(t) < LONG or max(map(len, t.split()), default=0) < LONG and not BLANKS.search(t)
            out.append(self.fast.encode_ordinary(t) if self.fast and short
                       else self.exact.encode(t, add_special_tokens=False).ids)
        return out


class PieceTokens:
    """A piece vocabulary with byte fallback: a text's ids, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        names = [self.model.id_to_piece(i) for i in ids]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode()
                      for i, n in zip(ids, names)]
        #: whether every piece with a blank has its blanks in front
        self.blanks_lead = not any(re.search("[^▁]▁", n) for n in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(2)
def sides(byte_path: str, piece_path: str) -> tuple[ByteTokens, PieceTokens, list[str]]:
    """Both vocabularies, and the text of each id before a comma and before the end of its part of a group."""
    a, b = ByteTokens(byte_path), PieceTokens(piece_path)
    return a, b, [f"{i}{end}" for side, ends in ((a, ",|"), (b, ",;")) for i in range(len(side.bytes)) for end in ends]


def parts(text: str, size: int) -> Iterator[str]:
    """A text in parts of about ``size`` characters, cut at blanks between letters; the blank that opens
    a part is left out, as encoding puts one there."""
    start = 0
    while len(text) - start > size:
        cut = CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start() + 1
    yield text[start:]


def covering(starts: np.ndarray, docs: np.ndarray, other: np.ndarray, other_docs: np.ndarray) -> np.ndarray:
    """For each token's start, the number of the other side's token that covers it."""
    tokens = pd.DataFrame({"at": starts, "doc": docs})
    others = pd.DataFrame({"at": other, "doc": other_docs, "token": np.arange(len(other))})
    return pd.merge_asof(tokens, others, on="at", by="doc")["token"].to_numpy(np.int64)


class Chunk:
    """Documents' alignments, gathered until they are given out with the dictionary of their pairs."""

    def __init__(self, tokens):
        self.a, self.b, self.names = tokens
        self.size_a = np.array([len(x) for x in self.a.bytes])
        self.size_b = np.array([len(x) for x in self.b.bytes])
        self.clear()

    def clear(self) -> None:
        self.ids, self.void, self.hashes = [], set(), {}
        self.sums = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.docs, self.pairs, self.times = [], [], []

    def open(self, id: str | None) -> int:
        self.ids.append(id)
        return len(self.ids) - 1

    def add(self, held: list[tuple[int, str]]) -> None:
        """Align parts (document, text) of some texts."""
        self.sums = np.vstack([self.sums, np.zeros((len(self.ids) - len(self.sums), 4), np.int64)])
        kept, ids_a, ids_b = [], [], []
        texts = [t for _, t in held]
        for (doc, text), x, y in zip(held, self.a.encode([" " + t for t in texts]), self.b.encode(texts)):
            whole = (" " + text).encode()
            if (b"".join(map(self.a.bytes.__getitem__, x)) != whole
                    or b"".join(map(self.b.bytes.__getitem__, y)) != whole):
                self.void.add(doc)
            else:
                kept.append((doc, len(x), len(y)))
                ids_a += x
                ids_b += y
        if not kept:
            return
        doc, n_a, n_b = np.array(kept).T
        id_a, id_b = np.array(ids_a), np.array(ids_b)
        doc_a, doc_b = np.repeat(doc, n_a), np.repeat(doc, n_b)
        end_a, end_b = np.cumsum(self.size_a[id_a]), np.cumsum(self.size_b[id_b])
        start_a, start_b = end_a - self.size_a[id_a], end_b - self.size_b[id_b]

        over_a = covering(start_a, doc_a, start_b, doc_b)
        over_b = covering(start_b, doc_b, start_a, doc_a)
        alone = start_a[over_b] != start_b  # the others are found from both sides
        link_a = np.concatenate([np.arange(len(id_a)), over_b[alone]])
        link_b = np.concatenate([over_a, np.flatnonzero(alone)])
        link_doc = doc_a[link_a]
        code, seen = pd.factorize(id_a[link_a] << 32 | id_b[link_b])
        at, times = np.unique(link_doc * len(seen) + code, return_counts=True)
        self.docs.append(at // len(seen))
        self.pairs.append(seen[at % len(seen)])
        self.times.append(times)

        at = np.searchsorted(end_b, end_a)
        last_a, last_b = end_b[at] == end_a, np.zeros(len(id_b), bool)
        last_b[at[last_a]] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n = len(self.ids)
        self.sums += np.stack([np.bincount(x, minlength=n) for x in (doc_a, doc_b, doc_a[last_a], link_doc)], axis=1)
        merged = np.empty(len(id_a) + len(id_b), np.int64)  # a group's tokens of A, then those of B
        merged[np.arange(len(id_a)) + np.searchsorted(group_b, group_a)] = 2 * id_a + last_a
        merged[np.arange(len(id_b)) + np.searchsorted(group_a, group_b, "right")] = 2 * (len(self.a.bytes) + id_b) + last_b
        merged = merged.tolist()
        stop = 0
        for d, count in zip(doc.tolist(), (n_a + n_b).tolist()):
            text = "".join(map(self.names.__getitem__, merged[stop:stop + count]))[:-1]
            stop += count
            if d in self.hashes:
                text = ";" + text
            self.hashes.setdefault(d, hashlib.sha256()).update(text.encode())

    def rows(self, number: int) -> Iterator[pd.DataFrame]:
        """The documents of the chunk, then its dictionary; the chunk is empty afterwards."""
        n = len(self.ids)
        if not n:
            return
        docs, pairs, times = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.docs, self.pairs, self.times))
        if self.void:
            void = sorted(self.void)
            self.sums[void] = 0
            fine = ~np.isin(docs, void)
            docs, pairs, times = docs[fine], pairs[fine], times[fine]
        at, known = pd.factorize(pairs, sort=True)
        ends = np.searchsorted(docs, np.arange(n + 1))
        at, times = at.astype("<u4"), times.astype("<i8")
        found = pd.DataFrame({
            "chunk": number, "doc_id": pd.Series(self.ids, dtype=object), **dict(zip(COUNTS, self.sums.T)),
            "groups_sha256": [self.hashes[d].hexdigest() if d in self.hashes and d not in self.void else "" for d in range(n)],
            "at": [at[i:j].tobytes() for i, j in zip(ends, ends[1:])],
            "times": [_narrow(times[i:j]) for i, j in zip(ends, ends[1:])], "pairs": None, "n": None})
        yield found
        totals = np.bincount(at, weights=times, minlength=len(known)).astype("<i8")
        yield pd.DataFrame([(number, None, None, None, None, None, None, None, None, known.astype("<i8").tobytes(),
                             totals.tobytes())], columns=list(found.columns))
        self.clear()


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
CHUNKS = ("chunk long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "at binary, times binary, pairs binary, n binary")


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers in as many bytes each as the greatest needs; the first byte tells how many."""
    width = next(w for w in (1, 2, 4, 8) if not len(numbers) or numbers.max() < 1 << (8 * w - 1))
    return bytes([width]) + numbers.astype(f"<i{width}").tobytes()


def _numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<i{packed[0]}", offset=1).astype(np.int64)


def chunks(docs: DataFrame, id: str, text: str, byte_tokens: str, piece_tokens: str, size: int) -> DataFrame:
    """One row per document (NULL in pairs) and one per chunk (NULL in at); see CHUNKS."""

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = sides(byte_tokens, piece_tokens)
        chunk, number = Chunk(tokens), TaskContext.get().partitionId() << 32
        held, waiting, taken = [], 0, 0
        for batch in batches:
            for name, content in zip(batch["doc_id"], batch["text"]):
                doc = chunk.open(name)
                for part in parts(content, SLICE) if content and tokens[1].blanks_lead else [content] if content else []:
                    held.append((doc, part))
                    waiting += len(part)
                    if waiting >= SLICE:
                        chunk.add(held)
                        taken += waiting
                        held, waiting = [], 0
                if taken + waiting >= size:
                    chunk.add(held)
                    yield from chunk.rows(number)
                    number, held, waiting, taken = number + 1, [], 0, 0
        chunk.add(held)
        yield from chunk.rows(number)

    return docs.select(F.col(id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(align, CHUNKS)


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for chunk, pairs, n in zip(batch["chunk"], batch["pairs"], batch["n"]):
            yield pd.DataFrame({"chunk": chunk, "pair": np.frombuffer(pairs, "<i8"), "n": np.frombuffer(n, "<i8")})


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best) of all linked pairs of ids, the first in the upper 32 bits: in how many links,
    and whether no id is linked to the second more often. An id has at most as many partners as the
    other vocabulary has ids, so no window partition grows with the corpus."""
    counts = entries(aligned).groupBy("pair").agg(F.sum("n").alias("count"))
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(second)))


def entries(aligned: DataFrame) -> DataFrame:
    """(chunk, pair, n): the dictionaries of the chunks."""
    return (aligned.where("pairs is not null").select("chunk", "pairs", "n")
            .mapInPandas(_entries, "chunk long, pair long, n long"))


def _scored(documents: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
    weights = weights.sort_values("pair")  # the dictionary's order
    count, best = weights["count"].to_numpy(np.int64), weights["best"].to_numpy(bool)
    sums = []
    for at, times in zip(documents["at"], documents["times"]):
        at, times = np.frombuffer(at, "<u4"), _numbers(times)
        sums.append((times[best[at]].sum(), times @ count[at]))
    out = documents[["doc_id", *COUNTS, "groups_sha256"]].astype({c: "int64" for c in COUNTS})
    return out.assign(n_best=[int(x) for x, _ in sums], count_sum=[int(x) for _, x in sums])


def aligned(docs: DataFrame, *, id: str = "doc_id", text: str = "text", byte_tokens: str = BYTE_TOKENS,
            piece_tokens: str = PIECE_TOKENS, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A: the byte-level tokens of a blank and the text; B: the pieces of the text. n_links: pairs of
    tokens whose bytes overlap. n_best: links whose pair of ids is, in the corpus, the most frequent
    one of its id of B; count_sum: the corpus counts of all links' pairs, added up. groups_sha256: of the
    ids of all groups, ``a1,a2|b1;a3|b2,b3``.

    Whole texts are taken, long ones in parts that no token crosses; a text without a blank between
    letters is one part, which a task must hold. Texts that are NULL or empty, or whose tokens do not give back their bytes, have no tokens: zeros and ''.
    Repeated rows come back, and count, as often as given; NULL ids stay NULL; an empty table gives no
    rows; other columns are not used. The vocabulary files are read on every executor.
    """
    table = written(chunks(docs, id, text, byte_tokens, piece_tokens, chunk), "alignment", compression="zstd")
    weights = entries(table).select("chunk", "pair").join(pair_counts(table), "pair")
    documents = table.where("pairs is null").drop("pairs", "n")
    out = (documents.groupBy("chunk").cogroup(weights.groupBy("chunk")).applyInPandas(
        _scored, "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, "
                 "count_sum long"))
    found = written(out.select(F.col("doc_id").cast(docs.schema[id].dataType).alias("doc_id"), *COUNTS, "n_best",
                               "count_sum", "groups_sha256"), "aligned")
    discard(table)
    return found
