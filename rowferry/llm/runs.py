"""Runs: stretches of words that repeat with a period, found by an enhanced suffix array.

For each LCP interval, of depth d, the suffixes of all its children but the largest are tested: is the
suffix d words further on, or back, in the same interval but another child? Then d words stand twice
in a row and the next word differs. Such a square is the last of its run; rotated to the left as far
as words agree, it gives the run's start. All arrays cover many texts at once; no tree nodes are made.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Words searched at a time; a longer text is searched alone.
AT_ONCE = 200_000
LEAST_LENGTH, LEAST_COPIES = 6, 4


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): a sorting permutation, and for each place the number of smaller keys."""
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return order, rank


class SuffixArray:
    """The suffixes of many texts in order, each text's by themselves.

    ``words`` are numbers, equal for equal words; ``ends`` has, for each place, where its text ends. levels[k][i] orders
    the first 2^k words from i on (a text's end counts as a word that occurs once), so common prefixes of any two suffixes of a
    text are found by halving.
    """

    def __init__(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.n, self.words, self.ends = len(words), words, ends
        order, rank = _dense(starts * (int(words.max(initial=0)) + 1) + words)
        self.levels, width = [rank], 1
        while True:
            ordered = rank[order]
            tied = np.zeros(self.n, bool)
            if self.n:
                same = ordered[1:] == ordered[:-1]
                tied[1:] |= same
                tied[:-1] |= same
            if not tied.any():
                break
            some = np.flatnonzero(tied)  # only what is not yet told apart is sorted again
            at = order[some]
            further = at + width
            inside = further < ends[at]
            # a suffix that ends sorts first; two of one text never end at one place
            second = np.where(inside, rank[np.minimum(further, self.n - 1)] + 1, 0)
            key = ordered[some] * (self.n + 2) + second
            turn = np.argsort(key, kind="stable")
            key, at = key[turn], at[turn]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            order[some] = at
            rank = rank.copy()
            rank[at] = np.maximum.accumulate(np.where(new, some, 0))
            width *= 2
            self.levels.append(rank)
        self.order = order
        self.place = rank  # all are told apart now

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Equal words from x and from y on; x and y are in one text each."""
        x, y = x.copy(), y.copy()
        out = np.zeros(len(x), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            inside = np.maximum(x, y) < self.ends[np.minimum(np.minimum(x, y), self.n - 1)]
            same = inside & (rank[np.minimum(x, self.n - 1)] == rank[np.minimum(y, self.n - 1)])
            step = same << k
            x, y, out = x + step, y + step, out + step
        return out


def _nearest_smaller(height: np.ndarray, some: np.ndarray, step: int) -> np.ndarray:
    """For each place in ``some``, the nearest place in direction ``step`` whose height is smaller. All look at
    once and jump along the answers that others have so far; the first and last heights are below all others."""
    found = np.arange(len(height)) + step
    active = some[height[found[some]] >= height[some]]
    while len(active):
        found[active] = found[found[active]]
        active = active[height[found[active]] >= height[active]]
    return found


def squares(suffixes: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares whose next word differs: d equal words twice, at depth-d intervals."""
    n, order, place = suffixes.n, suffixes.order, suffixes.place
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < 2:
        return none
    first = suffixes.levels[0][order]
    near = np.flatnonzero(first[1:] == first[:-1]) + 1  # neighbours that begin with one word
    if not len(near):
        return none
    height = np.zeros(n + 1, np.int64)  # height[k]: common words of the suffixes in places k - 1 and k
    height[near] = suffixes.common(order[near - 1], order[near])
    height[0] = height[n] = -1
    low, high = _nearest_smaller(height, near, -1)[near], _nearest_smaller(height, near, 1)[near]
    # separators of one interval have the same smaller neighbours; children lie between them
    turn = np.lexsort((near, high, low))
    at, low, high = near[turn], low[turn], high[turn]
    opens = np.ones(len(at), bool)
    opens[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    closes = np.append(opens[1:], True)
    left = np.where(opens, low, np.concatenate([[0], at[:-1]]))  # the child in front of each separator
    begin = np.concatenate([left, at[closes]])
    stop = np.concatenate([at, high[closes]])
    depth = np.concatenate([height[at], height[at[closes]]])
    interval = np.concatenate([np.cumsum(opens), np.cumsum(opens)[closes]])
    bottom, top = np.concatenate([low, low[closes]]), np.concatenate([high, high[closes]])
    by_size = np.lexsort((stop - begin, interval))
    largest = by_size[np.append(interval[by_size][1:] != interval[by_size][:-1], True)]
    small = np.ones(len(begin), bool)
    small[largest] = False
    begin, stop, depth, bottom, top = (x[small] for x in (begin, stop, depth, bottom, top))
    count = stop - begin
    child = np.repeat(np.arange(len(begin)), count)
    suffix = order[np.arange(len(child)) - np.repeat(np.cumsum(count) - count, count) + begin[child]]
    d = depth[child]
    starts, periods = [], []
    for other, start in ((suffix + d, suffix), (suffix - d, suffix - d)):
        fits = (other >= 0) & (other < n)
        rank = place[np.clip(other, 0, n - 1)]
        inside = fits & (rank >= bottom[child]) & (rank < top[child])
        inside &= (rank < begin[child]) | (rank >= stop[child])  # in another child: the next words differ
        starts.append(start[inside])
        periods.append(d[inside])
    found = np.unique(np.stack([np.concatenate(starts), np.concatenate(periods)]), axis=1)
    return found[0], found[1]


def repeats(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, stop, period) of all runs of LEAST_COPIES periods and LEAST_LENGTH words or more, by the
    period's smallest value. ``starts`` and ``ends``: of each word's text."""
    suffixes = SuffixArray(words, starts, ends)
    at, d = squares(suffixes)
    # a run of enough copies reaches that far to the left of its last square
    back = at - (LEAST_COPIES - 2) * d
    long = back >= (starts[at] if len(at) else 0)
    at, d, back = at[long], d[long], back[long]
    long = suffixes.common(back, back + d) >= (LEAST_COPIES - 1) * d
    at, d = at[long], d[long]
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, p in sorted(zip(at.tolist(), d.tolist()), key=lambda x: x[1]):
        stop = i + 2 * p
        # squares of several periods end where those of one do, and start in the same run
        if any(p % q == 0 and s <= i for s, q in runs[stop]):
            continue
        runs[stop].append((_rotated(words, i, p, int(starts[i])), p))
    return sorted((s, stop, p) for stop, found in runs.items() for s, p in found if stop - s >= LEAST_LENGTH)


def _rotated(words: np.ndarray, start: int, period: int, first: int) -> int:
    """The square's start moved to the left as long as the word there equals the one a period on."""
    step = 64
    while start > first:
        step = min(2 * step, start - first)
        unequal = np.flatnonzero(words[start - step:start] != words[start - step + period:start + period])
        if len(unequal):
            return start - step + int(unequal[-1]) + 1
        start -= step
    return start


def planted(words: list[bytes], seed: int | None) -> list[bytes]:
    """The words with a repetition put in for one seed in ten, as the seed says; others as they are."""
    n = len(words)
    if not n or seed is None or seed % 10:
        return words
    g = seed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _described(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    listed = sorted((s, stop - s, p) for s, stop, p in runs)
    digest = hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in listed).encode()).hexdigest()
    best, kept = (None,) * 4, words
    if listed:
        s, length, p = listed[0]
        for other in listed[1:]:
            if other[1] * p > length * other[2]:  # exact; of equal ones the first stays
                s, length, p = other
        best = s, length, p, 1000 * length // p
        drop = np.zeros(len(words) + 1, np.int64)
        for s, length, p in listed:
            drop[s + p] += 1
            drop[s + length] -= 1
        kept = [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]
    return len(listed), *best, digest, hashlib.sha256(b" ".join(kept)).hexdigest()


RUN_COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
RUNS = ("doc_id string, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
        "collapsed_sha256 string")


def _found(names: list, texts: list[list[bytes]]) -> pd.DataFrame:
    """The rows of some texts, searched together."""
    sizes = np.array([len(t) for t in texts])
    stops = np.cumsum(sizes)
    words = pd.factorize(np.array([w for t in texts for w in t], object))[0]
    runs: dict[int, list] = defaultdict(list)
    first = stops - sizes
    for s, stop, p in repeats(words, np.repeat(first, sizes), np.repeat(stops, sizes)):
        t = int(np.searchsorted(stops, s, "right"))
        runs[t].append((s - int(first[t]), stop - int(first[t]), p))
    rows = [(name, *_described(t, runs.get(i, []))) for i, (name, t) in enumerate(zip(names, texts))]
    return pd.DataFrame(rows, columns=["doc_id", *RUN_COLUMNS]).astype({c: "Int64" for c in RUN_COLUMNS[:5]})


def word_runs(docs: DataFrame, *, id: str = "doc_id", text: str = "text", seed: Column | None = None) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every row.

    A run is a stretch of words with a smallest period q and max(6, 4 q) words or more that cannot be
    extended with it. start to exponent_milli are of the run with most copies; of equal ones the first,
    then that of the smallest period. runs_sha256 covers all runs; collapsed_sha256 the text without
    the words that a run has after its first q. ``seed`` puts a known repetition into one text in ten
    (``planted``); without it texts are taken as they are.

    Every text is one row, worked on in the task that reads it: nothing is shuffled. A task holds some
    AT_ONCE words at a time, or one longer text with some 100 bytes a word. NULL and empty texts have no words and no run; a
    NULL seed puts nothing in; repeated rows come back as often as given; NULL ids stay NULL; an empty
    table gives no rows; other columns are not used.
    """
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, texts, held = [], [], 0
            for name, content, given in zip(batch["doc_id"], batch["text"], batch["seed"]):
                words = planted((content or "").encode().split(), None if given is None else int(given))
                if held and held + len(words) > AT_ONCE:
                    yield _found(names, texts)
                    names, texts, held = [], [], 0
                names.append(name)
                texts.append(words)
                held += len(words)
            if names:
                yield _found(names, texts)

    rows = docs.select(F.col(id).cast("string").alias("doc_id"), F.col(text).alias("text"),
                       (F.lit(None) if seed is None else seed).cast("string").alias("seed"))
    found = rows.mapInPandas(search, RUNS)
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id].dataType))
