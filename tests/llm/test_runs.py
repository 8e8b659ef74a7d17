from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from rowferry.llm import queries, runs


def brute_runs(words):
    """For each period, the maximal stretches with it; those a smaller period also has are left out."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = j
    return sorted((s, stop - s, p) for (s, stop), p in found.items())


def brute_row(doc, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if plant and doc is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    listed = brute_runs(words)
    best = min(listed, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, p in listed for i in range(s + p, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(listed), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join("%d,%d,%d\n" % r for r in listed)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def rows_of(df):
    return Counter(tuple(r[c] for c in ["doc_id", *runs.RUN_COLUMNS]) for r in df.collect())


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = rows_of(queries.QUERIES["op12_runs"](spark, sf))
    assert got == Counter(brute_row(*r) for r in docs)
    assert sum(r[1] > 0 for r in got) >= 5


def test_odd_rows(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    short = [r for r in rows if r[1] is None or len(r[1]) < 100_000]
    got = rows_of(runs.word_runs(odd_documents.where("text is null or length(text) < 100000")))
    assert got == Counter(brute_row(*r, plant=False) for r in short)
    assert runs.word_runs(odd_documents, seed=None).count() == len(rows)
    assert runs.word_runs(no_documents).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_random_words_in_texts_searched_together(letters):
    rng = random.Random(letters)
    texts = []
    for _ in range(60):
        text = [rng.randrange(letters) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            part = [rng.randrange(letters) for _ in range(rng.randrange(1, 9))]
            text += part * rng.randrange(2, 7) + part[:rng.randrange(len(part))] + [rng.randrange(letters)]
        texts.append(text)
    sizes = np.array([len(t) for t in texts])
    stops = np.cumsum(sizes)
    words = np.array([w for t in texts for w in t])
    got = runs.repeats(words, np.repeat(stops - sizes, sizes), np.repeat(stops, sizes))
    expected = [(int(first) + s, int(first) + s + length, p) for t, first in zip(texts, stops - sizes)
                for s, length, p in brute_runs(t)]
    assert got == sorted(expected) and len(got) > 20


def test_long_repetitions_end():
    """One word 60,000 times, a long period, and a stretch that is its own run inside a longer one."""
    one = np.zeros(60_000, np.int64)
    assert runs.repeats(one, one, one + 60_000) == [(0, 60_000, 1)]
    cycle = np.tile(np.arange(10_000), 5)
    assert runs.repeats(cycle, cycle * 0, cycle * 0 + 50_000) == [(0, 50_000, 10_000)]
    nested = np.tile(np.array([7, 7, 7, 7, 7, 7, 1]), 6)
    got = runs.repeats(nested, nested * 0, nested * 0 + 42)
    assert got == sorted([(0, 42, 7), *((7 * i, 7 * i + 6, 1) for i in range(6))])


def test_suffix_array_and_common_words():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 3, n) for n in (0, 1, 5, 40, 41)]
    sizes = np.array([len(t) for t in texts])
    stops = np.cumsum(sizes)
    words, starts, ends = np.concatenate(texts), np.repeat(stops - sizes, sizes), np.repeat(stops, sizes)
    suffixes = runs.SuffixArray(words, starts, ends)
    key = lambda i: (starts[i], words[i:ends[i]].tolist())
    assert suffixes.order.tolist() == sorted(range(len(words)), key=key)
    x, y = np.array([(i, j) for i in range(len(words)) for j in range(len(words)) if i != j and starts[i] == starts[j]]).T
    brute = [next((k for k in range(50) if max(i, j) + k >= ends[i] or words[i + k] != words[j + k])) for i, j in zip(x, y)]
    assert suffixes.common(x, y).tolist() == brute


def test_planted_words():
    words = [str(i).encode() for i in range(10)]
    assert runs.planted(words, 31) == words and runs.planted([], 30) == [] and runs.planted(words, None) == words
    assert runs.planted(words, 30) == [b"0", b"1", b"2", b"3", b"4", b"3", b"4", b"3", b"4", b"3"][:3] + [
        words[3 + i % (1 + 7 // 6)] for i in range(7)]
