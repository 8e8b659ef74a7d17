from __future__ import annotations

import math
import re
import struct
from collections import Counter

import pytest
import xxhash

from rowferry.llm import quality, queries


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= set(range(i, i + 5))
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def base_of(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def brute_ratios(docs, trusted, count, smoothing):
    def grams(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        signed = [x - (1 << 64) if x >> 63 else x for x in h]
        two = [xxhash.xxh64_intdigest(struct.pack("<q", b), xxhash.xxh64_intdigest(struct.pack("<q", a), 42))
               for a, b in zip(signed, signed[1:])]
        return [x % count for x in signed] + [(x - (1 << 64) if x >> 63 else x) % count for x in two]

    raw, target = Counter(), Counter()
    for d, t in docs:
        raw.update(grams(t))
        if d in trusted:
            target.update(grams(t))
    all_raw, all_target = sum(raw.values()) + count, sum(target.values()) + smoothing
    ratio = []
    for b in range(count):
        q = (raw[b] + 1) / all_raw
        ratio.append(math.log((target[b] + smoothing * q) / all_target / q))
    return {(d, t): (sum(ratio[b] for b in g) / len(g) if (g := grams(t)) else None) for d, t in docs}


def test_query_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    trusted = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    wanted = brute_ratios(docs, trusted, 10_000, 10_000.0)
    rows = {r.doc_id: r for r in queries.QUERIES["op2_quality"](spark, sf).collect()}
    assert len(rows) == len(docs)
    for d, t in docs:
        r = rows[d]
        assert base_of(r) == brute_base(t) and r.log_ratio == pytest.approx(wanted[d, t], abs=1e-9)
        assert r.kept == (not r.base_failed and r.log_ratio >= -0.15)


def test_good_documents_are_kept(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op2_quality"](spark, sf).collect() if r.doc_id in labels and not r.base_failed]
    assert all(r.kept for r in rows if labels[r.doc_id] == 1)
    assert sum(not r.kept for r in rows if labels[r.doc_id] == 0) > 0.3 * sum(labels[r.doc_id] == 0 for r in rows)


def test_odd_rows(spark, odd_documents, no_documents):
    trusted = spark.createDataFrame([(5, "x"), (6, "y"), (None, "z"), (5, "x")], "doc_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd_documents.collect()]
    wanted = brute_ratios(docs, {5, 6}, 64, 10.0)
    rows = quality.judged(odd_documents, trusted, bucket_count=64, smoothing=10.0).collect()
    got = sorted((str(r.doc_id), *base_of(r), "-" if r.log_ratio is None else f"{r.log_ratio:.9f}") for r in rows)
    assert got == sorted((str(d), *brute_base(t), "-" if wanted[d, t] is None else f"{wanted[d, t]:.9f}") for d, t in docs)
    assert not any(r.kept for r in rows if r.n_words < 10)
    assert quality.judged(no_documents, trusted).count() == 0
    assert all(r.log_ratio in (None, 0.0) or abs(r.log_ratio) < 1e-12 for r in quality.judged(odd_documents, trusted.limit(0)).collect())
