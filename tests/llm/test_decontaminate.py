from __future__ import annotations

import hashlib
import re

import pytest

from rowferry.llm import decontaminate, queries


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i:i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= {x for x in got if x is not None}
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=repr)


def pairs(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def test_query_against_brute_force(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    wanted = brute(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))
    got = rows_of(queries.QUERIES["op7_decontaminate"](spark, sf))
    assert got == wanted and any(r[5] for r in got)


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_ROWS, 0])
def test_odd_rows_and_short_items(spark, odd_documents, no_documents, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)
    items = [(1, "The quick brown fox jumps over the lazy dog near the river bank and more"), (2, "two words"), (3, "ONE"),
             (4, None), (5, ""), (6, "a b a b a b a b a b a b"), (7, "quick! brown; fox"), (7, "lazy dog near the river bank far"),
             (None, "jumps over the lazy"), (8, "großE straße"), (2, "two words"), (9, "ISTANBUL"),
             (10, "word1 tail1 word2 tail2 word3 tail3 word4 tail4 word5 tail5 word6 tail6")]
    items = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, key string")
    docs = pairs(odd_documents, "doc_id", "text")
    assert rows_of(decontaminate.contamination(odd_documents, items)) == brute(docs, pairs(items, "item_id", "text"))
    assert decontaminate.contamination(no_documents, items).count() == 0
    assert rows_of(decontaminate.contamination(odd_documents, items.limit(0))) == brute(docs, [])


def test_shared_runs_at_every_place(spark):
    base = [f"w{i % 9}x{i % 4}" for i in range(60)]
    items = [(i, " ".join(base[i:i + 10 + i % 5])) for i in range(30)]
    docs = [(i, " ".join(["q"] * (i % 7) + base[i:i + 7 + i % 9] + ["z"] * (i % 3) + base[:i])) for i in range(50)]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                                      spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got) == brute(docs, items)


def test_a_text_with_very_many_alignments(spark):
    """One passage thousands of times in a text and in many items, so tens of thousands of alignments."""
    passage = "zero one two three four five six seven eight nine ten eleven".split()
    docs = [(1, " ".join(f"{' '.join(passage)} gap{i}" for i in range(2_000))), (2, "nothing of it here " * 50)]
    items = [(i, " ".join([*passage, f"tail{i}"])) for i in range(40)]
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                                        spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found.collect()}
    assert got == {1: (26_000, 24_000, 40, True), 2: (200, 0, 0, False)}
