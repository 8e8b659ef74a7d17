from __future__ import annotations

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rowferry.llm import mixing, queries


def brute_targets(sizes):
    """sizes: source -> words. Reshares until no target is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def check(rows, docs, slack):
    texts = docs.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in rows) == sorted(
        (r.doc_id is None, r.doc_id or 0, size(r.text)) for r in texts)
    sizes = defaultdict(int)
    for r in texts:
        sizes[r.source] += size(r.text)
    targets, taken = brute_targets(sizes), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= slack for s in sizes)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    rows = queries.QUERIES["op8_mix"](spark, sf).withColumn("source", F.lit(None).cast("string")).collect()
    assert len(rows) == len(source)
    again = queries.QUERIES["op8_mix"](spark, sf).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    check(mixing.mixed(docs)[0].collect(), docs, 1)


def test_odd_rows(odd_documents, no_documents):
    documents, parts = mixing.mixed(odd_documents, block=8, shard_slots=16)
    check(documents.collect(), odd_documents, 1)
    documents, parts = mixing.mixed(no_documents)
    assert documents.count() == 0 and parts.count() == 0


def test_slots_are_dealt_once_and_shards_hold_all_sources(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 40)), "abc"[i % 3]) for i in range(600)]
    documents, parts = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=8,
                                    shard_slots=100)
    parts = parts.collect()
    place = defaultdict(set)
    for p in parts:
        place[p.shard, p.slot].add(p.number)
    assert all(len(v) == 1 for v in place.values())
    shards = max(s for s, _ in place) + 1
    assert sorted(place) == [(s, k) for s in range(shards) for k in range(100)][:len(place)]
    assert sum(p.length for p in parts) == sum(r.taken for r in documents.collect())
    counts = defaultdict(lambda: defaultdict(int))
    for (s, _), v in place.items():
        counts[s][min(v)] += 1
    assert all(len(counts[s]) == 3 for s in range(shards - 1)) and len({tuple(sorted(c.items())) for c in counts.values()}) > 1


@pytest.mark.parametrize("count", [1, 2, 3, 17, 64, 1000])
def test_permutations_are_one_to_one(spark, count):
    got = [r[0] for r in spark.range(count).select(mixing.permuted(F.col("id"), F.lit(count).cast("long"), F.lit(9).cast("long"))).collect()]
    assert sorted(got) == list(range(count)) and (count < 64 or got != sorted(got))


def test_targets_reshare_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 300, "z": 0}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_rows_repeated_fifty_thousand_times_are_mixed_like_others(spark):
    rows = [("a", 7, "one two three"), ("b", 8, "four"), ("a", 9, None)]
    docs = spark.createDataFrame(rows, "source string, doc_id long, text string").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") == 8, 100).otherwise(50_000)))).drop("copy")
    documents, _ = mixing.mixed(docs)
    got = {r.doc_id: r for r in documents.groupBy("doc_id").agg(
        F.count("*").alias("rows"), F.sum("taken").alias("taken"), F.max("taken").alias("most"), F.max("target").alias("target")).collect()}
    assert {k: r.rows for k, r in got.items()} == {7: 50_000, 8: 100, 9: 50_000}
    assert got[7].taken == round(got[7].target) and got[8].taken == round(got[8].target) and got[9].taken == 0
    assert got[7].most <= 6 and got[8].most <= 2
