from __future__ import annotations

from collections import Counter

import corpus_pipeline
from rowferry.llm import mixing

LENGTH = 3000


def test_words_by_source_hold_to_the_targets(spark):
    """Documents of many blocks: source b is taken at a rate below a half, others at 1.5 and 2."""
    docs = spark.createDataFrame([(1000 * k + i, f"n{i} " + "w " * (LENGTH - 1), name) for k, name in enumerate("abcdefghijkl")
                                  for i in range(240 if name == "b" else 65)], "doc_id long, text string, source string").repartition(8)
    rows = mixing.mixed(docs)[0].collect()
    got = corpus_pipeline.mixed(spark, docs, "").collect()
    words, targets, spread = Counter(), {}, Counter()
    for r in got:
        words[r.source] += LENGTH
    for r in rows:
        part = r.taken % LENGTH / LENGTH
        targets[r.source], spread[r.source] = r.target, spread[r.source] + part * (1 - part)
    assert targets["b"] < 0.45 * 240 * LENGTH
    for name, target in targets.items():
        assert abs(words[name] - target) <= 3 * LENGTH * spread[name] ** 0.5 + 1, name
    copies, taken = Counter(r.doc_id for r in got), {r.doc_id: r.taken for r in rows}
    assert all(taken[d] // LENGTH <= copies[d] <= -(-taken[d] // LENGTH) for d in taken)
    assert Counter(r.doc_id for r in corpus_pipeline.mixed(spark, docs.repartition(3), "").collect()) == copies


def test_repeated_rows_are_rounded_together(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    twice = docs.union(docs)
    taken, size = Counter(), {}
    for r in mixing.mixed(twice)[0].where("size > 0").collect():
        taken[r.doc_id, r.key] += r.taken
        size[r.doc_id, r.key] = r["size"]
    got = sum(-(-n // size[k]) for k, n in taken.items()), sum(n // size[k] for k, n in taken.items())
    assert got[1] <= corpus_pipeline.mixed(spark, twice, sf).count() <= got[0]
