"""The pipeline has no SQL; every stage is held against a brute-force version on its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import xxhash
from rowferry.llm import language, mixing, queries
from test_decontaminate import brute as brute_contamination
from test_sharding import brute_shard, sharding
from test_simhash import brute_components, brute_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return [tuple(r) for r in df.select(COLUMNS).collect()]


def brute_kept(rows):
    """Of each group, linked by comparing all pairs of fingerprints, the least row. rows: (rank, text); rank is unique."""
    prints = [brute_fingerprint(text) for _, text in rows]
    numbered = [(i, prints[i]) for i in sorted(range(len(rows)), key=lambda i: rows[i][0])]
    place = {i: at for at, (i, _) in enumerate(numbered)}
    least = brute_components([(place[i], f) for i, f in numbered])
    return [rows[numbered[at][0]] for at, _, first in least if at == first]


def check_near_copies(before, after):
    """Of each group the row of the least id is left."""
    assert sorted(after) == sorted(row for row, _ in brute_kept([(r, r[1]) for r in before])) and len(after) < len(before)


def xxhash64_of(text):
    """Spark's checksum of a text, signed; the seed for NULL."""
    drawn = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), seed=42)
    return drawn - (drawn >> 63 << 64)


def brute_copies(row):
    """A mixed document's part that is no whole copy is rounded up by a keyed hash of id and text."""
    drawn = 42
    for part in (b"copies", row.doc_id.to_bytes(8, "little", signed=True), row.key.to_bytes(8, "little", signed=True)):
        drawn = xxhash.xxh64_intdigest(part, seed=drawn)
    drawn -= (drawn >> 63) << 64
    return row.taken // row["size"] + (drawn % row["size"] < row.taken % row["size"])


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    kept = [rows_of(docs)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "benchmarks", "mix", "shards"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        assert docs.columns == COLUMNS
        kept.append(rows_of(docs))
    all_rows, known, single, clean, mix = kept
    assert set(known) <= set(all_rows)
    assert all(any(map(str.isalpha, r[1])) for r in known)
    dropped = set(all_rows) - set(known)
    assert len(dropped) < 0.02 * len(all_rows)
    check_near_copies(known, single)
    hit = {r[0] for r in brute_contamination([(r[0], r[1]) for r in single], items) if r[5]}
    assert sorted(clean) == sorted(r for r in single if r[0] not in hit) and hit
    taken = {r.doc_id: brute_copies(r) for r in mixing.mixed(
        spark.createDataFrame(clean, docs.schema))[0].where("size > 0").collect()}
    assert Counter(r[0] for r in mix) == Counter({d: n for d, n in taken.items() if n}) and set(mix) <= set(clean)
    assert set(taken.values()) <= {0, 1, 2}
    last = queries.QUERIES["pipeline"](spark, sf).collect()
    tree = sharding.grid(corpus_pipeline.SHARDS)
    assert Counter(r.doc_id for r in last) == Counter(r[0] for r in mix)
    assert all(r.shard == brute_shard(r.doc_id, tree) for r in last)


def test_odd_rows_in_every_stage(spark, sf, odd_documents, no_documents):
    odd = odd_documents.withColumnsRenamed({"key": "copy", "size": "score", "count": "lang_pred"})
    before = {(r.doc_id, r.text, r.score, r.lang_pred) for r in odd.collect()}
    given = {r.doc_id: r.text for r in odd.where("doc_id is not null").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd, no_documents):
            got = stage(spark, docs, sf)
            assert got.columns == docs.columns
            assert {r.doc_id for r in got.collect()} <= {*given, None}
            assert {(r.doc_id, r.text, r.score, r.lang_pred) for r in got.collect()} <= before
    single = corpus_pipeline.without_near_copies(spark, odd, sf).collect()
    rows = sorted({(r.doc_id is None, r.doc_id or 0, xxhash64_of(r.text), r.text or "") for r in odd.collect()})
    kept = [rank for rank, _ in brute_kept([(r, r[3]) for r in rows])]
    assert sorted((r.doc_id is None, r.doc_id or 0, xxhash64_of(r.text), r.text or "") for r in single) == sorted(kept)
    letters = corpus_pipeline.in_known_language(spark, odd, sf).collect()
    assert all(any(map(str.isalpha, r.text)) for r in letters) and language.UNKNOWN == "und"
