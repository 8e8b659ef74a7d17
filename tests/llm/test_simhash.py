from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from rowferry.llm import queries, simhash
from rowferry.llm.components import components


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (doc_id, fingerprint). By comparing all pairs."""
    prints = sorted({f for _, f in rows})
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array(prints, np.uint64)
    for i, f in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= 3):
            parent[find(prints[i + 1 + j])] = find(f)
    least = defaultdict(lambda: None)
    for d, f in rows:
        if d is not None:
            r = find(f)
            least[r] = d if least[r] is None else min(least[r], d)
    return [(d, f, least[find(f)]) for d, f in rows]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def check(result, docs):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in result.collect()]
    assert ordered(got) == ordered(brute_components(rows))


def test_query_against_brute_force(spark, sf):
    check(queries.QUERIES["op3_simhash"](spark, sf), spark.read.parquet(f"{sf}/documents.parquet"))


def test_odd_rows(spark, odd_documents, no_documents):
    check(simhash.near_duplicates(odd_documents), odd_documents)
    assert simhash.near_duplicates(no_documents).count() == 0


def test_anchors_are_all_code_words_within_reach():
    rng = random.Random(5)
    for word in [0, 0xFFFFFFFF, *[rng.getrandbits(32) for _ in range(40)]]:
        rows, found = simhash.anchors(np.array([word], np.int64))
        own = {a & 0xFFFFFFFF for a in found.tolist() if not a >> 32}
        near = {word} | {word ^ 1 << i for i in range(32)} | {word ^ 1 << i ^ 1 << j for i in range(32) for j in range(i)}

        def syndrome(v):
            s = 0
            for i in range(1, 32):
                s ^= i * (v >> (i - 1) & 1)
            return s

        assert own == {v for v in near if syndrome(v) == 0}


def test_every_near_pair_meets_even_in_cut_anchors(spark):
    rng = random.Random(7)
    center = rng.getrandbits(64)
    values = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(300)}
    values |= {rng.getrandbits(64) for _ in range(300)}
    rows = [(i, v) for i, v in enumerate(sorted(values))]
    signed = [(v - (1 << 64) if v >> 63 else v,) for _, v in rows]
    nodes = spark.createDataFrame(signed, "fingerprint long").repartition(4)
    for block in (8, 8192):
        roots = {r.node % (1 << 64): r.root for r in components(simhash.near_links(nodes, 3, block)).collect()}
        groups = defaultdict(set)
        for i, v, c in brute_components(rows):
            groups[c].add(v)
        for members in groups.values():
            assert len({roots.get(v, v) for v in members}) == 1
        assert len(set(roots.values())) == sum(len(m) > 1 for m in groups.values())


def test_forest_is_one_link_short_of_each_component():
    values = np.array([0, 1, 3, 7, 15, 1 << 40, 1 << 41 | 1 << 40, 0x0F0F0F0F0F0F0F0F], np.int64)
    assert len(simhash.forest(values, 1)) == 6 and len(simhash.forest(values, 0)) == 0


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (0, 1)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
