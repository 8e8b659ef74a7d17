from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from rowferry.llm import alignment, queries


@pytest.fixture(scope="module")
def tokens():
    return alignment.sides(alignment.BYTE_TOKENS, alignment.PIECE_TOKENS)[:2]


def spans(ids, names):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(names[i]), i))
        at += len(names[i])
    return out


def brute(rows, tokens):
    """Every text tokenized whole, all pairs of tokens compared."""
    a, b = tokens
    found = []
    for doc, text in rows:
        whole = (" " + text).encode() if text else b""
        x = spans(a.exact.encode(" " + text, add_special_tokens=False).ids, a.bytes) if text else []
        y = spans(b.model.encode(text), b.bytes) if text else []
        if b"".join(a.bytes[t[2]] for t in x) != whole or b"".join(b.bytes[t[2]] for t in y) != whole:
            x, y = [], []
        links, first = [], 0
        for start, end, i in x:
            while y[first][1] <= start:
                first += 1
            for s, e, j in y[first:]:
                if s >= end:
                    break
                links.append((i, j))
        ends = sorted({t[1] for t in x} & {t[1] for t in y})
        groups, low = [], 0
        for high in ends:
            groups.append("|".join(",".join(str(t[2]) for t in side if low < t[1] <= high) for side in (x, y))
                          if len(ends) < 300 else None)
            low = high
        if ends and groups[0] is None:  # the same, without looking through all tokens for each group
            number = {e: n for n, e in enumerate(ends)}
            cells = [([], []) for _ in ends]
            for k, side in enumerate((x, y)):
                n = 0
                for _, e, i in side:
                    cells[n][k].append(str(i))
                    n += e in number
            groups = [",".join(p) + "|" + ",".join(q) for p, q in cells]
        found.append((doc, len(x), len(y), len(groups), links,
                      hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
    counts = Counter(link for f in found for link in f[4])
    best = Counter()
    for (i, j), n in counts.items():
        best[j] = max(best[j], n)
    return Counter((doc, n_a, n_b, n_groups, len(links), sum(counts[p] == best[p[1]] for p in links),
                    sum(counts[p] for p in links), digest) for doc, n_a, n_b, n_groups, links, digest in found)


def rows_of(df):
    return Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
                   for r in df.collect())


def test_query_against_all_pairs(spark, sf, tokens):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op11_alignment"](spark, sf)
    assert rows_of(got) == brute(rows, tokens) and got.schema["doc_id"].dataType.simpleString() == "bigint"


ODD = ["<|endoftext|> <s> </s> <unk> <0x41> <0xFF>", "a▁b", "  two  blanks  ", "don't we'll I'M", "日本語の文章です。 текст 🙂🙂 é​\x00",
       "\n\n\ttabs and　wide lines\r\n", "3.14159 1,000,000 ½ ²³ Ⅷ", "w" * 3000 + " " * 1500 + "end", "�﻿ x"]


def test_odd_rows_and_small_parts(spark, odd_documents, no_documents, tokens, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()] + list(enumerate(ODD, 100))
    docs = odd_documents.select("doc_id", "text", "key", "size").unionByName(
        spark.createDataFrame(list(enumerate(ODD, 100)), "doc_id long, text string"), allowMissingColumns=True)
    expected = brute(rows, tokens)
    assert rows_of(alignment.aligned(docs)) == expected
    assert rows_of(alignment.aligned(docs.repartition(1), chunk=50)) == expected  # a chunk per text or two
    assert alignment.aligned(no_documents).count() == 0


@pytest.mark.parametrize("size", [1, 7, 50])
def test_parts_are_tokenized_as_the_whole(tokens, size, monkeypatch):
    """Documents in parts, and slices that end within a document, give what whole texts give."""
    rng = random.Random(size)
    texts = [" ".join(rng.choice(["the", "don't", "x9", "Straße", "дом", "a.", "(b", "", "\n", "oo"]) for _ in range(300)) for _ in range(6)]
    assert all(" ".join(alignment.parts(t, size)) == t for t in texts) and len(list(alignment.parts(texts[0], size))) > 5
    whole, cut = alignment.Chunk(alignment.sides(alignment.BYTE_TOKENS, alignment.PIECE_TOKENS)), alignment.Chunk(
        alignment.sides(alignment.BYTE_TOKENS, alignment.PIECE_TOKENS))
    for t in texts:
        whole.add([(whole.open("d"), t)])
        doc, held = cut.open("d"), list(alignment.parts(t, size))
        for k in range(0, len(held), 3):
            cut.add([(doc, p) for p in held[k:k + 3]])
    (w, w_pairs), (c, c_pairs) = list(whole.rows(0)), list(cut.rows(0))
    assert w.drop(columns=["at", "times"]).equals(c.drop(columns=["at", "times"])) and w_pairs.equals(c_pairs)


def test_both_byte_level_libraries_agree(tokens):
    """Every code point among letters, digits, blanks and marks (one in five, the first 12,000 all)."""
    a = tokens[0]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 12_000 or c % 5 == 0)]
    texts = [f"a{chr(c)}a1{chr(c)}1 {chr(c)} .{chr(c)}." for c in points]
    assert a.fast.encode_ordinary_batch(texts, num_threads=4) == [
        e.ids for e in a.exact.encode_batch(texts, add_special_tokens=False)]


def test_vocabulary_whose_pieces_cross_blanks_is_not_cut(tokens):
    assert tokens[1].blanks_lead and tokens[1].bytes[0x41 + 3] == b"A"


def test_counts_in_as_many_bytes_as_needed():
    for most in (0, 1, 127, 128, 40_000, 1 << 31, 1 << 40):
        import numpy as np
        numbers = np.array([0, most, 1], "<i8")
        assert (alignment._numbers(alignment._narrow(numbers)) == numbers).all()
    assert len(alignment._numbers(alignment._narrow(np.zeros(0, "<i8")))) == 0
