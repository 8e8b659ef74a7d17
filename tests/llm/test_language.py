from __future__ import annotations

import itertools
import zlib

import numpy as np

from rowferry.llm import language, queries


def test_query_holds_out_and_predicts(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op5_language"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    known = {d.lang for d in docs.values()}
    held = right = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        letters = any(map(str.isalpha, docs[r.doc_id].text or ""))
        assert r.lang_pred in known if letters else r.lang_pred == "und"
        if r.held_out and letters:
            held, right = held + 1, right + (r.lang_pred == docs[r.doc_id].lang)
    assert right >= 0.97 * held


def test_odd_rows(odd_documents, no_documents):
    rows = language.identified(odd_documents).collect()
    texts = odd_documents.select("doc_id", "text").collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in texts)
    for r in rows:
        if r.doc_id in (0, 1, 2, 8):
            assert r.lang_pred == "und" and r.score == 0
    assert language.identified(no_documents).count() == 0


def test_nothing_learned_gives_und(spark):
    rows = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.identified(rows).collect()] == ["und"]


def segmentations(word):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        out, last = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                out.append(word[last:i])
                last = i
        yield [*out, word[last:]]


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(language.VOCABULARY)
    rng = np.random.default_rng(1)
    chance = rng.random((pieces.count + 2, 3)) / 50
    chance[-1] = 0
    for word in ["the", "tion", "größe", "дом", "zz"]:
        ids = pieces.ids(language._codes([word]))
        text = language.START + word
        wanted = np.zeros(3)
        for parts in segmentations(text):
            p, at = np.ones(3), 0
            for part in parts:
                p *= chance[ids[len(part) - 1][0, at]] if len(part) <= len(ids) else 0
                at += len(part)
            wanted += p
        assert np.allclose(language.forward(ids, chance)[1][0], np.log(wanted))


def test_long_words_keep_their_scale():
    pieces = language.Pieces(language.VOCABULARY)
    chance = np.full((pieces.count + 2, 2), 1e-3)
    chance[:, 1] = 5e-4
    chance[-1] = 0
    word = "abcdefghij" * 300
    found = language.forward(pieces.ids(language._codes([word])), chance)[1][0]
    assert np.isfinite(found).all() and found[0] > found[1] > -len(word) * 10


def test_long_words_scored_in_parts_are_scored_alike(monkeypatch):
    pieces = language.Pieces(language.VOCABULARY)
    chance = np.random.default_rng(2).random((pieces.count + 2, 2)) / 50
    chance[-1] = 0
    model = language.Model(["a", "b"], pieces, chance)
    words = ["haus" * 40 + c for c in "abcdefg"] + ["house", "maison", "1"]
    whole = model.log_chances(words)
    monkeypatch.setattr(language, "AT_ONCE", 4)
    assert np.allclose(model.log_chances(words), whole) and not whole[-1].any()


def test_expected_counts_are_those_of_all_segmentations():
    pieces = language.Pieces(language.VOCABULARY)
    chance = np.full(pieces.count + 2, 0.01)
    chance[-1] = 0
    for word in ["tion", "abcabcabcabcabcabcabcabcabcabcabcabcabc"]:
        ids = pieces.ids(language._codes([word]))
        counts = language.expected(ids, chance, np.array([2.0]))
        assert counts.sum() > 0
        small = 1e-6  # the derivative of the logarithm by a piece's chance is its count over the chance
        piece = int(ids[0][0, 2])
        more = chance.copy()
        more[piece] += small
        slope = (language.forward(ids, more[:, None])[1] - language.forward(ids, chance[:, None])[1])[0, 0] / small
        assert np.isclose(counts[piece], 2 * chance[piece] * slope, rtol=1e-2)


def test_expected_counts_of_long_words_cover_every_character():
    pieces = language.Pieces(language.VOCABULARY)
    chance = np.random.default_rng(3).random(pieces.count + 2) / 50
    chance[-2:] = language.STRAY, 0
    for word in ["tion" * 8, "haus" * 30, "abcdefghij" * 300, "ⴰⴱⴲ" * 200]:
        ids = pieces.ids(language._codes([word, word]))
        share = np.zeros(len(chance))
        for length, found in enumerate(ids, 1):
            own = found[0][found[0] <= pieces.count]
            share[own] = length
        counts = language.expected(ids, chance, np.array([2.0, 1.0]))
        assert np.isfinite(counts).all() and np.isclose(counts @ share, 3 * (len(word) + 1))


def test_long_words_are_learned(spark):
    rows = [(i, ("haus" if i % 2 else "ville") * 30, ["fr", "de"][i % 2]) for i in range(20)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "fr"]
    assert model.predict(["haus" * 15, "ville" * 15], {})[0] == ["de", "fr"]
