from __future__ import annotations

import pytest

#: Rows for every operator on documents: NULLs, empty and long texts, ties, repeated rows, scripts.
LONG = " ".join(f"word{i % 700} tail{i % 13}" for i in range(20_000))
TEXTS = [None, "", "   \n\t ", "one", "two words", "the quick brown fox jumps over the lazy dog near the river bank",
         "The Quick brown fox jumps over the lazy dog near the river bank", "Ünïcode wörter große Straße ßß ẞ İstanbul",
         "12345 67890 !!! ***", "дом у реки стоит давно", LONG, "x" * 5000, "a b a b a b a b a b a b a b",
         "line\nline\nline\nother\n\n\n", "tab\tand\x0bvertical\x0cfeed\r\n"]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """documents with odd rows, repeated rows and extra columns whose names operators use inside."""
    rows = [(i, t, ["en", None, "de"][i % 3], [None, "a", "b", "\U00010000"][i % 4]) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, "no id here at all", "en", "a"), (None, None, None, None), (3, "another text of id three", "en", "b")]
    extra = [(*r, None if r[1] is None else len(r[1]), "x", 7, 8.5) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, "
                                        "key string, size int, count double").repartition(3)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
