from __future__ import annotations

import base64
import hashlib
import random
import re

import numpy as np

from rowferry.llm import queries, secret_scan


def brute(text):
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in re.finditer(
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m.group(2)) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(spans, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def check(rows, texts):
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _ in texts)
    wanted = sorted((str(d), *[sum(k == x for x, _, _ in brute(t)) for k in ("assign", "access", "hex")], hashlib.sha256(
        ",".join(f"{k}:{a}:{b}" for k, a, b in brute(t)).encode()).hexdigest()) for d, t in texts)
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows) == wanted
    by_id = {d: t for d, t in texts}
    for r in rows:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        base = [f"{k}:{a}:{b}" for k, a, b in brute(by_id[r.doc_id])] if texts.count((r.doc_id, by_id[r.doc_id])) == 1 else []
        assert [":".join(s) for s in spans if s[0] != "random"] == base or not base
        assert [(int(a), secret_scan.KINDS.index(k)) for k, a, _ in spans] == sorted((int(a), secret_scan.KINDS.index(k)) for k, a, _ in spans)


def test_query_against_brute_force(spark, sf):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(queries.QUERIES["op10_secrets"](spark, sf).collect(), texts)


def test_odd_rows(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect() if r.doc_id not in (3, 5) and r.doc_id is not None]
    more = ["PassWord : 'abcdef' ünd tokeN=\"x.y-z_1\" token=short", "paſſword=abcdefg toKen=abcdefg", "é" * 5 + "AKIA" + "A" * 16 + "AKIA",
            "secret\t=abcdef api_key=secret=abcdefgh apikey =  a", "deadbeef" * 5 + " password=" + "0" * 30, "token=password=secret=abcdef"]
    rows += [(100 + i, t) for i, t in enumerate(more)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    check(secret_scan.secrets(df).collect(), rows)
    assert secret_scan.secrets(no_documents).count() == 0
    assert secret_scan.secrets(odd_documents).count() == odd_documents.count()


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(11)
    random_bytes = lambda n: bytes(rng.randrange(256) for _ in range(n))
    rows = [(i, "ab " + base64.b64encode(random_bytes(30)).decode() + " cd") for i in range(100)]
    words = ["thtionerandhestouringly", "internationalization_and_localization", "aaaaaaaaaaaaaaaaaaaaaaaa", "ABABABABABABABABABABABAB",
             "ungkeitverenpflicheinheit", "src/main/resources/application", "0123456789012345678901234567890"]
    rows += [(100 + i, f"é {words[i % len(words)]} x") for i in range(300)]
    got = {r.doc_id: r.spans for r in secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == "random:3:43" for i in range(100)) >= 90
    assert sum("random" in got[100 + i] for i in range(300)) <= 3


def test_p_values_of_random_tokens_are_uniform_or_larger():
    rng = np.random.default_rng(2)
    for size, n in ((16, 32), (64, 24), (64, 60), (32, 26)):
        draws = [rng.integers(0, size, n) for _ in range(3000)]
        for test in (secret_scan.chi_squared, secret_scan.runs, secret_scan.serial_correlation):
            p = np.array([test(v, size) for v in draws])
            assert (p < 0.05).mean() < 0.075 and (p < 0.5).mean() > 0.25


def test_limits_follow_benjamini_and_hochberg():
    rng = random.Random(4)
    cells = [(rng.randrange(5), min(399, int(rng.expovariate(0.02)))) for _ in range(500)]
    counts = {c: cells.count(c) for c in cells}
    for kind, first in enumerate(secret_scan.limits(counts, 0.05, 0.01)):
        p = sorted(10 ** (-c / 20) for k, c in cells if k == kind)
        passed = [x for i, x in enumerate(p, 1) if x <= 0.05 * i / len(p)]
        rejected = {c for k, c in cells if k == kind and (c >= 40 or passed and 10 ** (-c / 20) <= max(passed))}
        assert rejected == {c for k, c in cells if k == kind and c >= first}


def test_tokens_of_letters_only_are_found_among_long_words(spark):
    rng = random.Random(13)
    lower, upper = secret_scan.LOWER, secret_scan.UPPER
    rows = [(i, "ab " + "".join(rng.choices((lower, upper, lower + upper)[i % 3], k=(20, 32, 40, 64)[i // 3 % 4])) + " cd")
            for i in range(240)]
    words = ["thtionerandhestouringly", "internationalization", "ungkeitverenpflicheinheit", "antidisestablishmentarianism",
             "getApplicationContextFromRequest", "createDefaultConnectionHandler", "incomprehensibilities"]
    rows += [(1000 + i, f"x {words[i % len(words)]} y") for i in range(280)]
    got = {r.doc_id: r.spans for r in secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == f"random:3:{len(t) - 3}" for i, t in rows[:240]) >= 216
    assert not any("random" in got[i] for i, _ in rows[240:])
