"""Secret scans: patterns of known secrets, and a battery of randomness tests for the rest."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rowferry.llm.common import written

#: The kinds in their order, and the base patterns, on bytes with A-Z lowered for ASSIGN.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KEYWORDS = (b"passw", b"secret", b"token", b"api")
#: Encodings that a token may have, the smallest alphabet first.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (DIGITS, DIGITS + "abcdef", DIGITS + "ABCDEF", LOWER, UPPER, UPPER + "234567", DIGITS + LOWER, DIGITS + UPPER,
             UPPER + LOWER, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_", UPPER + LOWER + DIGITS + "+/-_")
#: How often words have each letter from a to z, in hundredths, about the mean of English and German.
FREQUENCIES = (7, 2, 3, 4.5, 15, 2, 2.2, 4.5, 7.5, .3, 1, 4, 2.6, 8.5, 5, 1.7, .2, 6.5, 6.8, 7.5, 3.8, .9, 1.5, .2, 1, .8)
TOKEN = re.compile(rb"[A-Za-z0-9+/_-]{20,}={0,2}")
LEAST_TOKEN = 20
#: Upper ends of the length classes within which false discoveries are controlled.
CLASS_ENDS = (24, 32, 48, 64)
#: p-values are counted in cells of a twentieth of a decade.
CELLS_PER_DECADE, CELLS = 20, 400

_VALUES = []
for _alphabet in ENCODINGS:
    _table = np.full(256, -1, np.int64)
    _table[np.frombuffer(_alphabet.encode(), np.uint8)] = np.arange(len(_alphabet))
    _VALUES.append(_table)
_IN_HEX = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_IN_TOKEN = bytes(120 if chr(b) in UPPER + LOWER + DIGITS + "+/_-" else 32 for b in range(256))


_CLASSES = np.zeros(256, np.int64)  # digits, lower case, upper case, others
for _i, _chars in enumerate((DIGITS, LOWER, UPPER)):
    _CLASSES[np.frombuffer(_chars.encode(), np.uint8)] = _i + 1
_WEIGHTS = np.zeros(256)  # of letters, with mean 0 and variance 1 over the alphabet
for _chars in (LOWER, UPPER):
    _WEIGHTS[np.frombuffer(_chars.encode(), np.uint8)] = (np.log(FREQUENCIES) - np.log(FREQUENCIES).mean()) / np.log(FREQUENCIES).std()


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared(values: np.ndarray, size: int) -> float:
    """p of uniform use of the alphabet, in as many equal parts of it as the length can fill (5 each)."""
    n = len(values)
    parts = max(2, min(size, n // 5, 16))
    return _uniform(np.bincount(values * parts // size, minlength=parts),
                    np.bincount(np.arange(size) * parts // size, minlength=parts) * n / size)


def classes(raw: np.ndarray, alphabet: str) -> float:
    """p of uniform use of the alphabet's digits, lower-case, upper-case and other characters."""
    expected = np.bincount(_CLASSES[np.frombuffer(alphabet.encode(), np.uint8)], minlength=4) * len(raw) / len(alphabet)
    return _uniform(np.bincount(_CLASSES[raw], minlength=4)[expected > 0], expected[expected > 0])


def _uniform(seen: np.ndarray, expected: np.ndarray) -> float:
    if len(seen) < 2:
        return 1.0
    x, df = ((seen - expected) ** 2 / expected).sum(), len(seen) - 1
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))  # Wilson and Hilferty
    return 0.5 * math.erfc(z / math.sqrt(2))


def runs(values: np.ndarray, size: int) -> float:
    """p of the number of runs below and above the alphabet's middle (Wald and Wolfowitz)."""
    high = values * 2 >= size
    n, above = len(values), int(high.sum())
    below = n - above
    if not above or not below:
        return 2.0 ** (1 - n)
    mean = 2 * above * below / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    count = 1 + int((high[1:] != high[:-1]).sum())
    return _two_sided((count - mean) / math.sqrt(variance)) if variance > 0 else 1.0


def serial_correlation(values: np.ndarray, size: int) -> float:
    """p of the correlation of neighbours."""
    centred = values - (size - 1) / 2
    spread = (size * size - 1) / 12
    return _two_sided(float((centred[1:] * centred[:-1]).sum()) / spread / math.sqrt(len(values) - 1))


def frequent_letters(raw: np.ndarray) -> float:
    """p of letters as frequent in words as these, or more, among random letters: by the mean logarithm
    of their frequencies, whose upper tail is lighter than the normal one's."""
    return 0.5 * math.erfc(float(_WEIGHTS[raw].sum()) / math.sqrt(2 * len(raw)))


def randomness(token: bytes) -> float:
    """p of the token being random in the smallest alphabet that has all its characters: the least of
    the tests, times their number. Words have letters only too, so such tokens have a test of letters;
    it takes the place of that of character classes where the alphabet has one class."""
    raw = np.frombuffer(token.rstrip(b"="), np.uint8)
    for table, alphabet in zip(_VALUES, ENCODINGS):
        values = table[raw]
        if (values >= 0).all():
            size = len(alphabet)
            tests = [chi_squared(values, size), runs(values, size), serial_correlation(values, size)]
            if alphabet not in (LOWER, UPPER):
                tests.append(classes(raw, alphabet))
            if alphabet.isalpha():
                tests.append(frequent_letters(raw))
            return min(1.0, len(tests) * min(tests))
    return 0.0


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans (start, kind, end) and further tokens (start, end, length class, cell of p).

    Positions are code points. Equal results come from searching the bytes: what a pattern can match
    is ASCII. Tokens inside a base span are left out.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    found: list[tuple[int, int, int]] = []
    lowered = data.lower()
    if any(k in lowered for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(lowered) if m.end() - m.start(1) >= LEAST_VALUE]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= LEAST_ACCESS]
    if b"h" * LEAST_HEX in data.translate(_IN_HEX):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(data) if m.end() - m.start() >= LEAST_HEX]
    tokens: list[tuple[int, int, int, int]] = []
    if b"x" * LEAST_TOKEN in data.translate(_IN_TOKEN):
        for m in TOKEN.finditer(data):
            if not any(a <= m.start() and m.end() <= b for a, _, b in found):
                kind = sum(m.end() - m.start() >= e for e in CLASS_ENDS)
                p = max(randomness(m.group()), 1e-300)
                tokens.append((m.start(), m.end(), kind, min(int(-math.log10(p) * CELLS_PER_DECADE), CELLS - 1)))
    if (found or tokens) and len(data) != len(text or ""):
        points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
        at = lambda i: int(points[i]) if i < len(data) else len(text)
        found = [(at(a), k, at(b)) for a, k, b in found]
        tokens = [(at(a), at(b), c, p) for a, b, c, p in tokens]
    return sorted(found), tokens


def limits(counts: dict[tuple[int, int], int], rate: float, least_p: float) -> list[int]:
    """For each length class the first cell whose tokens are held not to be random.

    Within a class, Benjamini and Hochberg's rule finds those for which randomness is rejected at a
    false discovery rate of ``rate``: it takes the largest p with p <= rate * rank / tokens, here a
    cell's upper end. p below ``least_p`` is rejected in any case. A longer token's tests are sharper,
    so classes of their own keep many short tokens from deciding over few long ones.
    """
    out = []
    for kind in range(len(CLASS_ENDS) + 1):
        total = sum(n for (k, _), n in counts.items() if k == kind)
        first, rank = min(CELLS, math.ceil(-math.log10(least_p) * CELLS_PER_DECADE)), 0
        for cell in range(CELLS - 1, -1, -1):
            rank += counts.get((kind, cell), 0)
            if counts.get((kind, cell)) and 10 ** (-cell / CELLS_PER_DECADE) <= rate * rank / total:
                first = min(first, cell)
        out.append(first)
    return out


def secrets(docs: DataFrame, *, id: str = "doc_id", text: str = "text", rate: float = 0.05,
            least_p: float = 0.01) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of ``docs``.

    Base spans follow fixed patterns. The method adds ``random`` spans: tokens of 20 or more characters
    of an encoding, outside base spans, that chi-squared, runs and serial-correlation tests together
    do not tell from random ones, with false discoveries controlled by length over all tokens of the
    table (see ``limits``; the driver gets counts by class and cell only). spans lists all as
    kind:start:end by start, then kind.

    NULL texts are empty. Repeated rows come back as often as given; an empty table gives no rows;
    other columns are not used.
    """
    @F.pandas_udf("base array<struct<start:int,kind:int,end:int>>, "
                  "tokens array<struct<start:int,end:int,class:int,cell:int>>")
    def scanned(texts: pd.Series) -> pd.DataFrame:
        base, tokens = [], []
        for t in texts:
            b, k = scan(t)
            base.append([dict(zip(("start", "kind", "end"), x)) for x in b])
            tokens.append([dict(zip(("start", "end", "class", "cell"), x)) for x in k])
        return pd.DataFrame({"base": base, "tokens": tokens})

    rows = written(docs.select(F.col(id).alias("doc_id"), scanned(F.col(text)).alias("found"))
                   .select("doc_id", "found.base", "found.tokens"), "spans")
    counts = rows.select(F.explode("tokens").alias("t")).groupBy("t.class", "t.cell").count().collect()
    first = F.array(*map(F.lit, limits({(r["class"], r["cell"]): r["count"] for r in counts}, rate, least_p)))
    added = F.transform(F.filter("tokens", lambda t: t["cell"] < F.get(first, t["class"])), lambda t: F.struct(
        t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                       F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                       joined(F.sort_array(F.concat("base", added))).alias("spans"))
