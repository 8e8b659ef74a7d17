"""Quality rules: base rules of words, symbols and repeats, and a likelihood ratio of n-grams."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from rowferry.llm.common import SPACES, indexes, let, words

#: Symbol characters, and the base rules' limits.
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def repeated_words(h: Column, window: int = WINDOW) -> Column:
    """Words in windows of ``window`` words found twice or more in the text, the first included.
    ``h``: the hashes of the words, bound by ``let``."""
    grams = F.transform(indexes(F.size(h) - (window - 1)), lambda i: F.xxhash64(*[h[i + j] for j in range(window)]))

    def covered(g: Column) -> Column:
        by_gram = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("gram"), i.alias("at"))))
        starts = let(by_gram, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, j: F.get(s, j - 1)["gram"].eqNullSafe(x["gram"])
                     | F.get(s, j + 1)["gram"].eqNullSafe(x["gram"])), lambda x: x["at"])))
        none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
        return F.aggregate(starts, none, lambda a, at: F.struct(
            (at + window).alias("end"), (a["total"] + at + window - F.greatest(at, a["end"])).alias("total")),
            lambda a: a["total"])

    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))


def buckets(h: Column, count: int) -> Column:
    """The buckets of all words and of all pairs of neighbours."""
    pairs = F.transform(indexes(F.size(h) - 1), lambda i: F.pmod(F.xxhash64(h[i], h[i + 1]), F.lit(count)).cast("int"))
    return F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(count)).cast("int")), pairs)


def log_ratios(docs: DataFrame, trusted: DataFrame, *, id: str, text: str, bucket_count: int, trusted_rows: int,
               smoothing: float) -> list[float]:
    """ln(p(bucket | trusted) / p(bucket | corpus)) for each bucket.

    The corpus counts are over all documents. The target counts are over about ``trusted_rows`` rows
    of ``trusted`` (all, if it has no more), chosen by a hash of the id: the stated bound of the
    labelled sample, small enough to be broadcast. One scan counts both; the driver gets two numbers
    per bucket.
    """
    known = trusted.select(F.col(id).alias("id")).where("id is not null").distinct()
    share = trusted_rows / max(known.count(), 1)
    luck = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.broadcast(known.where(luck < share).select("id", F.lit(1).alias("is_trusted")))
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(chosen, "id", "left")
    found = rows.select("is_trusted", F.explode(let(word_hashes(F.col("text")), lambda h: buckets(h, bucket_count)))
                        .alias("bucket"))
    counts = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("is_trusted").alias("target")).collect()
    raw, target = [0] * bucket_count, [0] * bucket_count
    for row in counts:
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    # The target is drawn towards the corpus, so a bucket that it happens to lack does not decide.
    all_raw, all_target = sum(raw) + bucket_count, sum(target) + smoothing
    p = [(r + 1) / all_raw for r in raw]
    return [math.log((t + smoothing * q) / all_target / q) for t, q in zip(target, p)]


def judged(docs: DataFrame, trusted: DataFrame, *, id: str = "doc_id", text: str = "text", bucket_count: int = 10_000,
           trusted_rows: int = 20_000, smoothing: float = 10_000.0, least: float = -0.15) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_ratio, kept)
    of every row of ``docs``.

    log_ratio: the mean of ln(p(n-gram | trusted) / p(n-gram | corpus)) over the text's words and pairs
    of words, which are hashed into ``bucket_count`` buckets; NULL without a word. ``trusted`` has the
    ids of documents of known quality. kept: not base_failed, and log_ratio is at least ``least``,
    the same fixed number for every document; without a trusted row all ratios are 0.

    NULL and empty texts have no words and fail the base rules. Repeated rows come back as often as
    given; an empty table gives no rows; other columns are not used.
    """
    ratios = log_ratios(docs, trusted, id=id, text=text, bucket_count=bucket_count, trusted_rows=trusted_rows,
                        smoothing=smoothing)
    weights = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")

    def measured(h: Column) -> Column:
        total = F.aggregate(buckets(h, bucket_count), F.lit(0.0), lambda a, b: a + F.get(weights, b))
        return F.struct(F.size(h).cast("long").alias("n_words"), repeated_words(h).cast("long").alias("n_repeat_words"),
                        F.when(F.size(h) > 0, total / (2 * F.size(h) - 1)).alias("log_ratio"))

    content = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(content, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(
        F.col(id).alias("doc_id"), F.length(F.regexp_replace(content, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(content) - F.length(F.regexp_replace(content, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(word_hashes(content), measured).alias("of_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return (rows.select("doc_id", "of_words.n_words", "word_chars", "n_symbols", "n_dup_lines", "of_words.n_repeat_words",
                        "of_words.log_ratio").withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= least)))
