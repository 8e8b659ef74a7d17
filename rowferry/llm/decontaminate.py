"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowferry.llm.common import indexes, let, words, written

#: Characters between words (ASCII other than letters and digits) and the case pairs.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tables of benchmark fingerprints up to so many rows of some 100 bytes may be broadcast.
BROADCAST_ROWS = 200_000


def exact_words(text: Column) -> Column:
    """Words with A-Z lowered and nothing else changed."""
    return words(F.translate(text, UPPER, LOWER), BETWEEN)


def folded_words(text: Column) -> Column:
    """Words that are equal wherever exact words are: upper() folds A-Z, and perhaps more. Faster."""
    return words(F.upper(text), BETWEEN)


def gram_hashes(tokens: Column, k: int) -> Column:
    """The hash of each run of ``k`` words, by position."""
    return let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: F.transform(
        indexes(F.size(h) - (k - 1)), lambda i: F.xxhash64(*[h[i + j] for j in range(k)])))


def winnowed(hashes: Column, window: int) -> Column:
    """The least hash of every window of ``window`` hashes, each once."""
    return let(hashes, lambda h: F.array_distinct(F.transform(
        indexes(F.size(h) - (window - 1)),
        lambda i: F.least(*[h[i + j] for j in range(window)]) if window > 1 else h[i])))


def winnowed_at(hashes: Column, window: int) -> Column:
    """(hash, position) of every hash that is the least of some window: those that ``winnowed`` gives,
    at all of their positions inside such windows."""
    def kept(h: Column) -> Column:
        minima = F.transform(indexes(F.size(h) - (window - 1)), lambda i: F.array_min(F.slice(h, i + 1, window)))
        return let(minima, lambda m: F.filter(
            F.transform(h, lambda x, i: F.struct(x.alias("hash"), i.alias("position"))),
            lambda s: F.exists(F.slice(m, F.greatest(s["position"] - (window - 2), F.lit(1)),
                                       F.least(s["position"] + 1, F.lit(window))), lambda x: x == s["hash"])))
    return let(hashes, kept)


def _scheme(span: int) -> tuple[int, int]:
    """(k, window) with k + window - 1 == span: a shared run of ``span`` words shares a fingerprint."""
    k = span // 2 + 1
    return k, span - k + 1


def _sized(small: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of proven size; a larger one is joined by a shuffle."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def contamination(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", span: int = 10) -> DataFrame:
    """(doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``;
    key is the MD5 of the text.

    A window is ``span`` consecutive words of an item, or a shorter item's whole words. A document
    word is hit where a window occurs. Winnowing keeps the least hash of k words in every window of
    ``span`` words on both sides, so every shared window shares a fingerprint; items shorter than
    ``span`` have fingerprints of their own length's guarantee. Documents that share one are aligned
    with the item at each shared position, and every alignment is compared word by word as far as the
    item reaches; only real windows count.

    NULL texts have no words. Equal texts are examined once. Rows with a NULL item id hit words but
    name no item. Repeated rows come back as often as given; empty tables give no rows, or no hits;
    other columns are not used.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.md5(text).alias("key"))
    found = _occurrences(rows, benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), span)
    hit = (found.select("key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("at"))
           .distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_hit")))
    items = found.groupBy("key").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    by_key = written(hit.join(items, "key"), "hits")
    n_items = F.coalesce(F.size("items"), F.lit(0)).cast("long")
    digest = F.sha2(F.concat_ws(",", F.array_sort(F.coalesce("items", F.array().cast("array<string>")))), 256)
    counted = rows.select("doc_id", "key", F.size(words(F.col("text"), BETWEEN)).cast("long").alias("n_words"))
    return (counted.join(by_key, "key", "left")
            .select("doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.when(F.col("items").isNull(), 0).otherwise(n_items).cast("long").alias("n_items"),
                    digest.alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated")))


def _occurrences(rows: DataFrame, benchmark: DataFrame, span: int) -> DataFrame:
    """(key, item_id, start, length) of every window that occurs in a text of ``rows`` (key, text)."""
    items = (benchmark.groupBy("item_id", "text").count()
             .select("item_id", F.xxhash64("item_id", "text").alias("item"), exact_words(F.col("text")).alias("words"),
                     folded_words(F.col("text")).alias("folded"))
             .where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(span))))
    items = written(items, "items")
    n_items = items.count()
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # at most ``span`` numbers

    def prints(tokens: Column, at: bool) -> list[tuple[int, Column]]:
        return [(n, (winnowed_at if at else winnowed)(gram_hashes(tokens, _scheme(n)[0]), _scheme(n)[1]))
                for n in lengths]

    empty = "key string, item_id long, start int, length int"
    if not lengths:
        return rows.sparkSession.createDataFrame([], empty)
    marks = None
    for n, column in prints(F.col("folded"), True):
        part = (items.where(F.col("length") == n).select("item", F.explode(column).alias("mark"))
                .select("item", F.lit(n).alias("n"), F.col("mark.hash").alias("hash"),
                        F.col("mark.position").alias("item_at")))
        marks = part if marks is None else marks.union(part)
    marks = written(marks, "fingerprints")
    n_marks = marks.count()

    # Which texts share a fingerprint: rows of (key, hash) meet the benchmark's hashes.
    tokens = rows.where(F.col("text").isNotNull()).withColumn("tokens", folded_words(F.col("text")))
    def marked(n: int, hashes: Column) -> Column:
        return F.transform(hashes, lambda h: F.struct(F.lit(n).alias("n"), h.alias("hash")))

    of_text = let(F.col("tokens"), lambda t: F.concat(*[marked(n, hashes) for n, hashes in prints(t, False)]))
    shared = (tokens.select("key", F.explode(of_text).alias("mark")).select("key", "mark.n", "mark.hash")
              .join(_sized(marks.select("n", "hash").distinct(), n_marks), ["n", "hash"], "left_semi")
              .select("key").distinct())
    texts = written(rows.join(written(shared, "keys"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
                    .select("key", exact_words(F.col("text")).alias("words"), folded_words(F.col("text")).alias("folded")),
                    "texts")

    # Align every such text with an item at each shared position.
    seeds = None
    for n in lengths:
        part = (texts.select("key", F.posexplode(gram_hashes(F.col("folded"), _scheme(n)[0])).alias("doc_at", "hash"))
                .join(_sized(marks.where(F.col("n") == n).drop("n"), n_marks), "hash")
                .select("key", "item", (F.col("doc_at") - F.col("item_at")).alias("shift")))
        seeds = part if seeds is None else seeds.union(part)
    item_words = items.select("item", "item_id", "length", F.col("words").alias("item_words"))
    most = (items.agg(F.max(F.size("words"))).first()[0] or 0)
    first = F.greatest(F.col("shift"), F.lit(0))
    # Alignments stream past their one text, of which each takes what the item can reach; none are gathered.
    aligned = (seeds.distinct().join(texts.select("key", "words"), "key")
               .select("key", "item", "shift", F.slice("words", first + 1, F.lit(most)).alias("text_words")))
    same = F.zip_with(F.col("text_words"), F.slice("item_words", F.greatest(-F.col("shift"), F.lit(0)) + 1,
                                                   F.size("item_words")),
                      lambda a, b: F.coalesce(a == b, F.lit(False)))
    starts = let(same, lambda s: F.filter(indexes(F.size(s) - F.col("length") + 1), lambda i: F.forall(
        F.slice(s, i + 1, F.col("length")), lambda x: x)))
    return (aligned.join(_sized(item_words, n_items), "item")
            .select("key", "item_id", "length", first.alias("first"), F.explode(starts).alias("at"))
            .select("key", "item_id", (F.col("first") + F.col("at")).alias("start"), "length"))
