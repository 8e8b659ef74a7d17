"""Mixing sources to target weights in fixed-length blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowferry.llm.common import running_sum, words, written

#: Rounds of the swap-or-not shuffle; its keys are hashes of seed and round.
ROUNDS = 32
#: Slots that one row of the slot table unfolds into.
SLOTS_PER_ROW = 20_000


def permuted(index: Column, count: Column, seed: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0 .. count-1 (swap-or-not shuffle, Hoang, Morris, Rogaway, 2012).

    Each round pairs x with key - x modulo count, and a bit of the pair's hash swaps it or not. So a
    round is one-to-one for every count, and so are all rounds together.
    """
    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(seed, r), count) + count - x, count)
        bit = F.xxhash64(seed, r, F.greatest(x, partner)).bitwiseAND(F.lit(1).cast("long"))
        return F.when(bit == 1, partner).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(rounds)]), index.cast("long"), swap)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """(source, number, source_size, target) of each source of ``sizes`` (source, size).

    Sources by code point, NULL last, have the weights in turn and share ``share`` times all sizes. A
    target stops at ``most`` times its source's size, and the excess is shared again by weight. So a
    target is least(most * size, level * weight), with one level for all; sources ordered by the
    level at which they stop show it by running sums. Windows here hold one row per source.
    """
    by_name, by_stop, all_rows = Window.orderBy(F.col("source").isNull(), "source"), None, Window.partitionBy(F.lit(0))
    by_stop = Window.orderBy("stop", "number").rowsBetween(Window.unboundedPreceding, -1)
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (sums.withColumn("number", F.row_number().over(by_name) - 1)
              .withColumn("weight", F.get(cycle, F.col("number") % len(weights)))
              .withColumn("cap", F.col("source_size") * most).withColumn("stop", F.col("cap") / F.col("weight")))
    level = ((F.sum("source_size").over(all_rows) * share - F.coalesce(F.sum("cap").over(by_stop), F.lit(0.0)))
             / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(by_stop), F.lit(0.0))))
    levels = ranked.withColumn("level", level).withColumn("free", F.col("stop") > F.col("level"))
    # The level is right where the first source, in this order, does not stop; if all stop, none is free.
    shared = F.min(F.when(F.col("free"), F.struct("stop", "number", "level"))).over(all_rows)["level"]
    target = F.when(shared.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), shared * F.col("weight")))
    return levels.select("source", "number", "source_size", target.alias("target"))


def slots(targets: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, number, block, length) of the mix: which block of which source fills each slot.

    A source has one slot for each block of its target's whole passes over the source and of the part
    of a pass that remains, the last one cut to the words that remain. All slots of all sources are
    dealt to the output by one pseudorandom permutation. So an output shard's counts by source are a
    multinomial draw by target, conditioned on the totals (multivariate hypergeometric), which then
    hold to the word. A source's slots run through its blocks by a permutation of its own for each
    pass; the short block at a source's end is the last of its pass.
    """
    words_ = F.round("target").cast("long")
    plan = (targets.where("source_size > 0").withColumn("full", F.expr(f"source_size div {block}"))
            .withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
            .withColumn("words", words_).withColumn("passes", F.expr("words div source_size"))
            .withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
            .withColumn("count", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long")))
    ahead = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    plan = (plan.withColumn("offset", F.coalesce(F.sum("count").over(ahead), F.lit(0)))
            .withColumn("all", F.sum("count").over(Window.partitionBy(F.lit(0)))).where("count > 0"))
    pieces = written(plan.withColumn("piece", F.explode(F.expr(f"sequence(0L, (count - 1) div {SLOTS_PER_ROW})"))), "pieces")
    each = (pieces.repartition(max(1, pieces.count()), "number", "piece")
            .withColumn("j", F.explode(F.expr(f"sequence(piece * {SLOTS_PER_ROW}, "
                                              f"least(count, (piece + 1) * {SLOTS_PER_ROW}) - 1)")))
            .withColumn("pass", F.expr("j div blocks")).withColumn("at", F.expr("j % blocks")))
    own = F.xxhash64(F.lit(seed), "number", "pass")
    remains = F.col("rest") - F.col("at") * block
    tail = F.col("source_size") - F.col("full") * block
    length = F.when(F.col("pass") < F.col("passes"), F.when(F.col("at") < F.col("full"), F.lit(block)).otherwise(tail)
                    ).otherwise(F.least(remains, F.lit(block)))
    place = permuted(F.col("offset") + F.col("j"), F.col("all"), F.lit(seed).cast("long"))
    return (each.withColumn("block", F.when(F.col("at") < F.col("full"), permuted(F.col("at"), F.col("full"), own))
                            .otherwise(F.col("at")))
            .withColumn("length", length.cast("long")).withColumn("place", place)
            .select(F.expr(f"place div {shard_slots}").alias("shard"), (F.col("place") % shard_slots).alias("slot"),
                    "number", "block", "length"))


def mixed(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source",
          weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 256,
          shard_slots: int = 4096, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(documents, parts) of the mix.

    documents: (doc_id, source, key, size, source_size, target, taken) of every row of ``docs``; taken
    counts the words that the mix takes, repeats included; ``key`` is a checksum of the text, which
    tells rows of one id apart. parts: (shard, slot, doc_id, number, start, length): the words of
    which documents fill each slot.

    A source's documents, one after the other in a hashed order, form a stream of words that is cut
    into blocks of ``block`` words; slots and blocks are joined by source and block index. Reruns
    give the same mix. NULL and wordless texts have size 0 and are never taken. NULL sources are one
    source. Repeated rows are rows of their own; an empty table gives no rows; other columns are not
    used. ``most`` must be 2 or less for a document's words to be taken twice at most.
    """
    content = F.col(text)
    sized = written(docs.select(F.col(id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(content).alias("key"),
                                F.size(words(content)).cast("long").alias("size")), "sizes")
    targets = written(source_targets(sized, weights, share, most), "targets")
    n = sized.count()
    known = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    streams = written(running_sum(known, "number", "size", ["doc_id", "key", "size"], "start", n), "streams")
    pieces = (streams.where("size > 0")
              .select("doc_id", "number", "start", "size", F.explode(F.expr(
                  f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
              .withColumn("from", F.greatest(F.col("start") - F.col("block") * block, F.lit(0)))
              .withColumn("to", F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))))
    # Slots unfold from few rows, by which Spark would take them for small and broadcast them.
    parts = (slots(targets, block, shard_slots, seed).hint("merge").join(pieces, ["number", "block"])
             .withColumn("length", F.least("to", "length") - F.col("from")).where("length > 0")
             .select("shard", "slot", "doc_id", "number", "start", "length"))
    taken = parts.groupBy("number", "start").agg(F.sum("length").alias("taken"))
    some = streams.where("size > 0").join(taken, ["number", "start"], "left")
    documents = some.unionByName(streams.where("size = 0").withColumn("taken", F.lit(None).cast("long")))
    return documents.select("doc_id", "source", "key", "size", "source_size", "target",
                            F.coalesce("taken", F.lit(0).cast("long")).alias("taken")), parts
