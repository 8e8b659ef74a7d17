"""A training corpus from ``documents``: language, near-duplicates, benchmarks, mix, shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the
last return the columns of ``documents``. A stage's result is written as Parquet in the shared
folder and read again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowferry.llm import decontaminate, language, mixing, sharding, simhash
from rowferry.llm.common import table, unused, written

#: A document goes when it has no letters, or when no language has so much of the probability.
LEAST_SCORE = 0.5
#: Words of a shingle and most differing bits of SimHash near copies, as in op3_simhash.
SHINGLE, BITS = 3, 3
SHARDS = 40


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that language identification rejects: no letters, or no language stands out. NULL and
    empty texts go, repeated rows and NULL ids stay, an empty table stays empty, other columns are kept whatever their names."""
    model = language.train(docs.where(F.coalesce(~language.held_out(F.col("doc_id")), F.lit(True))))
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))  # columns called as the model's are safe in it
    return (language.languages(rows, model)
            .where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash group, fingerprints of three-word shingles that differ in at most 3 bits
    and chains of them: that with the least id, one without an id only if none has one. Of its repeated rows one stays; of
    different texts under that id, the one with the least checksum. Texts without a word, NULL ones among them, have
    fingerprint 0 and are one group; an empty table stays empty."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    found = simhash.near_duplicates(docs, width=SHINGLE, distance=BITS)
    kept = found.groupBy("class").agg(F.min(rank).alias("kept")).select("kept.*")
    key = unused(docs, "key")
    rows = docs.withColumn(key, F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows[key] == kept["key"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", key]).drop(key)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item. NULL and empty texts hold none; repeated rows
    go or stay together, whatever their ids; an empty table stays empty."""
    hit = (decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
           .where("contaminated").select(F.col("key").alias("hit")).distinct())
    return docs.join(hit, F.md5(docs["text"]) == hit["hit"], "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 times. A part of a document is rounded up with
    a probability equal to it, by a hash of id and text; so a source's expected words are its target.
    Repeated rows of one id and text are taken together. Documents without a word are not taken."""
    documents, _ = mixing.mixed(docs)
    rounded = F.expr("taken div size + if(pmod(xxhash64('copies', doc_id, key), size) < taken % size, 1, 0)")
    copies = (documents.where("size > 0").groupBy("doc_id", "key", "size").agg(F.sum("taken").alias("taken"))
              .select("doc_id", "key", rounded.cast("int").alias("copies")).where("copies > 0"))
    key, copy = unused(docs, "key"), unused(docs, "copy")
    rows = docs.withColumn(key, F.xxhash64("text")).dropDuplicates(["doc_id", key])
    same = rows["doc_id"].eqNullSafe(copies["doc_id"]) & (rows[key] == copies["key"])
    return (rows.join(copies, same).withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies["copies"])))
            .select(*[rows[c] for c in docs.columns]))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every row in a shard, NULL ids and texts and repeated rows as well; an empty table stays empty."""
    return sharding.shards(docs, sharding.grid(SHARDS))


STAGES = [
    ("language", in_known_language),
    ("near_copies", without_near_copies),
    ("benchmarks", without_benchmarks),
    ("mix", mixed),
    ("shards", sharded),
]

#: Models, fingerprints and permutations have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
