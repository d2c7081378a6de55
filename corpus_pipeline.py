"""A training corpus from ``documents``: five stages, each written as Parquet and read again.

Stages take ``(spark, docs, sf_dir)`` and return a DataFrame; all but the last return the
columns of ``documents``.  Decisions: documents that the quality model rejects go; of equal
texts the one with the smallest id stays; of each group of near duplicates the one with the
smallest id stays; sources are repeated up to the mix's weights (every document at least
once); the last stage gives each remaining row's token ids as count and digests.

Defined results: columns beyond those of ``documents`` are dropped; null texts are empty ones and null
sources one source; rows with null or repeated ids are rows of their own in every stage (the stages
tell them apart by their texts); no documents give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenspark.llm import bpe, exact_dedup, jaccard, mixing, quality
from screenspark.llm.common import discard, join_counted, materialise, small_batches, small_side, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BPE_FILE = "byte_bpe_50k.json"
#: Pieces that a task remembers; fewer than by default, as the stages before leave an executor less room.
BPE_CACHE = 60_000


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score reaches the bound; the score is computed beside the row, so no text is shuffled."""
    weights, bias = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.keep_accepted(docs.select(*COLUMNS), weights, bias)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of links one row stays: the smallest id's, null ids last, of equal ids the one with the smallest text digest."""
    found = materialise(jaccard.jaccard_rows(docs))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_key")
    first = materialise(found.filter("c is not null").groupBy("c").agg(F.min(order).alias("first"), F.count("*").alias("m")))
    linked = join_counted(found.filter("c is not null"), first, "c", "m").select("doc_id", "text_key", F.lit(True).alias("linked"), (order != F.col("first")).alias("gone"))
    alone = found.filter("c is null").select("doc_id", "text_key", F.lit(False).alias("linked"), F.lit(False).alias("gone"))
    found = materialise(linked.union(alone))
    # ids that lose all their rows go by id alone, so that only repeated and null ids need the digest
    whole = materialise(found.filter("doc_id is not null").groupBy("doc_id").agg(F.every("gone").alias("gone")).filter("gone").select("doc_id"))
    some = found.filter("gone").join(whole, "doc_id", "left_anti").select("doc_id", "text_key").distinct().withColumn("stays", F.lit(False))
    again = found.filter("linked and not gone").groupBy("doc_id", "text_key").agg(F.count("*").alias("m")).filter("m > 1").select("doc_id", "text_key", F.lit(True).alias("stays"))
    keys = materialise(some.union(again))
    left = docs.join(small_side(whole), "doc_id", "left_anti").select(*COLUMNS)
    if keys.isEmpty():
        return left
    left = left.withColumn("own_key", jaccard.text_key(F.col("text")))
    left = left.join(keys.withColumnRenamed("doc_id", "id"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("text_key")), "left")
    one = left.filter("stays").dropDuplicates(["doc_id", "own_key"])
    return left.filter("stays is null").union(one).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.mixing_plan(docs)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    digests = bpe.token_digests(docs, public_tokenizers.path(BPE_FILE), cache=BPE_CACHE).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    with small_batches(spark):  # the batches' size is fixed when the rows are computed
        return materialise(digests)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = None
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        if kept is not None:  # nothing reads the stage before the last one any more
            discard(kept)
        kept = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier is trained by gradient descent and the tokenizer is a vocabulary file, so SQL
#: can express neither; tests hold the stages against brute force.
ORACLE_SQL = None
