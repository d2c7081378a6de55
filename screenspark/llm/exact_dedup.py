"""Exact duplicates by a tree-merge of sorted digest runs.

Every input partition is a run of text digests.  Runs of neighbouring partitions are
exchanged and merged in rounds; a round folds ``FAN_IN`` = 2**3 runs, three binomial steps,
into one, so P partitions need ceil(log8 P) rounds.  Each level keeps, per digest, the
smallest identifier and the number of rows seen; a partial combine runs before each
exchange, so a text that makes up a third of all rows is one row per run from the start.
Runs are cut into digest ranges (``buckets``), and the merges of different ranges are
independent, so no task ever holds a whole run.

Two texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` became one space.
A digest is SHA-256 of the normalised UTF-8 text; a merge also compares its byte length and
a second, independent 64-bit hash, and fails on a SHA-256 match that these contradict.

Defined results: null text counts as empty, and empty texts are equal; rows with a null id
belong to their text's group, are counted, and stay only if the whole group has null ids;
of repeated rows with the smallest id exactly one stays; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, free_names, join_counted, materialise, small_side

FAN_BITS = 3
BUCKETS = 4096
_SPACES = r"[\x20\x09-\x0D]+"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: its row position, run (input partition) and digest."""
    text = F.regexp_replace("text", _SPACES, " ")
    return (
        documents(docs, id_col, text_col)
        .withColumn("text", text)
        .select(
            "doc_id",
            F.monotonically_increasing_id().alias("pos"),
            F.spark_partition_id().alias("run"),
            F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
            F.octet_length("text").cast("long").alias("n_bytes"),
            F.xxhash64("text").alias("check"),
        )
    )


def merge_runs(digest_rows: DataFrame, runs: int, buckets: int = BUCKETS, fan_bits: int = FAN_BITS) -> DataFrame:
    """Winners per digest: ``sha, first`` (struct of the smallest doc_id and its row position), ``rows``."""
    level = digest_rows.select(
        (F.conv(F.substring("sha", 1, 4), 16, 10).cast("int") % buckets).alias("bucket"),
        F.col("run").alias("node"),
        "sha",
        # null ids sort after all others
        F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "pos").alias("first"),
        F.lit(1).cast("long").alias("rows"),
        F.struct("n_bytes", "check").alias("proof"),
    )
    node, rounds = F.col("node"), 0
    while rounds == 0 or (1 << (fan_bits * rounds)) < runs:
        # a struct minimum makes Spark plan a sort-based aggregate: sorted runs merged in order
        level = (
            level.withColumn("node", F.shiftright(node, fan_bits))
            .groupBy("bucket", "node", "sha")
            .agg(F.min("first").alias("first"), F.sum("rows").alias("rows"), F.min("proof").alias("proof"), F.max("proof").alias("other"))
            .withColumn("rows", F.when(F.col("proof") == F.col("other"), F.col("rows")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long")))
            .drop("other")
        )
        rounds += 1
    return level.select("sha", "first", "rows")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, n_bytes`` for every row of ``docs``."""
    rows = materialise(digests(docs, id_col, text_col))
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    winners = materialise(merge_runs(rows, runs).withColumn("m", F.col("rows")))
    return join_counted(rows, winners, "sha", "m").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("rows").alias("group_size"),
        (F.col("pos") == F.col("first.pos")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "n_bytes",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Where ids are unique and not null this is an anti-join on the ids that go, mostly the fewer.  Rows that share an
    id with a row that stays are told apart by their normalised text, and one row of each is kept.
    """
    found = materialise(exact_duplicates(docs, id_col, text_col).select("doc_id", "kept", "text_sha256"))
    kept_id, kept_sha, own_sha = free_names(docs, "kept_id", "kept_sha", "own_sha")
    kept = found.filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha))
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), _SPACES, " ").cast("binary"), 256)
    same_id = F.col(kept_id).eqNullSafe(F.col(id_col).cast("long"))
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("kept").alias("k")).filter("n > 1 and k > 0").limit(1).count() > 0
    if not repeated:
        gone = materialise(found.filter("not kept and doc_id is not null").select(F.col("doc_id").alias(kept_id)))
        if found.filter("doc_id is null").isEmpty():
            return docs.join(small_side(gone), same_id, "left_anti")
        return docs.join(kept, same_id, "left_semi")
    marked = docs.withColumn(own_sha, sha)
    out = marked.join(kept, same_id & (F.col(kept_sha) == F.col(own_sha)), "left_semi")
    return out.dropDuplicates([id_col, own_sha]).drop(own_sha)
