"""Cosine networks of guides and genes, and scores read from them.

Vectors here are aggregates (guides, genes), a few thousand rows whatever the number of cells; all pairs of them
are the result.  Unit vectors are dealt to blocks, each pair of blocks is one matrix product in a task of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..plans.lineage import cut

#: Rows of one block.
BLOCK = 1024


def _products(kind: pa.DataType):
    """``i, j, sim`` with i < j of the rows on side 0 with those on side 1; a zero vector has similarity 0, an incomplete one null."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        keys = np.array(table.column("k").to_pylist(), dtype=object)
        x = np.array(table.column("v").to_pylist(), dtype=np.float64)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, n, out=np.where(np.isnan(n), np.nan, np.zeros_like(x)), where=n > 0)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        sims = x[left] @ x[right].T
        ahead = keys[left][:, None] < keys[right]
        if table.column("p")[0].as_py() == table.column("q")[0].as_py():
            at, to = np.nonzero(ahead)
            i, j = left[at], right[to]
        else:
            at, to = (g.ravel() for g in np.indices(sims.shape))
            first = ahead[at, to]
            i, j = np.where(first, left[at], right[to]), np.where(first, right[to], left[at])
        found = sims[at, to]
        return pa.table([pa.array(keys[i], kind), pa.array(keys[j], kind), pa.array(found, mask=np.isnan(found))], names=["i", "j", "sim"])

    return run


def cosine_pairs(vectors: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """``i, j, sim`` for i < j; every unordered pair is formed once."""
    rows = cut(vectors.select(F.col(key).alias("k"), F.col("features").cast("array<double>").alias("v")))
    blocks = max(1, -(-rows.count() // block))
    own = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")
    left = rows.select(own.alias("p"), F.explode(F.sequence(own, F.lit(blocks - 1))).alias("q"), F.lit(0).alias("side"), "k", "v")
    right = rows.select(F.explode(F.sequence(F.lit(0), own)).alias("p"), own.alias("q"), F.lit(1).alias("side"), "k", "v")
    name = rows.schema["k"].dataType.simpleString()
    kind = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[name]
    return left.union(right).groupBy("p", "q").applyInArrow(_products(kind), f"i {name}, j {name}, sim double")


def subset(pairs: DataFrame, keys: DataFrame, absolute: bool = True) -> DataFrame:
    """Pairs with both ends in ``keys(k)``, by default with absolute similarity."""
    pairs = pairs.join(keys.select(F.col("k").alias("i")), "i", "left_semi").join(keys.select(F.col("k").alias("j")), "j", "left_semi")
    return pairs.withColumn("sim", F.abs("sim")) if absolute else pairs


def guide_consistency(guides: DataFrame) -> DataFrame:
    """Mean similarity of each guide to the other guides of its gene; null for single guides."""
    a = guides.select("gene_id", "barcode", F.col("features").alias("x"))
    b = guides.select("gene_id", F.col("barcode").alias("other"), F.col("features").alias("y"))
    sims = a.join(b, "gene_id").filter("barcode <> other").groupBy("gene_id", "barcode").agg(F.avg(cosine(F.col("x"), F.col("y"))).alias("score"))
    return guides.select("gene_id", "barcode").join(sims, ["gene_id", "barcode"], "left")


def offdiag_baseline(pairs: DataFrame, n: int) -> DataFrame:
    """Off-diagonal sum over n**2, the reference line of the score plot."""
    return pairs.agg((2 * F.sum("sim") / float(n * n)).alias("baseline"))


def gene_scores(scores: DataFrame) -> DataFrame:
    return scores.groupBy("gene_id").agg(F.avg("score").alias("mean_score"), F.median("score").alias("median_score"))


def fill_worst(scores: DataFrame, value: str = "score") -> DataFrame:
    """Missing and infinite scores become the worst finite one."""
    finite = F.when(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    worst = scores.agg(F.min(finite).alias("worst"))
    return scores.join(F.broadcast(worst)).withColumn(value, F.coalesce(finite, "worst")).drop("worst")
