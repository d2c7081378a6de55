"""Gene pairs against an edge list, and per-feature or per-gene tests built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .hypothesis import bh_fdr, ks_p_auto, ks_statistic


def mean_edges(edges: DataFrame) -> DataFrame:
    """One row per directed pair, repeated ones averaged (the long form of a pivot by mean)."""
    return edges.groupBy("g1", "g2").agg(F.avg("score").alias("score"))


def named_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Ids of ``edges(g1, g2, score)`` replaced by ``names(id, name)``; an unknown id raises when read."""
    for side in ("g1", "g2"):
        known = names.select(F.col("id").alias(side), F.col("name").alias("_n"))
        name = F.when(F.col("_n").isNull(), F.raise_error(F.concat(F.lit("no name for "), F.col(side).cast("string")))).otherwise(F.col("_n"))
        edges = edges.join(known, side, "left").withColumn(side, name).drop("_n")
    return edges


def scored_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``i, j, sim, score`` of pairs with both genes in the network; a missing edge scores 0."""
    genes = edges.select(F.explode(F.array("g1", "g2")).alias("g")).distinct()
    for side in ("i", "j"):
        pairs = pairs.join(genes.withColumnRenamed("g", side), side, "left_semi")
    known = mean_edges(edges).select(F.col("g1").alias("i"), F.col("g2").alias("j"), "score")
    return pairs.join(known, ["i", "j"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def labelled_pairs(scored: DataFrame, threshold: float) -> DataFrame:
    """Label 1 above the threshold, 0 without an edge; pairs in between go."""
    label = F.when(F.col("score") > threshold, 1).when(F.col("score") == 0, 0)
    return scored.withColumn("label", label).filter("label is not null")


def band(score: Column, low: float, high: float) -> Column:
    return F.when(score < low, "low").when(score < high, "mid").otherwise("high")


def band_quartiles(scored: DataFrame, low: float, high: float) -> DataFrame:
    q = F.percentile("sim", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    rows = scored.groupBy(band(F.col("score"), low, high).alias("band")).agg(F.count("*").alias("n"), q.alias("q"))
    return rows.select("band", "n", *(F.col("q")[k].alias(f"q{k}") for k in range(5)))


def band_tests(scored: DataFrame, low: float, high: float) -> DataFrame:
    """KS between bands with its p: high-low, mid-low, high-mid; a comparison without one of its bands is left out."""
    named = [("high-low", "high", "low"), ("mid-low", "mid", "low"), ("high-mid", "high", "mid")]
    at = band(F.col("score"), low, high)
    roles = F.array(*(F.when(at == a, F.struct(F.lit(n).alias("test"), F.lit(True).alias("is_first"))).when(at == b, F.struct(F.lit(n).alias("test"), F.lit(False).alias("is_first"))) for n, a, b in named))
    rows = scored.select("sim", F.explode(F.array_compact(roles)).alias("r")).select("sim", "r.test", "r.is_first")
    found = ks_statistic(rows, ["test"], "sim").filter("n1 > 0 and n2 > 0")
    return found.withColumn("p", ks_p_auto(F.col("ks"), F.col("n1"), F.col("n2")))


def volcano(samples: DataFrame, key: str, value: str = "x") -> DataFrame:
    """Per key: KS against control, its p (``hypothesis.ks_p_auto``), FDR over keys, median and direction of the first sample.

    ``samples`` holds ``key, value, is_first``; control rows have ``is_first`` false.
    """
    tests = ks_statistic(samples, [key], value).filter("n1 > 0 and n2 > 0")
    tests = cut(tests.withColumn("p", ks_p_auto(F.col("ks"), F.col("n1"), F.col("n2"))))
    mine, control = F.when(F.col("is_first"), F.col(value)), F.when(~F.col("is_first"), F.col(value))
    up = F.avg(mine) - F.avg(control)
    centre = samples.groupBy(key).agg(F.median(mine).alias("median"), F.when((up > 0) & ~F.isnan(up), 1).otherwise(-1).alias("direction"))
    return bh_fdr(tests).join(centre, key).withColumn("signed_ks", F.col("ks") * F.col("direction"))


def feature_samples(long: DataFrame, gene: str, control: str) -> DataFrame:
    """Rows of one gene and of control, tested per ``dim``."""
    return long.filter(F.col("gene_id").isin(gene, control)).select("dim", "x", (F.col("gene_id") == gene).alias("is_first"))


def gene_samples(long: DataFrame, dim: int, control: str) -> DataFrame:
    """Rows of one feature per gene, each with all control rows beside them (control against itself too).

    Control rows repeat once per gene: genes are at most a genome, tens of thousands.
    """
    one = long.filter(F.col("dim") == dim).select("gene_id", "x")
    genes = one.select("gene_id").distinct().agg(F.collect_set("gene_id").alias("genes"))
    against = one.filter(F.col("gene_id") == control).select("x").join(F.broadcast(genes)).select(F.explode("genes").alias("gene_id"), "x")
    return one.withColumn("is_first", F.lit(True)).unionByName(against.withColumn("is_first", F.lit(False)))


def wide_by_model(scores: DataFrame, models: list[str], passing: float) -> DataFrame:
    """``gene`` with a column per model (genes of the first model), its best model value and whether that passes."""
    medians = scores.groupBy("gene", "model").agg(F.median("auc").alias("auc"))
    wide = medians.groupBy("gene").pivot("model", models).agg(F.first("auc")).filter(F.col(models[0]).isNotNull())
    best = F.greatest(*models) if len(models) > 1 else F.col(models[0])
    return wide.withColumn("best", best).withColumn("passes", F.coalesce(F.col("best") > passing, F.lit(False)))
