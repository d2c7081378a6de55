"""Classifier and retrieval curves from (label, score) rows.

A first aggregate per distinct score (with partial combine) comes before any running sum, and running sums go in two levels
(``prefix``), so neither a class nor a query with many rows meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import ratio
from .prefix import running


def cumulative(df: DataFrame, keys: list[str] | None = None, y: str = "y", score: str = "score", ahead: dict[str, str] | None = None) -> DataFrame:
    """Per distinct score, from high to low: true and false positives at or above it."""
    keys = keys or []
    each = df.groupBy(*keys, score).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum(1 - F.col(y).cast("long")).alias("n"))
    return running(each, keys, [(score, True)], {"tp": ("sum", "p"), "fp": ("sum", "n")}, {"pos": ("sum", "p"), "neg": ("sum", "n")}, ahead)


def roc_curve(df: DataFrame) -> DataFrame:
    """``threshold, fpr, tpr`` from (0, 0) at an infinite threshold on; points between equal steps lie on a line and are left out."""
    rows = cumulative(df, ahead={"p_next": "p", "n_next": "n"})
    first = (F.col("tp") == F.col("p")) & (F.col("fp") == F.col("n"))
    turns = F.col("p_next").isNull() | (F.col("p") != F.col("p_next")) | (F.col("n") != F.col("n_next"))
    points = rows.filter(first | turns).select(F.col("score").cast("double").alias("threshold"), ratio(F.col("fp"), F.col("neg")).alias("fpr"), ratio(F.col("tp"), F.col("pos")).alias("tpr"))
    return points.union(df.sparkSession.createDataFrame([(math.inf, 0.0, 0.0)], "threshold double, fpr double, tpr double"))


def tpr_at_fpr(curve: DataFrame, rates: tuple[float, ...] = (0.05, 0.1)) -> DataFrame:
    """Linear interpolation of the curve (with (0, 0)) at some rates; of equal fpr the last point counts."""
    points = curve.select("fpr", "tpr").union(curve.sparkSession.createDataFrame([(0.0, 0.0)], "fpr double, tpr double"))
    rows = points.withColumn("rate", F.explode(F.array(*map(F.lit, rates))))
    left, right = F.col("fpr") <= F.col("rate"), F.col("fpr") > F.col("rate")
    ends = rows.groupBy("rate").agg(F.max(F.when(left, F.struct("fpr", "tpr"))).alias("l"), F.min(F.when(right, F.struct("fpr", "tpr"))).alias("r"))
    value = F.when(F.col("r").isNull(), F.col("l.tpr")).otherwise(F.col("l.tpr") + (F.col("rate") - F.col("l.fpr")) * ratio(F.col("r.tpr") - F.col("l.tpr"), F.col("r.fpr") - F.col("l.fpr")))
    return ends.select("rate", value.alias("tpr"))


def roc_auc(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Area under the curve with half credit for ties; null with one class only."""
    keys = keys or []
    rows = cumulative(df, keys).withColumn("part", F.col("p") * (F.col("neg") - F.col("fp")) + 0.5 * F.col("p") * F.col("n"))
    return rows.groupBy(*keys).agg(ratio(F.sum("part"), F.max(F.col("pos") * F.col("neg"))).alias("auc"))


def pr_curve(df: DataFrame) -> DataFrame:
    """``threshold, precision, recall`` at each distinct score, and the end point (1, 0) without a threshold."""
    points = cumulative(df).select(F.col("score").cast("double").alias("threshold"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("pos")).alias("recall"))
    return points.union(df.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double"))


def average_precision(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Step sum of precision over recall gains."""
    keys = keys or []
    rows = cumulative(df, keys)
    return rows.groupBy(*keys).agg(F.sum(ratio(F.col("p"), F.col("pos")) * ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("ap"))


def retrieval_ap(ranked: DataFrame, query: str = "query", relevant: str | None = None) -> DataFrame:
    """Trapezoid average precision of ``query, rank`` (0-based rank of each positive).

    The sum is divided by the positives that exist: the column ``relevant``, or those that were found.
    """
    rows = ranked.select(query, "rank", F.lit(1).cast("long").alias("_one"), *([relevant] if relevant else []))
    rows = running(rows, [query], [("rank", False)], {"_j": ("sum", "_one")}, {"_n": ("sum", "_one")}).withColumn("j", F.col("_j") - 1)
    all_of = F.col(relevant) if relevant else F.col("_n")
    before = F.when(F.col("rank") == 0, F.lit(1.0)).otherwise(ratio(F.col("j"), F.col("rank")))
    after = (F.col("j") + 1) / (F.col("rank") + 1)
    return rows.groupBy(query).agg(F.sum((before + after) / (2.0 * all_of)).alias("ap"))


def mean_over_queries(values: DataFrame, queries: DataFrame, value: str, query: str = "query") -> DataFrame:
    """``queries, judged, mean``: the mean of a per-query value over the queries that have positives; the others are left out of it."""
    joined = queries.select(query).distinct().join(values.select(query, value), query, "left")
    return joined.agg(F.count("*").alias("queries"), F.count(value).alias("judged"), F.avg(value).alias("mean"))


def without_junk(ranked: DataFrame, query: str = "query") -> DataFrame:
    """Ranks of positives after junk rows before them are taken out; ``kind`` is ok, junk or other."""
    rows = running(ranked.withColumn("_junk", (F.col("kind") == "junk").cast("long")), [query], [("rank", False)], {"junk": ("sum", "_junk")})
    return rows.filter("kind = 'ok'").select(query, (F.col("rank") - F.col("junk")).alias("rank"))


def precision_at(ranked: DataFrame, k: int, query: str = "query") -> DataFrame:
    """``hits / min(last positive, k)`` with 1-based ranks of positives; a query keeps its first k ranks at most."""
    kq = F.least(F.max("pos"), F.lit(k))
    tops = ranked.withColumn("pos", F.col("rank") + 1).groupBy(query).agg(kq.alias("kq"), F.collect_list(F.when(F.col("pos") <= k, F.col("pos"))).alias("ps"))
    return tops.select(query, ratio(F.size(F.filter("ps", lambda p: p <= F.col("kq"))), F.col("kq")).alias("precision"))
