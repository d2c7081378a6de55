"""Distribution tests and summaries of long tables (group, value)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import ratio
from .prefix import running


def ks_statistic(df: DataFrame, keys: list[str], value: str = "x", first: str = "is_first") -> DataFrame:
    """Two-sample KS: sup of the gap of both distribution functions, per key.

    Rows are pre-aggregated to distinct values; ``first`` marks the first sample.
    """
    each = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, value).agg(F.count_if(F.col(first)).alias("a"), F.count_if(~F.col(first)).alias("b"))
    rows = running(each, keys, [(value, False)], {"ca": ("sum", "a"), "cb": ("sum", "b")}, {"na": ("sum", "a"), "nb": ("sum", "b")})
    return rows.groupBy(*keys).agg(F.max(F.abs(ratio(F.col("ca"), F.col("na")) - ratio(F.col("cb"), F.col("nb")))).alias("ks"), F.max("na").alias("n1"), F.max("nb").alias("n2"))


def ks_p_value(ks: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p: ``2 sum (-1)^(k-1) exp(-2 k^2 t^2)`` with ``t = ks sqrt(n1 n2 / (n1 + n2))``."""
    t2 = ks * ks * n1 * n2 / (n1 + n2)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * t2))
    return F.when(t2 < 0.04, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * total)))


def exact_ks_p(ks: float, m: int, n: int) -> float:
    """Share of all orders of both samples whose gap reaches ``ks``: the mass that leaves the band on the way to (m, n)."""
    g = math.gcd(m, n)
    h = round(ks * (m // g) * n)
    if h == 0:
        return 1.0
    i = np.arange(m + 1)
    inside, left = np.zeros(m + 1), 0.0
    inside[0] = 1.0
    for k in range(m + n):
        step = inside * (n - k + i) / (m + n - k)
        step[1:] += (inside * (m - i) / (m + n - k))[:-1]
        out = np.abs(i * (n // g) - (k + 1 - i) * (m // g)) >= h
        left += step[out].sum()
        step[out] = 0.0
        inside = step
    return min(1.0, left)


def ks_p_auto(ks: Column, n1: Column, n2: Column, most: int = 10_000) -> Column:
    """Exact p where both samples have ``most`` values or fewer, the series above."""

    @F.pandas_udf("double")
    def exact(ks: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        known = ks.notna() & n1.gt(0) & n2.gt(0) & n1.le(most) & n2.le(most)
        return pd.Series([exact_ks_p(float(d), int(m), int(n)) if k else None for d, m, n, k in zip(ks, n1, n2, known)], dtype="float64")

    return F.when(F.greatest(n1, n2) <= most, exact(ks, n1, n2)).otherwise(ks_p_value(ks, n1, n2))


def bh_fdr(df: DataFrame, p: str = "p", keys: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg: running minimum of ``p n / rank`` from the largest p down; a null p has a null result and does not count.

    Equal values share the largest rank, so both passes run over distinct values.
    """
    keys = keys or []
    each = df.filter(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("_m"))
    ranked = running(each, keys, [(p, False)], {"_r": ("sum", "_m")}, {"_n": ("sum", "_m")})
    ranked = ranked.withColumn("_v", F.col(p) * F.col("_n") / F.col("_r"))
    low = running(ranked, keys, [(p, True)], {"_low": ("min", "_v")}).select(*keys, p, F.least(F.lit(1.0), F.col("_low")).alias("fdr"))
    same = F.lit(True)
    for c in (*keys, p):
        same &= df[c].eqNullSafe(low[c])
    return df.join(low, same, "left").select(*(df[c] for c in df.columns), "fdr")


def above_kth(df: DataFrame, value: str, k: int) -> DataFrame:
    """Rows strictly above the (k+1)-th largest value; ties at the cut go."""
    cut = df.select(value).orderBy(F.desc(value)).limit(k + 1).agg(F.min(value).alias("_cut"), F.count("*").alias("_n"))
    return df.join(F.broadcast(cut)).filter((F.col("_n") > k) & (F.col(value) > F.col("_cut"))).drop("_cut", "_n")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``bin, n, density`` over equal widths between minimum and maximum, the last bin closed."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    rows = df.filter(F.col(value).isNotNull()).join(F.broadcast(ends))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.lit(bins), F.floor(ratio(F.col(value) - F.col("lo"), width)) + 1).cast("int")
    return rows.groupBy(F.coalesce(at, F.lit(1)).alias("bin")).agg(F.count("*").alias("n"), F.first(ratio(F.lit(1), F.col("total") * width)).alias("_unit")).select("bin", "n", (F.col("n") * F.col("_unit")).alias("density"))


def gaussian_kde(df: DataFrame, value: str, points: int) -> DataFrame:
    """Density at evenly spaced points, Scott bandwidth; each row adds to all points at once (one pass)."""
    stats = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"), F.stddev_samp(value).alias("sd"))
    rows = df.join(F.broadcast(stats)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points))))
    at = F.col("lo") + F.col("k") * (F.col("hi") - F.col("lo")) / points
    h = F.pow("total", F.lit(-0.2)) * F.col("sd")
    u = ratio(F.col(value) - at, h)
    return rows.groupBy("k").agg((F.avg(F.exp(-0.5 * u * u)) / (F.first(h) * F.lit(2.5066282746310002))).alias("density"))
