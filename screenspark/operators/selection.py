"""Row selection, look-ups and small report columns of the analysis steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running


def minus_log10(p: Column) -> Column:
    """``-log10(p)``; infinity at 0."""
    return F.when(p == 0, F.lit(float("inf"))).otherwise(-F.log10(p))


def dot_size(score: Column, most: float, least: float) -> Column:
    """``max(score * most, least)``; NaN stays NaN."""
    return F.greatest(score * most, F.lit(least))


def normalise_channels(values: Column, means: list[float], deviations: list[float]) -> Column:
    """``(x - mean) / deviation`` of each channel."""
    params = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(d).alias("d")) for m, d in zip(means, deviations, strict=True)))
    return F.zip_with(values, params, lambda x, p: (x - p["m"]) / p["d"])


def string_names(df: DataFrame, names: list) -> DataFrame:
    """Columns renamed to the texts of ``names``."""
    return df.toDF(*map(str, names))


def exclude_names(df: DataFrame, columns: list[str], parts: list[str]) -> DataFrame:
    """Rows in whose columns none of the texts occurs, as a part of any value."""
    return df.filter(~reduce(lambda a, b: a | b, (F.col(c).contains(p) for c in columns for p in parts)))


def any_above(df: DataFrame, bounds: dict[str, float]) -> DataFrame:
    """Rows of which at least one column exceeds its bound."""
    return df.filter(reduce(lambda a, b: a | b, (F.col(c) > t for c, t in bounds.items())))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an explicit order; a minimum with a partial combine, so a hot key is no window."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return first.select(*keys, *(F.col("row")[c].alias(c) for c in rest)).select(*df.columns)


def key_report(df: DataFrame, key: str, column: str) -> DataFrame:
    """``rows``, ``kinds`` and whether a key has a single value in ``column`` (nulls do not count)."""
    return df.groupBy(key).agg(F.count("*").alias("rows"), F.count_distinct(column).alias("kinds")).withColumn("single", F.col("kinds") == 1)


def cluster_label(clusters: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with their ``cluster``; a key that the map lacks raises."""
    joined = rows.join(clusters.select(key, "cluster"), key, "left")
    missing = F.raise_error(F.concat(F.lit("no cluster for "), F.col(key).cast("string"))).cast(clusters.schema["cluster"].dataType)
    return joined.withColumn("cluster", F.coalesce("cluster", missing))


def top_k_accuracy(df: DataFrame, scores: str, label: str, ks: list[int]) -> DataFrame:
    """Percent of rows whose label is among the k highest scores, per k; of equal scores the earlier class is higher."""
    own = F.element_at(scores, F.col(label).cast("int") + 1)
    place = F.size(F.filter(scores, lambda s, i: (s > own) | ((s == own) & (i < F.col(label)))))
    hits = df.select(place.alias("place")).agg(*(F.avg((F.col("place") < k).cast("double")).alias(str(k)) for k in ks))
    return hits.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (100 * F.col(str(k))).alias("accuracy")) for k in ks))).alias("r")).select("r.k", "r.accuracy")


def final_average(df: DataFrame, key: str, order: list[str], value: str, momentum: float) -> DataFrame:
    """Last ``m a + (1 - m) b`` of each key's series, which starts at its first value.

    A value r places before the end has the weight ``(1 - m) m**r``, the first one ``m**r``, so the fold is a sum with a partial combine.
    """
    rows = df.select(key, *order, F.col(value).cast("double").alias("v"), F.lit(1).cast("long").alias("_one"))
    placed = running(rows, [key], [(c, False) for c in order], {"_at": ("sum", "_one")}, {"_all": ("sum", "_one")})
    ranked = placed.select(key, "v", (F.col("_all") - F.col("_at")).alias("r"), (F.col("_all") - 1).alias("first"))
    weight = F.pow(F.lit(momentum), "r") * F.when(F.col("r") == F.col("first"), 1.0).otherwise(1 - momentum)
    return ranked.groupBy(key).agg(F.sum(F.col("v") * weight).alias("ema"))
