"""Sliding windows, runs, schedules and small vector rules of training logs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import norm
from .prefix import last_values, row_numbers, running


def smoothed(df: DataFrame, key: str, order: list[str], value: str, width: int = 20) -> DataFrame:
    """Lower median, mean, maximum of the last ``width`` values, and the running mean; a key may be a third of all rows."""
    along = [(c, False) for c in order]
    sums = running(df.withColumn("_one", F.when(F.col(value).isNotNull(), 1)), [key], along, {"_s": ("sum", value), "_c": ("sum", "_one")})
    near = last_values(sums, [key], along, value, width, "_near")
    values = F.sort_array(F.array_compact("_near"))
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, v: s + v), F.size(values))
    median = F.get(values, F.ceil(F.size(values) / 2).cast("int") - 1)
    return near.select(*df.columns, median.alias("median"), mean.alias("mean"), F.array_max(values).alias("top"), F.try_divide("_s", "_c").alias("global_mean"))


def run_lengths(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Runs of equal values: ``run, value, n, end`` with the running end index."""
    along = Window.partitionBy(key).orderBy(order)
    marked = df.withColumn("_new", F.when(F.lag(value).over(along).eqNullSafe(F.col(value)), 0).otherwise(1)).withColumn("run", F.sum("_new").over(along))
    runs = marked.groupBy(key, "run").agg(F.first(value).alias("value"), F.count("*").alias("n"))
    return runs.withColumn("end", F.sum("n").over(Window.partitionBy(key).orderBy("run")))


def cosine_schedule(step: Column, base: float, final: float, steps: int, warmup: int, start: float = 0.0) -> Column:
    """The value at a step: a linear warm-up (end point included), then half a cosine."""
    ramp = F.lit(start) + (base - start) * step / max(1, warmup - 1)
    wave = F.lit(final) + 0.5 * (base - final) * (1 + F.cos(F.lit(math.pi) * (step - warmup) / (steps - warmup)))
    return F.when(step < warmup, ramp).otherwise(wave)


def temperature_schedule(epoch: Column, start: float, final: float, warmup: int) -> Column:
    """The value at an epoch: a linear warm-up, then constant."""
    return F.when(epoch < warmup, F.lit(start) + (final - start) * epoch / max(1, warmup - 1)).otherwise(F.lit(final))


def clip_coefficient(vector: Column, clip: float) -> Column:
    return F.least(F.lit(1.0), clip / (norm(vector) + 1e-6))


def balanced_sample(df: DataFrame, keys: list[str], label: str, ident: str, seed: str) -> DataFrame:
    """As many rows of either class of a key (``label`` true or false) as the smaller one has, in the order of a hash of the id.

    A key without rows of one class keeps none.
    """
    sizes = df.groupBy(*keys).agg(F.least(F.count_if(F.col(label)), F.count_if(~F.col(label))).alias("_n"))
    hashed = df.filter(F.col(label).isNotNull()).withColumn("_h", F.md5(F.concat(F.col(ident).cast("string"), F.lit(seed)).cast("binary")))
    ranked = row_numbers(hashed, [*keys, label], [("_h", False), (ident, False)], "_r")
    return ranked.join(sizes, keys).filter("_r <= _n").select(*df.columns)
