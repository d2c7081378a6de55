"""Long-form normalisation of features against in-batch controls, and roll-ups.

Tables are long: keys, ``dim``, ``x``.  Statistics are two small aggregates per (batch, dim).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import ratio

#: Third quartile of the normal distribution, to the digits the results are defined with; fixed value.
MAD_SCALE = 0.67449
CONTROL = "nontargeting"


def to_long(df: DataFrame, features: str = "features", keys: list[str] | None = None) -> DataFrame:
    keys = keys or [c for c in df.columns if c != features]
    return df.select(*keys, F.posexplode(features).alias("dim", "x"))


def _controls(long: DataFrame, control: str, batch: str) -> DataFrame:
    return long.filter(F.col("gene_id") == control).select(batch, "dim", "x")


def robust_center_scale(long: DataFrame, control: str = CONTROL, batch: str = "plate_well") -> DataFrame:
    """``z = (x - median) / (MAD / 0.67449)`` by batch; a batch without controls or a zero MAD gives null."""
    own = _controls(long, control, batch)
    med = own.groupBy(batch, "dim").agg(F.median("x").alias("med"))
    mad = own.join(med, [batch, "dim"]).groupBy(batch, "dim").agg(F.median(F.abs(F.col("x") - F.col("med"))).alias("mad"))
    stats = med.join(mad, [batch, "dim"])
    return long.join(stats, [batch, "dim"], "left").withColumn("z", ratio(F.col("x") - F.col("med"), F.col("mad") / MAD_SCALE)).drop("med", "mad")


def center_scale(long: DataFrame, control: str = CONTROL, batch: str = "plate_well") -> DataFrame:
    """``z = (x - mean) / std`` of the batch's controls (sample deviation)."""
    stats = _controls(long, control, batch).groupBy(batch, "dim").agg(F.avg("x").alias("mu"), F.stddev_samp("x").alias("sd"))
    return long.join(stats, [batch, "dim"], "left").withColumn("z", ratio(F.col("x") - F.col("mu"), F.col("sd"))).drop("mu", "sd")


def scale_vectors(df: DataFrame, robust: bool = True, features: str = "features", control: str = CONTROL, batch: str = "plate_well") -> DataFrame:
    """``df`` with its feature vectors scaled like ``robust_center_scale`` (or ``center_scale``) does, row by row.

    Only controls are exploded; statistics come back as one array row per batch, so what is joined to the
    cells is their vectors as they are (or nothing is shuffled, where Spark finds the statistics small).
    """
    own = _controls(to_long(df.select("gene_id", batch, features), features), control, batch)
    if robust:
        centre = own.groupBy(batch, "dim").agg(F.median("x").alias("c"))
        spread = own.join(centre, [batch, "dim"]).groupBy(batch, "dim").agg(F.first("c").alias("c"), (F.median(F.abs(F.col("x") - F.col("c"))) / MAD_SCALE).alias("s"))
    else:
        spread = own.groupBy(batch, "dim").agg(F.avg("x").alias("c"), F.stddev_samp("x").alias("s"))
    stats = spread.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct("dim", "c", "s"))).alias("stats"))
    scaled = F.transform(features, lambda x, i: ratio(x - F.get("stats", i)["c"], F.get("stats", i)["s"]))
    return df.join(stats, batch, "left").withColumn(features, scaled).select(*df.columns)


def normalize(long: DataFrame, method=robust_center_scale, control: str = CONTROL, batch: str = "plate_well") -> DataFrame:
    return method(long, control, batch)


def drop_nan_dims(long: DataFrame, value: str = "z") -> DataFrame:
    """Drops a dim for all rows if any of its values is null or NaN."""
    bad = long.groupBy("dim").agg(F.max(F.col(value).isNull() | F.isnan(value)).alias("bad")).filter("bad").select("dim")
    return long.join(bad, "dim", "left_anti")


def roll_up(long: DataFrame, keys: list[str], method: str = "mean", value: str = "z") -> DataFrame:
    """Mean or exact median per key and dim; NaN counts as missing and null keys go."""
    if method not in ("mean", "median"):
        raise ValueError(method)
    clean: Column = F.when(~F.isnan(value), F.col(value))
    agg = F.avg(clean) if method == "mean" else F.median(clean)
    return long.filter(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys, "dim").agg(agg.alias(value))


def by_guide(long: DataFrame, method: str = "mean") -> DataFrame:
    return roll_up(long, ["barcode", "gene_id"], method)


def by_gene(long: DataFrame, method: str = "median") -> DataFrame:
    return roll_up(long, ["gene_id"], method)


def to_vectors(long: DataFrame, keys: list[str], value: str = "z") -> DataFrame:
    """One row per key with ``features``, ordered by dim."""
    pairs = F.sort_array(F.collect_list(F.struct("dim", value)))
    return long.groupBy(*keys).agg(F.transform(pairs, lambda p: p[value]).alias("features"))
