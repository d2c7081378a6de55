"""8-connected regions of marked pixels, labelled by tiles.

Images may be larger than a task: pixels are grouped by tile, a tile's pixels become runs per row that are united where
runs of neighbouring rows touch, and the labels of a tile meet those of the next ones only where pixels on
both sides of an edge touch.  Labels that meet form a graph that is far smaller than the pixels; its components
(smallest label) follow by joins.  A label is the place of the first pixel in reading order, so it does
not depend on tiles or partitions.

Defined results: no marked pixels give no regions; repeated pixels count once (the largest base stays);
images of any size and rows in any order give the same labels; null coordinates or keys are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Side of a tile in pixels; a task holds one tile at a time.
TILE = 512


def place(y: Column, x: Column) -> Column:
    """Reading order of pixels as one number."""
    return F.shiftleft(y.cast("long"), 32) + x.cast("long")


def tile_labels(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For pixels in reading order without repeats: the index of the first pixel of each one's region."""
    new = np.ones(len(y), dtype=bool)
    new[1:] = (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(y)) - 1
    run_y, low, high = y[first], x[first], x[last]
    parent = list(range(len(first)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    above = 0  # the first run that may still touch a later one
    for k in range(len(first)):
        while above < k and (run_y[above] < run_y[k] - 1 or (run_y[above] == run_y[k] - 1 and high[above] < low[k] - 1)):
            above += 1
        at = above
        while at < k and run_y[at] == run_y[k] - 1 and low[at] <= high[k] + 1:
            a, b = root(at), root(k)
            parent[max(a, b)] = min(a, b)
            at += 1
    roots = np.array([root(k) for k in range(len(first))], dtype=np.int64)
    return first[roots][np.cumsum(new) - 1]


def _label(keys: list[str]):
    def run(table: pa.Table) -> pa.Table:
        y, x = (table.column(c).to_numpy() for c in ("y", "x"))
        order = np.lexsort((x, y))
        table = table.take(pa.array(order))
        y, x = y[order], x[order]
        first = tile_labels(y, x)
        return table.select([*keys, "y", "x", "base"]).append_column("label", pa.array((y[first].astype(np.int64) << 32) + x[first]))

    return run


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, label, region``: for each label in ``edges(keys, a, b)`` the smallest label that it reaches.

    Each round takes the smallest region among neighbours and then that region's own region, so long chains
    take about as many rounds as their length has bits; rounds end when no label falls.
    """
    both = cut(edges.union(edges.select(*keys, F.col("b"), F.col("a"))).toDF(*keys, "label", "other").distinct())
    found = both.groupBy(*keys, "label").agg(F.least("label", F.min("other")).alias("region"))
    while True:
        found = cut(found)
        near = both.join(found.withColumnsRenamed({"label": "other", "region": "r"}), [*keys, "other"]).groupBy(*keys, "label").agg(F.min("r").alias("r"))
        lower = found.join(near, [*keys, "label"]).select(*keys, "label", F.col("region").alias("was"), F.least("region", "r").alias("region"))
        # what a region's first label falls to, all its labels fall to
        hook = lower.groupBy(*keys, "was").agg(F.min("region").alias("to")).withColumnRenamed("was", "region")
        moved = lower.select(*keys, "label", "was", "region").join(hook, [*keys, "region"], "left")
        moved = cut(moved.select(*keys, "label", "was", F.least("region", F.coalesce("to", "region")).alias("region")))
        found = moved.drop("was")
        if moved.filter("region < was").isEmpty():
            return found


def label_regions(pixels: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """``keys, y, x, base, region`` of marked pixels ``(keys, y, x, base)``; ``region`` is the place of its first pixel."""
    known = pixels.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("base").cast("int").alias("base")).dropna(subset=[*keys, "y", "x"])
    known = known.groupBy(*keys, "y", "x").agg(F.max("base").alias("base"))
    kinds = {f.name: f.dataType.simpleString() for f in known.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "y", "x", "base")) + ", label bigint"
    tiled = known.withColumn("ty", F.floor(F.col("y") / tile)).withColumn("tx", F.floor(F.col("x") / tile))
    labelled = cut(tiled.groupBy(*keys, "ty", "tx").applyInArrow(_label(keys), schema))
    # pixels on the first row or column of a tile look across its edge
    across = F.when(F.pmod("y", F.lit(tile)) == 0, F.array(*(F.struct(F.lit(-1).alias("dy"), F.lit(d).alias("dx")) for d in (-1, 0, 1)))).otherwise(F.array())
    aside = F.when(F.pmod("x", F.lit(tile)) == 0, F.array(*(F.struct(F.lit(d).alias("dy"), F.lit(-1).alias("dx")) for d in (-1, 0, 1)))).otherwise(F.array())
    looks = labelled.select(*keys, "y", "x", F.col("label").alias("a"), F.explode(F.array_union(across, aside)).alias("d"))
    looks = looks.select(*keys, (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"), "a")
    edges = looks.join(labelled.select(*keys, "y", "x", F.col("label").alias("b")), [*keys, "y", "x"]).filter("a <> b").select(*keys, "a", "b").distinct()
    merged = components(edges, keys)
    return labelled.join(merged, [*keys, "label"], "left").select(*keys, "y", "x", "base", F.coalesce("region", "label").alias("region"))


def spot_pixels(probability: DataFrame, keys: list[str], threshold: float = 0.5, channel: str = "ch", value: str = "p") -> DataFrame:
    """Marked pixels of probabilities ``(keys, ch, y, x, p)``: any channel above the threshold; ``base`` is 1 + the channel of the largest, the first among equals."""
    best = F.max_by(F.col(channel), F.struct(F.col(value), -F.col(channel)))
    return probability.groupBy(*keys, "y", "x").agg(F.max(value).alias("_top"), best.alias("_ch")).filter(F.col("_top") > threshold).select(*keys, "y", "x", (F.col("_ch") + 1).cast("int").alias("base"))


def region_calls(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, region, base, y, x, n``: a call at the centroid of each region, or of each base in a region of several.

    With one base the intensity-weighted centroid is the mean place; with several, each base's pixels have a mean of their own.  Halves go to even.
    """
    mean = lambda c: F.rint(F.sum(c) / F.count("*")).cast("int").alias(c)
    return labelled.groupBy(*keys, "region", "base").agg(mean("y"), mean("x"), F.count("*").alias("n"))
