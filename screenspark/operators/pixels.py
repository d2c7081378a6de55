"""Image steps on exploded pixels ``img, ch, y, x, v``.

Groups are single channels of one image, so exact percentiles and maxima have a bounded group;
neighbourhoods are boxes of tiles and lines of pixels.  Neither joins pixels, whose rows Spark takes for as few
as their images and would broadcast, and neither deals them out anew if they lie by image.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import ratio


def rescale(pixels: DataFrame, low: float = 0.1, high: float = 99.9, clip: bool = True) -> DataFrame:
    """``(v - lo) / (hi - lo)`` between two percentiles of each channel.

    Flat channels take lo = 0 and, within an image, one hi: the largest of their values and 1.
    """
    ends = pixels.groupBy("img", "ch").agg(F.percentile("v", F.array(F.lit(low / 100), F.lit(high / 100))).alias("q"))
    ends = ends.select("img", "ch", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    flat = F.col("lo") == F.col("hi")
    spare = F.greatest(F.lit(1.0), F.max(F.when(flat, F.col("hi"))).over(Window.partitionBy("img")))
    ends = ends.select("img", "ch", F.when(flat, 0.0).otherwise(F.col("lo")).alias("lo"), F.when(flat, spare).otherwise(F.col("hi")).alias("hi"))
    v = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return pixels.join(ends, ["img", "ch"]).withColumn("v", F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) if clip else v).select(*pixels.columns)


def divide_by_percentile(pixels: DataFrame, q: float = 70.0) -> DataFrame:
    """Each frame over its percentile; null where that is 0."""
    level = pixels.groupBy("img", "ch").agg(F.percentile("v", F.lit(q / 100)).alias("q"))
    return pixels.join(level, ["img", "ch"]).withColumn("v", ratio(F.col("v"), F.col("q"))).select(*pixels.columns)


def center_window(pixels: DataFrame, height: int, width: int, window: float) -> DataFrame:
    i, j = (int(n / 2.0 * (1 - 1 / float(window))) for n in (height, width))
    return pixels.filter(F.col("y").between(i, height - i - 1) & F.col("x").between(j, width - j - 1))


def max_composite(pixels: DataFrame) -> DataFrame:
    """Largest value of all tiles that cover a mosaic pixel."""
    return pixels.groupBy("ch", "y", "x").agg(F.max("v").alias("v"))


def _box_max(before: int, after: int):
    """``img, id, ch, v`` of the spots (rows with ``spot``) of one tile, from its pixels."""
    reach = before + after

    def run(table: pa.Table) -> pa.Table:
        names = ["img", "id", "ch", "v"]
        is_spot = table.column("spot")
        spots, px = table.filter(is_spot), table.filter(pc.invert(is_spot))
        if not len(spots) or not len(px):
            return table.slice(0, 0).select(names)
        channels = px.column("ch").combine_chunks().dictionary_encode(null_encoding="encode")
        sy, sx, y, x = (t.column(c).to_numpy() for t in (spots, px) for c in ("y", "x"))
        y0, x0 = y.min() - after + 1, x.min() - after + 1  # the first places whose boxes meet a pixel
        shape = (int(y.max() - y0) + before + reach, int(x.max() - x0) + before + reach, len(channels.dictionary))
        at = (y - y0 + before, x - x0 + before, channels.indices.to_numpy())
        known = px.column("v").is_valid().to_numpy()
        v = px.column("v").to_numpy()
        best, found, valued = np.full(shape, -np.inf), np.zeros(shape, dtype=bool), np.zeros(shape, dtype=bool)
        np.maximum.at(best, tuple(k[known] for k in at), v[known])  # NaN counts as largest
        found[at] = True
        valued[tuple(k[known] for k in at)] = True
        for axis in (0, 1):
            views = lambda grid, axis=axis: [np.moveaxis(grid, axis, 0)[d : grid.shape[axis] - reach + 1 + d] for d in range(reach)]
            best, found, valued = (np.moveaxis(op.reduce(views(grid)), 0, axis) for op, grid in ((np.maximum, best), (np.logical_or, found), (np.logical_or, valued)))
        near = np.flatnonzero((sy >= y0) & (sy - y0 < best.shape[0]) & (sx >= x0) & (sx - x0 < best.shape[1]))
        here = (sy[near] - y0, sx[near] - x0)
        spot, ch = np.nonzero(found[here])
        own = spots.take(pa.array(near[spot]))
        top = pa.array(best[here][spot, ch], pa.float64(), mask=~valued[here][spot, ch])
        return pa.table([own.column("img"), own.column("id"), channels.dictionary.take(pa.array(ch)), top], names=names)

    return run


def max_around(spots: DataFrame, pixels: DataFrame, before: int, after: int, tile: int = 256) -> DataFrame:
    """``img, id, ch, v``: largest value in ``[y - before, y + after) x [x - before, x + after)``, cut at the image edge.

    Spots go to the tile that holds them, pixels to all tiles with places whose boxes they lie in; a tile is one group.
    Pixels that are dealt by a hash of ``img`` over ``spark.sql.shuffle.partitions`` stay where they are.
    """
    deal = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = lambda c: F.floor((c + (before + after)) / tile)
    meets = lambda c: F.explode(F.sequence(cell(F.col(c) - (after - 1)), cell(F.col(c) + before)))
    at = [F.col(c).cast("long").alias(c) for c in ("y", "x")]
    kind = {c: d.schema[c].dataType for d, c in ((spots, "id"), (pixels, "ch"))}
    px = pixels.select("img", F.lit(None).cast(kind["id"]).alias("id"), "ch", *at, F.col("v").cast("double").alias("v"), F.lit(False).alias("spot"))
    px = px.dropna(subset=["img", "y", "x"]).withColumn("ty", meets("y")).withColumn("tx", meets("x"))
    own = spots.select("img", "id", F.lit(None).cast(kind["ch"]).alias("ch"), *at, F.lit(None).cast("double").alias("v"), F.lit(True).alias("spot"))
    own = own.dropna(subset=["img", "y", "x"]).withColumn("ty", cell(F.col("y"))).withColumn("tx", cell(F.col("x"))).repartition(deal, "img")
    schema = px.select("img", "id", "ch", "v").schema
    parts = px.union(own).groupBy("img", "ty", "tx").applyInArrow(_box_max(before, after), schema)
    return parts.repartition("img", "id").groupBy("img", "id", "ch").agg(F.max("v").alias("v"))


def brightest_base(levels: DataFrame, bases: str = "CATG") -> DataFrame:
    """Base of the brightest channel; the first of equal ones."""
    best = levels.filter(F.col("ch") < len(bases)).groupBy("img", "id").agg(F.max(F.struct("v", (-F.col("ch")).alias("c"))).alias("m"))
    return best.select("img", "id", F.substring(F.lit(bases), 1 - F.col("m.c").cast("int"), F.lit(1)).alias("base"))


def weighted_centroid(pixels: DataFrame, region: Column) -> DataFrame:
    """Centre of each region weighted by value, rounded half to even; null where all weights are 0."""
    rows = pixels.withColumn("region", region)
    at = lambda c: F.rint(ratio(F.sum(F.col("v") * F.col(c)), F.sum("v")))
    return rows.groupBy("img", "ch", "region").agg(at("y").alias("y"), at("x").alias("x"))


def composite_rgb(pixels: DataFrame, colours: list[tuple[float, float, float]]) -> DataFrame:
    """Sum of channels times their colours, clipped to [0, 1]; a colour table entry per channel."""
    table = F.array(*(F.array(*map(F.lit, c)) for c in colours))
    part = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(F.col("v") * table[F.col("ch")][k])))
    return pixels.groupBy("img", "y", "x").agg(*(part(k).alias(n) for k, n in enumerate("rgb")))


def label_raster(spots: DataFrame, size: int, reach: int) -> DataFrame:
    """Distinct painted pixels ``img, base, y, x`` of squares around base calls; the last row and column stay free."""
    span = lambda c: F.explode(F.filter(F.sequence(F.col(c) - reach, F.col(c) + reach), lambda k: (k >= 0) & (k < size - 1)))
    rows = spots.select("img", "base", "x", span("y").alias("py"))
    return rows.select("img", "base", F.col("py").alias("y"), span("x").alias("x")).distinct()


def dice_loss(both: DataFrame, eps: float = 1e-7) -> DataFrame:
    """``1 - mean over channels of 2 sum(p q) / (sum p + sum q + eps)`` of columns ``ch, p, q``."""
    each = both.groupBy("ch").agg((2 * F.sum(F.col("p") * F.col("q")) / (F.sum("p") + F.sum("q") + eps)).alias("d"))
    return each.agg((1 - F.avg("d")).alias("loss"))


def fill_range(pixels: DataFrame, low: float, high: float, seed: str = "0") -> DataFrame:
    """Values outside two percentiles of their frame replaced by uniform noise between these, drawn by a hash of the pixel."""
    ends = pixels.groupBy("img", "ch").agg(F.percentile("v", F.array(F.lit(low / 100), F.lit(high / 100))).alias("q"))
    name = F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in ("img", "ch", "y", "x")))
    u = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    lo, hi = F.col("q")[0], F.col("q")[1]
    return pixels.join(ends, ["img", "ch"]).withColumn("v", F.when(F.col("v").between(lo, hi), F.col("v")).otherwise(lo + (hi - lo) * u)).select(*pixels.columns)


def shift(pixels: DataFrame, dy: int, dx: int) -> DataFrame:
    """Frames moved by whole pixels; what comes from outside is 0, and no offset leaves them as they are.

    A pixel and the one that moves to it lie on one line, so the value is looked up among the line's sorted pixels.
    """
    if not dy and not dx:
        return pixels
    along, step = ("y", dy) if dy else ("x", dx)
    line = Window.partitionBy("img", "ch", F.col("y") * dx - F.col("x") * dy).orderBy(along).rangeBetween(-step, -step)
    placed = F.col("img").isNotNull() & F.col("ch").isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull()
    return pixels.select("img", "ch", "y", "x", F.coalesce(F.when(placed, F.max("v").over(line)), F.lit(0.0)).alias("v"))


def half_turn(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Frames turned by 180 degrees; pixels outside the stated size raise."""
    inside = F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)
    turned = lambda c, n: F.when(inside, n - 1 - F.col(c)).otherwise(F.raise_error(F.lit("the image has another size")).cast("long"))
    return pixels.select("img", "ch", turned("y", height).alias("y"), turned("x", width).alias("x"), "v")
