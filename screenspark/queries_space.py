"""Registered queries on field geometry and pixels, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vectors import r6
from .operators import geometry, pixels, projection, spatial
from .plans import fixtures as fx
from .registry import query

S, SIDE, HALF = 0.5, 100, 2.5
MOTION = (0.998, 0.02, 1.5, -2.25)

_SRC = f"{fx.FOV}, src AS (SELECT event_id AS pid, event_id % 8 AS source_field_id, event_id * 31 % 100 AS x, event_id * 17 % 100 AS y FROM events)"


def _pixels_in_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").selectExpr("event_id AS pid", "event_id % 8 AS source_field_id", "event_id * 31 % 100 AS x", "event_id * 17 % 100 AS y")


@query(f"WITH {_SRC} SELECT pid, x0 + 0.5::DOUBLE * (99 - x) AS sx, y0 + 0.5::DOUBLE * y AS sy FROM src JOIN fov ON field_id = source_field_id")
def field_to_stage(spark, sf_dir):
    on = _pixels_in_fields(spark, sf_dir).join(fx.fov(spark), F.col("field_id") == F.col("source_field_id"))
    X, Y = geometry.field_to_stage(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), SIDE, S)
    return on.select("pid", X.alias("sx"), Y.alias("sy"))


@query(f"WITH {_SRC}, st AS (SELECT pid, x0, y0, x0 + 0.5::DOUBLE * (99 - x) AS sx, y0 + 0.5::DOUBLE * y AS sy FROM src JOIN fov ON field_id = source_field_id) SELECT pid, round(99 - (sx - x0) / 0.5::DOUBLE, 6) + 0.0 AS x, round((sy - y0) / 0.5::DOUBLE, 6) + 0.0 AS y FROM st")
def field_stage_round_trip(spark, sf_dir):
    on = _pixels_in_fields(spark, sf_dir).join(fx.fov(spark), F.col("field_id") == F.col("source_field_id"))
    there = geometry.field_to_stage(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), SIDE, S)
    x, y = geometry.stage_to_field(*there, F.col("x0"), F.col("y0"), SIDE, S)
    return on.select("pid", r6(x).alias("x"), r6(y).alias("y"))


@query(f"WITH {fx.FIELDS} SELECT well, min(x0) AS wx, min(y0) AS wy, CAST(round_even((max(x0) - min(x0)) / 0.5::DOUBLE, 0) + 100 AS INTEGER) AS ww, CAST(round_even((max(y0) - min(y0)) / 0.5::DOUBLE, 0) + 100 AS INTEGER) AS wh FROM fields GROUP BY well")
def well_extent(spark, sf_dir):
    return geometry.well_extent(fx.fields(spark, sf_dir), SIDE, SIDE, S, ["well"])


@query(f"""WITH {_SRC}, w AS (SELECT min(x0) AS wx, min(y0) AS wy, (max(y0) - min(y0)) / 0.5::DOUBLE + 100 AS wh FROM fov),
a AS (SELECT pid, source_field_id, (x0 + 0.5::DOUBLE * (99 - x) - wx) / 0.5::DOUBLE AS x, wh - 1 - (y0 + 0.5::DOUBLE * y - wy) / 0.5::DOUBLE AS y, wx, wy, wh FROM src JOIN fov ON field_id = source_field_id, w),
i AS (SELECT *, (0.998::DOUBLE * (x - 1.5) + 0.02::DOUBLE * (y + 2.25)) / (0.998::DOUBLE * 0.998 + 0.02::DOUBLE * 0.02) AS u, (0.998::DOUBLE * (y + 2.25) - 0.02::DOUBLE * (x - 1.5)) / (0.998::DOUBLE * 0.998 + 0.02::DOUBLE * 0.02) AS v FROM a),
s AS (SELECT pid, source_field_id, wx + 0.5::DOUBLE * u AS px, wy + 0.5::DOUBLE * (wh - 1 - v) AS py FROM i),
h AS (SELECT pid, field_id, px >= x0 + 2.5 AND px < x1 - 2.5 AND py >= y0 + 2.5 AND py < y1 - 2.5 AS core FROM s JOIN fov ON px >= x0 AND px < x1 AND py >= y0 AND py < y1),
t AS (SELECT pid, count(*) FILTER (core) AS n1, min(field_id) FILTER (core) AS f1, count(*) AS n2, min(field_id) AS f2 FROM h GROUP BY pid),
o AS (SELECT pid, CASE WHEN n1 = 1 THEN f1 WHEN n1 = 0 AND n2 = 1 THEN f2 END AS f FROM t)
SELECT s.pid, s.source_field_id, src.x AS source_x, src.y AS source_y, coalesce(f, -1) AS target_field_id, coalesce(round(99 - (px - x0) / 0.5::DOUBLE, 6) + 0.0, -1) AS target_x, coalesce(round((py - y0) / 0.5::DOUBLE, 6) + 0.0, -1) AS target_y
FROM s JOIN src ON src.pid = s.pid LEFT JOIN o ON o.pid = s.pid LEFT JOIN fov ON field_id = f""")
def project_pixels(spark, sf_dir):
    fov = fx.fov(spark)
    out = geometry.project_pixels(_pixels_in_fields(spark, sf_dir), fov, fov, (SIDE, SIDE), S, MOTION, HALF)
    none = F.lit(-1)
    return out.select("pid", "source_field_id", "source_x", "source_y", F.coalesce("target_field_id", none).alias("target_field_id"), F.coalesce(r6(F.col("target_x")), none).alias("target_x"), F.coalesce(r6(F.col("target_y")), none).alias("target_y"))


_WELLS = f"""{fx.FOV}, wells AS (SELECT DISTINCT user_id AS well FROM events), cyc AS (SELECT unnest(range(1, 4)) AS cycle),
fields AS (SELECT well, cycle, field_id, x0 + well % 7 * 10 + cycle * 2 AS x0, y0 - cycle AS y0 FROM wells, cyc, fov),
motions AS (SELECT well, cycle, 0.998::DOUBLE AS a, 0.02::DOUBLE * (cycle - 1) AS b, 1.5::DOUBLE * cycle AS tx, -2.25::DOUBLE * cycle AS ty FROM wells, cyc),
calls AS (SELECT user_id AS well, event_id % 3 + 1 AS cycle, event_id AS pid, event_id % 8 AS source_field_id, event_id * 31 % 100 AS x, event_id * 17 % 100 AS y, substr('CATG', event_id // 3 % 4 + 1, 1) AS base FROM events)"""


_LANDED = f"""{_WELLS}, src AS (SELECT well, cycle, min(x0) AS wx, min(y0) AS wy, (max(y0) - min(y0)) / 0.5::DOUBLE + 100 AS wh FROM fields GROUP BY ALL),
o AS (SELECT c.*, (f.x0 + 0.5::DOUBLE * (99 - x) - s.wx) / 0.5::DOUBLE AS u, s.wh - 1 - (f.y0 + 0.5::DOUBLE * y - s.wy) / 0.5::DOUBLE AS v, t.wx AS vx, t.wy AS vy, t.wh AS vh, a, b, tx, ty
  FROM calls c JOIN fields f ON f.well = c.well AND f.cycle = c.cycle AND field_id = source_field_id JOIN src s ON s.well = c.well AND s.cycle = c.cycle
  JOIN motions m ON m.well = c.well AND m.cycle = c.cycle JOIN src t ON t.well = c.well AND t.cycle = 1),
p AS (SELECT well, cycle, pid, source_field_id, x, y, base, vx + 0.5::DOUBLE * ((a * (u - tx) + b * (v - ty)) / (a * a + b * b)) AS px, vy + 0.5::DOUBLE * (vh - 1 - (a * (v - ty) - b * (u - tx)) / (a * a + b * b)) AS py FROM o),
h AS (SELECT p.*, field_id, x0, y0, px >= x0 + 2.5 AND px < x0 + 50 - 2.5 AND py >= y0 + 2.5 AND py < y0 + 50 - 2.5 AS core
  FROM p JOIN fields f ON f.well = p.well AND f.cycle = 1 AND px >= x0 AND px < x0 + 50 AND py >= y0 AND py < y0 + 50),
k AS (SELECT *, count(*) FILTER (core) OVER w AS n1, count(*) OVER w AS n2 FROM h WINDOW w AS (PARTITION BY pid)),
landed AS (SELECT well, cycle, pid, source_field_id, x AS source_x, y AS source_y, field_id, 99 - (px - x0) / 0.5::DOUBLE AS x, (py - y0) / 0.5::DOUBLE AS y, base
FROM k WHERE n1 = 1 AND core OR n1 = 0 AND n2 = 1)"""


def _wells(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    cycles = events.select(F.col("user_id").alias("well")).distinct().withColumn("cycle", F.explode(F.expr("sequence(1L, 3L)")))
    fields = cycles.withColumn("field_id", F.explode(F.expr("sequence(0L, 7L)"))).join(F.broadcast(fx.fov(spark)), "field_id")
    fields = fields.selectExpr("well", "cycle", "field_id", "x0 + well % 7 * 10 + cycle * 2 AS x0", "y0 - cycle AS y0").selectExpr("*", "x0 + 50 AS x1", "y0 + 50 AS y1")
    motions = cycles.selectExpr("well", "cycle", "0.998D AS a", "0.02D * (cycle - 1) AS b", "1.5D * cycle AS tx", "-2.25D * cycle AS ty")
    calls = events.selectExpr("user_id AS well", "event_id % 3 + 1 AS cycle", "event_id AS pid", "event_id % 8 AS source_field_id", "event_id * 31 % 100 AS x", "event_id * 17 % 100 AS y", "substring('CATG', CAST(event_id div 3 % 4 AS INT) + 1, 1) AS base")
    return calls, fields, motions


@query(f"WITH {_LANDED} SELECT well, cycle, pid, source_field_id, source_x, source_y, field_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM landed")
def project_first_cycle(spark, sf_dir):
    calls, fields, motions = _wells(spark, sf_dir)
    out = projection.project_calls(calls.drop("base"), fields, motions, (SIDE, SIDE), S, HALF)
    return out.withColumn("x", r6(F.col("x"))).withColumn("y", r6(F.col("y")))


@query(f"""WITH {_WELLS}, src AS (SELECT well, cycle, min(x0) AS wx, min(y0) AS wy, (max(y0) - min(y0)) / 0.5::DOUBLE + 100 AS wh, (max(y0) - min(y0)) / 0.25::DOUBLE + 200 AS th FROM fields GROUP BY ALL),
o AS (SELECT c.well, c.pid AS id, (f.x0 + 0.5::DOUBLE * (99 - x) - s.wx) / 0.5::DOUBLE AS u, s.wh - 1 - (f.y0 + 0.5::DOUBLE * y - s.wy) / 0.5::DOUBLE AS v, t.wx AS vx, t.wy AS vy, t.th AS vh, 0.5::DOUBLE * a AS a, 0.5::DOUBLE * b AS b, tx, ty
  FROM calls c JOIN fields f ON f.well = c.well AND f.cycle = 1 AND field_id = source_field_id JOIN src s ON s.well = c.well AND s.cycle = 1 JOIN motions m ON m.well = c.well AND m.cycle = 2 JOIN src t ON t.well = c.well AND t.cycle = 2),
p AS (SELECT well, id, vx + 0.25::DOUBLE * ((a * (u - tx) + b * (v - ty)) / (a * a + b * b)) AS px, vy + 0.25::DOUBLE * (vh - 1 - (a * (v - ty) - b * (u - tx)) / (a * a + b * b)) AS py FROM o),
h AS (SELECT p.*, field_id, x0, y0, px >= x0 + 2.5 AND px < x0 + 50 - 2.5 AND py >= y0 + 2.5 AND py < y0 + 50 - 2.5 AS core FROM p JOIN fields f ON f.well = p.well AND f.cycle = 2 AND px >= x0 AND px < x0 + 50 AND py >= y0 AND py < y0 + 50),
k AS (SELECT *, count(*) FILTER (core) OVER w AS n1, count(*) OVER w AS n2 FROM h WINDOW w AS (PARTITION BY well, id)),
g AS (SELECT well, id, field_id, 199 - (px - x0) / 0.25::DOUBLE AS tx, (py - y0) / 0.25::DOUBLE AS ty FROM k WHERE n1 = 1 AND core OR n1 = 0 AND n2 = 1)
SELECT c.well, c.pid AS id, c.source_field_id, c.x AS source_x, c.y AS source_y, coalesce(g.field_id, -1) AS target_field_id, coalesce(round(g.tx, 6) + 0.0, -1) AS target_x, coalesce(round(g.ty, 6) + 0.0, -1) AS target_y
FROM calls c LEFT JOIN g ON g.well = c.well AND g.id = c.pid""")
def barcodes_on_target(spark, sf_dir):
    """Places in the first cycle's fields carried to target images of half the pixel size; -1 where no field holds them."""
    calls, fields, motions = _wells(spark, sf_dir)
    places = calls.select("well", F.col("pid").alias("id"), F.col("source_field_id").alias("field_id"), "x", "y")
    source, target = (fields.filter(F.col("cycle") == c).drop("cycle") for c in (1, 2))
    motion = motions.filter("cycle = 2").select("well", (F.col("a") * 0.5).alias("a"), (F.col("b") * 0.5).alias("b"), "tx", "ty")
    out = projection.project_barcodes(places, source, target, motion, (SIDE, SIDE, S), (2 * SIDE, 2 * SIDE, S / 2), HALF)
    none = F.lit(-1)
    return out.select("well", "id", "source_field_id", "source_x", "source_y", F.coalesce("target_field_id", none).alias("target_field_id"), F.coalesce(r6(F.col("target_x")), none).alias("target_x"), F.coalesce(r6(F.col("target_y")), none).alias("target_y"))


_CALLED = f"""{_LANDED}, has AS (SELECT well, field_id, min(cycle) AS c0 FROM landed GROUP BY ALL), present AS (SELECT DISTINCT well, field_id, cycle FROM landed),
ref AS (SELECT l.* FROM landed l JOIN has USING (well, field_id) WHERE cycle = c0),
hit AS (SELECT r.well, r.field_id, r.pid, l.cycle, arg_min(l.base, (r.x - l.x) ** 2 + (r.y - l.y) ** 2) AS b FROM ref r JOIN landed l ON l.well = r.well AND l.field_id = r.field_id AND l.cycle > r.cycle AND (r.x - l.x) ** 2 + (r.y - l.y) ** 2 < 625 GROUP BY ALL),
every AS (SELECT r.well, r.field_id, r.pid AS id, r.base || coalesce(string_agg(coalesce(b, 'N'), '' ORDER BY p.cycle) FILTER (p.cycle > r.cycle), '') AS barcode
  FROM ref r JOIN present p ON p.well = r.well AND p.field_id = r.field_id LEFT JOIN hit h ON h.well = r.well AND h.field_id = r.field_id AND h.pid = r.pid AND h.cycle = p.cycle GROUP BY r.well, r.field_id, r.pid, r.base)"""


def _called(spark, sf_dir):
    return projection.map_barcodes(*_wells(spark, sf_dir), fx.guides_library(spark, sf_dir), (SIDE, SIDE), S, HALF, 25.0, 3)


@query(f"WITH {_CALLED} SELECT * FROM every")
def all_barcodes(spark, sf_dir):
    return _called(spark, sf_dir)[1]


@query(f"WITH {_CALLED}, {fx.LIBRARY} SELECT well, field_id, id, barcode, lib.gene_id FROM every JOIN lib ON substr(sgRNA, 1, 3) = barcode WHERE barcode NOT LIKE '%N%'")
def valid_barcodes(spark, sf_dir):
    return _called(spark, sf_dir)[0]


_GAPS = f"""{fx.FIELDS}, n AS (SELECT a.well, a.field_id, b.x0 - a.x0 AS dx, b.y0 - a.y0 AS dy FROM fields a JOIN fields b ON a.well = b.well AND a.field_id <> b.field_id),
sides AS (SELECT *, CASE WHEN abs(dx) < 1 AND dy > 0 AND dy < 51 THEN 'top' WHEN abs(dx) < 1 AND dy < 0 AND dy > -51 THEN 'bottom'
  WHEN abs(dy) < 1 AND dx > 0 AND dx < 51 THEN 'right' WHEN abs(dy) < 1 AND dx < 0 AND dx > -51 THEN 'left' END AS side FROM n),
closest AS (SELECT well, field_id, side, arg_min(abs(dx), dx * dx + dy * dy) AS dx, arg_min(abs(dy), dx * dx + dy * dy) AS dy FROM sides WHERE side IS NOT NULL GROUP BY ALL),
gaps AS (SELECT well, median(dx) FILTER (side IN ('left', 'right')) AS dx, median(dy) FILTER (side IN ('top', 'bottom')) AS dy FROM closest GROUP BY well)"""


@query(f"WITH {_GAPS} SELECT well, axis, round(CASE WHEN dx IS NULL OR dy IS NULL THEN 0 ELSE 1 - CASE axis WHEN 'x' THEN dx ELSE dy END / 50 END, 6) + 0.0 AS overlap FROM gaps, (VALUES ('x'), ('y')) a(axis)")
def field_overlap(spark, sf_dir):
    return geometry.overlap(fx.fields(spark, sf_dir), SIDE, S, 1.0, ["well"]).withColumn("overlap", r6(F.col("overlap")))


_CROPS = f"""{fx.FIELDS}, views AS (SELECT well, (max(x0) + 50 + min(x0) + 50) / 2 - 25 - 37.5 AS vx, (max(y0) + 50 + min(y0) + 50) / 2 - 25 - 37.5 AS vy FROM fields GROUP BY well),
met AS (SELECT fields.*, vx, vy FROM fields JOIN views USING (well) WHERE x0 > vx - 50 AND x0 < vx + 75 AND y0 > vy - 50 AND y0 < vy + 75),
placed AS (SELECT well, field_id, CAST(trunc((x0 - vx) / 0.5::DOUBLE) AS INTEGER) AS l, 150 - 100 - CAST(trunc((y0 - vy) / 0.5::DOUBLE) AS INTEGER) AS t FROM met),
crops AS (SELECT well, field_id, greatest(0, l) AS col0, least(150, l + 100) AS col1, greatest(0, t) AS row0, least(150, t + 100) AS row1, greatest(0, l) - l AS crop_left, greatest(0, t) - t AS crop_top
  FROM placed WHERE l + 100 > 0 AND l < 150 AND t + 100 > 0 AND t < 150)"""


def _views(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    fields = fx.fields(spark, sf_dir)
    return fields, geometry.central_views(fields, 150, (SIDE, SIDE), S, ["well"])


@query(f"WITH {_CROPS} SELECT * FROM crops")
def mosaic_crops(spark, sf_dir):
    fields, views = _views(spark, sf_dir)
    return geometry.mosaic_crops(geometry.mosaic_fields(fields, views, (SIDE, SIDE), S, ["well"]), views, (SIDE, SIDE), S, ["well"])


@query(f"""WITH {_CROPS}, px AS (SELECT user_id AS well, event_id % 8 AS field_id, event_id % 2 AS ch, event_id * 31 % 100 AS y, event_id * 17 % 100 AS x, value AS v FROM events)
SELECT well, ch, row0 + y - crop_top AS "row", col0 + x - crop_left AS col, max(v) AS v FROM px JOIN crops USING (well, field_id)
WHERE y >= crop_top AND y < crop_top + row1 - row0 AND x >= crop_left AND x < crop_left + col1 - col0 GROUP BY ALL""")
def well_mosaic(spark, sf_dir):
    """The middle of each well's image, from field pixels that events mark."""
    fields, views = _views(spark, sf_dir)
    marked = fx.table(spark, sf_dir, "events").selectExpr("user_id AS well", "event_id % 8 AS field_id", "event_id % 2 AS ch", "event_id * 31 % 100 AS y", "event_id * 17 % 100 AS x", "value AS v")
    return geometry.mosaic(marked, fields, views, (SIDE, SIDE), S, ["well"])


_CHAIN = """reg AS (SELECT event_id AS pid, event_id % 500 AS x, event_id * 7 % 400 AS y, event_id % 11 - 5 AS dx, event_id % 7 - 3 AS dy, radians((event_id % 13 - 6) * 0.5::DOUBLE) AS angle, 1 + (event_id % 5 - 2) / 100.0::DOUBLE AS scale FROM events),
s1 AS (SELECT *, x - 600.0::DOUBLE AS u, y - 500.0::DOUBLE AS w FROM reg),
s2 AS (SELECT * REPLACE (u / 1.25::DOUBLE AS u, w / 1.25::DOUBLE AS w) FROM s1),
s3 AS (SELECT * REPLACE (u - dx AS u, w - dy AS w) FROM s2),
s4 AS (SELECT * REPLACE ((cos(angle) * u - sin(angle) * w) / scale AS u, (sin(angle) * u + cos(angle) * w) / scale AS w) FROM s3),
s5 AS (SELECT * REPLACE (u * 0.75::DOUBLE AS u, w * 0.75::DOUBLE AS w) FROM s4),
s6 AS (SELECT *, u + 450.0::DOUBLE AS px, w + 375.0::DOUBLE AS py FROM s5)"""


@query(f"WITH {_CHAIN} SELECT pid, round(px, 6) + 0.0 AS px, round(py, 6) + 0.0 AS py, round(x, 6) + 0.0 AS back_x, round(y, 6) + 0.0 AS back_y FROM s6")
def registration_chain(spark, sf_dir):
    """Points carried from target to source pixels by one motion made of six, and back by its inverse."""
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    points = fx.table(spark, sf_dir, "events").selectExpr("event_id AS pid", "event_id % 500 AS x", "event_id * 7 % 400 AS y", "named_struct('dx', event_id % 11 - 5, 'dy', event_id % 7 - 3, 'angle', (event_id % 13 - 6) * 0.5D, 'scale', 1 + (event_id % 5 - 2) / 100D) AS found")
    points = points.withColumn("m", geometry.registration(lit(900, 750), lit(1200, 1000), *lit(0.75, 1.25), F.col("found")))
    px, py = geometry.moved(F.col("m"), F.col("x"), F.col("y"))
    back = geometry.moved(geometry.undone(F.col("m")), px, py)
    return points.select("pid", r6(px).alias("px"), r6(py).alias("py"), r6(back[0]).alias("back_x"), r6(back[1]).alias("back_y"))


@query(f"WITH {fx.FOV} SELECT a.pid AS src, b.pid AS dst FROM pts a JOIN pts b ON a.pid <> b.pid AND (a.px - b.px) ** 2 + (a.py - b.py) ** 2 <= 4")
def radius_graph(spark, sf_dir):
    return spatial.close_pairs(fx.points(spark, sf_dir).toDF("id", "x", "y"), 2.0).toDF("src", "dst")


# --- pixels ----------------------------------------------------------------------------


_Q = """ends AS (SELECT img, ch, quantile_cont(v, 0.001) AS lo, quantile_cont(v, 0.999) AS hi FROM px GROUP BY ALL),
fixed AS (SELECT img, ch, CASE WHEN lo = hi THEN 0 ELSE lo END AS lo, CASE WHEN lo = hi THEN greatest(1.0, max(CASE WHEN lo = hi THEN hi END) OVER (PARTITION BY img)) ELSE hi END AS hi FROM ends)"""


@query(f"WITH {fx.PIXELS}, {_Q} SELECT img, ch, y, x, round(greatest(0, least(1, (v - lo) / (hi - lo))), 6) + 0.0 AS v FROM px JOIN fixed USING (img, ch)")
def rescale_channels(spark, sf_dir):
    return pixels.rescale(fx.pixels(spark, sf_dir)).withColumn("v", r6(F.col("v")))


@query(f"WITH {fx.PIXELS} SELECT img, ch, y, x, round(v / q, 6) + 0.0 AS v FROM px JOIN (SELECT img, ch, quantile_cont(v, 0.7) AS q FROM px GROUP BY ALL) USING (img, ch)")
def percentile_frames(spark, sf_dir):
    return pixels.divide_by_percentile(fx.pixels(spark, sf_dir)).withColumn("v", r6(F.col("v")))


@query(f"WITH {fx.PIXELS} SELECT * FROM px WHERE x BETWEEN 8 AND 23 AND y BETWEEN 8 AND 23")
def center_window(spark, sf_dir):
    return pixels.center_window(fx.pixels(spark, sf_dir), 32, 32, 2.0)


@query(f"WITH {fx.PIXELS} SELECT ch, y, x + img * 20 AS x, max(v) AS v FROM px GROUP BY ALL")
def max_composite(spark, sf_dir):
    return pixels.max_composite(fx.pixels(spark, sf_dir).withColumn("x", (F.col("x") + F.col("img") * 20)))


_LEVELS = f"""{fx.PIXELS}, sp AS (SELECT event_id AS id, user_id AS img, event_id * 7 % 32 AS y, event_id * 13 % 32 AS x FROM events),
lv AS (SELECT sp.img, id, ch, max(v) AS v FROM sp JOIN px ON px.img = sp.img AND px.y >= sp.y - 3 AND px.y < sp.y + 3 AND px.x >= sp.x - 3 AND px.x < sp.x + 3 GROUP BY ALL)"""


def _levels(spark, sf_dir) -> DataFrame:
    spots = fx.table(spark, sf_dir, "events").selectExpr("event_id AS id", "user_id AS img", "event_id * 7 % 32 AS y", "event_id * 13 % 32 AS x")
    return pixels.max_around(spots, fx.pixels(spark, sf_dir), 3, 3)


@query(f"WITH {_LEVELS} SELECT * FROM lv")
def spot_intensities(spark, sf_dir):
    return _levels(spark, sf_dir)


@query(f"WITH {fx.PIXELS}, sp AS (SELECT event_id AS id, user_id AS img, event_id * 7 % 32 AS y, event_id * 13 % 32 AS x FROM events) SELECT sp.img, id, ch, max(v) AS v FROM sp JOIN px ON px.img = sp.img AND px.y BETWEEN sp.y - 2 AND sp.y + 2 AND px.x BETWEEN sp.x - 2 AND sp.x + 2 GROUP BY ALL")
def spot_maxima(spark, sf_dir):
    """The closed 5 x 5 neighbourhood of each spot."""
    spots = fx.table(spark, sf_dir, "events").selectExpr("event_id AS id", "user_id AS img", "event_id * 7 % 32 AS y", "event_id * 13 % 32 AS x")
    return pixels.max_around(spots, fx.pixels(spark, sf_dir), 2, 3)


@query(f"WITH {_LEVELS} SELECT img, id, substr('CATG', arg_max(ch, v * 1000 - ch / 1000.0) + 1, 1) AS base FROM lv GROUP BY img, id")
def brightest_base(spark, sf_dir):
    return pixels.brightest_base(_levels(spark, sf_dir))


@query(f"WITH {fx.PIXELS} SELECT img, ch, (px.y // 8) * 4 + px.x // 8 AS region, round_even(sum(v * px.y) / sum(v), 0) AS y, round_even(sum(v * px.x) / sum(v), 0) AS x FROM px GROUP BY img, ch, (px.y // 8) * 4 + px.x // 8")
def region_centroids(spark, sf_dir):
    return pixels.weighted_centroid(fx.pixels(spark, sf_dir), F.expr("(y div 8) * 4 + x div 8"))


@query(f"WITH {fx.PIXELS}, c AS (SELECT unnest([0, 1, 2, 3]) AS ch, unnest([1.0, 0.0, 0.0, 0.5]) AS r, unnest([0.0, 1.0, 0.25, 0.5]) AS g, unnest([0.0, 0.0, 1.0, 0.5]) AS b) SELECT img, y, x, round(least(1, sum(v / 200 * r)) + 1e-8, 6) AS r, round(least(1, sum(v / 200 * g)) + 1e-8, 6) AS g, round(least(1, sum(v / 200 * b)) + 1e-8, 6) AS b FROM px JOIN c USING (ch) GROUP BY img, y, x")
def composite_rgb(spark, sf_dir):
    colours = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.25, 1.0), (0.5, 0.5, 0.5)]
    out = pixels.composite_rgb(fx.pixels(spark, sf_dir).withColumn("v", F.col("v") / 200), colours)
    return out.select("img", "y", "x", *(r6(F.col(c) + 1e-8).alias(c) for c in "rgb"))


@query("""WITH sp AS (SELECT user_id AS img, substr('CATG', (event_id % 4) + 1, 1) AS base, event_id * 7 % 256 AS y, event_id * 13 % 256 AS x FROM events)
SELECT DISTINCT img, base, y + dy AS y, x + dx AS x FROM sp, (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) WHERE y + dy >= 0 AND y + dy < 255 AND x + dx >= 0 AND x + dx < 255""")
def label_raster(spark, sf_dir):
    spots = fx.table(spark, sf_dir, "events").selectExpr("user_id AS img", "substring('CATG', CAST(event_id % 4 AS INT) + 1, 1) AS base", "event_id * 7 % 256 AS y", "event_id * 13 % 256 AS x")
    return pixels.label_raster(spots, 256, 2)


@query(f"WITH {fx.PIXELS} SELECT round(1 - avg(d), 6) AS loss FROM (SELECT ch, 2 * sum(v / 101 * (x % 2)) / (sum(v / 101) + sum(x % 2) + 1e-7) AS d FROM px GROUP BY ch)")
def dice_loss(spark, sf_dir):
    return pixels.dice_loss(fx.pixels(spark, sf_dir).select("ch", (F.col("v") / 101).alias("p"), (F.col("x") % 2).alias("q"))).withColumn("loss", r6(F.col("loss")))
