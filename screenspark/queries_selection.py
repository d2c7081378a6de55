"""Queries of row selection, look-ups, report columns and pixel moves, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.vectors import r6
from .operators import barcodes, geometry, keys, pixels, selection, spatial
from .plans import fixtures as fx
from .registry import query


@query("SELECT event_id, 'A0' || (event_id % 9 + 1) || '-' || event_type || '-' || (event_id % 5) || '-' || user_id AS uid FROM events")
def composite_uid(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "events")
    well = keys.well_loc(F.lit(1), F.col("event_id") % 9 + 1)
    return rows.select("event_id", keys.tile_uid(well, F.col("event_type"), F.col("event_id") % 5, F.col("user_id")).alias("uid"))


@query("SELECT event_id, CASE WHEN p = 0 THEN 'Infinity'::DOUBLE ELSE round(-log10(p), 6) + 0.0 END AS score FROM (SELECT event_id, (event_id * 7919 % 10007) / 10007.0::DOUBLE AS p FROM events)")
def minus_log_fdr(spark, sf_dir):
    p = fx.table(spark, sf_dir, "events").selectExpr("event_id", "(event_id * 7919 % 10007) / 10007D AS p")
    score = selection.minus_log10(F.col("p"))
    return p.select("event_id", F.when(F.col("p") == 0, score).otherwise(r6(score)).alias("score"))


@query("SELECT event_id, CAST(instr('GTAC', substr('CATGN', event_id % 5 + 1, 1)) - 1 AS INTEGER) AS place, nullif(substr('CATG', event_id % 6, 1), '') AS base, CAST(trunc(value) AS BIGINT)::VARCHAR AS whole, printf('%.2f', value) AS places FROM events")
def bases_and_labels(spark, sf_dir):
    """Places of bases in the order of a model's channels, bases of 1-based codes, and numbers as bar labels."""
    base = F.substring(F.lit("CATGN"), (F.col("event_id") % 5 + 1).cast("int"), F.lit(1))
    place = F.coalesce(keys.channel(base, "GTAC"), F.lit(-1))
    return fx.table(spark, sf_dir, "events").select("event_id", place.alias("place"), keys.base_at(F.col("event_id") % 6, first=1).alias("base"), keys.shown_value(F.col("value"), "int").alias("whole"), keys.shown_value(F.col("value"), "float").alias("places"))


@query("SELECT event_id, greatest(value * 0.1, 5.0)::DOUBLE AS size FROM events")
def dot_size(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select("event_id", selection.dot_size(F.col("value"), 0.1, 5.0).alias("size"))


@query("""SELECT vec_id, CAST(i AS INTEGER) AS ch, round((embedding[i + 1]::DOUBLE - (0.1::DOUBLE * i)) / (0.5::DOUBLE + i), 6) + 0.0 AS v
FROM embeddings, (SELECT unnest(range(64)) AS i)""")
def normalise_channels(spark, sf_dir):
    whole = F.transform("embedding", lambda x: x.cast("double"))
    rows = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(selection.normalise_channels(whole, [0.1 * i for i in range(64)], [0.5 + i for i in range(64)])).alias("ch", "v"))
    return rows.withColumn("v", r6(F.col("v")))


_WIDE = ", ".join(f'embedding[{i + 1}]::DOUBLE AS "{i}"' for i in range(64))


@query(f'SELECT vec_id AS "ID", {_WIDE} FROM embeddings')
def string_names(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double") for i in range(64)))
    return selection.string_names(rows, ["ID", *range(64)])


@query(f"WITH {fx.CELLS} SELECT ID, gene_id, plate_well FROM cells WHERE plate_well <> 'P0_W0'")
def plate_holdout(spark, sf_dir):
    return fx.cells(spark, sf_dir).filter("plate_well <> 'P0_W0'").select("ID", "gene_id", "plate_well")


_READS = f"""{fx.LIBRARY}, reads AS (SELECT DISTINCT CASE WHEN sgRNA LIKE '%CC%' THEN replace(substr(sgRNA, 1, 10), 'C', 'N') ELSE substr(sgRNA, 1, 10) END AS barcode FROM lib)"""


@query(f"WITH {_READS} SELECT barcode, gene_id FROM reads JOIN (SELECT substr(sgRNA, 1, 10) AS barcode, gene_id FROM lib) USING (barcode) WHERE barcode NOT LIKE '%N%'")
def map_barcodes(spark, sf_dir):
    library = fx.guides_library(spark, sf_dir)
    reads = library.selectExpr("CASE WHEN contains(sgRNA, 'CC') THEN replace(substring(sgRNA, 1, 10), 'C', 'N') ELSE substring(sgRNA, 1, 10) END AS barcode").distinct()
    return barcodes.valid_barcodes(reads, library)


@query(f"""WITH {fx.CELLS}, g AS (SELECT DISTINCT gene_id FROM cells), e AS (SELECT gene_id AS g1, CASE k WHEN 0 THEN 'nontargeting' WHEN 1 THEN 'intergenic_7' ELSE 'G' || k END AS g2 FROM g, (SELECT unnest(range(10)) AS k))
SELECT g1, g2 FROM e WHERE g1 NOT LIKE '%intergenic%' AND g1 NOT LIKE '%nontargeting%' AND g2 NOT LIKE '%intergenic%' AND g2 NOT LIKE '%nontargeting%'""")
def edges_without_controls(spark, sf_dir):
    genes = fx.cells(spark, sf_dir).select(F.col("gene_id").alias("g1")).distinct()
    edges = genes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).selectExpr("g1", "CASE k WHEN 0 THEN 'nontargeting' WHEN 1 THEN 'intergenic_7' ELSE concat('G', k) END AS g2")
    return selection.exclude_names(edges, ["g1", "g2"], ["intergenic", "nontargeting"])


@query(f"""WITH {fx.FOV}, h AS (SELECT pid, field_id, px >= x0 + 2.5 AND px < x1 - 2.5 AND py >= y0 + 2.5 AND py < y1 - 2.5 AS core
  FROM pts JOIN fov ON px >= x0 AND px < x1 AND py >= y0 AND py < y1),
t AS (SELECT pid, count(*) FILTER (core) AS n1, min(field_id) FILTER (core) AS f1, count(*) AS n2, min(field_id) AS f2 FROM h GROUP BY pid)
SELECT pid, CASE WHEN n1 = 1 THEN f1 ELSE f2 END AS field_id FROM t WHERE n1 = 1 OR n1 = 0 AND n2 = 1""")
def points_on_mosaic(spark, sf_dir):
    return spatial.point_in_field(fx.points(spark, sf_dir), fx.fov(spark), 2.5).dropna("any")


@query("SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_discount > 0.08 OR l_tax > 0.06")
def annotated_points(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return selection.any_above(rows, {"l_discount": 0.08, "l_tax": 0.06})


@query("SELECT event_id, value FROM (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN value END AS value FROM events) WHERE value IS NOT NULL")
def drop_failed(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 11 <> 0 THEN value END AS value").filter("value is not null")


@query("SELECT vec_id AS ID, label, quality FROM embeddings JOIN labels ON vec_id = doc_id")
def join_metadata(spark, sf_dir):
    metadata = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ID"), "quality")
    return fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ID"), "label").join(metadata, "ID")


@query("SELECT labels, gene_id, r_name FROM (SELECT label AS labels, count(*) AS n FROM embeddings GROUP BY label) JOIN (SELECT r_regionkey AS gene_id, r_name FROM region) ON labels = gene_id")
def join_labels(spark, sf_dir):
    left = fx.table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("labels")).count().drop("count")
    right = fx.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("gene_id"), "r_name")
    return left.join(right, F.col("labels") == F.col("gene_id"))


@query(f'WITH {fx.CELLS} SELECT plate_well, count(*) AS "rows", count(DISTINCT gene_id) AS kinds, count(DISTINCT gene_id) = 1 AS single FROM cells GROUP BY plate_well')
def key_report(spark, sf_dir):
    return selection.key_report(fx.cells(spark, sf_dir), "plate_well", "gene_id")


@query("""WITH s AS (SELECT label, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS v FROM embeddings WHERE label < 10),
p AS (SELECT len(list_filter(range(10), lambda i: v[i + 1] > v[label + 1] OR (v[i + 1] = v[label + 1] AND i < label))) AS place FROM s)
SELECT CAST(k AS INTEGER) AS k, round(100 * avg(CAST(place < k AS DOUBLE)), 6) AS accuracy FROM p, (SELECT unnest([1, 5]) AS k) GROUP BY k""")
def top_k_accuracy(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings").filter("label < 10").select("label", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("scores"))
    return selection.top_k_accuracy(rows, "scores", "label", [1, 5]).withColumn("accuracy", r6(F.col("accuracy")))


@query("SELECT event_type, round(avg(value), 6) + 0.0 AS mean FROM events GROUP BY event_type")
def process_mean(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("mean")).withColumn("mean", r6(F.col("mean")))


@query("SELECT vec_id, label, 'cluster ' || (label % 3) AS cluster FROM embeddings")
def cluster_labels(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    clusters = rows.select("label").distinct().withColumn("cluster", F.concat(F.lit("cluster "), (F.col("label") % 3).cast("string")))
    return selection.cluster_label(clusters, rows, "label")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS r FROM events) WHERE r = 1")
def first_of_each(spark, sf_dir):
    return selection.keep_first(fx.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_type", "event_id"])


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) - 1 AS r, count(*) OVER (PARTITION BY event_type) - 1 AS last FROM events)
SELECT event_type, round(sum(value * pow(0.99, r) * CASE WHEN r = last THEN 1 ELSE 0.01 END), 6) AS ema FROM r GROUP BY event_type""")
def final_average(spark, sf_dir):
    return selection.final_average(fx.table(spark, sf_dir, "events"), "event_type", ["event_id"], "value", 0.99).withColumn("ema", r6(F.col("ema")))


@query(f"WITH {fx.SPOTS} SELECT field_id, list_sort(list(DISTINCT cycle))::VARCHAR AS cycles FROM spots GROUP BY field_id")
def sorted_cycles(spark, sf_dir):
    cycles = fx.spots(spark, sf_dir).groupBy("field_id").agg(F.array_sort(F.collect_set("cycle")).alias("c"))
    return cycles.select("field_id", F.concat(F.lit("["), F.array_join(F.transform("c", lambda c: c.cast("string")), ", "), F.lit("]")).alias("cycles"))


@query(f"WITH {fx.SPOTS} SELECT field_id, cycle, count(*) AS n FROM spots WHERE cycle IN (1, 3) GROUP BY field_id, cycle")
def union_of_cycles(spark, sf_dir):
    spots = fx.spots(spark, sf_dir).select("field_id", "cycle")
    return spots.filter("cycle = 1").unionByName(spots.filter("cycle = 3")).groupBy("field_id", "cycle").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT p_brand AS name FROM part INTERSECT SELECT DISTINCT p_brand FROM part WHERE p_partkey % 3 = 0")
def common_names(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    return part.select(F.col("p_brand").alias("name")).intersect(part.filter("p_partkey % 3 = 0").select("p_brand"))


def _levels(spark, sf_dir) -> DataFrame:
    rows = fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("round"))
    return rows.withColumn("ch", F.explode(F.sequence(F.lit(0), F.lit(3)))).selectExpr("id", "round", "ch", "(id * 7919 * (round + 1) + id * ch * 31) % 101 AS v")


@query(f"""WITH {fx.LIBRARY}, book AS (SELECT substr(sgRNA, 1, 3) AS barcode, min(gene_id) AS target FROM lib GROUP BY 1),
b AS (SELECT event_id AS id, r, substr('CATG', arg_max(ch, ((event_id * 7919 * (r + 1) + event_id * ch * 31) % 101) * 10 - ch) + 1, 1) AS base
      FROM events, (SELECT unnest(range(3)) AS r), (SELECT unnest(range(4)) AS ch) GROUP BY event_id, r),
d AS (SELECT id, string_agg(base, '' ORDER BY r) AS barcode FROM b GROUP BY id)
SELECT id, barcode, target FROM d LEFT JOIN book USING (barcode)""")
def decode_rounds(spark, sf_dir):
    book = fx.guides_library(spark, sf_dir).groupBy(F.substring("sgRNA", 1, 3).alias("barcode")).agg(F.min("gene_id").alias("target"))
    return barcodes.decode_rounds(_levels(spark, sf_dir), book)


@query(f"""WITH {fx.PIXELS}, q AS (SELECT img, ch, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM px GROUP BY img, ch)
SELECT img, ch, y, x, round(CASE WHEN v BETWEEN lo AND hi THEN v ELSE lo + (hi - lo) * (CAST('0x' || substr(md5('0|' || img || '|' || ch || '|' || y || '|' || x), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) END, 6) AS v
FROM px JOIN q USING (img, ch)""")
def fill_range(spark, sf_dir):
    return pixels.fill_range(fx.pixels(spark, sf_dir), 5, 95).withColumn("v", r6(F.col("v")))


@query(f"WITH {fx.PIXELS} SELECT a.img, a.ch, a.y, a.x, coalesce(b.v, 0) AS v FROM px a LEFT JOIN px b ON a.img = b.img AND a.ch = b.ch AND a.y = b.y + 3 AND a.x = b.x - 2")
def shift_pixels(spark, sf_dir):
    return pixels.shift(fx.pixels(spark, sf_dir), 3, -2)


@query(f"WITH {fx.PIXELS} SELECT img, ch, 31 - y AS y, 31 - x AS x, v FROM px")
def half_turn(spark, sf_dir):
    return pixels.half_turn(fx.pixels(spark, sf_dir), 32, 32)


@query("""SELECT event_id, CAST(round_even(48 * abs(sin(a)) + 64 * abs(cos(a)), 0) AS BIGINT) AS width, CAST(round_even(64 * abs(sin(a)) + 48 * abs(cos(a)), 0) AS BIGINT) AS height
FROM (SELECT event_id, event_id % 8 * pi() / 4 AS a FROM events)""")
def upright_size(spark, sf_dir):
    angle = F.col("event_id") % 8 * F.lit(math.pi) / 4
    return fx.table(spark, sf_dir, "events").select("event_id", *geometry.upright_size(F.lit(64), F.lit(48), angle))
