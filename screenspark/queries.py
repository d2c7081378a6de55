"""The registered queries of the screen operators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.vectors import r6
from .operators import barcodes, curves, hypothesis, keys, normalize, series, similarity, spatial
from .plans import fixtures as fx
from .registry import ORACLE_SQL, QUERIES, ks_exact_sql, query


def _long(spark, sf_dir) -> DataFrame:
    return normalize.to_long(fx.cells(spark, sf_dir))


def _scaled(spark, sf_dir, robust: bool = True) -> DataFrame:
    return normalize.to_long(normalize.scale_vectors(fx.cells(spark, sf_dir), robust)).withColumnRenamed("x", "z")


def _guides(spark, sf_dir) -> DataFrame:
    return normalize.by_guide(_scaled(spark, sf_dir))


# --- keys ------------------------------------------------------------------------------


@query(f"WITH {fx.CELLS} SELECT ID, split_part(ID, '_', 1) AS plate, split_part(ID, '_', 1) || '_' || split_part(ID, '_', 2) AS plate_well FROM cells")
def parse_ids(spark, sf_dir):
    return fx.cells(spark, sf_dir).select("ID", keys.plate(F.col("ID")).alias("plate"), keys.plate_well(F.col("ID")).alias("plate_well"))


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def clean_features(spark, sf_dir):
    df = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", F.col("l_tax").alias("x_pvalue"), F.col("l_discount").alias("y_moments_1"), F.col("l_extendedprice").alias("nucleus_centroid_x"))
    return keys.clean_features(df, ("nucleus_centroid_x", "absent"))


@query(f"WITH {fx.LIBRARY} SELECT sgRNA, gene_id, substr(sgRNA, 1, 10) AS barcode FROM lib")
def barcode_prefix(spark, sf_dir):
    return fx.guides_library(spark, sf_dir).withColumn("barcode", keys.barcode_prefix(F.col("sgRNA")))


@query(f"WITH {fx.LIBRARY} SELECT sgRNA, sgRNA[1] || sgRNA[3] || sgRNA[5] || sgRNA[8] AS barcode FROM lib")
def barcode_pick(spark, sf_dir):
    return fx.guides_library(spark, sf_dir).select("sgRNA", keys.barcode_pick(F.col("sgRNA"), [0, 2, 4, 7]).alias("barcode"))


_BASES = f"{fx.LIBRARY}, b AS (SELECT sgRNA, gene_id, CAST(r AS INTEGER) AS round, substr(sgRNA, r + 1, 1) AS base FROM lib, (SELECT unnest(range(10)) AS r))"


@query(f"WITH {_BASES} SELECT gene_id AS target, round, CAST(instr('CATG', base) - 1 AS INTEGER) AS channel, 1 AS value FROM b")
def codebook_sparse(spark, sf_dir):
    return keys.codebook_sparse(barcode_prefix(spark, sf_dir))


@query(f"WITH {_BASES} SELECT substr(sgRNA, 1, 10) AS barcode, round, CAST(c AS INTEGER) AS channel, CAST(instr('CATG', base) - 1 = c AS INTEGER) AS value FROM b, (SELECT unnest(range(4)) AS c)")
def codebook_onehot(spark, sf_dir):
    return keys.codebook_onehot(barcode_prefix(spark, sf_dir))


@query("SELECT n_nationkey, chr(65 + n_regionkey) || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS well FROM nation")
def well_loc(spark, sf_dir):
    return fx.table(spark, sf_dir, "nation").select("n_nationkey", keys.well_loc(F.col("n_regionkey") + 1, F.col("n_nationkey") + 1).alias("well"))


@query("SELECT 'b' || n_regionkey AS bucket, 'a/k' || n_nationkey || '.npy' AS key FROM nation")
def s3_uri_split(spark, sf_dir):
    uri = F.concat(F.lit("s3://b"), F.col("n_regionkey"), F.lit("/a/k"), F.col("n_nationkey"), F.lit(".npy"))
    return fx.table(spark, sf_dir, "nation").select(*keys.uri_bucket_key(uri))


@query("SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[3]::DOUBLE AS b, embedding[5]::DOUBLE AS c FROM embeddings")
def channel_parse(spark, sf_dir):
    picked = fx.table(spark, sf_dir, "embeddings").select("vec_id", keys.select_channels(F.col("embedding"), F.lit("0-2-4")).alias("p"))
    return picked.select("vec_id", *(F.get("p", k).cast("double").alias(n) for k, n in enumerate("abc")))


# --- normalisation and roll-ups --------------------------------------------------------


@query(f"WITH {fx.CELLS} SELECT ID, dim, round(z, 6) + 0.0 AS z FROM robust")
def robust_scale(spark, sf_dir):
    return _scaled(spark, sf_dir).select("ID", "dim", r6(F.col("z")).alias("z"))


@query(f"WITH {fx.CELLS} SELECT ID, dim, round((x - mu) / nullif(sd, 0), 6) + 0.0 AS z FROM long LEFT JOIN med USING (plate_well, dim)")
def std_scale(spark, sf_dir):
    return _scaled(spark, sf_dir, robust=False).select("ID", "dim", r6(F.col("z")).alias("z"))


@query(f"WITH {fx.CELLS}, h AS (SELECT ID, dim, CASE WHEN dim % 7 = 3 AND ID LIKE '%_C8' THEN NULL ELSE x END AS z FROM long) SELECT ID, dim, z FROM h WHERE dim NOT IN (SELECT dim FROM h WHERE z IS NULL)")
def drop_nan_dims(spark, sf_dir):
    holes = _long(spark, sf_dir).withColumn("z", F.when(~((F.col("dim") % 7 == 3) & F.col("ID").endswith("_C8")), F.col("x")))
    return normalize.drop_nan_dims(holes).select("ID", "dim", "z")


@query(f"WITH {fx.CELLS} SELECT barcode, gene_id, dim, round(z, 6) + 0.0 AS z FROM guide")
def agg_guide_mean(spark, sf_dir):
    return _guides(spark, sf_dir).withColumn("z", r6(F.col("z")))


@query(f"WITH {fx.CELLS} SELECT barcode, gene_id, dim, round(median(z), 6) + 0.0 AS z FROM robust GROUP BY ALL")
def agg_guide_median(spark, sf_dir):
    return normalize.by_guide(_scaled(spark, sf_dir), "median").withColumn("z", r6(F.col("z")))


@query(f"WITH {fx.CELLS} SELECT gene_id, dim, round(z, 6) + 0.0 AS z FROM gene")
def agg_gene_median(spark, sf_dir):
    return normalize.by_gene(_guides(spark, sf_dir)).withColumn("z", r6(F.col("z")))


@query(f"WITH {fx.CELLS} SELECT gene_id, dim, round(avg(z), 6) + 0.0 AS z FROM guide GROUP BY ALL")
def agg_gene_mean(spark, sf_dir):
    return normalize.by_gene(_guides(spark, sf_dir), "mean").withColumn("z", r6(F.col("z")))


def _gene_pairs(spark, sf_dir) -> DataFrame:
    return similarity.cosine_pairs(normalize.to_vectors(normalize.by_gene(_guides(spark, sf_dir)), ["gene_id"]), "gene_id")


@query(f"WITH {fx.CELLS} SELECT i, j, round(sim, 6) + 0.0 AS sim FROM genesim")
def flagship_gene_similarity(spark, sf_dir):
    return _gene_pairs(spark, sf_dir).withColumn("sim", r6(F.col("sim")))


# --- similarity ------------------------------------------------------------------------


@query(f"WITH {fx.CELLS} SELECT i, j, round(abs(sim), 6) + 0.0 AS sim FROM genesim WHERE i LIKE 'G%' AND j LIKE 'G%'")
def cosine_abs_subset(spark, sf_dir):
    genes = fx.cells(spark, sf_dir).select(F.col("gene_id").alias("k")).distinct().filter("k like 'G%'")
    return similarity.subset(_gene_pairs(spark, sf_dir), genes).withColumn("sim", r6(F.col("sim")))


_CONSISTENT = f"""{fx.CELLS}, gn AS (SELECT barcode, gene_id, sqrt(sum(z * z)) AS n FROM guide GROUP BY ALL),
gs AS (SELECT a.gene_id, a.barcode, b.barcode AS other, sum(a.z * b.z) / (max(x.n) * max(y.n)) AS sim
       FROM guide a JOIN guide b ON a.gene_id = b.gene_id AND a.dim = b.dim AND a.barcode <> b.barcode
       JOIN gn x ON x.barcode = a.barcode JOIN gn y ON y.barcode = b.barcode GROUP BY ALL),
sc AS (SELECT gene_id, barcode, avg(sim) AS score FROM gs GROUP BY ALL)"""


def _scores(spark, sf_dir) -> DataFrame:
    return similarity.guide_consistency(normalize.to_vectors(_guides(spark, sf_dir), ["gene_id", "barcode"]))


@query(f"WITH {_CONSISTENT} SELECT gene_id, barcode, round(score, 6) + 0.0 AS score FROM sc")
def guide_consistency(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("score", r6(F.col("score")))


@query(f"WITH {_CONSISTENT} SELECT gene_id, round(avg(score), 6) + 0.0 AS mean_score, round(median(score), 6) + 0.0 AS median_score FROM sc GROUP BY gene_id")
def gene_score_rollup(spark, sf_dir):
    return similarity.gene_scores(_scores(spark, sf_dir)).select("gene_id", r6(F.col("mean_score")).alias("mean_score"), r6(F.col("median_score")).alias("median_score"))


@query(f"WITH {fx.CELLS} SELECT round(2 * sum(sim) / (SELECT count(DISTINCT gene_id) ** 2 FROM cells), 6) + 0.0 AS baseline FROM genesim")
def offdiag_baseline(spark, sf_dir):
    genes = fx.cells(spark, sf_dir).select("gene_id").distinct().count()
    return similarity.offdiag_baseline(_gene_pairs(spark, sf_dir), genes).withColumn("baseline", r6(F.col("baseline")))


@query("""WITH h AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'Infinity'::DOUBLE WHEN event_id % 17 = 0 THEN '-Infinity'::DOUBLE WHEN event_id % 19 = 0 THEN 'NaN'::DOUBLE ELSE value END AS v FROM events)
SELECT event_id, CASE WHEN v IS NULL OR isinf(v) OR isnan(v) THEN (SELECT min(v) FROM h WHERE isfinite(v)) ELSE v END AS score FROM h""")
def score_fill_worst(spark, sf_dir):
    holes = fx.table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN double('Infinity') WHEN event_id % 17 = 0 THEN double('-Infinity') WHEN event_id % 19 = 0 THEN double('NaN') ELSE value END AS score")
    return similarity.fill_worst(holes)


# --- curves ----------------------------------------------------------------------------


@query(f"""WITH {fx.SCORED}, st AS (SELECT *, lead(p) OVER w AS p2, lead(n) OVER w AS n2 FROM cum WINDOW w AS (ORDER BY score DESC))
SELECT round(score, 6) AS threshold, round(fp::DOUBLE / neg, 6) AS fpr, round(tp::DOUBLE / pos, 6) AS tpr FROM st WHERE tp = p AND fp = n OR p2 IS NULL OR p <> p2 OR n <> n2
UNION ALL SELECT 'Infinity'::DOUBLE, 0, 0""")
def roc_curve(spark, sf_dir):
    return curves.roc_curve(fx.scored(spark, sf_dir)).select(*(r6(F.col(c)).alias(c) for c in ("threshold", "fpr", "tpr")))


@query(f"""WITH {fx.SCORED}, pts AS (SELECT fp::DOUBLE / neg AS f, tp::DOUBLE / pos AS t FROM cum UNION ALL SELECT 0, 0),
l AS (SELECT rate, max({{'f': f, 't': t}}) AS l FROM pts, (VALUES (0.05::DOUBLE), (0.1::DOUBLE)) v(rate) WHERE f <= rate GROUP BY rate),
r AS (SELECT rate, min({{'f': f, 't': t}}) AS r FROM pts, (VALUES (0.05::DOUBLE), (0.1::DOUBLE)) v(rate) WHERE f > rate GROUP BY rate)
SELECT rate, round(l.t + (rate - l.f) * (r.t - l.t) / (r.f - l.f), 6) AS tpr FROM l JOIN r USING (rate)""")
def tpr_at_fpr(spark, sf_dir):
    return curves.tpr_at_fpr(curves.roc_curve(fx.scored(spark, sf_dir))).withColumn("tpr", r6(F.col("tpr")))


@query(f"WITH {fx.SCORED} SELECT round(sum(p * (neg - fp) + 0.5 * p * n)::DOUBLE / max(pos * neg), 6) AS auc FROM cum")
def roc_auc(spark, sf_dir):
    return curves.roc_auc(fx.scored(spark, sf_dir)).withColumn("auc", r6(F.col("auc")))


@query(f"WITH {fx.SCORED} SELECT round(score, 6) AS threshold, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / pos, 6) AS recall FROM cum UNION ALL SELECT NULL, 1, 0")
def pr_curve(spark, sf_dir):
    return curves.pr_curve(fx.scored(spark, sf_dir)).select(*(r6(F.col(c)).alias(c) for c in ("threshold", "precision", "recall")))


@query(f"WITH {fx.SCORED} SELECT round(sum(p::DOUBLE / pos * tp / (tp + fp)), 6) AS ap FROM cum")
def average_precision(spark, sf_dir):
    return curves.average_precision(fx.scored(spark, sf_dir)).withColumn("ap", r6(F.col("ap")))


# --- tests -----------------------------------------------------------------------------

_KS = """s AS (SELECT event_type, value, 1 AS a, 0 AS b FROM events WHERE event_type <> 'view'
  UNION ALL SELECT t.event_type, e.value, 0, 1 FROM events e, (SELECT DISTINCT event_type FROM events WHERE event_type <> 'view') t WHERE e.event_type = 'view'),
g AS (SELECT event_type, value, sum(a) AS a, sum(b) AS b FROM s GROUP BY ALL),
c AS (SELECT event_type, abs(sum(a) OVER w::DOUBLE / sum(a) OVER t - sum(b) OVER w::DOUBLE / sum(b) OVER t) AS gap, sum(a) OVER t AS n1, sum(b) OVER t AS n2
      FROM g WINDOW w AS (PARTITION BY event_type ORDER BY value), t AS (PARTITION BY event_type)),
k AS (SELECT event_type, max(gap) AS ks, max(n1) AS n1, max(n2) AS n2 FROM c GROUP BY event_type)""".replace("sum(a) OVER w::DOUBLE", "(sum(a) OVER w)::DOUBLE").replace("sum(b) OVER w::DOUBLE", "(sum(b) OVER w)::DOUBLE")


_EXACT = ks_exact_sql("SELECT event_type AS key, ks, n1, n2 FROM k")


def _ks(spark, sf_dir) -> DataFrame:
    events = fx.table(spark, sf_dir, "events")
    kinds = events.filter("event_type <> 'view'").select("event_type").distinct()
    control = events.filter("event_type = 'view'").select("value").join(F.broadcast(kinds))
    both = events.filter("event_type <> 'view'").select("event_type", "value", F.lit(True).alias("is_first")).unionByName(control.withColumn("is_first", F.lit(False)))
    return hypothesis.ks_statistic(both, ["event_type"], "value")


@query(f"WITH {_KS} SELECT event_type, round(ks, 6) AS ks, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2 FROM k")
def ks_by_gene(spark, sf_dir):
    return _ks(spark, sf_dir).withColumn("ks", r6(F.col("ks")))


@query(f"WITH RECURSIVE {_KS}, {_EXACT} SELECT event_type, round(ks, 6) AS ks, CAST(k.n1 AS BIGINT) AS n1, CAST(k.n2 AS BIGINT) AS n2, round(p, 6) AS p FROM k JOIN exact ON key = event_type")
def ks_pvalue(spark, sf_dir):
    return _ks(spark, sf_dir).select("event_type", r6(F.col("ks")).alias("ks"), "n1", "n2", F.round(hypothesis.ks_p_auto(F.col("ks"), F.col("n1"), F.col("n2")), 6).alias("p"))


_P = "p AS (SELECT event_id AS id, (event_id * 7919 % 10007) / 10007.0::DOUBLE AS p FROM events)"


def _p(spark, sf_dir) -> DataFrame:
    return fx.table(spark, sf_dir, "events").selectExpr("event_id AS id", "(event_id * 7919 % 10007) / 10007D AS p")


@query(f"""WITH {_P}, r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r, count(*) OVER () AS n FROM p)
SELECT id, round(least(1.0, min(p * n / r) OVER (ORDER BY p DESC)), 6) AS fdr FROM r""")
def bh_fdr(spark, sf_dir):
    return hypothesis.bh_fdr(_p(spark, sf_dir)).select("id", r6(F.col("fdr")).alias("fdr"))


@query("SELECT event_id, value FROM events WHERE value > (SELECT value FROM events ORDER BY value DESC LIMIT 1 OFFSET 20)")
def volcano_topk(spark, sf_dir):
    return hypothesis.above_kth(fx.table(spark, sf_dir, "events").select("event_id", "value"), "value", 20)


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n FROM events),
b AS (SELECT CAST(least(20, floor((value - lo) / ((hi - lo) / 20)) + 1) AS INTEGER) AS bin, lo, hi, e.n AS total FROM events, e)
SELECT bin, count(*) AS n, round(count(*) / (max(total) * (max(hi) - max(lo)) / 20), 6) AS density FROM b GROUP BY bin""")
def hist_density(spark, sf_dir):
    return hypothesis.histogram(fx.table(spark, sf_dir, "events"), "value", 20).withColumn("density", r6(F.col("density")))


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi, pow(count(value), -0.2) * stddev_samp(value) AS h FROM events)
SELECT CAST(k AS INTEGER) AS k, round(avg(exp(-0.5 * pow((value - (lo + k * (hi - lo) / 10)) / h, 2))) / (max(h) * 2.5066282746310002), 6) AS density
FROM events, e, (SELECT unnest(range(11)) AS k) GROUP BY k""")
def kde_curve(spark, sf_dir):
    return hypothesis.gaussian_kde(fx.table(spark, sf_dir, "events"), "value", 10).withColumn("density", r6(F.col("density")))


# --- space -----------------------------------------------------------------------------


@query(f"""WITH {fx.FOV}, h AS (SELECT pid, field_id, px >= x0 + 2.5 AND px < x1 - 2.5 AND py >= y0 + 2.5 AND py < y1 - 2.5 AS core
  FROM pts JOIN fov ON px >= x0 AND px < x1 AND py >= y0 AND py < y1),
t AS (SELECT pid, count(*) FILTER (core) AS n1, min(field_id) FILTER (core) AS f1, count(*) AS n2, min(field_id) AS f2 FROM h GROUP BY pid)
SELECT pid, CASE WHEN n1 = 1 THEN f1 WHEN n1 = 0 AND n2 = 1 THEN f2 ELSE -1 END AS field_id FROM pts LEFT JOIN t USING (pid)""")
def point_in_field(spark, sf_dir):
    found = spatial.point_in_field(fx.points(spark, sf_dir), fx.fov(spark), 2.5)
    return found.withColumn("field_id", F.coalesce("field_id", F.lit(-1)))


@query(f"""WITH {fx.FIELDS}, n AS (SELECT a.well, a.field_id, b.field_id AS other, b.x0 - a.x0 AS dx, b.y0 - a.y0 AS dy FROM fields a JOIN fields b ON a.well = b.well AND a.field_id <> b.field_id),
s AS (SELECT *, CASE WHEN abs(dx) < 1 AND dy > 0 AND dy < 51 THEN 'top' WHEN abs(dx) < 1 AND dy < 0 AND dy > -51 THEN 'bottom'
  WHEN abs(dy) < 1 AND dx > 0 AND dx < 51 THEN 'right' WHEN abs(dy) < 1 AND dx < 0 AND dx > -51 THEN 'left' END AS side FROM n)
SELECT well, field_id, side, arg_min(other, sqrt(dx * dx + dy * dy)) AS other, min(sqrt(dx * dx + dy * dy)) AS dist FROM s WHERE side IS NOT NULL GROUP BY well, field_id, side""")
def field_neighbours(spark, sf_dir):
    return spatial.neighbours(fx.fields(spark, sf_dir), 50.0, 1.0, ["well"])


@query(f"""WITH {fx.SPOTS} SELECT field_id, id, r.base || coalesce(string_agg(coalesce(b.base, 'N'), '' ORDER BY w.cycle), '') AS barcode
FROM spots r CROSS JOIN (SELECT unnest(range(2, 6)) AS cycle) w LEFT JOIN near n ON n.field_id = r.field_id AND n.cycle = w.cycle AND n.lid = r.id
LEFT JOIN spots b ON b.field_id = n.field_id AND b.cycle = n.cycle AND b.id = n.rid WHERE r.cycle = 1 GROUP BY r.field_id, r.id, r.base""".replace("SELECT field_id, id, r.base", "SELECT r.field_id, r.id, r.base"))
def stitch_barcodes(spark, sf_dir):
    return barcodes.stitch(fx.spots(spark, sf_dir))


@query(f"WITH {fx.FOV} SELECT a.pid AS id, a.px AS x, a.py AS y FROM pts a WHERE NOT EXISTS (SELECT 1 FROM pts b WHERE b.pid < a.pid AND (a.px - b.px) ** 2 + (a.py - b.py) ** 2 <= 0.25)")
def dedup_radius(spark, sf_dir):
    return spatial.dedup_radius(fx.points(spark, sf_dir).toDF("id", "x", "y"), 0.5)


# --- series ----------------------------------------------------------------------------


@query("""SELECT event_id, round(list_sort(list(value) OVER w)[CAST(ceil(len(list(value) OVER w) / 2.0) AS INTEGER)], 6) AS median, round(avg(value) OVER w + 1e-9, 6) AS mean,
max(value) OVER w AS top, round(avg(value) OVER g + 1e-9, 6) AS global_mean FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), g AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def smoothed_window(spark, sf_dir):
    out = series.smoothed(fx.table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value")
    return out.select("event_id", r6(F.col("median")).alias("median"), r6(F.col("mean") + 1e-9).alias("mean"), "top", r6(F.col("global_mean") + 1e-9).alias("global_mean"))


@query("""WITH m AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM m), g AS (SELECT user_id, run, min(event_type) AS value, count(*) AS n FROM r GROUP BY user_id, run)
SELECT user_id, run, value, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY run) AS BIGINT) AS "end" FROM g""")
def run_lengths(spark, sf_dir):
    return series.run_lengths(fx.table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("""SELECT event_id AS step, round(CASE WHEN event_id < 10 THEN 0.5 * event_id / 9.0 ELSE 0.01 + 0.5 * 0.49 * (1 + cos(pi() * (event_id - 10) / ((SELECT count(*) FROM events) - 10.0))) END, 6) AS value FROM events""")
def cosine_schedule(spark, sf_dir):
    """The learning rate of each event, taken as a step of a run over all events."""
    events = fx.table(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("step"), r6(series.cosine_schedule(F.col("event_id"), 0.5, 0.01, events.count(), 10)).alias("value"))


@query("SELECT DISTINCT event_id // 20 AS step, round(CASE WHEN event_id // 20 < 10 THEN 0.04 + 0.03 * (event_id // 20) / 9.0 ELSE 0.07 END, 6) AS value FROM events")
def temperature_schedule(spark, sf_dir):
    """The temperature of each epoch of twenty events."""
    epochs = fx.table(spark, sf_dir, "events").selectExpr("event_id div 20 AS step").distinct()
    return epochs.withColumn("value", r6(series.temperature_schedule(F.col("step"), 0.04, 0.07, 10)))


@query("SELECT vec_id, round(least(1.0, 3.0 / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) + 1e-6)), 6) AS coefficient FROM embeddings")
def l2_clip(spark, sf_dir):
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", r6(series.clip_coefficient(F.transform("embedding", lambda x: x.cast("double")), 3.0)).alias("coefficient"))


@query(f"""WITH {fx.CELLS}, s AS (SELECT plate_well, ID, gene_id = 'intergenic' AS y FROM cells WHERE gene_id = 'intergenic' OR gene_id = 'G2' AND plate_well <> 'P1_W1'),
n AS (SELECT plate_well, least(count(*) FILTER (y), count(*) FILTER (NOT y)) AS n FROM s GROUP BY plate_well)
SELECT plate_well, ID, y FROM (SELECT s.*, n.n, row_number() OVER (PARTITION BY plate_well, y ORDER BY md5(ID || '42')) AS r FROM s JOIN n USING (plate_well)) WHERE r <= n""")
def balanced_sample(spark, sf_dir):
    rows = fx.cells(spark, sf_dir).filter("gene_id = 'intergenic' OR gene_id = 'G2' AND plate_well <> 'P1_W1'").selectExpr("plate_well", "ID", "gene_id = 'intergenic' AS y")
    return series.balanced_sample(rows, ["plate_well"], "y", "ID", "42")


from . import queries_images, queries_network, queries_selection, queries_space, queries_vectors  # noqa: E402, F401  register their queries too
