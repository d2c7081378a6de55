"""Screen-like tables derived from the driver's tables, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ID, gene_id, barcode, plate_well, features`` from ``embeddings``."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "concat('P', vec_id % 2, '_W', (vec_id div 2) % 2, '_C', vec_id) AS ID",
        "CASE label WHEN 0 THEN 'nontargeting' WHEN 1 THEN 'intergenic' ELSE concat('G', label) END AS gene_id",
        "concat('B', label, '_', (vec_id div 4) % 4) AS barcode",
        "concat('P', vec_id % 2, '_W', (vec_id div 2) % 2) AS plate_well",
        "transform(embedding, x -> CAST(x AS DOUBLE)) AS features",
    )


CELLS = """
cells AS (
  SELECT 'P' || (vec_id % 2) || '_W' || ((vec_id // 2) % 2) || '_C' || vec_id AS ID,
         CASE label WHEN 0 THEN 'nontargeting' WHEN 1 THEN 'intergenic' ELSE 'G' || label END AS gene_id,
         'B' || label || '_' || ((vec_id // 4) % 4) AS barcode,
         'P' || (vec_id % 2) || '_W' || ((vec_id // 2) % 2) AS plate_well,
         embedding::DOUBLE[] AS features
  FROM embeddings),
long AS (
  SELECT ID, gene_id, barcode, plate_well, CAST(unnest(range(len(features))) AS INTEGER) AS dim, unnest(features) AS x FROM cells),
med AS (SELECT plate_well, dim, median(x) AS med, mad(x) AS mad, avg(x) AS mu, stddev_samp(x) AS sd
        FROM long WHERE gene_id = 'nontargeting' GROUP BY plate_well, dim),
robust AS (SELECT long.*, (x - med) / nullif(mad / 0.67449, 0) AS z FROM long LEFT JOIN med USING (plate_well, dim)),
guide AS (SELECT barcode, gene_id, dim, avg(z) AS z FROM robust GROUP BY ALL),
gene AS (SELECT gene_id, dim, median(z) AS z FROM guide GROUP BY ALL),
gnorm AS (SELECT gene_id, sqrt(sum(z * z)) AS n FROM gene GROUP BY gene_id),
genesim AS (
  SELECT a.gene_id AS i, b.gene_id AS j, sum(a.z * b.z) / (max(x.n) * max(y.n)) AS sim
  FROM gene a JOIN gene b ON a.dim = b.dim AND a.gene_id < b.gene_id
  JOIN gnorm x ON x.gene_id = a.gene_id JOIN gnorm y ON y.gene_id = b.gene_id GROUP BY ALL)
"""


def guides_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sgRNA, gene_id`` from ``part``: twenty bases by modular arithmetic."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat_ws('', transform(sequence(0, 19), i -> substring('CATG', CAST((p_partkey * (i + 3) + i * i + p_partkey div 7) % 4 AS INT) + 1, 1))) AS sgRNA",
        "concat('G', p_partkey % 50) AS gene_id",
    )


LIBRARY = """
lib AS (
  SELECT array_to_string(list_transform(range(20), lambda i: substr('CATG', ((p_partkey * (i + 3) + i * i + p_partkey // 7) % 4) + 1, 1)), '') AS sgRNA,
         'G' || (p_partkey % 50) AS gene_id
  FROM part)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``y, score`` with ties, from ``labels``."""
    return table(spark, sf_dir, "labels").selectExpr("doc_id", "quality AS y", "(doc_id * 37 % 101) / 101D AS score")


SCORED = """
scored AS (SELECT doc_id, quality AS y, (doc_id * 37 % 101) / 101.0::DOUBLE AS score FROM labels),
steps AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM scored GROUP BY score),
cum AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM steps WINDOW w AS (ORDER BY score DESC))
"""


def fov(spark: SparkSession, k: int = 3) -> DataFrame:
    """A k x k grid of 100-pixel fields of 0.5 units a pixel with a tenth of overlap; the last is missing."""
    rows = spark.range(k * k).filter(F.col("id") < k * k - 1)
    x, y = F.floor(F.col("id") / k) * 45.0, (F.col("id") % k) * 45.0
    return rows.select(F.col("id").alias("field_id"), x.alias("x0"), y.alias("y0"), (x + 50.0).alias("x1"), (y + 50.0).alias("y1"))


FOV = """
fov AS (SELECT range AS field_id, (range // 3) * 45.0::DOUBLE AS x0, (range % 3) * 45.0::DOUBLE AS y0, (range // 3) * 45.0::DOUBLE + 50 AS x1, (range % 3) * 45.0::DOUBLE + 50 AS y1 FROM range(8)),
pts AS (SELECT event_id AS pid, (event_id * 7919 % 15013) / 100.0::DOUBLE AS px, (event_id * 104729 % 14983) / 100.0::DOUBLE AS py FROM events)
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id AS pid", "(event_id * 7919 % 15013) / 100D AS px", "(event_id * 104729 % 14983) / 100D AS py")


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``field_id, cycle, id, x, y, base``: cycles 1 to 5 of jittered spots."""
    base = table(spark, sf_dir, "events").withColumn("cycle", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return base.selectExpr(
        "event_id % 9 AS field_id", "cycle", "event_id AS id",
        "(event_id * 7919 % 200003) / 20D + CASE WHEN cycle = 1 THEN 0 ELSE (event_id * 31 * cycle % 97) / 14D END AS x",
        "(event_id * 104729 % 199999) / 20D + CASE WHEN cycle = 1 THEN 0 ELSE (event_id * 17 * cycle % 89) / 23D END AS y",
        "substring('CATG', CAST((event_id * cycle + event_id div 3) % 4 AS INT) + 1, 1) AS base",
    )


SPOTS = """
spots AS (
  SELECT event_id % 9 AS field_id, cycle, event_id AS id,
         (event_id * 7919 % 200003) / 20.0::DOUBLE + CASE WHEN cycle = 1 THEN 0 ELSE (event_id * 31 * cycle % 97) / 14.0::DOUBLE END AS x,
         (event_id * 104729 % 199999) / 20.0::DOUBLE + CASE WHEN cycle = 1 THEN 0 ELSE (event_id * 17 * cycle % 89) / 23.0::DOUBLE END AS y,
         substr('CATG', ((event_id * cycle + event_id // 3) % 4) + 1, 1) AS base
  FROM events, (SELECT unnest(range(1, 6)) AS cycle)),
near AS (
  SELECT a.field_id, b.cycle, a.id AS lid, arg_min(b.id, (a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS rid
  FROM spots a JOIN spots b ON a.field_id = b.field_id AND a.cycle = 1 AND b.cycle > 1
   AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < 25 GROUP BY ALL)
"""


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``well, field_id, x0, y0, x1, y1``: the fields of ``fov`` in one well per user, each well with its own corner and spacing."""
    wells = table(spark, sf_dir, "events").select(F.col("user_id").alias("well")).distinct()
    placed = wells.withColumn("field_id", F.explode(F.expr("sequence(0L, 7L)")))
    x, y = F.floor(F.col("field_id") / 3) * (44.0 + F.col("well") % 4) + F.col("well") % 7 * 10, (F.col("field_id") % 3) * (46.0 - F.col("well") % 3 * 0.5) - F.col("well") % 5
    return placed.select("well", "field_id", x.alias("x0"), y.alias("y0"), (x + 50.0).alias("x1"), (y + 50.0).alias("y1"))


FIELDS = """
fields AS (
  SELECT well, field_id, x0, y0, x0 + 50 AS x1, y0 + 50 AS y1
  FROM (SELECT well, field_id, (field_id // 3) * (44.0::DOUBLE + well % 4) + well % 7 * 10 AS x0, (field_id % 3) * (46.0::DOUBLE - well % 3 * 0.5::DOUBLE) - well % 5 AS y0
        FROM (SELECT DISTINCT user_id AS well FROM events), (SELECT unnest(range(8)) AS field_id)))
"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``img, ch, y, x, v``: an image of four 32 x 32 channels per user; channel 3 of image 0 is flat.

    Images are dealt out before they are spread to pixels: as whole rows they are so few that one task would get them all.
    """
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("img"))
    images = users.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "img").distinct()
    at = images.withColumn("k", F.explode(F.expr("sequence(0L, 4095L)"))).selectExpr("img * 4096 + k AS id", "img", "k div 1024 AS ch", "k div 32 % 32 AS y", "k % 32 AS x")
    return at.selectExpr("img", "ch", "y", "x", "CASE WHEN img = 0 AND ch = 3 THEN 5D ELSE (id * 7919 % 10007) / 100D + 0.5D END AS v")


PIXELS = """
px AS (
  SELECT img, ch, y, x, CASE WHEN img = 0 AND ch = 3 THEN 5.0::DOUBLE ELSE (id * 7919 % 10007) / 100.0::DOUBLE + 0.5::DOUBLE END AS v
  FROM (SELECT img * 4096 + k AS id, img, k // 1024 AS ch, k // 32 % 32 AS y, k % 32 AS x
        FROM (SELECT DISTINCT user_id AS img FROM events), (SELECT unnest(range(4096)) AS k)))
"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``g1, g2, score`` between genes of ``cells``, both directions, some missing."""
    labels = table(spark, sf_dir, "embeddings").filter("label >= 2").select("label").distinct()
    both = labels.withColumn("other", F.explode(F.sequence(F.lit(2), F.lit(9)))).filter("label <> other")
    return both.selectExpr("concat('G', label) AS g1", "concat('G', other) AS g2", "(label * 37 + other * 37 + label * other * 11) % 1000 AS s").filter("s > 200").selectExpr("g1", "g2", "s / 1000D AS score")


EDGES = """
edges AS (
  SELECT 'G' || label AS g1, 'G' || other AS g2, s / 1000.0::DOUBLE AS score
  FROM (SELECT label, other, (label * 37 + other * 37 + label * other * 11) % 1000 AS s
        FROM (SELECT DISTINCT label FROM embeddings WHERE label >= 2), (SELECT unnest(range(2, 10)) AS other) WHERE label <> other)
  WHERE s > 200)
"""


def split_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``gene, split, model, y, score``: labels dealt to four genes and three splits, scored by two models."""
    rows = table(spark, sf_dir, "labels").selectExpr("concat('G', doc_id % 4) AS gene", "doc_id % 3 AS split", "quality AS y", "(doc_id * 37 % 101) / 101D AS a", "(doc_id * 53 % 97) / 97D AS b")
    return rows.selectExpr("gene", "split", "y", "stack(2, 'a', a, 'b', b) AS (model, score)")


SPLITS = """
splits AS (
  SELECT 'G' || (doc_id % 4) AS gene, doc_id % 3 AS split, quality AS y, model,
         CASE model WHEN 'a' THEN (doc_id * 37 % 101) / 101.0::DOUBLE ELSE (doc_id * 53 % 97) / 97.0::DOUBLE END AS score
  FROM labels, (VALUES ('a'), ('b')) m(model)),
aucs AS (
  SELECT p.gene, p.split, p.model, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END)::DOUBLE AS auc
  FROM splits p JOIN splits n ON p.gene = n.gene AND p.split = n.split AND p.model = n.model AND p.y = 1 AND n.y = 0 GROUP BY ALL)
"""
