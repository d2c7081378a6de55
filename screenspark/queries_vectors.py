"""Registered queries on whole vectors: covariance, whitening, neighbour graphs and communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.vectors import r6
from .operators import graph, probe, whitening
from .plans import fixtures as fx
from .plans.lineage import cut, shared_folder
from .registry import query
from .sources import images


@query(f"WITH {fx.CELLS} SELECT a.dim AS i, b.dim AS j, round(covar_samp(a.x, b.x), 6) + 0.0 AS cov FROM long a JOIN long b ON a.ID = b.ID GROUP BY a.dim, b.dim")
def feature_covariance(spark, sf_dir):
    return whitening.covariance_table(fx.cells(spark, sf_dir)).withColumn("cov", r6(F.col("cov")))


@query(f"WITH {fx.CELLS}, d AS (SELECT DISTINCT dim FROM long) SELECT a.dim AS i, b.dim AS j, (a.dim = b.dim)::INTEGER::DOUBLE AS cov FROM d a, d b")
def pca_whiten(spark, sf_dir):
    """The covariance of whitened cells: every component has variance 1 and none moves with another."""
    return whitening.covariance_table(whitening.whiten(fx.cells(spark, sf_dir))).withColumn("cov", F.round("cov", 6) + 0.0)


@query(f"""WITH {fx.CELLS}, c AS (SELECT a.dim AS i, b.dim AS j, covar_samp(a.x, b.x) AS cov FROM long a JOIN long b ON a.ID = b.ID GROUP BY a.dim, b.dim)
SELECT count(*) FILTER (i = j) AS components, round(sum(cov) FILTER (i = j), 6) AS total, round(sum(cov * cov), 6) AS squares FROM c""")
def pca_variances(spark, sf_dir):
    """Variances of the components: their number, sum and sum of squares are the covariance matrix's size, trace and squared norm."""
    fitted = whitening.fit_projection(fx.cells(spark, sf_dir), power=0.0)
    return fitted.agg(F.count("*").alias("components"), F.round(F.sum("variance"), 6).alias("total"), F.round(F.sum(F.col("variance") ** 2), 6).alias("squares"))


@query()
def partial_whitening(spark, sf_dir):
    """A projection fitted on control cells, floored at 1e-5 of the largest variance, applied to all cells."""
    cells = fx.cells(spark, sf_dir)
    control = cells.filter("gene_id IN ('nontargeting', 'intergenic')")
    fitted = whitening.fit_projection(control, dim=32, power=0.5, floor=1e-5, centre=False)
    return cells.select("ID", whitening.project(F.col("features"), fitted).alias("features"))


_KNN = """pairs AS (SELECT a.vec_id AS id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
knn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rank FROM pairs QUALIFY rank <= 10)"""


def _knn(spark, sf_dir):
    return graph.knn_graph(fx.table(spark, sf_dir, "embeddings"), 10, "vec_id", "embedding")


@query(f"WITH {_KNN} SELECT id, other, CAST(rank AS INTEGER) AS rank, round(sim, 6) + 0.0 AS sim FROM knn")
def knn_graph(spark, sf_dir):
    return _knn(spark, sf_dir).withColumn("sim", r6(F.col("sim")))


@query()
def neighbour_communities(spark, sf_dir):
    """Communities of the graph of ten nearest neighbours, of at most 100 vectors each."""
    return graph.communities(_knn(spark, sf_dir).select(F.col("id").alias("a"), F.col("other").alias("b")), 1.0, 100)


def _probed(spark, sf_dir):
    cells = cut(fx.cells(spark, sf_dir).select("ID", "gene_id", "plate_well", "features"))
    return cells, cut(probe.fit_probes(cells, "intergenic"))


@query()
def linear_probes(spark, sf_dir):
    """Chosen penalty and accuracy of each fold mean, per gene and held-out well."""
    _, probes = _probed(spark, sf_dir)
    return probes.select("gene", "split", "n", "penalty", "scores", "intercept")


@query()
def probe_metrics(spark, sf_dir):
    cells, probes = _probed(spark, sf_dir)
    return probe.probe_metrics(cut(probe.score_held_out(cells, probes, "intergenic")))


@query(f"WITH {fx.CELLS} SELECT ID, gene_id, plate_well, {', '.join(f'features[{k + 1}] AS \"{k}\"' for k in range(64))} FROM cells WHERE plate_well = 'P1_W0'")
def features_written(spark, sf_dir):
    """One well of the features read back from the Parquet table that all wells were written to, one of them twice."""
    wide = images.wide_features(fx.cells(spark, sf_dir).select("ID", "gene_id", "plate_well", "features"), 64)
    path = shared_folder(spark)
    images.write_features(wide, path)
    images.write_features(wide.filter("plate_well = 'P1_W0'"), path)
    return spark.read.parquet(path).filter("plate_well = 'P1_W0'")
