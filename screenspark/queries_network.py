"""Registered queries on gene networks, volcano tests and retrieval, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.vectors import norm, r6
from .operators import curves, network, normalize, prefix, similarity
from .plans import fixtures as fx
from .registry import ks_exact_sql, query

_PAIRS = f"""{fx.CELLS}, {fx.EDGES}, genes AS (SELECT g1 AS g FROM edges UNION SELECT g2 FROM edges),
sc AS (SELECT i, j, sim, coalesce(score, 0) AS score FROM genesim LEFT JOIN edges ON g1 = i AND g2 = j WHERE i IN (FROM genes) AND j IN (FROM genes))"""


def _scored(spark, sf_dir) -> DataFrame:
    guides = normalize.by_guide(normalize.to_long(normalize.scale_vectors(fx.cells(spark, sf_dir))).withColumnRenamed("x", "z"))
    pairs = similarity.cosine_pairs(normalize.to_vectors(normalize.by_gene(guides), ["gene_id"]), "gene_id")
    return network.scored_pairs(pairs, fx.edges(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT i, j, round(sim, 6) + 0.0 AS sim, score, CAST(score > 0.6 AS INTEGER) AS label FROM sc WHERE score > 0.6 OR score = 0")
def network_labels(spark, sf_dir):
    return network.labelled_pairs(_scored(spark, sf_dir), 0.6).withColumn("sim", r6(F.col("sim")))


@query(f"""WITH {_PAIRS}, l AS (SELECT sim, CAST(score > 0.6 AS INTEGER) AS y FROM sc WHERE score > 0.6 OR score = 0)
SELECT round(avg(CASE WHEN p.sim > n.sim THEN 1.0 WHEN p.sim = n.sim THEN 0.5 ELSE 0 END)::DOUBLE, 6) AS auc FROM l p JOIN l n ON p.y = 1 AND n.y = 0""")
def network_auc(spark, sf_dir):
    rows = network.labelled_pairs(_scored(spark, sf_dir), 0.6).select(F.col("label").alias("y"), F.col("sim").alias("score"))
    return curves.roc_auc(rows).withColumn("auc", r6(F.col("auc")))


@query(f"""WITH RECURSIVE {_PAIRS}, b AS (SELECT sim, CASE WHEN score < 0.3 THEN 'low' WHEN score < 0.7 THEN 'mid' ELSE 'high' END AS band FROM sc)
SELECT band, count(*) AS n, round(min(sim), 6) AS q0, round(quantile_cont(sim, 0.25), 6) AS q1, round(median(sim), 6) AS q2, round(quantile_cont(sim, 0.75), 6) AS q3, round(max(sim), 6) AS q4 FROM b GROUP BY band""")
def band_quartiles(spark, sf_dir):
    out = network.band_quartiles(_scored(spark, sf_dir), 0.3, 0.7)
    return out.select("band", "n", *(r6(F.col(f"q{k}")).alias(f"q{k}") for k in range(5)))


def _ks(key: str) -> str:
    return f"""grid AS (SELECT {key}, x, sum(a) AS a, sum(b) AS b FROM smp GROUP BY ALL),
cdf AS (SELECT {key}, abs((sum(a) OVER w)::DOUBLE / sum(a) OVER t - (sum(b) OVER w)::DOUBLE / sum(b) OVER t) AS gap, sum(a) OVER t AS n1, sum(b) OVER t AS n2
        FROM grid WINDOW w AS (PARTITION BY {key} ORDER BY x), t AS (PARTITION BY {key})),
ks AS (SELECT {key}, max(gap) AS ks, CAST(max(n1) AS BIGINT) AS n1, CAST(max(n2) AS BIGINT) AS n2 FROM cdf GROUP BY {key}),
{ks_exact_sql(f"SELECT {key} AS key, ks, n1, n2 FROM ks WHERE n1 > 0 AND n2 > 0")},
pp AS (SELECT ks.*, p FROM ks JOIN exact ON exact.key = ks.{key}),
rk AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r, count(*) OVER () AS n FROM pp),
bh AS (SELECT {key}, ks, n1, n2, least(1.0, min(p * n / r) OVER (ORDER BY p DESC)) AS fdr FROM rk),
ctr AS (SELECT {key}, median(CASE WHEN a = 1 THEN x END) AS med, CASE WHEN avg(CASE WHEN a = 1 THEN x END) > avg(CASE WHEN b = 1 THEN x END) THEN 1 ELSE -1 END AS direction FROM smp GROUP BY {key})"""


def _volcano(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, r6(F.col("ks")).alias("ks"), "n1", "n2", r6(F.col("fdr")).alias("fdr"), r6(F.col("median")).alias("med"), "direction")


@query(f"""WITH RECURSIVE {_PAIRS}, bands AS (SELECT sim AS x, CASE WHEN score < 0.3 THEN 'low' WHEN score < 0.7 THEN 'mid' ELSE 'high' END AS band FROM sc),
smp AS (SELECT test, x, CAST(band = f AS INTEGER) AS a, CAST(band = s AS INTEGER) AS b FROM bands JOIN (VALUES ('high-low', 'high', 'low'), ('mid-low', 'mid', 'low'), ('high-mid', 'high', 'mid')) v(test, f, s) ON band IN (f, s)), {_ks("test")}
SELECT test, round(ks, 6) AS ks, n1, n2, round(p, 6) + 0.0 AS p FROM pp""")
def band_tests(spark, sf_dir):
    return network.band_tests(_scored(spark, sf_dir), 0.3, 0.7).withColumn("ks", r6(F.col("ks"))).withColumn("p", r6(F.col("p")))


@query(f"""WITH RECURSIVE {fx.CELLS}, smp AS (SELECT dim, x, CAST(gene_id = 'G3' AS INTEGER) AS a, CAST(gene_id = 'nontargeting' AS INTEGER) AS b FROM long WHERE gene_id IN ('G3', 'nontargeting')), {_ks("dim")}
SELECT dim, round(ks, 6) AS ks, n1, n2, round(fdr, 6) + 0.0 AS fdr, round(med, 6) + 0.0 AS med, direction FROM bh JOIN ctr USING (dim)""")
def feature_volcano(spark, sf_dir):
    long = normalize.to_long(fx.cells(spark, sf_dir))
    return _volcano(network.volcano(network.feature_samples(long, "G3", "nontargeting"), "dim"), "dim")


@query(f"""WITH RECURSIVE {fx.CELLS}, one AS (SELECT gene_id, x FROM long WHERE dim = 0),
smp AS (SELECT gene_id, x, 1 AS a, 0 AS b FROM one UNION ALL SELECT g.gene_id, x, 0, 1 FROM one, (SELECT DISTINCT gene_id FROM one) g WHERE one.gene_id = 'nontargeting'), {_ks("gene_id")}
SELECT gene_id, round(ks, 6) AS ks, n1, n2, round(fdr, 6) + 0.0 AS fdr, round(med, 6) + 0.0 AS med, direction FROM bh JOIN ctr USING (gene_id)""")
def gene_volcano(spark, sf_dir):
    long = normalize.to_long(fx.cells(spark, sf_dir))
    return _volcano(network.volcano(network.gene_samples(long, 0, "nontargeting"), "gene_id"), "gene_id")


@query("SELECT n_nationkey AS g1, n_regionkey AS g2, n.n_name AS name1, r.n_name AS name2 FROM nation n JOIN (SELECT n_nationkey AS k, n_name FROM nation) r ON r.k = n.n_regionkey")
def named_edges(spark, sf_dir):
    nation = fx.table(spark, sf_dir, "nation")
    edges = nation.select(F.col("n_nationkey").alias("g1"), F.col("n_regionkey").alias("g2"), F.col("n_nationkey").alias("k1"), F.col("n_regionkey").alias("k2"))
    named = network.named_edges(edges, nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))
    return named.select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), F.col("g1").alias("name1"), F.col("g2").alias("name2"))


_AUCS = f"""{fx.SPLITS}, m AS (SELECT gene, model, median(auc) AS auc FROM aucs GROUP BY ALL),
w AS (SELECT gene, max(auc) FILTER (model = 'a') AS a, max(auc) FILTER (model = 'b') AS b FROM m GROUP BY gene)"""


def _models(spark, sf_dir) -> DataFrame:
    return network.wide_by_model(curves.roc_auc(fx.split_scores(spark, sf_dir), ["gene", "split", "model"]), ["a", "b"], 0.5)


@query(f"WITH {_AUCS} SELECT gene, round(a, 6) AS a, round(b, 6) AS b, round(greatest(a, b), 6) AS best, greatest(a, b) > 0.5 AS passes FROM w WHERE a IS NOT NULL")
def auc_by_model(spark, sf_dir):
    out = _models(spark, sf_dir)
    return out.select("gene", *(r6(F.col(c)).alias(c) for c in ("a", "b", "best")), "passes")


@query(f"WITH {_AUCS} SELECT count(*) FILTER (a > 0.5) AS a, count(*) FILTER (b > 0.5) AS b, count(*) AS genes FROM w WHERE a IS NOT NULL")
def genes_passing(spark, sf_dir):
    return _models(spark, sf_dir).agg(F.count_if(F.col("a") > 0.5).alias("a"), F.count_if(F.col("b") > 0.5).alias("b"), F.count("*").alias("genes"))


@query("""WITH s AS (SELECT quality AS y, (doc_id * 7919 % 10007)::DOUBLE AS score FROM labels),
c AS (SELECT score, sum(y) AS p, count(*) AS n FROM s GROUP BY score), r AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS k, sum(p) OVER () AS pos FROM c WINDOW w AS (ORDER BY score DESC))
SELECT round(sum(p::DOUBLE / pos * tp / k), 6) AS ap FROM r""")
def chance_average_precision(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "labels").selectExpr("quality AS y", "CAST(doc_id * 7919 % 10007 AS DOUBLE) AS score")
    return curves.average_precision(rows).withColumn("ap", r6(F.col("ap")))


@query("SELECT round(avg(CAST(((doc_id * 37 % 101) / 101.0::DOUBLE >= 0.5) = (quality = 1) AS INTEGER)), 6) AS accuracy FROM labels")
def accuracy(spark, sf_dir):
    return fx.scored(spark, sf_dir).agg(r6(F.avg(((F.col("score") >= 0.5) == (F.col("y") == 1)).cast("int"))).alias("accuracy"))


_RANKED = """rk AS (SELECT lang AS query, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS rank, CASE WHEN doc_id % 7 = 0 THEN 'ok' WHEN doc_id % 5 = 0 THEN 'junk' ELSE 'other' END AS kind FROM documents WHERE lang IS NOT NULL),
jk AS (SELECT *, coalesce(sum(CAST(kind = 'junk' AS INTEGER)) OVER (PARTITION BY query ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS junk FROM rk),
ps AS (SELECT query, rank - junk AS rank FROM jk WHERE kind = 'ok')"""


def _positives(spark, sf_dir) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents").filter("lang is not null").select(F.col("lang").alias("query"), "n_chars", "doc_id")
    ranked = prefix.row_numbers(docs, ["query"], [("n_chars", True), ("doc_id", False)], "place")
    rows = ranked.select("query", (F.col("place") - 1).alias("rank"), F.expr("CASE WHEN doc_id % 7 = 0 THEN 'ok' WHEN doc_id % 5 = 0 THEN 'junk' ELSE 'other' END").alias("kind"))
    return curves.without_junk(rows)


@query(f"""WITH {_RANKED}, n AS (SELECT query, rank, row_number() OVER (PARTITION BY query ORDER BY rank) - 1 AS j, count(*) OVER (PARTITION BY query) AS n FROM ps)
SELECT query, round(sum((CASE WHEN rank = 0 THEN 1.0 ELSE j::DOUBLE / rank END + (j + 1)::DOUBLE / (rank + 1)) / (2.0 * n)), 6) AS ap FROM n GROUP BY query""")
def retrieval_ap(spark, sf_dir):
    return curves.retrieval_ap(_positives(spark, sf_dir)).withColumn("ap", r6(F.col("ap")))


@query(f"WITH {_RANKED}, k AS (SELECT query, least(max(rank) + 1, 10) AS kq FROM ps GROUP BY query) SELECT query, round(count(*) FILTER (rank + 1 <= kq)::DOUBLE / max(kq), 6) AS precision FROM ps JOIN k USING (query) GROUP BY query")
def precision_at_10(spark, sf_dir):
    return curves.precision_at(_positives(spark, sf_dir), 10).withColumn("precision", r6(F.col("precision")))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE + x::DOUBLE * 0.5 + 1) / 2) AS m FROM embeddings),
u AS (SELECT vec_id, sqrt(list_sum(list_transform(m, lambda x: x * x))) AS n, m FROM v) SELECT vec_id, CAST(unnest(range(len(m))) AS INTEGER) AS dim, round(unnest(m) / n, 6) + 0.0 AS x FROM u""")
def multiscale_feature(spark, sf_dir):
    """Mean of the vectors of several scales, then unit length."""
    double = F.transform("embedding", lambda x: x.cast("double"))
    scales = F.zip_with(double, F.transform(double, lambda x: x * 0.5 + 1), lambda a, b: (a + b) / 2)
    rows = fx.table(spark, sf_dir, "embeddings").select("vec_id", scales.alias("m"))
    unit = F.transform("m", lambda x: x / norm(F.col("m")))
    return rows.select("vec_id", F.posexplode(unit).alias("dim", "x")).withColumn("x", r6(F.col("x")))


@query(f"""WITH {_RANKED}, n AS (SELECT query, rank, row_number() OVER (PARTITION BY query ORDER BY rank) - 1 AS j FROM ps),
q AS (SELECT lang AS query, count(*) FILTER (doc_id % 7 = 0) AS relevant FROM documents GROUP BY lang), a AS (SELECT query, sum((CASE WHEN rank = 0 THEN 1.0 ELSE j::DOUBLE / rank END + (j + 1)::DOUBLE / (rank + 1)) / (2.0 * relevant)) AS ap FROM n JOIN q USING (query) GROUP BY query)
SELECT (SELECT count(*) FROM (SELECT DISTINCT lang FROM documents UNION SELECT 'xx')) AS queries, count(ap) AS judged, round(avg(ap), 6) AS mean FROM a""")
def mean_retrieval_ap(spark, sf_dir):
    """Mean average precision over languages, one of which has no positives and is left out of the mean."""
    docs = fx.table(spark, sf_dir, "documents").select(F.col("lang").alias("query"), (F.col("doc_id") % 7 == 0).alias("ok"))
    relevant = docs.groupBy("query").agg(F.count_if("ok").alias("relevant"))
    found = curves.retrieval_ap(_positives(spark, sf_dir).join(relevant, "query"), relevant="relevant")
    queries = docs.select("query").union(spark.createDataFrame([("xx",)], "query string"))
    return curves.mean_over_queries(found, queries, "ap").withColumn("mean", r6(F.col("mean")))


@query("SELECT 'S' || l_suppkey % 40 AS g1, 'S' || l_partkey % 40 AS g2, round(avg(l_discount::DOUBLE), 6) + 0.0 AS score FROM lineitem GROUP BY 1, 2")
def mean_edges(spark, sf_dir):
    """Edges that come several times, averaged per directed pair."""
    edges = fx.table(spark, sf_dir, "lineitem").selectExpr("concat('S', l_suppkey % 40) AS g1", "concat('S', l_partkey % 40) AS g2", "CAST(l_discount AS DOUBLE) AS score")
    return network.mean_edges(edges).withColumn("score", r6(F.col("score")))
