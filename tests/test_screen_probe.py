"""Probes: optimality of the fit, the choice of penalties, balanced rows, and metrics against DuckDB."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from screenspark.operators import prefix, probe, series


def cells(spark, n=90, d=4):
    draw = np.random.default_rng(5)
    rows = []
    for i in range(n):
        gene = ["intergenic", "A", "B"][i % 3]
        well = f"W{i // 3 % 3}"
        if gene == "B" and well == "W2":
            continue
        x = draw.normal(size=d) + (1.5 if gene == "A" else 0)
        rows.append((f"c{i}", gene, well, x.tolist()))
    return spark.createDataFrame(rows, "ID string, gene_id string, plate_well string, features array<double>").repartition(5)


def test_the_fit_meets_the_optimality_conditions():
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=(80, 6)), (draw.random(80) < 0.5).astype(int)
    x[:, 0] += y
    for c in (1e-2, 1.0, 100.0):
        w, b = probe.fit_elastic_net(x, y, c, steps=50_000, tolerance=1e-10)
        p = 1 / (1 + np.exp(-(x @ w + b)))
        slope = c * x.T @ (p - y) + 0.5 * w
        assert abs((p - y).sum()) < 1e-5 * max(1, 1 / c)
        assert np.all(np.where(w == 0, np.abs(slope) <= 0.5 + 1e-5, np.abs(slope + 0.5 * np.sign(w)) < 1e-4 * max(1, c)))


def test_the_best_penalty_has_the_best_folds():
    draw = np.random.default_rng(2)
    y = np.repeat([0, 1], 20)
    x = draw.normal(size=(40, 3)) + y[:, None]
    x[:, 2] = 7.0
    found = probe.fit_probe(x, y)
    assert found["penalty"] == probe.PENALTIES[int(np.argmax(found["scores"]))] and found["weights"][2] == 0
    fold = probe.folds_of(y, 5)
    assert all((np.bincount(y[fold == f]) == 4).all() for f in range(5))


def test_training_rows_are_balanced_and_leave_the_well_out(spark):
    df = cells(spark)
    rows = probe.training_rows(df, "intergenic").join(df.select("ID", "gene_id", "plate_well"), "ID").collect()
    pairs = {(r.gene, r.split) for r in rows}
    assert pairs == {("A", "W0"), ("A", "W1"), ("A", "W2"), ("B", "W0"), ("B", "W1")}
    for gene, split in pairs:
        own = [r for r in rows if (r.gene, r.split) == (gene, split)]
        assert all(r.plate_well != split and r.gene_id == (gene if r.y else "intergenic") for r in own)
        assert sum(r.y for r in own) * 2 == len(own) > 0 and len({r.ID for r in own}) == len(own)


def test_metrics_equal_sql_over_the_probabilities(spark):
    df = cells(spark)
    probes = probe.fit_probes(df, "intergenic")
    scores = probe.score_held_out(df, probes, "intergenic")
    rows = scores.toPandas()
    assert len(rows) == len(rows.drop_duplicates(["gene", "split", "ID"]))
    found = probe.probe_metrics(spark.createDataFrame(rows)).toPandas()
    con = duckdb.connect()
    con.register("s", rows)
    want = con.execute("""WITH p AS (SELECT a.gene, a.split, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc
        FROM s a JOIN s b ON a.gene = b.gene AND a.split = b.split AND a.y AND NOT b.y GROUP BY ALL)
        SELECT gene, split, auc, avg(((score > 0.5) = y)::INT) AS accuracy, count(*) AS rows FROM s JOIN p USING (gene, split) GROUP BY ALL""").fetchdf()
    both = found[found.kind == "all"].merge(want, on=["gene", "split"], suffixes=("", "_w"))
    assert len(both) == len(want) == 5
    for c in ("auc", "accuracy", "rows"):
        assert np.allclose(both[c].astype(float), both[c + "_w"].astype(float))
    assert (found[(found.gene == "A") & (found.kind == "all")].auc > 0.8).all()
    sampled = found[found.kind == "sampled"]
    assert (sampled.rows % 2 == 0).all()


def test_a_key_of_one_class_keeps_no_rows(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("b", 3, True), ("b", 4, False), ("b", 5, False)], "k string, i int, y boolean")
    kept = series.balanced_sample(rows, ["k"], "y", "i", "s").collect()
    assert len(kept) == 2 and {r.k for r in kept} == {"b"} and {r.y for r in kept} == {True, False}


def test_running_values_across_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    draw = np.random.default_rng(3)
    rows = [(["a", "b", None][k % 3], i, float(draw.integers(0, 50)) if draw.random() < 0.95 else None) for k, i in enumerate(draw.permutation(300).tolist())]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    try:
        out = prefix.running(df, ["k"], [("t", True)], {"s": ("sum", "v"), "low": ("min", "v")}, {"all": ("sum", "v")}, {"nxt": "t"})
        assert "SinglePartition" not in out._jdf.queryExecution().toString()
        found = {(r.k, r.t): r for r in out.collect()}
        near = {(r.k, r.t): r.near for r in prefix.last_values(df.dropna(subset=["v"]), ["k"], [("t", False)], "v", 6, "near").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == 300
    for k in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: -r[1])
        seen: list[float] = []
        for j, (_, t, v) in enumerate(own):
            seen += [v] if v is not None else []
            r = found[k, t]
            assert (r.s, r.low, r.nxt) == (sum(seen) if seen else None, min(seen, default=None), own[j + 1][1] if j + 1 < len(own) else None)
        values = [(t, v) for _, t, v in reversed(own) if v is not None]
        for j, (t, _) in enumerate(values):
            assert near[k, t] == [v for _, v in values[max(0, j - 5) : j + 1]]
