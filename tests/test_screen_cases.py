"""Hand-written cases that the driver's tables do not hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenspark.operators import barcodes, curves, geometry, hypothesis, keys, network, normalize, pixels, selection, series, similarity, spatial
from screenspark.sources import files
from screenspark.streaming import windows


def test_cosine_of_a_zero_vector_is_zero(spark):
    rows = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 2.0]), ("c", [2.0, 4.0])], "g string, features array<double>")
    got = {(r.i, r.j): round(r.sim, 9) for r in similarity.cosine_pairs(rows, "g").collect()}
    assert got == {("a", "b"): 0.0, ("a", "c"): 0.0, ("b", "c"): 1.0}


def test_every_pair_of_blocks_is_formed_once(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(23, 3))
    rows = spark.createDataFrame([(f"g{i:02d}", v) for i, v in enumerate(x.tolist())] + [("h", [1.0, None, 2.0])], "g string, features array<double>")
    found = similarity.cosine_pairs(rows, "g", block=4).collect()
    got = {(r.i, r.j): r.sim for r in found}
    assert len(found) == len(got) == 24 * 23 // 2 and all(i < j for i, j in got)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for (i, j), sim in got.items():
        assert sim is None if j == "h" else abs(sim - u[int(i[1:])] @ u[int(j[1:])]) < 1e-12


def test_single_guide_has_no_score(spark):
    rows = spark.createDataFrame([("g", "b1", [1.0, 0.0]), ("h", "b2", [1.0, 0.0]), ("h", "b3", [0.0, 1.0])], "gene_id string, barcode string, features array<double>")
    assert {r.barcode: r.score for r in similarity.guide_consistency(rows).collect()} == {"b1": None, "b2": 0.0, "b3": 0.0}


def test_spread_of_zero_gives_null(spark):
    rows = spark.createDataFrame([("w", "nontargeting", "b", f"i{k}", [1.0]) for k in range(3)] + [("w", "g", "c", "j", [2.0])], "plate_well string, gene_id string, barcode string, ID string, features array<double>")
    assert [r.z for r in normalize.robust_center_scale(normalize.to_long(rows)).collect()] == [None] * 4


def test_tied_scores_make_half_an_area(spark):
    rows = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5)], "y int, score double")
    assert curves.roc_auc(rows).first().auc == 0.5
    assert curves.roc_auc(rows.filter("y = 1")).first().auc is None


def test_average_precision_is_the_step_sum(spark):
    rows = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, score double")
    assert curves.average_precision(rows).first().ap == pytest.approx(0.8333333)


def test_ks_and_fdr_equal_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, 40), rng.integers(2, 12, 25)
    rows = spark.createDataFrame([("k", float(v), True) for v in a] + [("k", float(v), False) for v in b], "k string, x double, is_first boolean")
    grid = np.union1d(a, b)
    want = max(abs((a <= v).mean() - (b <= v).mean()) for v in grid)
    assert hypothesis.ks_statistic(rows, ["k"]).first().ks == pytest.approx(want)
    p = [0.01, 0.02, 0.02, 0.5, 0.9]
    got = [r.fdr for r in hypothesis.bh_fdr(spark.createDataFrame([(v,) for v in p], "p double")).orderBy("p").collect()]
    n = len(p)
    assert got == pytest.approx([min(min(p[j] * n / (j + 1) for j in range(i, n)), 1) for i in range(n)])


def test_too_few_rows_for_the_label_cut(spark):
    assert hypothesis.above_kth(spark.createDataFrame([(1.0,), (2.0,)], "v double"), "v", 5).count() == 0


def test_point_in_no_one_and_two_fields(spark):
    fov = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 10.0), (1, 8.0, 0.0, 18.0, 10.0)], "field_id int, x0 double, y0 double, x1 double, y1 double")
    pts = spark.createDataFrame([(0, 5.0, 5.0), (1, 9.0, 5.0), (2, 30.0, 5.0), (3, 0.2, 5.0)], "pid int, px double, py double")
    assert {r.pid: r.field_id for r in spatial.point_in_field(pts, fov, 0.5).collect()} == {0: 0, 1: None, 2: None, 3: 0}


def test_missing_cycle_is_skipped_and_missing_spot_is_n(spark):
    rows = [(1, 1, 1, 0.0, 0.0, "C"), (1, 3, 2, 1.0, 0.0, "A"), (2, 1, 3, 0.0, 0.0, "T"), (2, 2, 4, 50.0, 0.0, "G")]
    spots = spark.createDataFrame(rows, "field_id long, cycle int, id long, x double, y double, base string")
    assert {r.field_id: r.barcode for r in barcodes.stitch(spots).collect()} == {1: "CA", 2: "TN"}


def test_crops_cover_the_view_once_cut(spark):
    fov = spark.createDataFrame([(0, 0.0, 0.0), (1, 90.0, 0.0), (2, 500.0, 0.0)], "field_id int, x0 double, y0 double")
    got = {r.field_id: tuple(r)[1:] for r in geometry.mosaic_crops(fov.withColumn("w", F.lit(0)), spark.createDataFrame([(0, 10.0, 10.0, 120, 80)], "w int, vx double, vy double, vw int, vh int"), (100, 100), 1.0, ["w"]).drop("w").collect()}
    assert got == {0: (0, 90, 0, 80, 10, 10), 1: (80, 120, 0, 80, 0, 10)}


def test_flat_channels_share_one_top(spark):
    rows = [(0, 0, 0, x, 7.0) for x in range(4)] + [(0, 1, 0, x, 0.0) for x in range(4)] + [(0, 2, 0, x, float(x)) for x in range(4)]
    px = spark.createDataFrame(rows, "img int, ch int, y int, x int, v double")
    got = pixels.rescale(px, 0, 100).groupBy("ch").agg(F.max("v").alias("v"))
    assert {r.ch: r.v for r in got.collect()} == {0: 1.0, 1: 0.0, 2: 1.0}


def test_first_of_equally_bright_channels_wins(spark):
    levels = spark.createDataFrame([(0, 1, 2, 5.0), (0, 1, 1, 5.0), (0, 1, 0, 1.0)], "img int, id int, ch int, v double")
    assert pixels.brightest_base(levels).first().base == "A"


def test_unknown_name_raises_and_missing_edge_is_zero(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "a", 0.9), ("c", "a", 0.4)], "g1 string, g2 string, score double")
    pairs = spark.createDataFrame([("a", "b", 0.1), ("b", "c", 0.2), ("a", "z", 0.3), ("a", "c", 0.4)], "i string, j string, sim double")
    scored = network.scored_pairs(pairs, edges)
    assert {(r.i, r.j): r.label for r in network.labelled_pairs(scored, 0.5).collect()} == {("a", "b"): 1, ("b", "c"): 0, ("a", "c"): 0}
    with pytest.raises(Exception, match="no name for c"):
        network.named_edges(edges, spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")).collect()


def test_an_empty_band_is_left_out(spark):
    scored = spark.createDataFrame([("a", "b", 0.1, 0.0), ("a", "c", 0.3, 0.5)], "i string, j string, sim double, score double")
    assert [r.test for r in network.band_tests(scored, 0.05, 0.95).collect()] == ["mid-low"]


def test_files(spark, tmp_path):
    (tmp_path / "links.txt").write_text("protein1 protein2 combined_score\na b 900\nb a 900\n")
    (tmp_path / "info.txt").write_text("#string_protein_id\tpreferred_name\tsize\na\tA\t1\nb\tB\t2\n")
    named = network.named_edges(files.read_links(spark, str(tmp_path / "links.txt")), files.read_names(spark, str(tmp_path / "info.txt")))
    assert sorted(tuple(r) for r in named.select("g1", "g2", "score").collect()) == [("A", "B", 0.9), ("B", "A", 0.9)]
    image = np.arange(24, dtype="uint16").reshape(2, 3, 4)
    np.save(tmp_path / "i.npy", image)
    assert {(r.ch, r.y, r.x): r.v for r in files.read_npy(spark, str(tmp_path)).collect()} == {k: float(v) for k, v in np.ndenumerate(image)}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windows.counts(stream, "ts", "event_type", "1 hour", "1 day").writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = windows.counts(events, "ts", "event_type", "1 hour", "1 day")
    pick = lambda df: sorted((r.event_type, r.start, r.n, r.top) for r in df.collect())
    assert pick(spark.table("hourly")) == pick(batch)


def test_ks_p_is_exact_for_small_samples(spark):
    from itertools import combinations
    from math import comb

    def counted(ks, m, n):
        hits = 0
        for firsts in combinations(range(m + n), m):
            i = gap = 0
            for k in range(m + n):
                i += k in firsts
                gap = max(gap, abs(i * n - (k + 1 - i) * m))
            hits += gap >= round(ks * m * n)
        return hits / comb(m + n, m)

    cases = [(0.5, 4, 6), (1.0, 3, 5), (0.4, 5, 5), (0.25, 4, 8), (0.0, 3, 3)]
    rows = spark.createDataFrame([*cases, (0.02, 20000, 9000), (None, 0, 5)], "ks double, n1 long, n2 long")
    both = rows.select("ks", "n1", "n2", hypothesis.ks_p_auto(F.col("ks"), F.col("n1"), F.col("n2")).alias("p"), hypothesis.ks_p_value(F.col("ks"), F.col("n1"), F.col("n2")).alias("series"))
    got = {(r.ks, r.n1, r.n2): (r.p, r.series) for r in both.collect()}
    for case in cases:
        assert got[case][0] == pytest.approx(counted(*case), rel=1e-12)
    assert got[0.02, 20000, 9000][0] == got[0.02, 20000, 9000][1]
    assert got[None, 0, 5][0] is None


def test_composite_uid_joins_four_parts(spark):
    rows = spark.createDataFrame([("A01", "t2", 3, 4), ("A01", None, 3, 4)], "well string, tile string, cycle_id int, tile_id int")
    got = rows.select(keys.tile_uid(F.col("well"), F.col("tile"), F.col("cycle_id"), F.col("tile_id")).alias("uid"))
    assert {r.uid for r in got.collect()} == {"A01-t2-3-4", None}


def test_shared_library_prefix_multiplies_rows(spark):
    library = spark.createDataFrame([("CATGT", "g1"), ("CATGA", "g2"), ("TTTTT", "g3")], "sgRNA string, gene_id string")
    found = spark.createDataFrame([(1, "CATG"), (2, "CANG"), (3, "GGGG"), (4, "TTTT")], "id int, barcode string")
    got = sorted((r.id, r.gene_id) for r in barcodes.valid_barcodes(found, library, 4).collect())
    assert got == [(1, "g1"), (1, "g2"), (4, "g3")]


def test_ema_folds_in_order(spark):
    rows = spark.createDataFrame([("a", 2, 3.0), ("a", 1, 1.0), ("a", 3, 5.0), ("b", 1, 7.0)], "k string, t int, v double")
    assert {r.k: r.ema for r in selection.final_average(rows, "k", ["t"], "v", 0.5).collect()} == {"a": 3.5, "b": 7.0}


def test_union_of_tables_fills_missing_columns(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "a int, b string").write.parquet(f"{tmp_path}/one")
    spark.createDataFrame([(2.5, 2)], "c double, a int").write.parquet(f"{tmp_path}/two")
    got = {(r.a, r.b, r.c) for r in files.read_tables(spark, [f"{tmp_path}/one", f"{tmp_path}/two"]).collect()}
    assert got == {(1, "x", None), (2, None, 2.5)}


def test_scaled_vectors_equal_the_long_form(spark):
    rows = [("a", "nontargeting", "w1", [1.0, 5.0]), ("b", "nontargeting", "w1", [3.0, 5.0]), ("c", "nontargeting", "w1", [8.0, 5.0]), ("d", "G", "w1", [9.0, 1.0]), ("e", "G", "w2", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "ID string, gene_id string, plate_well string, features array<double>")
    for robust, long_form in ((True, normalize.robust_center_scale), (False, normalize.center_scale)):
        mine = normalize.to_long(normalize.scale_vectors(df, robust)).collect()
        other = long_form(normalize.to_long(df)).collect()
        assert sorted(((r.ID, r.dim, r.x) for r in mine), key=str) == sorted(((r.ID, r.dim, r.z) for r in other), key=str)


def test_project_calls_drops_what_has_no_field(spark):
    from screenspark.operators import projection

    fields = spark.createDataFrame([(w, c, 0, 10.0 * c, 0.0, 10.0 * c + 50, 50.0) for w in (1, 2) for c in (1, 2)], "well long, cycle long, field_id long, x0 double, y0 double, x1 double, y1 double")
    motions = spark.createDataFrame([(1, 1, 1.0, 0.0, 0.0, 0.0), (1, 2, 1.0, 0.0, 500.0, 0.0)], "well long, cycle long, a double, b double, tx double, ty double")
    schema = "well long, cycle long, pid long, source_field_id long, x long, y long, base string"
    calls = [(1, 1, 7, 0, 40, 60, "C"), (1, 1, 8, 5, 40, 60, "A"), (1, 2, 9, 0, 40, 60, "T"), (2, 1, 7, 0, 40, 60, "G"), (1, None, 3, 0, 1, 1, "C")]

    def run(rows):
        return [tuple(r) for r in projection.project_calls(spark.createDataFrame(rows, schema), fields, motions, (100, 100), 0.5, 2.5).collect()]

    # an unknown field, a motion off the mosaic, a well without motions and a null cycle go
    assert run(calls) == [(1, 1, 7, 0, 40, 60, 0, 40.0, 60.0, "C")]
    assert run([]) == []


def test_map_barcodes_keeps_wells_apart(spark):
    from screenspark.operators import projection

    fields = spark.createDataFrame([(w, c, 0, 0.0, 0.0, 50.0, 50.0) for w in (1, 2) for c in (1, 2)], "well long, cycle long, field_id long, x0 double, y0 double, x1 double, y1 double")
    motions = spark.createDataFrame([(w, c, 1.0, 0.0, 0.0, 0.0) for w in (1, 2) for c in (1, 2)], "well long, cycle long, a double, b double, tx double, ty double")
    calls = spark.createDataFrame([(1, 1, 1, 0, 40, 60, "C"), (1, 2, 5, 0, 41, 60, "A"), (2, 1, 1, 0, 40, 60, "T"), (2, 2, 5, 0, 60, 60, "A")], "well long, cycle long, pid long, source_field_id long, x long, y long, base string")
    library = spark.createDataFrame([("CAGG", "G1"), ("TNGG", "G2")], "sgRNA string, gene_id string")
    valid, every = projection.map_barcodes(calls, fields, motions, library, (100, 100), 0.5, 2.5, 5.0, 2)
    assert sorted((r.well, r.id, r.barcode) for r in every.collect()) == [(1, 1, "CA"), (2, 1, "TN")]
    assert [(r.well, r.barcode, r.gene_id) for r in valid.collect()] == [(1, "CA", "G1")]
