"""Plans and operators that must not grow beyond their rows: no broadcast of pixels, tiles and blocks of any size with the same results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenspark.operators import barcodes, graph, pixels, spatial
from screenspark.plans import fixtures as fx
from screenspark.queries import QUERIES

SF = "/root/testdata/sf0.001"


def ran(df):
    """The plan that was run, as adaptive execution left it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["spot_intensities", "spot_maxima", "brightest_base", "shift_pixels"])
def test_pixels_are_not_broadcast(spark, name):
    plan = ran(QUERIES[name](spark, SF))
    assert "Broadcast" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("tile", [1, 4, 256])
def test_maxima_around_spots_do_not_depend_on_tiles(spark, tile):
    draw = random.Random(5)
    px = [(i, c, y, x, draw.choice([None, -math.inf, math.nan, 1.0, draw.uniform(-9, 9)])) for i in (0, 1) for c in (0, 2, None) for y in range(9) for x in range(-3, 7) if draw.random() < 0.6]
    px += [*px[:5], (0, 0, None, 1, 99.0), (None, 0, 1, 1, 99.0)]
    spots = [(draw.randrange(3), f"s{k % 40}", draw.randrange(-6, 14), draw.randrange(-8, 12)) for k in range(60)] + [(0, "n", None, 2), (None, "n", 1, 1), (0, None, 3, 3)]
    before, after = 2, 3
    want = {}
    for i, name, y, x in spots:
        for j, c, py, qx, v in px:
            if None not in (i, y, x, j, py) and i == j and y - before <= py < y + after and x - before <= qx < x + after:
                want.setdefault((i, name, c), []).append(v)
    top = lambda vs: None if not (k := [v for v in vs if v is not None]) else math.nan if any(map(math.isnan, k)) else max(k)
    want = {k: str(top(v)) for k, v in want.items()}
    found = pixels.max_around(spark.createDataFrame(spots, "img long, id string, y int, x long").repartition(3), spark.createDataFrame(px, "img long, ch int, y int, x int, v double").repartition(4), before, after, tile).collect()
    assert {(r.img, r.id, r.ch): str(r.v) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("by", [(3, -2), (-1, 0), (0, 2), (2, 2), (0, -3)])
def test_shifted_frames_with_holes(spark, by):
    draw = random.Random(6)
    px = {(i, c, y, x): draw.choice([None, draw.random()]) for i in (0, 1) for c in (0, 1) for y in range(-2, 8) for x in range(9) if draw.random() < 0.7}
    rows = [(*k, v) for k, v in px.items()] + [(0, 0, None, 1, 5.0), (0, None, 1, 1, 5.0)]
    found = pixels.shift(spark.createDataFrame(rows, "img long, ch int, y int, x long, v double").repartition(5), *by).collect()
    want = {(i, c, y, x): px.get((i, c, y - by[0], x - by[1])) or 0.0 for i, c, y, x in px} | {(0, 0, None, 1): 0.0, (0, None, 1, 1): 0.0}
    assert {(r.img, r.ch, r.y, r.x): r.v for r in found} == want and len(found) == len(rows)


@pytest.mark.parametrize("tile,step,least", [(1, 7, 5), (2, 1 << 17, 1), (8, 100, 1 << 16)])
def test_close_pairs_do_not_depend_on_tiles(spark, tile, step, least):
    draw = np.random.default_rng(7)
    at = np.concatenate([draw.uniform(-30, 30, (150, 2)), draw.normal(0, 0.5, (300, 2)), [(k, 2.0 * (k % 3)) for k in range(-6, 8, 2)], [(np.nextafter(2, 0), 9), (4, 9)]]).tolist()
    points = [(k, *p) for k, p in enumerate(at)] + [(3, 0.0, 0.0), (3, 0.1, 0.0), (4, *at[4]), (None, 0.0, 0.0), (900, None, 0.0), (901, float("nan"), 0.0), (902, float("inf"), 0.0)]
    close = lambda p, q: None not in (*p, *q) and p[0] != q[0] and (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= 4
    want = sorted((p[0], q[0]) for p in points for q in points if close(p, q))
    found = spatial.close_pairs(spark.createDataFrame(points, "id long, x double, y double").repartition(4), 2.0, tile, step, least).collect()
    assert sorted(map(tuple, found)) == want
    assert spatial.close_pairs(spark.createDataFrame([], "id long, x double, y double"), 2.0).collect() == []


def test_radius_graph_shuffles_a_point_less_than_twice(spark):
    spread = spatial.in_tiles(fx.points(spark, SF).toDF("id", "x", "y"), 2.0)
    assert spread.count() < 2 * spark.read.parquet(f"{SF}/events.parquet").count()
    assert spread.filter("own").count() == spread.select("id").distinct().count()


@pytest.mark.parametrize("largest", [None, 7])
def test_rounds_in_the_driver_and_in_tasks_give_the_same_communities(spark, largest):
    draw = random.Random(8)
    edges = [(a * 5 - 40, b * 5 - 40) for a in range(70) for b in range(a) if draw.random() < (0.5 if a // 10 == b // 10 else 0.05)]
    df = spark.createDataFrame(edges, "a long, b long")
    (near, one), (far, two) = (({r.v: r.c for r in graph.communities(df, 1.0, largest, trace, here).collect()}, trace) for here, trace in ((1 << 20, []), (0, [])))
    assert near == far and len(one) < 60
    assert one == pytest.approx(two) and all(a < b for a, b in zip(one, one[1:]))
    assert largest is None or max(list(near.values()).count(c) for c in near.values()) <= largest


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("block,step", [(13, 4), (50, 64), (1 << 16, 1 << 11)])
def test_neighbours_do_not_depend_on_blocks(spark, block, step, kind):
    x = np.random.default_rng(9).normal(size=(120, 5)).astype(np.float32)
    x[100:] = x[:20]
    x[40:43] = 0
    x[60, 2], x[61, 1] = np.nan, np.inf  # without a norm, as if 0; near to none
    rows = [(i * 3 - 50, row) for i, row in enumerate(x.tolist())] + [(None, [0.0] * 5), (7777, None)]
    found = graph.knn_graph(spark.createDataFrame(rows, f"id long, features array<{kind}>").repartition(5), 6, block=block, step=step).collect()
    x = x.astype(float)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    good = [i for i in range(120) if i != 61]
    u[61] = 0
    sim = np.round(u @ u.T, 9)
    want = {i * 3 - 50: [j * 3 - 50 for j in sorted((j for j in good if j != i), key=lambda j: (-sim[i, j], j))[:6]] for i in good}
    assert {i: [r.other for r in sorted((r for r in found if r.id == i), key=lambda r: r.rank)] for i in {r.id for r in found}} == want
    assert {r.rank for r in found} == set(range(1, 7)) and len(found) == 6 * len(good)


def test_neighbour_tasks_copy_a_row_a_few_times(spark):
    df = spark.range(30_000).selectExpr("id", "transform(sequence(1, 4), k -> sin(id * k)) AS features")
    found = graph.knn_graph(df, 2)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    tasks = max(graph.TASKS, 2 * spark.sparkContext.defaultParallelism)
    blocks, parts = graph.dealt(30_000, graph.BLOCK, graph.STEP, tasks)
    assert blocks * parts >= tasks and blocks + parts <= 2 * math.isqrt(tasks) + 2
    assert sum(graph.dealt(600_000, graph.BLOCK, graph.STEP, 32)) <= 14  # 586 copies with blocks of 2,048 rows


def test_vectors_of_two_lengths_raise(spark):
    with pytest.raises(Exception, match="one length"):
        graph.knn_graph(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, features array<double>"), 1).collect()


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_guides_of_one_prefix_are_counted_before_the_join(spark, monkeypatch, few):
    monkeypatch.setattr(barcodes, "FEW", few)
    library = spark.createDataFrame([("CATG" + str(k), f"g{k % 2}") for k in range(5000)] + [("TTTTT", "g9"), ("TTTTA", None), (None, "g1")], "sgRNA string, gene_id string")
    found = spark.createDataFrame([(1, "CATG"), (2, "CANG"), (3, "GGGG"), (4, "TTTT"), (5, "CATG"), (6, None)], "id int, barcode string")
    valid = barcodes.valid_barcodes(found, library, 4)
    got = [tuple(r) for r in valid.select("id", "barcode", "gene_id").collect()]
    want = [(i, "CATG", f"g{k % 2}") for i in (1, 5) for k in range(5000)] + [(4, "TTTT", "g9"), (4, "TTTT", None)]
    assert sorted(got, key=str) == sorted(want, key=str) and sorted(valid.columns) == ["barcode", "gene_id", "id"]
    # the join itself has a row per gene of a prefix
    assert "Generate explode(sequence(" in valid._jdf.queryExecution().executedPlan().toString()


def test_many_guides_of_few_prefixes_are_made_in_many_tasks(spark):
    library = spark.range(4000).selectExpr("concat('CAT', id) AS sgRNA", "'g' AS gene_id")
    found = spark.range(400).selectExpr("id", "'CAT' AS barcode")
    made = barcodes.valid_barcodes(found, library, 3).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in made) == 1_600_000 and len(made) > 4 and max(r["count"] for r in made) < 800_000
