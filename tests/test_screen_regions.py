"""Regions by tiles against a flood fill, whitening and neighbour graphs against numpy, communities on planted groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenspark.operators import graph, regions, whitening


def flood(pixels):
    """Smallest (y, x) of the 8-connected region of each pixel."""
    left, out = set(pixels), {}
    for start in sorted(pixels):
        if start not in left:
            continue
        todo = [start]
        left.discard(start)
        while todo:
            y, x = todo.pop()
            out[y, x] = (start[0] << 32) + start[1]
            for p in [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]:
                if p in left:
                    left.discard(p)
                    todo.append(p)
    return out


def spiral(side):
    """A path that winds through every tile, one pixel wide."""
    return {(y, x) for y in range(0, side, 2) for x in range(side)} | {(y, (side - 1) if y % 4 == 1 else 0) for y in range(1, side - 1, 2)}


@pytest.mark.parametrize("tile", [1, 3, 8, 512])
def test_regions_do_not_depend_on_tiles(spark, tile):
    draw = random.Random(2)
    images = {0: {(draw.randrange(20), draw.randrange(20)) for _ in range(160)}, 1: spiral(17), 2: {(5, 5)}, 3: {(i, 15 - i) for i in range(16)}}
    rows = [(k, y, x, 1 + (y + x) % 4) for k, px in images.items() for y, x in px]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows + rows[:9], "img long, y long, x long, base int").repartition(5)
    found = {(r.img, r.y, r.x): r.region for r in regions.label_regions(df, ["img"], tile).collect()}
    assert found == {(k, y, x): c for k, px in images.items() for (y, x), c in flood(px).items()}


def test_calls_of_pure_and_mixed_regions(spark):
    rows = [(0, 0, 0, 2), (0, 0, 1, 2), (0, 9, 3, 1), (0, 9, 4, 3), (0, 10, 4, 3), (0, 10, 5, 1)]
    df = spark.createDataFrame(rows, "img long, y long, x long, base int")
    found = {(r.region, r.base): (r.y, r.x, r.n) for r in regions.region_calls(regions.label_regions(df, ["img"], 4), ["img"]).collect()}
    assert found == {(0, 2): (0, 0, 2), ((9 << 32) + 3, 1): (10, 4, 2), ((9 << 32) + 3, 3): (10, 4, 2)}  # halves go to even
    assert regions.label_regions(df.limit(0), ["img"]).collect() == []


def test_marked_pixels_take_the_first_of_equal_channels(spark):
    rows = [(0, 0, 1, 1, 0.7), (0, 2, 1, 1, 0.7), (0, 1, 2, 2, 0.5), (0, 3, 3, 3, 0.9), (0, 3, 3, 3, None)]
    df = spark.createDataFrame(rows, "img long, ch int, y long, x long, p double")
    assert sorted(tuple(r) for r in regions.spot_pixels(df, ["img"]).collect()) == [(0, 1, 1, 1), (0, 3, 3, 4)]


def vectors(spark, x, parts=4):
    return spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "id long, features array<double>").repartition(parts)


def test_whitening_against_numpy(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(300, 6)) @ np.random.default_rng(1).normal(size=(6, 6)) + 1e4
    df = vectors(spark, x)
    n, mean, cov = whitening.covariance(df)
    assert n == 300 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T), atol=1e-8)
    white = np.array([r.features for r in whitening.whiten(df).collect()])
    assert np.allclose(np.cov(white.T), np.eye(6), atol=1e-7) and np.allclose(white.mean(axis=0), 0, atol=1e-6)
    # stored, read and applied to other rows: floor and exponent as stated
    model = whitening.fit_projection(df, dim=3, power=0.25, floor=0.2, centre=False)
    model.write.parquet(f"{tmp_path}/model")
    other = np.random.default_rng(2).normal(size=(7, 6))
    got = {r.id: r.p for r in vectors(spark, other).select("id", whitening.project(F.col("features"), spark.read.parquet(f"{tmp_path}/model")).alias("p")).collect()}
    d, v = np.linalg.eigh(np.cov(x.T))
    d = np.maximum(d, d.max() * 0.2)
    order = np.argsort(-d, kind="stable")[:3]
    want = np.abs(other @ (v[:, order] / d[order] ** 0.25))
    assert np.allclose(np.abs(np.array([got[i] for i in range(7)])), want)


def test_incomplete_rows_project_to_null(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [2.0, 5.0]), (5, [float("nan"), 1.0]), (6, [4.0, 4.0])]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    n, *_ = whitening.covariance(df)
    assert n == 3
    assert {r.id for r in whitening.whiten(df).filter("features is null").collect()} == {2, 3, 5}
    with pytest.raises(ValueError):
        whitening.covariance(df.filter("id = 2"))


@pytest.mark.parametrize("block", [7, 4096])
def test_neighbours_are_exact(spark, block):
    x = np.random.default_rng(3).normal(size=(60, 4))
    x[10] = x[3]
    x[11] = x[3]
    x[50] = 0
    found = graph.knn_graph(vectors(spark, x), 5, block=block).collect()
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    sim = np.round(u @ u.T, 9)
    for i in range(60):
        want = sorted((j for j in range(60) if j != i), key=lambda j: (-sim[i, j], j))[:5]
        assert [r.other for r in sorted((r for r in found if r.id == i), key=lambda r: r.rank)] == want


def test_communities_of_planted_groups(spark):
    draw = random.Random(4)
    edges = [(a, b) for a in range(60) for b in range(a) if draw.random() < (0.7 if a // 15 == b // 15 else 0.02)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(edges + [(b, a) for a, b in edges[:20]], "a long, b long")
    trace: list[float] = []
    found = {r.v: r.c for r in graph.communities(df, trace=trace).collect()}
    assert found == {v: v // 15 * 15 for v in range(60)}
    assert all(a < b for a, b in zip(trace, trace[1:]))
    again = {r.v: r.c for r in graph.communities(df.repartition(11, "b")).collect()}
    assert again == found
    small = graph.communities(df, largest=5).groupBy("c").count().agg(F.max("count")).first()[0]
    assert small <= 5
    assert graph.communities(df.limit(0)).collect() == []
