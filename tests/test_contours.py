"""Contours as data, and lines turned across in tiles."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewave.operators import geometry, lines
from linewave.sources import images


def inside(points, x, y):
    """Even-odd rule: edges whose ends lie on unlike sides of the row, crossed to the right of x."""
    n = 0
    for (xa, ya), (xb, yb) in zip(points, points[1:] + points[:1]):
        if (ya > y) != (yb > y):
            n += x < (xb - xa) * (y - ya) / (yb - ya) + xa
    return n % 2 == 1


def picture(spark, h, w, ids=(1,)):
    return spark.createDataFrame([(i, y, *[[float(1 + 100 * c + x) for x in range(w)] for c in range(3)]) for i in ids for y in range(h)], images.ROWS)


def star(n, seed):
    rnd = np.random.RandomState(seed)
    turn, far = 2 * np.pi * np.arange(n) / n, rnd.uniform(3, 14, n)
    return list(zip((12 + far * np.cos(turn)).tolist(), (10 + far * np.sin(turn)).tolist()))


SHAPES = {
    1: [(2.0, 2.0), (18.0, 6.0), (6.0, 15.0)],
    2: star(500, 1),
    3: [(3.0, 3.0), (9.0, 3.0), (9.0, 9.0), (3.0, 9.0)],  # corners on pixel centres, level edges
    4: [(0.0, 0.0), (20.0, 18.0), (20.0, 0.0), (0.0, 18.0)],  # crosses itself
    5: [(-9.0, -7.0), (60.0, 5.5), (4.0, 99.0)],  # beyond the image
}


@pytest.fixture(scope="module")
def shapes(spark):
    vertices = spark.createDataFrame([(c, i, float(x), float(y)) for c, ps in SHAPES.items() for i, (x, y) in enumerate(ps)] + [(1, 99, None, 1.0)], "contour_id long, place long, x double, y double")
    contours = spark.createDataFrame([(c, 1 + c % 2) for c in SHAPES] + [(8, 1), (3, 77)], "contour_id long, image_id long")
    return picture(spark, 20, 24, (1, 2)), contours, vertices


def test_masks_follow_the_even_odd_rule(shapes):
    got = {(r.contour_id, r.y): r.g for r in geometry.contoured(*shapes).collect()}
    want = {(c, y): [float(101 + x) if inside(ps, x, y) else 255.0 for x in range(24)] for c, ps in SHAPES.items() for y in range(20)}
    assert got == want


def test_crops_are_cut_to_the_box(shapes):
    got = {(r.contour_id, r.y): r.r for r in geometry.contoured(*shapes, outside=0.0, crop=True).collect()}
    want = {}
    for c, ps in SHAPES.items():
        xs, ys = zip(*ps)
        a, b, d, e = max(0, round(min(xs))), max(0, round(min(ys))), round(max(xs)), round(max(ys))
        want |= {(c, y - b): [float(1 + x) if inside(ps, x, y) else 0.0 for x in range(a, min(d, 24))] for y in range(b, min(e, 20))}
    assert got == want


def test_literal_polygons_are_contours_too(spark):
    for crop, outside in ((False, 255.0), (True, 0.0)):
        own = picture(spark, 20, 24)
        got = geometry.crop_polygon(own, SHAPES[2]) if crop else geometry.mask_polygon(own, SHAPES[2])
        data = spark.createDataFrame([(2, i, float(x), float(y)) for i, (x, y) in enumerate(SHAPES[2])], "contour_id long, place long, x double, y double")
        want = geometry.contoured(own, spark.createDataFrame([(2, 1)], "contour_id long, image_id long"), data, outside, crop).drop("contour_id")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_few_vertices_are_an_error(spark):
    two = spark.createDataFrame([(1, 0, 1.0, 1.0), (1, 1, 5.0, 5.0)], "contour_id long, place long, x double, y double")
    with pytest.raises(Exception, match="three points"):
        geometry.contour_edges(two).collect()
    assert geometry.scanlines(geometry.contour_edges(two.limit(0))).count() == 0


def test_thousands_of_vertices_cost_little_more(spark):
    own = picture(spark, 20, 24)

    def took(points):
        geometry.mask_polygon(own, points).collect()
        began = time.perf_counter()
        got = geometry.mask_polygon(own, points).collect()
        return time.perf_counter() - began, got

    few, _ = took(star(5, 1))
    many, got = took(star(5000, 3))
    assert many < 5 * few + 3
    points = star(5000, 3)
    assert all(r.r[x] == (float(1 + x) if inside(points, x, r.y) else 255.0) for r in got if r.y in (4, 9) for x in range(24))


@pytest.mark.parametrize("h, w, tile", [(5, 7, 128), (9, 4, 3), (6, 6, 3), (7, 10, 1), (1, 5, 2)])
def test_tiles_turn_lines_across(spark, h, w, tile):
    values = np.random.RandomState(h * w).randint(0, 99, (h, w)).astype(float)
    df = spark.createDataFrame([("a", y, row.tolist()) for y, row in enumerate(values)] + [("b", 0, [1.0]), ("c", 0, None), ("d", 0, [])], "k string, line int, v array<double>")
    got = {(r.k, r.line): r.v for r in lines.transposed(df, ["k"], tile=tile).collect()}
    assert got == {("a", x): values[:, x].tolist() for x in range(w)} | {("b", 0): [1.0]}


def test_lines_of_unlike_lengths_are_turned(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [4.0]), (2, [5.0, 6.0])], "line int, v array<double>").withColumn("k", F.lit(1))
    assert {r.line: r.v for r in lines.transposed(df, ["k"], tile=2).collect()} == {0: [1.0, 4.0, 5.0], 1: [2.0, 6.0], 2: [3.0]}


def test_images_of_vectors_have_a_bounded_height(spark, tmp_path):
    rows = [(i, [0.0] * 64, 3 if i % 10 else 4) for i in range(3000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    heights = images.embedding_rows(spark, str(tmp_path), slot=100).groupBy("image_id").agg(F.count("*").alias("n"), F.max("y").alias("y"), F.countDistinct("y").alias("d")).collect()
    assert all(images.HEIGHT <= r.n < 2 * images.HEIGHT and r.y == r.n - 1 and r.d == r.n for r in heights)
    assert sum(r.n for r in heights) == 3000 and {r.image_id % 10 for r in heights} == {3, 4}
